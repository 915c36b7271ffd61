"""Quality scores: boosted trees over statistics of the text."""

from __future__ import annotations

import gc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.boosting import Trees, fit
from vicinal.llm.common import Shipped, arrow_type, only, remainder, rows_of, sql_type
from vicinal.llm.labels import SAMPLE_ROWS, labelled_sample

# Classes of characters: 0 other, 1 lower-case letter, 2 upper-case, 3 other letter, 4 digit, 5 white space,
# 6 the signs of plain prose.
PROSE_SIGNS = ".,;:'\"()-?"


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x30000):
        c = chr(point)
        if c.isalpha():
            table[point] = 1 if c.islower() else 2 if c.isupper() else 3
        elif c.isdigit():
            table[point] = 4
        elif c.isspace():
            table[point] = 5
    for c in PROSE_SIGNS:
        table[ord(c)] = 6
    return table


class Statistics:
    """Numbers that describe a text."""

    names = (
        "log_chars log_words lower upper letters digits spaces prose_signs other_signs repeats ascii word_mean "
        "word_spread distinct_words distinct_words_scaled commonest capitals_only with_signs with_digits one_letter lines_per_word "
        "distinct_lines line_mean line_ends sentences sign_kinds"
    ).split()

    def __init__(self, _=None):
        self.classes = _classes()

    def __call__(self, text: str) -> list[float]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        kind = self.classes[points]
        share = np.bincount(kind, minlength=7) / max(n, 1)
        signs = points[kind == 0]
        words = text.split()
        w = max(len(words), 1)
        lengths = np.array([len(x) for x in words]) if words else np.zeros(1)
        kinds = Counter(words)
        common = max(kinds.values(), default=0)
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        # A word with a sign or digit: its first such place follows a letter or another sign.
        start = np.append(True, kind[:-1] == 5) if n else np.zeros(0, bool)
        word_of = np.cumsum(start & (kind != 5)) if n else np.zeros(0, int)
        flagged = lambda of: len(np.unique(word_of[of])) / w if n else 0.0
        capital = np.bincount(word_of[kind != 5], kind[kind != 5] != 2) if n else np.zeros(1)
        return [
            np.log1p(n),
            np.log1p(len(words)),
            share[1],
            share[2],
            share[1] + share[2] + share[3],
            share[4],
            share[5],
            share[6],
            share[0],
            float((points[1:] == points[:-1]).mean()) if n > 1 else 0.0,
            float((points < 128).mean()) if n else 1.0,
            float(lengths.mean()),
            float(lengths.std()),
            len(kinds) / w,
            len(kinds) / w**0.8,
            common / w,
            float((capital[1:] == 0).sum() / w) if len(capital) > 1 else 0.0,
            flagged(kind == 0),
            flagged(kind == 4),
            float((lengths == 1).mean()),
            len(lines) / w,
            len(set(lines)) / max(len(lines), 1),
            np.log1p(n / max(len(lines), 1)),
            sum(x[-1] in ".!?" for x in lines) / max(len(lines), 1),
            text.count(". ") / w,
            float(len(np.unique(signs))) / max(len(signs), 1) ** 0.5,
        ]


def fit_quality(
    df: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    fold: tuple[int, int] = (5, 0),
    rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Trees:
    """Fit trees on at most `rows` labelled documents outside `fold`; only their statistics reach the driver."""
    sample = labelled_sample(df, labels, label_col, fold, rows, id_col, text_col)
    tool = Shipped(df.sparkSession, None)

    def run(batches):
        statistics = tool.made(Statistics)
        for batch in batches:
            values = [statistics(t or "") for (t,) in rows_of([batch], "_text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.list_(pa.float64())), batch.column("_label")], ["x", "y"]
            )

    found = sample.select("_text", "_label").mapInArrow(run, "x array<double>, y int").collect()
    x = np.array([r.x for r in found]).reshape(len(found), len(Statistics.names))
    y = np.array([r.y for r in found], float)
    order = np.lexsort((*x.T, y))  # the same model whatever order tasks end in
    return fit(x[order], y[order])


def score_quality(
    df: DataFrame,
    model: Trees,
    fold: tuple[int, int] = (5, 0),
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text: `id_col`, `held_out`, `score` (0 to 1), `predicted` (1 from `threshold` on).

    No shuffle. A null text is scored as an empty one; ids may be null or repeat, each row is scored; an
    empty table gives no rows; other columns are ignored.
    """
    shipped = Shipped(df.sparkSession, model)
    source = only(df, _id=id_col, _text=text_col)
    kind = arrow_type(source, "_id")

    def run(batches):
        gc.disable()
        statistics = shipped.made(Statistics)
        trees = shipped.broadcast.value
        for batch in batches:
            values = np.array([statistics(t or "") for (t,) in rows_of([batch], "_text")])
            if len(values):
                scores = trees.score(values)
                yield pa.RecordBatch.from_arrays([batch.column("_id").cast(kind), pa.array(scores)], [id_col, "score"])

    scored = source.mapInArrow(run, f"`{id_col}` {sql_type(source, '_id')}, score double")
    modulus, held_out = fold
    return scored.select(
        id_col,
        (remainder(id_col, modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
