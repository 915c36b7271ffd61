"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import Shipped, arrow_type, blocks, letter_slices, only, remainder, rows_of, sql_type

BUCKETS = 1 << 15
#: Characters hashed together; some twenty numbers for each are held at a time.
TOGETHER = 1 << 20
#: The matrix has a row of BUCKETS numbers for each language and goes to every task, so their number is bounded.
MOST_LANGUAGES = 1000
#: What a text without letters is called.
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities
    prior: np.ndarray


class Grams:
    """Hashed runs of one to three letters, with the end of a word as a letter."""

    def __init__(self, _=None):
        letter = [chr(p).isalpha() for p in range(0x34000)]
        self.letter = np.zeros(0x110000, bool)
        self.letter[: len(letter)] = letter

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, text) of every run in all texts, and the number of letters in each text."""
        folded = [t.lower() + "\n" for t in texts]
        # What lies before the first text is no letter either.
        points = np.frombuffer(("\n" + "".join(folded)).encode("utf-32-le"), np.uint32)
        text_of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + (i == 0) for i, t in enumerate(folded)])
        letter = self.letter[points]
        # One zero for whatever lies between two words or before the first.
        keep = letter | np.append(True, letter[:-1])
        c = np.where(letter, points, 0)[keep].astype(np.uint64)
        text_of, letter = text_of[keep], letter[keep]
        one, two = c * np.uint64(0x9E3779B97F4A7C15), c * np.uint64(0xC2B2AE3D27D4EB4F)
        three = c * np.uint64(0x165667B19E3779F9)
        pair = one[:-1] + two[1:]
        parts = [
            (one[letter], text_of[letter]),
            (pair, text_of[1:]),
            ((pair[:-1] + three[2:])[letter[1:-1]], text_of[1:-1][letter[1:-1]]),
        ]
        code = np.concatenate([p for p, _ in parts])
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        bucket = (code >> np.uint64(64 - 15)).astype(np.int32)
        return bucket, np.concatenate([t for _, t in parts]), np.bincount(text_of[letter], minlength=len(texts))


def fit_languages(
    df: DataFrame,
    lang_col: str = "lang",
    fold: tuple[int, int] = (4, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Count the n-grams of every document with a language outside `fold`.

    Counts are summed in each task, then by Spark; languages x BUCKETS sums reach the driver, no more. A model holds
    MOST_LANGUAGES at most, so that it fits into every task; a column of more is no column of languages and raises
    ValueError. Long texts are counted in parts.
    """
    modulus, held_out = fold
    source = (
        only(df, _id=id_col, _text=text_col, _lang=lang_col)
        .where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (remainder("_id", modulus) != held_out))
        .select(F.col("_lang").cast("string").alias("_lang"), "_text")
    )
    tool = Shipped(df.sparkSession, None)

    def run(batches):
        gc.disable()
        grams = tool.made(Grams)
        counts: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}

        def rows():
            for lang, found in counts.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(at) + 1), pa.string()),
                        pa.array(np.append(at, -1), pa.int32()),
                        pa.array(np.append(found[at], documents[lang]), pa.int64()),
                    ],
                    ["lang", "bucket", "n"],
                )

        for held in blocks(rows_of(batches, "_lang", "_text"), TOGETHER):
            for lang, _ in held:
                documents[lang] = documents.get(lang, 0) + 1
            for parts in blocks(letter_slices(held, TOGETHER), TOGETHER):
                bucket, text_of, _ = grams([t for _, t in parts])
                names = sorted({lang for lang, _ in parts})
                number = {lang: i for i, lang in enumerate(names)}
                lang_of = np.array([number[lang] for lang, _ in parts], np.int64)
                found = np.bincount(lang_of[text_of] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                for i, lang in enumerate(names):
                    counts[lang] = counts.get(lang, 0) + found[i * BUCKETS : (i + 1) * BUCKETS]
            if len(counts) > 128:
                yield from rows()
                counts.clear()
                documents.clear()
        yield from rows()

    summed = (
        source.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).persist()
    try:
        languages = [r.lang for r in summed.where("bucket = -1").select("lang").orderBy("lang").take(MOST_LANGUAGES + 1)]
        if len(languages) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col!r}")
        number = {lang: i for i, lang in enumerate(languages)}
        counts = np.zeros((BUCKETS + 1, len(languages)))
        table = summed.toArrow()
        lang_at = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
        counts[table["bucket"].to_numpy(), lang_at] = table["n"].to_numpy()
    finally:
        summed.unpersist()
    grams, documents = counts[:BUCKETS] + 0.5, counts[BUCKETS]
    weights = np.log(grams / grams.sum(axis=0, keepdims=True)).astype(np.float32)
    return Model(languages, weights, np.log((documents + 1) / (documents.sum() + len(languages))))


def identify(
    df: DataFrame, model: Model, fold: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Language of every whole text: `id_col`, `held_out`, `lang_pred`, `score` (its probability).

    `lang_pred` is "und" and the score 0 for a text that is null or has no letter, and for every text if no
    language was learned. No shuffle. Ids may be null or repeat, each row is scored; an empty table gives no
    rows; other columns are ignored.
    """
    shipped = Shipped(df.sparkSession, model)
    source = only(df, _id=id_col, _text=text_col)
    kind = arrow_type(source, "_id")

    def run(batches):
        gc.disable()
        grams, model = shipped.made(Grams), shipped.broadcast.value
        for held in blocks(((i, t or "") for i, t in rows_of(batches, "_id", "_text")), TOGETHER):
            total = np.zeros((len(held), max(len(model.languages), 1)))
            letters = np.zeros(len(held), np.int64)
            for parts in blocks(letter_slices(((row, t) for row, (_, t) in enumerate(held)), TOGETHER), TOGETHER):
                bucket, text_of, count = grams([t for _, t in parts])
                row = np.array([i for i, _ in parts])
                np.add.at(letters, row, count)
                for k in range(len(model.languages)):
                    total[:, k] += np.bincount(row[text_of], model.weights[bucket, k], len(held))
            if model.languages:
                total += model.prior
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            known = (letters > 0) & bool(model.languages)
            names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in held], kind),
                    pa.array(names, pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                ],
                [id_col, "lang_pred", "score"],
            )

    found = source.mapInArrow(run, f"`{id_col}` {sql_type(source, '_id')}, lang_pred string, score double")
    modulus, held_out = fold
    return found.select(id_col, (remainder(id_col, modulus) == held_out).alias("held_out"), "lang_pred", "score")
