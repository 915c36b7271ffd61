"""Toxicity scores of texts whose disguised words are restored first."""

from __future__ import annotations

import gc
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import BLOCK_CHARS, Shipped, arrow_type, blocks, letter_slices, only, remainder, rows_of, sql_type
from vicinal.llm.deobfuscation import SYMBOLS, WORD, LetterCounts, deobfuscator, may_begin
from vicinal.llm.flat_ids import Chunks, distinct, joined, slices
from vicinal.llm.labels import SAMPLE_ROWS, labelled_sample
from vicinal.session import Scratch

#: Toxic documents that a word or beginning must be in.
LEAST_DOCUMENTS = 4
#: Lengths of the beginnings that count beside whole words.
BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    letter_counts: np.ndarray
    weights: dict[str, float]  # of words ("word ") and beginnings ("wor"), above zero only
    coefficients: np.ndarray  # of Evidence.features, the constant first


def features_of(word: str) -> list[str]:
    return [word + " ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


class Evidence:
    """What speaks for toxicity in a text: its words' weights."""

    def __init__(self, letter_counts: np.ndarray, weights: dict[str, float]):
        self.restore, self.weights = deobfuscator(letter_counts), weights
        # How features begin: other words need no look.
        self.openings = {f[: BEGINNINGS[0]] for f in weights}
        self.wanted = may_begin({opening.rstrip() for opening in self.openings})
        self.chunks = Chunks(self._learn, self._forget)
        self._forget()
        self.begun = {f[:n] for f in weights if f.endswith(" ") for n in range(1, len(f) - 1)}

    def split_words(self, text: str) -> list[str]:
        """Words of the model that the text writes in parts; only whole words, as beginnings join by chance."""
        words, found = WORD.findall(text.lower()), []
        for i in [i for i, w in enumerate(words) if w in self.begun]:
            joint = words[i]
            while joint in self.begun and (i := i + 1) < len(words):
                joint += words[i]
                if joint + " " in self.weights:
                    found.append(joint)
        return found

    def _weight(self, word: str) -> float:
        if (word + " ")[: BEGINNINGS[0]] not in self.openings:
            return 0.0
        get = self.weights.get
        return max([get(f, 0.0) for f in features_of(word)])

    def _hits(self, words: list[str]) -> list[tuple[str, float]]:
        return [(w, v) for w in words if (v := self._weight(w))]

    def _forget(self) -> None:
        self.hits: dict[int, list[tuple[str, float]]] = {}
        self.known = 0

    def _learn(self, chunks: list[bytes]) -> None:
        for number, chunk in enumerate(chunks, self.known):
            if hits := self._hits(self.restore.words(chunk.decode(), self.wanted)):
                self.hits[number] = hits
        self.known += len(chunks)

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: its largest weight, the largest of a word that begins otherwise, and the weights of all its
        different words together against the root of how many words it has, as chance finds more in a long text.

        Repeating a word changes nothing.
        """
        found: list[dict[str, float]] = [{} for _ in texts]
        different = np.zeros(len(texts), np.int64)
        for held in slices(texts):
            number, upto = self.chunks.numbers(*joined([t for _, t in held]))
            # Each different chunk of a text, or of a slice of a long one, once.
            text = np.repeat(np.arange(len(held)), np.diff(np.append(0, upto)))
            text, number = np.divmod(distinct(text * max(self.known, 1) + number)[0], max(self.known, 1))
            rows = np.array([i for i, _ in held])
            different += np.bincount(rows[text], minlength=len(texts))
            some = np.flatnonzero(np.isin(number, list(self.hits)))
            for i, n in zip(rows[text[some]].tolist(), number[some].tolist(), strict=True):
                found[i].update(self.hits[n])
        out = []
        for text, hits, words in zip(texts, found, different.tolist(), strict=True):
            hits.update(self._hits(self.restore.spaced_words(text, self.wanted) + self.split_words(text)))
            # Sorted by weight, the largest of a stem comes last and stays.
            by_weight = sorted(hits.items(), key=lambda hit: hit[1])
            stems = sorted({w[: BEGINNINGS[0]]: v for w, v in by_weight}.values(), reverse=True) + [0.0, 0.0]
            out.append([stems[0], stems[1], sum(hits.values()) / max(words, 1) ** 0.5])
        return np.array(out).reshape(len(texts), 3)


class Scorer:
    def __init__(self, model: Model):
        self.evidence = Evidence(model.letter_counts, model.weights)
        self.coefficients = model.coefficients

    def __call__(self, texts: list[str]) -> np.ndarray:
        x = self.evidence.features(texts)
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -30, 30)))


def count_letters(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigrams of letters over every whole text, summed in tasks and by Spark; SYMBOLS**3 numbers reach the driver."""
    tool = Shipped(df.sparkSession, None)

    def run(batches):
        gc.disable()
        letters = tool.made(LetterCounts)
        total = np.zeros(SYMBOLS**3, np.int64)
        texts = ((0, t) for (t,) in rows_of(batches, "_text") if t)
        for held in blocks(letter_slices(texts, BLOCK_CHARS // 4), BLOCK_CHARS // 4):
            total += letters([t for _, t in held])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    summed = only(df, _text=text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[found["code"].to_numpy()] = found["n"].to_numpy()
    return counts


def _document_counts(sample: DataFrame, shipped: Shipped) -> DataFrame:
    """In how many toxic and other documents of the sample each feature occurs: `feature`, `toxic`, `clean`."""

    def run(batches):
        gc.disable()
        restore = shipped.made(deobfuscator)
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def rows():
            names = list(counts[0] | counts[1])
            columns = [pa.array([held.get(f, 0) for f in names], pa.int64()) for held in (counts[1], counts[0])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["feature", "toxic", "clean"])

        for label, text in rows_of(batches, "_label", "_text"):
            words = set(restore.words(text or "")) | set(restore.spaced_words(text or ""))
            held = counts[label]
            for feature in {f for w in words for f in features_of(w)}:
                held[feature] = held.get(feature, 0) + 1
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield rows()
                counts[0].clear()
                counts[1].clear()
        yield rows()

    found = sample.select("_label", "_text").mapInArrow(run, "feature string, toxic long, clean long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Newton's method; the constant comes first and bears no penalty. More evidence never makes a score smaller:
    what would get a negative coefficient is left out, the most negative first."""
    used = list(range(x.shape[1]))
    while True:
        beta = _newton(x[:, used], y, penalty, rounds)
        if not used or beta[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(1 + u for u in used)]] = beta
            return out
        del used[int(beta[1:].argmin())]


def fit_toxicity(
    df: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    fold: tuple[int, int] = (3, 1),
    rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit the character model on every text, and the word weights on at most `rows` labelled ones outside `fold`.

    One half of the sample gives the words and beginnings and their weights, by how much surer than chance
    they occur in more toxic documents than others; the other half says what weights amount to.
    Without labelled rows of both classes every score is 0.
    """
    spark = df.sparkSession
    letters = count_letters(df, text_col)
    shipped = Shipped(spark, letters)
    drawn = labelled_sample(df, labels, label_col, fold, rows, id_col, text_col)
    # Copies of a text say nothing new.
    sample = Scratch(spark).save(drawn.dropDuplicates(["_text", "_label"]), "labelled")
    size = {(r["_half"], r["_label"]): r["count"] for r in sample.groupBy("_half", "_label").count().collect()}
    toxic, clean = size.get((0, 1), 0), size.get((0, 0), 0)
    nothing = Model(letters, {}, np.array([-30.0, 0, 0, 0]))
    if not toxic or not clean:
        return nothing

    # A low estimate of its share in toxic texts against a high one in others; as many as the sample holds.
    counted = _document_counts(sample.where("_half = 0"), shipped).where(F.col("toxic") >= LEAST_DOCUMENTS)
    low = (F.col("toxic") - F.sqrt("toxic")) / toxic
    high = (F.col("clean") + 2) / (clean + 2)
    surer = counted.where(low > 3 * high).select("feature", F.log(low / high).alias("weight"), "toxic").collect()
    # A beginning stands for other forms of words of the model, which must be most of what begins so.
    whole: Counter[str] = Counter()
    for r in surer:
        if r.feature.endswith(" "):
            whole.update({r.feature[:n]: r.toxic for n in BEGINNINGS if len(r.feature) > n})
    weights = {r.feature: r.weight for r in surer if r.feature.endswith(" ") or 2 * whole[r.feature] >= r.toxic}

    trial = Shipped(spark, Model(letters, weights, np.zeros(4)))

    def run(batches):
        gc.disable()
        evidence = trial.made(evidence_of)
        for held in blocks(((y, t or "") for y, t in rows_of(batches, "_label", "_text")), BLOCK_CHARS):
            x = evidence.features([t for _, t in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), pa.array([y for y, _ in held], pa.int32())], ["x", "y"]
            )

    judged = sample.where("_half = 1").select("_label", "_text").mapInArrow(run, "x array<double>, y int").collect()
    x, y = np.array([r.x for r in judged]).reshape(len(judged), 3), np.array([r.y for r in judged], float)
    if not len(y) or y.min() == y.max():
        return nothing
    order = np.lexsort((*x.T, y))
    return Model(letters, weights, _logistic(x[order], y[order]))


def evidence_of(model: Model) -> Evidence:
    return Evidence(model.letter_counts, model.weights)


def score_toxicity(
    df: DataFrame,
    model: Model,
    fold: tuple[int, int] = (3, 1),
    threshold: float = 0.7,
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
        scorer = shipped.made(Scorer)
        for held in blocks(((i, t or "") for i, t in rows_of(batches, "_id", "_text")), BLOCK_CHARS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in held], kind), pa.array(scorer([t for _, t in held]))], [id_col, "score"]
            )

    scored = source.mapInArrow(run, f"`{id_col}` {sql_type(source, '_id')}, score double")
    modulus, held_out = fold
    return scored.select(
        id_col,
        (remainder(id_col, modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns as they are, whose text scores below `threshold`."""
    shipped = Shipped(df.sparkSession, model)

    def run(batches):
        gc.disable()
        scorer = shipped.made(Scorer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = scorer([t or "" for t in part.column(text_col).to_pylist()])
                yield part.filter(pa.array(scores < threshold))

    return df.mapInArrow(run, df.schema)
