"""Quality by Bradley-Terry pairwise ranking.

From labelled documents, preference pairs (a good one over a bad one) are drawn; the
logistic loss on the difference of their features gives one weight per feature, as
in Bradley and Terry's model of paired comparisons. A document's strength is the
weighted sum of its features. A quantile of the strengths of the labelled documents
is the threshold, and a logistic map puts that threshold at ``cut``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import row_blocks, utf8, word_hashes

#: Labelled rows that are fitted on, at most, by the least hashes of their ids; pairs drawn from them.
SAMPLE, PAIRS = 10_000, 60_000
CUT = 0.3

_upper = np.zeros(256, bool)
_upper[65:91] = True
_letter = _upper.copy()
_letter[97:123] = True
_letter[128:] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_mark = ~(_letter | _digit | _blank)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, float32 matrix) of a string column: square roots of byte shares, and shares of characters, words and lines."""
    data, at = utf8(column)
    for lo, hi in row_blocks(at):
        part, begin = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        n = hi - lo
        size = np.maximum(np.diff(begin), 1)
        owner = np.repeat(np.arange(n), np.diff(begin))
        shares = np.bincount(owner * 256 + part, minlength=256 * n).reshape(n, 256)
        words, word_at = word_hashes(part, begin)
        count = np.maximum(np.diff(word_at), 1)
        word_owner = np.repeat(np.arange(n), np.diff(word_at))
        order = np.lexsort((words, word_owner))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (word_owner[order][1:] != word_owner[order][:-1])
        distinct = np.bincount(word_owner[order][new], minlength=n)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
        repeated = np.bincount(word_owner[again], minlength=n)
        # a mark straight before a blank, and marks in a row
        after = np.zeros(len(part), bool)
        after[:-1] = _blank[part[1:]]
        marks = _mark[part]
        closing = np.bincount(owner[marks & after], minlength=n)
        double = np.zeros(len(part), bool)
        double[1:] = marks[1:] & (part[1:] == part[:-1])
        doubled = np.bincount(owner[double], minlength=n)
        first = np.zeros(len(part), bool)
        first[1:] = _upper[part[1:]] & _letter[part[:-1]]
        inner_upper = np.bincount(owner[first], minlength=n)
        lines = shares[:, 10] + 1
        dense = np.stack(
            [
                shares[:, _upper].sum(axis=1) / size,
                shares[:, _digit].sum(axis=1) / size,
                shares[:, _mark].sum(axis=1) / size,
                shares[:, _blank].sum(axis=1) / size,
                np.log1p(size) / 10,
                size / count / 10,
                distinct / count,
                repeated / count,
                closing / count,
                doubled / size,
                inner_upper / size,
                np.log1p(lines) / 10,
                count / lines / 100,
                np.minimum(1, 1 / count),
            ],
            axis=1,
        )
        yield lo, hi, np.hstack([np.sqrt(shares / size[:, None]), dense]).astype(np.float32)


@dataclass(frozen=True)
class Ranking:
    """Strength of x: weights . (x - mean) / spread; the strength ``threshold`` has score ``cut``."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    cut: float = CUT

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8).astype(np.float64) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.threshold) / self.scale + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def rank(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, seed: int = 11) -> Ranking:
    """Fit on features and labels. Without both labels, every document has the same score: 1 - cut, or 0 if all are bad."""
    width = x.shape[1]
    mean, spread = x.mean(axis=0) if len(x) else np.zeros(width), (x.std(axis=0) if len(x) else np.zeros(width)) + 1e-3
    upper, lower = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(upper) or not len(lower):
        return Ranking(mean, spread, np.zeros(width), np.inf if len(lower) else -1.0, 1.0)
    z = np.clip((x - mean) / spread, -8, 8)
    draw = np.random.default_rng(seed)
    over, under = upper[draw.integers(0, len(upper), pairs)], lower[draw.integers(0, len(lower), pairs)]
    w, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, steps + 1):  # Adam over batches of pairs
        part = slice(((step - 1) * 2048) % pairs, ((step - 1) * 2048) % pairs + 2048)
        difference = (z[over[part]] - z[under[part]]).astype(np.float64)
        off = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))
        grad = -(off @ difference) / len(difference) + decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    strength = z.astype(np.float64) @ w
    # the quantile: as large a share of the labelled documents lies below the threshold as is labelled bad
    threshold = float(np.quantile(strength, len(lower) / len(strength)))
    return Ranking(mean, spread, w, threshold, max(1e-6, float(strength.std()) / 2))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Fit on the documents of at most ``sample`` labelled rows that are not held out, those with the least hashes of their ids.

    Rows with a null id or label are no labels; of a doc_id that is labelled twice the last by id and
    label counts, and of one that several documents have the least label and features. Null texts
    count as empty. Without labels or documents, or with labels of one kind, every text has the same score.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample)
        .collect()
    )
    table = {r[0]: r[1] for r in chosen}
    known = docs.sparkSession.createDataFrame(sorted(table.items()), "doc_id long, quality int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in features(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "quality")], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # at most ``sample`` small rows; rows that repeat a doc_id count once
    found = rows.join(F.broadcast(known), "doc_id").mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()
    width = 256 + 14
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, width), np.float32)
    return rank(x, np.array([r["quality"] for r in found], np.int64))


def score_quality(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, from the text alone.

    Null texts count as empty, which has a score like any other text. A null doc_id is not
    held out. Repeated rows have equal scores; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in features(batch.column("text")):
                score = np.round(shared.value.score(x), 6)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(score), pa.array((score >= shared.value.cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_held_out(F.col("doc_id").cast("long")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text scores at least the ranking's cut.

    Null texts are judged as empty ones; null ids and repeated rows are rows like any other; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranking)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in features(batch.column(at).cast(pa.string())):
                yield batch.slice(lo, hi - lo).filter(pa.array(np.round(shared.value.score(x), 6) >= shared.value.cut))

    return docs.mapInArrow(run, docs.schema)
