"""Toxicity: character n-gram linear classifier with naive Bayes log-count ratios.

A text is lower-cased and turned into the set of its hashed character n-grams.  A feature
present in a text has the value ``r[b] = log((p_b / |p|) / (q_b / |q|))``, the naive Bayes
log-count ratio of its bucket over the labelled rows; a logistic regression is fitted on
these scaled features.  Ratios come from *all* labelled training rows (one partial count
vector per Arrow stream, summed in Spark); the regression weights from at most
``Settings.fit_rows`` rows, half of them per class, taken in hash order of the id.

Cases: a null or empty text has no features and scores the intercept alone; a text shorter
than the shortest n-gram likewise.  Without labelled rows of both classes the model is the
constant 0.5.  Conflicting labels of one id count as toxic; null ids and labels are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.session import staged

#: Code points hashed at once, which bounds the memory of a task whatever the texts' length.
PIECE = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Parameters of the classifier; ``fit_rows`` bounds the sample of the regression."""

    low: int = 3
    high: int = 6
    bits: int = 20
    smoothing: float = 0.5
    significance: float = 4.0
    fit_rows: int = 12_000
    epochs: int = 8
    rate: float = 0.1
    decay: float = 1e-5
    threshold: float = 0.7
    seed: int = 42


@dataclass(frozen=True)
class Sparse:
    """Values of some hash buckets; all others are 0."""

    settings: Settings
    buckets: np.ndarray
    values: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.settings.bits)
        out[self.buckets] = self.values
        return out


@dataclass(frozen=True)
class Model:
    """``weights`` are regression weights times log-count ratios."""

    weights: Sparse
    intercept: float

    @property
    def settings(self) -> Settings:
        return self.weights.settings

    def score(self, texts) -> np.ndarray:
        """Probability of the toxic class for each text, classes taken as equally common."""
        seen, weights = scratch(self.settings), self.weights.dense()
        useful = weights != 0
        logits = np.array([self.intercept + weights[buckets(t, self.settings, seen, useful)].sum() for t in texts])
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))


def scratch(settings: Settings) -> np.ndarray:
    return np.zeros(1 << settings.bits, dtype=np.int32)


def buckets(text: str | None, settings: Settings, seen: np.ndarray, useful: np.ndarray | None = None) -> np.ndarray:
    """Distinct hash buckets of a text's character n-grams, its ends padded with a space.

    ``seen`` is scratch of one entry per bucket; a bucket is kept at its last position.
    Buckets outside ``useful`` are left out early.
    """
    if not text:
        return np.empty(0, dtype=np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
    found = []
    for start in range(0, len(codes), PIECE):
        piece = codes[start : start + PIECE + settings.high - 1]
        rolled = piece * np.uint32(0x9E3779B1)
        for n in range(2, settings.high + 1):
            if len(piece) < n:
                break
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + piece[n - 1 :]
            if n >= settings.low:
                mixed = (rolled ^ (rolled >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
                found.append(mixed >> np.uint32(32 - settings.bits))
    if not found:
        return np.empty(0, dtype=np.int64)
    every = np.concatenate(found)
    if useful is not None:
        every = every[useful[every]]
    places = np.arange(len(every), dtype=np.int32)
    seen[every] = places
    return every[seen[every] == places].astype(np.int64)


def training_labels(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, y) of the rows that may be learned from: crc32(id) mod 3 is not 1."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .filter("doc_id is not null and y is not null")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def class_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, toxic, clean): in how many rows (text, y) of each class a bucket occurs.

    Every task counts in one vector, which is cut into parts that are added up apart.
    """
    size = 1 << settings.bits
    part = min(size, 1 << 14)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = scratch(settings), np.zeros((2, size), dtype=np.int32)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                sums[1 if y.as_py() > 0 else 0, buckets(text.as_py(), settings, seen)] += 1
        if sums.any():
            for at in range(0, size, part):
                # Byte by byte of all counts: mostly zeros in a row, which shuffles compress away.
                planes = np.ascontiguousarray(sums[:, at : at + part]).view(np.uint8).reshape(-1, 4).T
                yield pa.RecordBatch.from_pylist([{"part": at, "counts": planes.tobytes()}])

    def add(group: pa.Table) -> pa.Table:
        sums = np.zeros((2, part), dtype=np.int64)
        for counts in group.column("counts"):
            planes = np.frombuffer(counts.as_buffer(), dtype=np.uint8).reshape(4, -1)
            sums += np.ascontiguousarray(planes.T).view(np.int32).reshape(2, part)
        used = np.flatnonzero(sums.any(axis=0))
        return pa.table({"bucket": used + group.column("part")[0].as_py(), "toxic": sums[1, used], "clean": sums[0, used]})

    parts = rows.select("text", "y").mapInArrow(count, "part long, counts binary")
    return parts.groupBy("part").applyInArrow(add, "bucket long, toxic long, clean long")


def log_count_ratios(counts: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, r): the log-count ratios that differ from 0 by ``significance`` standard errors."""
    p, q = F.col("toxic") + settings.smoothing, F.col("clean") + settings.smoothing
    totals = counts.agg(F.sum(p).alias("ps"), F.sum(q).alias("qs"), F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    rows = counts.join(F.broadcast(totals), F.lit(True)).filter("t > 0 and c > 0")  # one row
    r = F.log(p / F.col("ps")) - F.log(q / F.col("qs"))
    return rows.filter(F.abs(r) >= settings.significance * F.sqrt(1 / p + 1 / q)).select("bucket", r.alias("r"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn ratios from all training rows, then regression weights from the bounded sample."""
    known = staged(training_labels(labels))
    docs = docs.select("doc_id", "text")
    # Labels grow with the corpus: texts always meet them by a shuffle, never by a broadcast.
    counts = staged(class_counts(docs.join(known.hint("shuffle_hash"), "doc_id"), settings))
    got = log_count_ratios(counts, settings).toPandas()  # no more rows than buckets
    ratios = Sparse(settings, got["bucket"].to_numpy(dtype=np.int64), got["r"].to_numpy(dtype=float))
    if not len(got):
        return Model(ratios, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("array<int>")
    def features(texts: pa.Array) -> pa.Array:
        seen, useful = scratch(settings), shared.value.dense() != 0
        kept = [buckets(text.as_py(), settings, seen, useful).astype(np.int32) for text in texts]
        return pa.array(kept, type=pa.list_(pa.int32()))

    def regress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (f.values.to_numpy() for f in batch.column(2)))]
        rows.sort(key=lambda row: (row[0], len(row[2])))
        weights, intercept = descend([f for _, _, f in rows], np.array([y for _, y, _ in rows], dtype=float), shared.value.dense(), settings)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used]), pa.array([intercept, *weights[used]])], names=["bucket", "weight"])

    order = F.xxhash64("doc_id", F.lit(settings.seed))
    half = settings.fit_rows // 2
    picked = [known.filter(c).select("doc_id", "y", order.alias("h")).orderBy("h", "doc_id").limit(half).drop("h") for c in ("y > 0", "y <= 0")]
    # At most fit_rows ids: small enough to send to every task at any size of the corpus.
    sample = docs.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "y", features("text").alias("f"))
    # The bounded sample meets in one task here, as the regression is sequential.
    fitted = staged(sample).coalesce(1).mapInArrow(regress, "bucket long, weight double").toPandas()
    inner = fitted[fitted["bucket"] >= 0]
    weights = Sparse(settings, inner["bucket"].to_numpy(dtype=np.int64), inner["weight"].to_numpy(dtype=float))
    return Model(weights, float(fitted["weight"][fitted["bucket"] < 0].sum()))


def descend(features: list[np.ndarray], ys: np.ndarray, ratios: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled features by AdaGrad; both classes weigh the same."""
    w, squares = np.zeros(len(ratios)), np.full(len(ratios), 1e-2)
    bias, bias_squares = 0.0, 1e-2
    share = np.where(ys > 0, 0.5 / max(1, (ys > 0).sum()), 0.5 / max(1, (ys <= 0).sum())) * len(ys)
    random = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for i in random.permutation(len(ys)):
            b = features[i]
            scaled = ratios[b]
            z = bias + np.dot(w[b], scaled)
            error = share[i] * (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - ys[i])
            step = error * scaled + settings.decay * w[b]
            squares[b] += step * step
            w[b] -= settings.rate * step / np.sqrt(squares[b])
            bias_squares += error * error
            bias -= settings.rate * error / np.sqrt(bias_squares)
    return w * ratios, bias


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score of each text as a column; only the text travels to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(shared.value.score(some))

    return scored(F.col(text))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= model.settings.threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    return docs.filter(score_column(docs, model) < model.settings.threshold)
