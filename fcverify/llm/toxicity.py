"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic rows carry a label into the fit; everything else is unlabelled text, in which a
share ``prior`` is toxic too. A linear classifier f over word features minimises the corrected risk

    prior * P[loss(f)] + max(0, U[loss(-f)] - prior * P[loss(-f)])

over the positives P and the unlabelled U, with the logistic loss, by mini-batches in numpy. A batch whose
second term is negative, a sign that positives are being learnt by heart, steps the other way on that
term, as in the published estimator. The prior is the share of toxic labels among the training labels.

Features: lower-cased runs of letters (bytes outside ASCII count as letters), whole and their beginnings of
``BEGINNINGS`` bytes, as a language may build many words on one stem, hashed to ``BUCKETS``. Spark counts, over all texts, in how many documents a bucket occurs, among the training positives and
altogether. Of the buckets that are ``LIFT`` times as common among positives, the ``FEATURES`` with the
largest log-likelihood gain become features. A feature is the logarithm of one plus the count of its words,
at most ``MOST``; a row of features longer than ``SOME`` is scaled to length 1, a shorter one by ``SOME``, so that a
text with two toxic words counts nearly like one with twenty, and a long text is not toxic for being long.

The fit uses at most ``POSITIVES`` toxic training rows and ``UNLABELLED`` other rows (documented bounds),
picked by hashes and reduced to their features before they reach the driver. Only the ids of these
positives are broadcast. Word statistics, the prior and the scores cover every row.

Rows with ``crc32(id as text) % 5 == 0`` are held out: their labels are never read, and their texts are no
training text. Labels, id and other columns are not inputs of a score. Defined cases: null and empty texts
have no features and get the score of the intercept; a null id is not held out and has no label;
several label rows of an id count as one, toxic if any says so; without toxic or other training rows every
score is the prior (0 without labels); repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.llm.words import U64, byte_table, mix, prefix_hash, span_hash, texts
from fcverify.session import settle

BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 7)
FEATURES = 1024
LEAST_POSITIVES = 5
MOST, SOME, LIFT = 3.0, 1.6, 2.0
POSITIVES, UNLABELLED = 20_000, 60_000
THRESHOLD = 0.5
STEPS, BATCH, RATE, DECAY = 4000, 256, 0.3, 1e-5
SEED = 13

_SPACE = np.ones(256, dtype=bool)
_SPACE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(id: str) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_buckets(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each text in the two others: sorted distinct buckets of its words, and their counts.

    ``wanted`` has a bit per bucket; others are left out.
    """
    bounds, buckets, counts = [np.zeros(1, np.int64)], [], []
    for t in texts(column):
        w = t.words((), fold=True, space=_SPACE)
        prefix = prefix_hash(byte_table(501, True)[t.bytes], 501)
        found = []
        for k, size in enumerate((None, *BEGINNINGS)):
            long = slice(None) if size is None else w.ends - w.starts >= size
            starts, ends = w.starts[long], w.ends[long] if size is None else w.starts[long] + size
            bucket = (mix(span_hash(prefix, starts, ends, 501) + U64(k)) >> U64(46)).astype(np.int64)
            key = w.text[long] * BUCKETS + bucket
            found.append(key if wanted is None else key[wanted[bucket]])
        key, n = np.unique(np.concatenate(found), return_counts=True)
        bounds.append(bounds[-1][-1] + np.searchsorted(key, np.arange(1, len(t) + 1) * BUCKETS))
        buckets.append(key % BUCKETS)
        counts.append(n)
    empty = np.zeros(0, np.int64)
    return np.concatenate(bounds), np.concatenate([empty, *buckets]), np.concatenate([empty, *counts])


def bucket_documents(rows: DataFrame, text: str, positive: str) -> DataFrame:
    """bucket, n (documents), p (positive documents), added up per Arrow batch first; bucket -1 counts the documents."""

    def run(batches):
        for batch in batches:
            bounds, buckets, _ = text_buckets(batch.column(0))
            sure = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            found, at = np.unique(buckets, return_inverse=True)
            n, p = np.bincount(at, minlength=len(found)), np.bincount(at, np.repeat(sure, np.diff(bounds)), minlength=len(found))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(found, -1)), pa.array(np.append(n, len(sure))), pa.array(np.append(p, sure.sum()).astype(np.int64))], ["bucket", "n", "p"])

    made = rows.select(F.col(text), F.col(positive)).mapInArrow(run, "bucket long, n long, p long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def chosen_buckets(counts: DataFrame, positives: int, documents: int, size: int = FEATURES) -> np.ndarray:
    """Sorted buckets with the largest log-likelihood gain among those much more common in the positives than elsewhere."""
    p, q = F.col("p") / F.lit(positives), (F.col("n") - F.col("p") + 1) / F.lit(documents - positives + 2)
    gain = F.col("p") * F.log(p / q) + (F.lit(positives) - F.col("p")) * F.log((1 - p + 1e-9) / (1 - F.least(q, F.lit(0.999))))
    good = counts.filter((F.col("bucket") >= 0) & (F.col("p") >= LEAST_POSITIVES)).select("bucket", p.alias("share"), q.alias("other"), gain.alias("gain"))
    best = good.filter(F.col("share") > LIFT * F.col("other")).orderBy(F.desc("gain"), "bucket").limit(size).collect()
    return np.array(sorted(r["bucket"] for r in best), dtype=np.int64)


@dataclass
class Rows:
    """Sparse rows: bounds of each in ``at`` (features) and ``values``."""

    bounds: np.ndarray
    at: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = (self.bounds[1:] - self.bounds[:-1])[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        inner = np.arange(bounds[-1]) + np.repeat(self.bounds[rows] - bounds[:-1], size)
        return Rows(bounds, self.at[inner], self.values[inner])

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Sum of value times weight of each row."""
        owner = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        return np.bincount(owner, self.values * weights[self.at], minlength=len(self)) if len(self.at) else np.zeros(len(self))

    def weighted(self, factors: np.ndarray, width: int) -> np.ndarray:
        """Sum over rows of factor times values, per feature."""
        return np.bincount(self.at, self.values * np.repeat(factors, np.diff(self.bounds)), minlength=width)[:width]

    def and_rows(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.bounds, other.bounds[1:] + self.bounds[-1]]), np.concatenate([self.at, other.at]),
                    np.concatenate([self.values, other.values]))


def features_of(column: pa.Array, chosen: np.ndarray) -> Rows:
    """The features (places in ``chosen``) of texts."""
    wanted = np.zeros(BUCKETS, dtype=bool)
    wanted[chosen] = True
    bounds, buckets, counts = text_buckets(column, wanted)
    values = np.minimum(np.log1p(counts), MOST)
    squares = np.concatenate([[0], np.cumsum(values**2)])
    size = np.sqrt(np.maximum(squares[bounds[1:]] - squares[bounds[:-1]], SOME**2))
    return Rows(bounds, np.searchsorted(chosen, buckets), values / np.repeat(size, np.diff(bounds)))


@dataclass
class Linear:
    """Weights and intercept of the score; a constant score without weights."""

    weights: np.ndarray
    intercept: float

    def score(self, rows: Rows) -> np.ndarray:
        return _logistic(self.intercept + rows.times(self.weights))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(positive: Rows, unlabelled: Rows, width: int, prior: float, steps: int = STEPS, seed: int = SEED) -> Linear:
    """Non-negative risk by mini-batches."""
    draw = np.random.default_rng(seed)
    w = np.zeros(width + 1)  # the last one is the intercept
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros(width + 1), np.full(width + 1, 1e-8)

    def slope(rows: Rows, factors: np.ndarray) -> np.ndarray:
        return np.append(rows.weighted(factors, width), factors.sum()) / len(rows)

    for step in range(steps):
        p = positive.take(draw.integers(len(positive), size=BATCH))
        u = unlabelled.take(draw.integers(len(unlabelled), size=4 * BATCH))
        fp, fu = p.times(w[:-1]) + w[-1], u.times(w[:-1]) + w[-1]
        # the logistic loss of f has the slope sigma(f) - 1, that of -f sigma(f)
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        rest_slope = slope(u, _logistic(fu)) - prior * slope(p, _logistic(fp))
        down = prior * slope(p, _logistic(fp) - 1) + rest_slope if rest >= 0 else -rest_slope
        down[:-1] += DECAY * w[:-1]
        square = 0.99 * square + 0.01 * down**2  # step sizes by the running size of each slope
        w = w - RATE / (1 + step / 300) * down / (np.sqrt(square) + 1e-4)
        if step >= steps // 2:  # average of the second half
            mean += w
    mean /= steps - steps // 2
    return Linear(mean[:-1], float(mean[-1]))


def _rows(found) -> Rows:
    parts = [(np.frombuffer(r["at"], dtype="<i4"), np.frombuffer(r["values"], dtype="<f4")) for r in found]
    none = np.zeros(0)
    return Rows(np.concatenate([[0], np.cumsum([len(a) for a, _ in parts], dtype=np.int64)]).astype(np.int64),
                np.concatenate([none.astype(np.int64), *[a for a, _ in parts]]), np.concatenate([none, *[v for _, v in parts]]))


def trained(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
            positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> tuple[np.ndarray, Linear]:
    """Chosen buckets and the classifier."""
    known = settle(labels.select(F.col(id).alias("of"), F.col(label).cast("int").alias("label")).filter(
        F.col("of").isNotNull() & F.col("label").isin(0, 1) & ~held_out("of")).groupBy("of").agg(F.max("label").alias("label")))
    share = known.agg(F.avg("label").alias("m")).first()["m"] or 0.0
    # a bounded number of ids, so the texts stay where they are
    sure = settle(known.filter("label = 1").orderBy(F.xxhash64("of"), "of").limit(positives).select("of"))
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(~held_out("id"))
    rows = own.join(F.broadcast(sure), F.col("id") == F.col("of"), "left").select(
        "text", F.col("of").isNotNull().alias("positive"), F.xxhash64("id", "text", F.monotonically_increasing_id()).alias("order"))
    counts = settle(bucket_documents(rows, "text", "positive"))
    total = counts.filter("bucket = -1").first()
    none = np.zeros(0, dtype=np.int64)
    if total is None or not total["p"] or total["p"] == total["n"] or not 0 < share < 1:
        return none, Linear(np.zeros(0), float(np.log(share / (1 - share))) if 0 < share < 1 else (500.0 if share else -500.0))
    chosen = chosen_buckets(counts, total["p"], total["n"], features)

    def reduce(batches):
        for batch in batches:
            r = features_of(batch.column(0), chosen)
            made = [(r.at[a:b].astype("<i4").tobytes(), r.values[a:b].astype("<f4").tobytes()) for a, b in zip(r.bounds, r.bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())],
                                             ["order", "at", "values"])

    def sample(sure: bool, of: int, most: int):
        """Rows with the smallest hashes; those that cannot be among them are left out before their features are made."""
        part = F.pmod(F.col("order"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * most / of))
        reduced = rows.filter(F.col("positive") == sure).filter(part).select("text", F.pmod(F.col("order"), F.lit(1 << 30))).mapInArrow(
            reduce, "order long, at binary, values binary")
        return _rows(reduced.orderBy("order", "at", "values").limit(most).collect())

    # unlabelled text as it comes: other rows and, at their share, positives
    p, u = sample(True, total["p"], positives), sample(False, total["n"] - total["p"], unlabelled)
    draw = np.random.default_rng(SEED)
    again = p.take(draw.integers(len(p), size=max(1, round(len(u) * total["p"] / (total["n"] - total["p"])))))
    return chosen, fit(p, u.and_rows(again), len(chosen), share)


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
             threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """Per row of docs: id, held_out, score, predicted."""
    chosen, model = trained(docs, labels, id, text, label, **bounds)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features_of(batch.column(1), chosen)))], ["id", "score"])

    scored = docs.select(F.col(id), F.col(text)).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op13_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)


QUERIES = {"op13_toxicity": op13_toxicity}
ORACLE_SQL: dict[str, str] = {}
