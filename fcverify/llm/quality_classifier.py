"""Quality classifier: regularised quadratic discriminant on document statistics.

Each document becomes ``FEATURES`` transformed statistics of its text. Per label class, mean and
covariance come from sums and cross products that Spark adds up over all labelled training rows, so
the model is fitted on all of them and the driver sees two rows. Covariances are shrunk towards the
pooled covariance and then towards a multiple of the identity. The score is the logistic of the
difference of Mahalanobis log-densities plus log priors, over the square root of the number of features;
it uses the inverse Cholesky factor of each covariance, worked out once.

Rows with ``crc32(id as text) % 4 == 2`` are held out and never fitted. Labels, id and other columns
are not inputs of a score. Defined cases: null and empty texts have the features of an empty text and
get a score; a null id is not held out; unlabelled rows and null labels are not fitted; without
training rows of both classes every score is the share of the class there is (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.llm.words import Texts, covered, texts
from fcverify.session import settle

FEATURES = ["log_words", "word_size", "word_spread", "upper", "digits", "symbols", "marks", "marked_words", "wide", "distinct",
            "commonest", "adjacent", "repeated", "words_a_line", "upper_words"]
POOL, RIDGE = 0.1, 0.05
THRESHOLD = 0.7
REPEAT_WINDOW = 8
PRIOR_WORDS, PRIOR_SIZE = 20, 5.0


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(b"#*$%&|<>@^~_=+\\/{}[]")
_MARK = _table(b".,;:!?\"'()-")
_WIDE = _table(bytes(range(128, 256)))
_LINE = _table(b"\n")


def statistics(t: Texts) -> np.ndarray:
    """Feature rows of some texts."""
    w = t.words((0, 1))
    n = np.diff(w.first).astype(float)
    # shares of short texts are drawn to those of a usual one
    some = n + PRIOR_WORDS
    size = np.diff(t.bounds) + PRIOR_WORDS * PRIOR_SIZE

    def bytes_of(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[t.bytes])])
        return (total[t.bounds[1:]] - total[t.bounds[:-1]]).astype(float)

    def words_of(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[w.first[1:]] - total[w.first[:-1]]).astype(float)

    length = (w.ends - w.starts).astype(float)
    mean = (words_of(length) + PRIOR_WORDS * PRIOR_SIZE) / some
    spread = np.sqrt(np.maximum((words_of(length**2) + 1.4 * PRIOR_WORDS * PRIOR_SIZE**2) / some - mean**2, 0))
    last = t.bytes[w.ends - 1] if len(w) else np.zeros(0, np.uint8)
    first = t.bytes[w.starts] if len(w) else last
    order = np.lexsort((w.hashes[0], w.text))
    h, owner = w.hashes[0][order], w.text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    distinct = np.bincount(owner[new], minlength=len(t)).astype(float)
    commonest = np.zeros(len(t))
    np.maximum.at(commonest, owner[new], runs)
    next_same = np.zeros(len(w), dtype=bool)
    next_same[1:] = (w.hashes[0][1:] == w.hashes[0][:-1]) & (w.text[1:] == w.text[:-1])
    at, (wh, _) = w.windows(REPEAT_WINDOW)
    order = np.lexsort((wh, w.text[at]))
    same = (wh[order[1:]] == wh[order[:-1]]) & (w.text[at[order[1:]]] == w.text[at[order[:-1]]])
    again = covered(np.union1d(at[order[1:]][same], at[order[:-1]][same]), REPEAT_WINDOW, len(w))

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.sqrt(np.clip(x / of, 0, 1))

    return np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), share(bytes_of(_UPPER), size), share(bytes_of(_DIGIT), size),
        share(bytes_of(_SYMBOL), size), share(bytes_of(_MARK), size), share(words_of(_MARK[last] | _SYMBOL[last]), some),
        share(bytes_of(_WIDE), size), np.log((distinct + PRIOR_WORDS) / some), share(commonest, some), share(words_of(next_same), some),
        share(words_of(again), some), np.log1p((n + PRIOR_WORDS) / (bytes_of(_LINE) + 1)), share(words_of(_UPPER[first]), some),
    ], axis=1)


def features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and the features by name."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = [statistics(t) for t in texts(batch.column(1))]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.concatenate(made).T.copy())], ["id", *FEATURES])

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, f"id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Discriminant:
    """Class priors, means, inverse Cholesky factors and log determinants; no factors without both classes."""

    priors: np.ndarray
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.priors[1])
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            density.append(np.log(self.priors[c]) - 0.5 * (np.einsum("ij,ij->i", z, z) + self.log_dets[c]))
        gap = (density[1] - density[0]) / np.sqrt(x.shape[1])
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def held_out(id: str) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(rows: DataFrame, label: str, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """Model of rows with the features and a label 0 or 1."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count("*").alias("n"), F.array(*[F.sum(f) for f in FEATURES]).alias("s"),
        F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]).alias("q")).collect()
    n = np.zeros(2)
    means, covariances = np.zeros((2, d)), np.zeros((2, d, d))
    for r in found:
        c = int(r[label])
        n[c] = r["n"]
        means[c] = np.array(r["s"]) / r["n"]
        for (i, j), q in zip(pairs, r["q"], strict=True):
            covariances[c, i, j] = covariances[c, j, i] = q / r["n"] - means[c, i] * means[c, j]
    if not n.sum():
        return Discriminant(np.array([0.5, 0.5]))
    priors = n / n.sum()
    if not n.all():
        return Discriminant(priors)
    pooled = np.tensordot(priors, covariances, 1)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, log_dets = [], []
    for c in (0, 1):
        mixed = ((1 - pool) * covariances[c] + pool * pooled) / np.outer(scale, scale)
        mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower) / scale)
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(priors, means, np.array(factors), np.array(log_dets))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
             threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: id, held_out, score, predicted."""
    rows = settle(features(docs, id, text))
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).filter(~held_out("id"))
    model = fit(rows.join(known, "id"), "label")
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], ["id", "score"])

    scored = rows.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_classifier(spark, sf_dir):
    """Quality score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
