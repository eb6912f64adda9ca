"""Gradient-boosted trees for many models at once, each level of all trees from one aggregate.

The rows of all models lie in one table of binned features (``binned``), dealt by model, a large model over
several blocks; models of one block need no shuffle after that. A round adds ``together`` trees to every model, all fitted to the same residuals on their own
draws of rows and features. A level of these trees is one Spark job (``best_splits``): blocks add up, per model,
tree, open node, feature and bin, the residuals and the rows; the sums of a model's blocks are added up and
searched for the best split of each open node; the driver sees one row per open node. Trees grow by best gain
up to ``leaves`` leaves and ``depth`` levels.

Rows carry their prediction as of the last ``settle``; newer trees are evaluated on the fly, so a lost
executor recomputes from the written table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.session import settle

U64 = np.uint64
BLOCK_ROWS = 200_000
#: Sums of this many blocks are added up in one group.
FAN_IN = 64
LEAST_GAIN = 1e-12
SPLITS = "model int, tree int, node int, gain double, feature int, cut int, left_sum double, left_rows double, right_sum double, right_rows double"


@dataclass
class Settings:
    trees: int = 200
    leaves: int = 31
    depth: int = 8
    rate: float = 0.05
    row_share: float = 0.9
    feature_share: float = 0.9
    bins: int = 64
    least_rows: int = 20
    together: int = 8
    seed: int = 42
    settle_every: int = 1


@dataclass
class Forest:
    """Trees of all models: arrays (model, tree, node). ``feature`` is -1 at leaves; children are left and left + 1."""

    base: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(base: np.ndarray, trees: int, leaves: int) -> Forest:
        shape = (len(base), trees, 2 * leaves - 1)
        return Forest(base, np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape, np.int16), np.zeros(shape))

    def part(self, first: int, last: int) -> Forest:
        return Forest(self.base, *(x[:, first:last] for x in (self.feature, self.cut, self.left, self.value)))

    def nodes(self, model: np.ndarray, bins: np.ndarray, tree: int) -> np.ndarray:
        """The node of a tree where each row ends."""
        at, row = np.zeros(len(model), dtype=np.int64), np.arange(len(model))
        while True:
            f = self.feature[model, tree, at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[row, np.maximum(f, 0)] > self.cut[model, tree, at]
            at = np.where(inner, self.left[model, tree, at] + right, at)

    def predict(self, model: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Sum of the trees, without the base."""
        out = np.zeros(len(model))
        for t in range(self.feature.shape[1]):
            out += self.value[model, t, self.nodes(model, bins, t)]
        return out


@dataclass
class Edges:
    """Bin edges per (group, feature), from training rows of the group."""

    group: str
    values: dict[object, list[np.ndarray]] = field(default_factory=dict)

    def bins(self, groups: list, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(groups), len(columns)), dtype=np.uint8)
        groups = np.array(groups, dtype=object)
        for g, edges in self.values.items():
            own = groups == g
            for f, column in enumerate(columns):
                out[own, f] = np.searchsorted(edges[f], column[own], "left")
        return out


def bin_edges(train: DataFrame, features: Sequence[str], group: str, bins: int) -> Edges:
    """Approximate quantiles of the training rows, one aggregate row per group."""
    levels = [i / bins for i in range(1, bins)]
    found = train.groupBy(group).agg(*[F.percentile_approx(f, levels, 100 * bins).alias(f"q{i}") for i, f in enumerate(features)]).collect()
    return Edges(group, {r[group]: [np.unique(np.array(r[f"q{i}"], dtype=float)) for i in range(len(features))] for r in found})


def binned(samples: DataFrame, features: Sequence[str], models: Sequence[tuple], keys: Sequence[str], edges: Edges, base: np.ndarray,
           row_keys: Sequence[str], label: str, blocks: Sequence[int]) -> DataFrame:
    """Keys, role, model, block, row hash, label, bins, prediction (so far the base); dealt by model and block, written once."""
    place = {m: i for i, m in enumerate(models)}
    counts = np.array(blocks, dtype=np.int64)
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    names = [*keys, *row_keys, "role"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def run(batches):
        for batch in batches:
            model = np.array([place[k] for k in zip(*(batch.column(c).to_pylist() for c in keys), strict=True)], dtype=np.int32)
            made = edges.bins(batch.column(edges.group).to_pylist(), [batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            block = (batch.column("__row").to_numpy().view(U64) % counts[model].astype(U64)).astype(np.int32)
            data = pa.array([r.tobytes() for r in made], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(model), pa.array(block), batch.column("__row"), batch.column(label), data, pa.array(base[model])],
                [*names, "__model", "__block", "__row", "__label", "__bins", "__made"])

    chosen = samples.select(*names, label, *features, F.xxhash64(*row_keys).alias("__row"))
    made = chosen.mapInArrow(run, f"{schema}, __model int, __block int, __row long, __label double, __bins binary, __made double")
    return settle(made.repartition(_partitions(made, sum(blocks)), "__model", "__block"))


def _partitions(df: DataFrame, groups: int) -> int:
    """Partitions for so many groups: no more than there are groups, twice the cores at least where there are enough."""
    return max(1, min(groups, max(groups // 16, 2 * df.sparkSession.sparkContext.defaultParallelism)))


def _matrix(column: pa.Array) -> np.ndarray:
    """The bins of a batch, one row per row."""
    if not len(column):
        return np.zeros((0, 0), dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].reshape(len(column), -1)


def _drawn(row: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether each row is in a tree's draw, from its hash."""
    x = (row.view(U64) ^ U64(seed * 1_000_003 + tree)) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    return (x >> U64(40)).astype(float) < share * (1 << 24)


def best_splits(rows: DataFrame, recent: Forest, slots: np.ndarray, width: int, growing: Forest, first_tree: int, allowed: np.ndarray,
                s: Settings, blocks: int) -> DataFrame:
    """The best split of each open node (``SPLITS``), where there is one.

    ``slots`` numbers the open nodes of each tree (-1: not open), ``width`` is how many there are at most;
    ``allowed`` says which features a tree may use; ``blocks`` is the largest number of blocks of a model.
    """
    bins, trees, features = s.bins, growing.feature.shape[1], allowed.shape[2]
    shape = (2, trees, features, width, bins)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            model, matrix = batch.column(0).to_numpy(), _matrix(batch.column(3))
            if not len(model):
                continue
            gap = batch.column(2).to_numpy() - batch.column(4).to_numpy() - recent.predict(model, matrix)
            row = batch.column(1).to_numpy()
            here, place = np.unique(model, return_inverse=True)
            made = np.zeros((len(here), *shape))
            for k in range(trees):
                slot = slots[model, k, growing.nodes(model, matrix, k)]
                own = np.flatnonzero((slot >= 0) & _drawn(row, first_tree + k, s.seed, s.row_share))
                at, size = (place[own] * width + slot[own]) * bins, len(here) * width * bins
                for f in range(features):
                    key = at + matrix[own, f]
                    made[:, 0, k, f] = np.bincount(key, gap[own], size).reshape(len(here), width, bins)
                    made[:, 1, k, f] = np.bincount(key, minlength=size).reshape(len(here), width, bins)
            for i, m in enumerate(here.tolist()):
                sums[m] = sums[m] + made[i] if m in sums else made[i]
        if blocks == 1:  # the models of this task are all here
            for m, total in sums.items():
                yield from _searched(m, total, allowed[m], slots[m], s).to_batches()
        else:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["model", "sums"])

    def added(table: pa.Table) -> np.ndarray:
        total = np.zeros(shape)
        for data in table["sums"]:
            total += np.frombuffer(data.as_buffer()).reshape(shape)
        return total

    def some(table: pa.Table) -> pa.Table:
        return pa.table({"model": table["model"].slice(0, 1), "sums": pa.array([added(table).tobytes()], pa.binary())})

    def search(table: pa.Table) -> pa.Table:
        m = table["model"][0].as_py()
        return _searched(m, added(table), allowed[m], slots[m], s)

    read = rows.select("__model", "__row", "__label", "__bins", "__made")
    if blocks == 1:
        return read.mapInArrow(run, SPLITS)
    partial = read.mapInArrow(run, "model int, sums binary")
    models = len(growing.base)
    if blocks > FAN_IN:
        parts = -(-blocks // FAN_IN)
        dealt = partial.withColumn("part", F.spark_partition_id() % parts).repartition(_partitions(rows, models * parts), "model", "part")
        partial = dealt.groupBy("model", "part").applyInArrow(some, "model int, sums binary")
    return partial.repartition(_partitions(rows, models), "model").groupBy("model").applyInArrow(search, SPLITS)


def _searched(model: int, sums: np.ndarray, allowed: np.ndarray, slots: np.ndarray, s: Settings) -> pa.Table:
    """Best split of the open nodes of a model from its sums by tree, feature, open node and bin."""
    total, rows = np.cumsum(sums[0], axis=-1), np.cumsum(sums[1], axis=-1)
    all_total, all_rows = total[..., -1:], rows[..., -1:]
    right_total, right_rows = all_total - total, all_rows - rows
    good = (rows >= s.least_rows) & (right_rows >= s.least_rows) & allowed[:, :, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(good, total**2 / rows + right_total**2 / right_rows - all_total**2 / all_rows, -np.inf)
    flat = gain.transpose(0, 2, 1, 3).reshape(gain.shape[0], gain.shape[2], -1)
    best = flat.argmax(axis=-1)
    found = np.take_along_axis(flat, best[..., None], -1)[..., 0]
    k, at = np.nonzero(slots >= 0)
    n = slots[k, at]
    k, n, at = (x[found[k, n] > LEAST_GAIN] for x in (k, n, at))
    feature, cut = best[k, n] // s.bins, best[k, n] % s.bins
    sides = [x[k, feature, n, cut] for x in (total, rows, right_total, right_rows)]
    columns = [np.full(len(k), model), k, at, found[k, n], feature, cut, *sides]
    return pa.Table.from_arrays([pa.array(c.astype(np.int32) if i in (0, 1, 2, 4, 5) else c) for i, c in enumerate(columns)],
                                [c.split()[0] for c in SPLITS.split(", ")])


def _grow(rows: DataFrame, recent: Forest, growing: Forest, first_tree: int, features: int, s: Settings, blocks: int) -> None:
    """Grow the trees of a round in place, one job per level."""
    models, trees, nodes = growing.feature.shape
    draw = np.random.default_rng([s.seed, first_tree])
    allowed = draw.random((models, trees, features)).argsort(axis=-1) < max(1, round(features * s.feature_share))
    used = np.ones((models, trees), dtype=np.int64)
    open_ = {(m, k): [0] for m in range(models) for k in range(trees)}
    for _ in range(s.depth):
        slots = np.full((models, trees, nodes), -1, dtype=np.int64)
        for (m, k), own in open_.items():
            slots[m, k, own] = np.arange(len(own))
        width = max(len(own) for own in open_.values())
        found = best_splits(rows, recent, slots, width, growing, first_tree, allowed, s, blocks).collect()
        open_ = {}
        for r in sorted(found, key=lambda r: (-r["gain"], r["model"], r["tree"], r["node"])):
            m, k, at, left = r["model"], r["tree"], r["node"], int(used[r["model"], r["tree"]])
            if left + 2 > nodes:  # as many leaves as there may be
                continue
            growing.feature[m, k, at], growing.cut[m, k, at], growing.left[m, k, at] = r["feature"], r["cut"], left
            growing.value[m, k, left] = s.rate * r["left_sum"] / r["left_rows"]
            growing.value[m, k, left + 1] = s.rate * r["right_sum"] / r["right_rows"]
            used[m, k] += 2
            open_.setdefault((m, k), []).extend([left, left + 1])
        if not open_:
            return


def fit_predict(samples: DataFrame, features: Sequence[str], models: Sequence[tuple], keys: Sequence[str], row_keys: Sequence[str],
                label: str = "target", bin_group: str = "fold", settings: Settings | None = None) -> DataFrame:
    """Test rows (``role`` test) of every model with ``y_pred``; models are fitted on their train rows.

    ``models`` are the values of ``keys`` that get a model; one without training rows has no test rows back.
    """
    s = settings or Settings()
    wanted = samples.filter(F.concat_ws(":", *keys).isin([":".join(map(str, m)) for m in models]))
    train = wanted.filter(F.col("role") == "train")
    counts = {tuple(r[k] for k in keys): r for r in wanted.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("role") == "train", F.col(label))).alias("base")).collect()}
    fitted = [m for m in models if m in counts and counts[m]["base"] is not None]
    base = np.array([counts[m]["base"] for m in fitted], dtype=float)
    blocks = [max(1, -(-counts[m]["n"] // BLOCK_ROWS)) for m in fitted]
    edges = bin_edges(train, features, bin_group, s.bins)
    kept = wanted.filter(F.concat_ws(":", *keys).isin([":".join(map(str, m)) for m in fitted]))
    rows = binned(kept, features, fitted, keys, edges, base, row_keys, label, blocks)
    learnt = rows.filter(F.col("role") == "train")
    forest = Forest.empty(base, s.trees, s.leaves)
    written = 0
    for n, first in enumerate(range(0, s.trees, s.together)):
        last = min(first + s.together, s.trees)
        _grow(learnt, forest.part(written, first), forest.part(first, last), first, len(features), s, max(blocks))
        if (n + 1) % s.settle_every == 0 and last < s.trees:
            learnt, written = settle(_with_trees(learnt, forest.part(written, last))), last
    test = rows.filter(F.col("role") == "test")
    return _with_trees(test, forest).withColumnRenamed("__made", "y_pred").select(
        *keys, *row_keys, F.col("__label").alias(label), "y_pred")


def _with_trees(rows: DataFrame, forest: Forest) -> DataFrame:
    """Rows with the trees added to their prediction."""
    def run(batches):
        for batch in batches:
            model, made = batch.column("__model").to_numpy(), batch.column("__made").to_numpy()
            new = pa.array(made + forest.predict(model, _matrix(batch.column("__bins")))) if len(model) else batch.column("__made")
            yield pa.RecordBatch.from_arrays([new if c == "__made" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
