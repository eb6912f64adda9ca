"""Near-duplicate groups by SetSketch registers.

The set of a document is its distinct ``width``-word shingles (A-Z lower-cased); a shorter text is
one shingle. Two documents are linked when 100 * |A & B| >= percent * |A | B|; a group is a
connected component of links and is named after its smallest id.

1. Each set becomes ``REGISTERS`` SetSketch registers: register i is ``floor(1 - log_b x)`` for the
   smallest of the elements' exponential variates x of hash i, truncated to 16 bits. Registers merge
   by maximum, and two sets agree in a register with a probability of at least their similarity.
2. Equal sets collapse to one representative. Bands of ``BAND`` registers are bucket keys. A pair at
   similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32, about 5e-6.
3. Of the documents that share a bucket with another, the shingles that no other of them holds are
   counted (``alone``). At most n - alone shingles of a document can be common with any partner, which
   bounds the similarity of a pair from above; edited copies of one text are mostly ruled out this way.
4. Star round: each member of a bucket is paired with the bucket's smallest id and with its most
   central member (the smallest share of lone shingles), not with every member. The registers and the
   known set sizes give the likelihood of each similarity; pairs whose estimate is more than ``MARGIN``
   (over five standard deviations) below the threshold go, all others are verified on the full sets.
   Verified links give components.
5. Cross round, in buckets that still hold several components. A hub, the most central member of the
   bucket's largest component, gives a sharper bound: two members have in common at most the smaller of
   what each shares with the hub, and the shingles both have beyond it. So a member x outside the
   largest component is paired with a member y of another one only if the first part alone can reach
   the threshold, or if x and y meet in an index of shingles beyond the hub, often enough. The index
   holds the rare ones of each member only, as many as a pair that reaches the threshold cannot all
   miss (``meeting``). These pairs are verified the same way. After this every pair that shares a bucket is verified, ruled out by an
   exact bound or already in one component: no link that could join two groups is left out.

Defined cases: null text, or none but white space, has an empty set, is linked with nothing and
kept; rows that repeat an id stand or fall together; a row with a null id is linked with nothing
and kept (component_id null); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fcverify.llm import exchange as X
from fcverify.llm.words import U64, as_bytes, mix, prefix_hash, span_hash, texts
from fcverify.session import settle

REGISTERS, BAND = 128, 4
BASE, RATE = 1.001, 20.0
MARGIN = 0.2
SLICE = 256 << 10
CHUNK_BYTES, BLOCK_KEYS = 4 << 20, 4 << 20
_SEEDS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_XOR, _TIMES = _SEEDS[:REGISTERS], _SEEDS[REGISTERS:] | U64(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By slices: sorted distinct shingle hashes text after text, and the bounds of each text."""
    for t in texts(column, SLICE):
        w = t.words((0,), fold=True)
        at, (h,) = w.windows(width)
        owner = w.text[at]
        size = np.diff(w.first)
        short = np.flatnonzero((size > 0) & (size < width))
        if len(short):
            prefix = prefix_hash(w.hashes[0], 101)
            h = np.concatenate([h, span_hash(prefix, w.first[short], w.first[short + 1], 101)])
            owner = np.concatenate([owner, short])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        yield h, np.searchsorted(owner, np.arange(len(t) + 1))


def registers(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers of every non-empty set; empty sets have zeros."""
    out = np.zeros((len(bounds) - 1, REGISTERS), dtype="<u2")
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        least = np.empty((len(full), REGISTERS), dtype=U64)
        for i in range(REGISTERS):
            least[:, i] = np.minimum.reduceat((h ^ _XOR[i]) * _TIMES[i], bounds[full])
        uniform = (least.astype(np.float64) + 0.5) / 2.0**64
        value = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
        out[full] = np.clip(value, 0, 65535)
    return out


def sketches(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """Per row: id, n (set size), h1 and h2 (identity of the set), registers."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, h1, h2, regs = [], [], [], []
            for h, bounds in shingle_sets(batch.column(1), width):
                full = np.diff(bounds)
                total = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(s)), dtype=U64)]) for s in (1, 2)]
                n.append(full)
                h1.append((total[0][bounds[1:]] - total[0][bounds[:-1]]).view(np.int64))
                h2.append((total[1][bounds[1:]] - total[1][bounds[:-1]]).view(np.int64))
                regs += [r.tobytes() for r in registers(h, bounds)]
            if n:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(h1)),
                     pa.array(np.concatenate(h2)), pa.array(regs, pa.binary())], ["id", "n", "h1", "h2", "registers"])

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, registers binary")


def jaccard_likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 24) -> np.ndarray:
    """Maximum-likelihood similarity of register rows, given the set sizes."""
    over, under = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - over - under
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        above, below = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return (over * np.log(np.maximum(above, tiny)) + under * np.log(np.maximum(below, tiny))
                + equal * np.log(np.maximum(1 - above - below, tiny)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        third = (high - low) / 3
        worse = score(low + third) < score(high - third)
        low, high = np.where(worse, low + third, low), np.where(worse, high, high - third)
    return (low + high) / 2


def _rows(column: pa.Array, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=dtype) for v in as_bytes(column)]


def likely(pairs: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Pairs a, b whose estimate does not rule out the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                a, b = (np.stack(_rows(batch.column(c), "<u2")) for c in ("r_a", "r_b"))
                fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
                fits &= jaccard_likelihood(a, b, n_a, n_b) >= percent / 100 - MARGIN
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fits))

    side = sets.select("id", "n", "registers")
    both = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, full: DataFrame, percent: int, kind: str) -> DataFrame:
    """Pairs a, b that reach the threshold on their full sets."""

    def run(batches):
        for batch in batches:
            a, b = _rows(batch.column("s_a"), "<u8"), _rows(batch.column("s_b"), "<u8")
            fits = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                fits[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fits))

    both = pairs.join(full.toDF("a", "s_a"), "a").join(full.toDF("b", "s_b"), "b")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def against(pairs: DataFrame, full: DataFrame, kind: str) -> DataFrame:
    """a, b, common, extras: what the set of a has in common with that of b, and its shingles beyond."""

    def run(batches):
        for batch in batches:
            common, extras = [], []
            for x, y in zip(_rows(batch.column("s_a"), "<u8"), _rows(batch.column("s_b"), "<u8"), strict=True):
                extras.append(np.setdiff1d(x, y, assume_unique=True).view(np.int64))
                common.append(len(x) - len(extras[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(extras, pa.list_(pa.int64()))],
                ["a", "b", "common", "extras"])

    both = pairs.join(full.toDF("a", "s_a"), "a").join(full.toDF("b", "s_b"), "b")
    return both.mapInArrow(run, f"a {kind}, b {kind}, common long, extras array<long>")


def full_sets(docs: DataFrame, members: DataFrame, id: str, text: str, width: int, kind: str,
              chunk_bytes: int = CHUNK_BYTES, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """id, n, alone, shingles of the documents in ``members`` (distinct ids)."""
    size = X.corpus_bytes(docs, text)
    chunks = max(1, -(-size // chunk_bytes))
    block_bits = max(1, int(np.ceil(np.log2(max(size / 6 / block_keys, 2)))))
    # rows without an id are linked with nothing, however many there are
    base = docs.filter(F.col(id).isNotNull()).select(X.chunk_of([F.col(id)], chunks).alias("chunk"), F.col(id).alias("id"), F.col(text).alias("text"))
    wanted = members.select(X.chunk_of([F.col("id")], chunks).alias("chunk"), "id")

    def sets_of(table: pa.Table, ids: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
        own = table.filter(pc.is_in(table["id"], value_set=ids.combine_chunks()))
        found = [h[a:b] for h, bounds in shingle_sets(own["text"], width) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        first = {}
        for i, v in enumerate(own["id"].to_pylist()):
            first.setdefault(v, i)
        keep = list(first.values())
        return own["id"].take(pa.array(keep, pa.int64())), [found[i] for i in keep]

    def block(keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - block_bits)).astype(np.int64)

    def send(table: pa.Table, ids: pa.Table) -> pa.Table:
        if not table.num_rows or not ids.num_rows:
            return X.KEYS_PA.empty_table()
        _, sets = sets_of(table, ids["id"])
        (keys,), multi, _ = X.distinct([np.concatenate(sets)])
        return X.send(table["chunk"][0].as_py(), 1, [keys], multi, block(keys))

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = answers.filter(pc.is_valid(answers["id"]))["id"]
        names, sets = sets_of(table, ids) if table.num_rows and len(ids) else (pa.array([], table.schema.field("id").type), [])
        made = {"n": [len(h) for h in sets], "alone": [], "shingles": [h.tobytes() for h in sets]}
        if sets:
            (keys,), _, place = X.distinct([np.concatenate(sets)])
            replies = answers.filter(pc.is_valid(answers["stage"])).select(["stage", "block", "bits"]).to_pylist()
            again = X.found_bits(replies, 1, block(keys))[place]
            made["alone"] = [int((~x).sum()) for x in np.split(again, np.cumsum(made["n"])[:-1])]
        return pa.table({"id": names, "n": pa.array(made["n"], pa.int64()), "alone": pa.array(made["alone"], pa.int64()),
                         "shingles": pa.array(made["shingles"], pa.binary())})

    sent = base.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(send, X.KEYS_SCHEMA)
    replies = sent.groupBy("block").applyInArrow(X.answer(()), X.REPLY_SCHEMA)
    both = wanted.unionByName(replies, allowMissingColumns=True)
    return base.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, f"id {kind}, n long, alone long, shingles binary")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links a, b: alternating large and small stars."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        found = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = found
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = settle(small)


def meeting(index: DataFrame, percent: int) -> DataFrame:
    """hub, a, b, n_a, n_b, common_a, common_b: the pairs that may have enough shingles beyond their hub in common.

    ``index``: hub, id, extra, n, component, common, asks. A set of n shingles, c of them the hub's, reaches the threshold only
    with t = n * percent / 100 - c others in common. Its extras that another one has stand in an order of the hub, rare ones
    first: the first that a pair has in common is among the first m - t + 1 of the m of either, and what follows it in both
    must be long enough. So the extras that many hold are hardly ever compared.
    """
    held = index.groupBy("hub", "extra").agg(F.count("*").alias("held"), F.max("asks").alias("asked"), (F.min("component") != F.max("component")).alias("mixed"))
    shared = index.join(held.filter("asked AND mixed").select("hub", "extra", "held"), ["hub", "extra"])
    own = Window.partitionBy("hub", "id")
    ranked = shared.withColumn("place", F.row_number().over(own.orderBy("held", "extra"))).withColumn("after", F.count("*").over(own) - F.col("place"))
    need = F.greatest(F.lit(1), F.floor((percent * F.col("n") + 99) / 100) - F.col("common"))
    first = ranked.filter(F.col("after") + 1 >= need)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("n", "component", "common", "asks", "after")] + [F.col("id").alias(x)]
    most = F.least("common_a", "common_b") + 1 + F.least("after_a", "after_b")
    fits = (
        (F.col("component_a") != F.col("component_b")) & (~F.col("asks_b") | (F.col("a") < F.col("b")))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    )
    found = first.filter("asks").select("hub", "extra", *side("a")).join(first.select("hub", "extra", *side("b")), ["hub", "extra"]).filter(fits)
    return found.select("hub", "a", "b", "n_a", "n_b", "common_a", "common_b").distinct()


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    kind = docs.schema[id].dataType.simpleString()
    rows = settle(sketches(docs, id, text, width))
    sets = settle(
        rows.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n")
        .agg(F.min("id").alias("id"), F.first("registers").alias("registers"))
    )
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(
        i, F.substring(F.col("registers"), i * (2 * BAND) + 1, F.lit(2 * BAND)))))
    banded = sets.select("id", band.alias("key"))
    shared = banded.groupBy("key").agg(F.count("id").alias("size")).filter("size > 1").select("key")
    members = settle(banded.join(shared, "key").select("key", "id"))
    full = settle(full_sets(docs, members.select("id").distinct(), id, text, width, kind))
    shingles = full.select("id", "shingles")
    placed = members.join(full.select("id", "n", "alone"), "id")

    def possible(a: str, b: str) -> Column:
        """Whether the lone shingles leave room for the threshold."""
        common = F.least(F.col(f"n_{a}") - F.col(f"alone_{a}"), F.col(f"n_{b}") - F.col(f"alone_{b}"))
        return (100 + percent) * common >= percent * (F.col(f"n_{a}") + F.col(f"n_{b}"))

    def linked(pairs: DataFrame) -> DataFrame:
        return settle(verified(likely(pairs, sets, percent, kind), shingles, percent, kind))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    side = lambda x: ("key", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("alone").alias(f"alone_{x}"))
    hub = F.struct("id", "n", "alone")
    hubs = placed.groupBy("key").agg(
        F.min(hub).alias("low"), F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), hub.alias("hub")))["hub"].alias("central"))
    hubs = hubs.select("key", F.explode(F.array("low", "central")).alias("h")).select(
        "key", F.col("h.id").alias("b"), F.col("h.n").alias("n_b"), F.col("h.alone").alias("alone_b"))
    star = settle(ordered(placed.select(*side("a")).join(hubs, "key").filter((F.col("a") != F.col("b")) & possible("a", "b"))))
    links = linked(star)
    label = components(links)

    placed = placed.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("key", "component").agg(F.count("id").alias("size")).groupBy("key").agg(
        F.max(F.struct("size", "component"))["component"].alias("largest"), F.count("component").alias("components")
    ).filter("components > 1")
    chiefs = label.join(full.select("id", "n", "alone"), "id").groupBy(F.col("component").alias("largest")).agg(
        F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "id"))["id"].alias("hub"))
    able = 100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")
    placed = placed.filter(able).join(open_.select("key", "largest"), "key").join(chiefs, "largest", "left").select(
        "key", "id", "n", "component", F.coalesce("hub", "largest").alias("hub"), (F.col("component") != F.col("largest")).alias("asks"))
    placed = settle(placed)
    beyond = settle(against(placed.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), shingles, kind))
    placed = placed.join(beyond.select(F.col("a").alias("id"), F.col("b").alias("hub"), "common"), ["id", "hub"])
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("n", "component", "common", "asks")] + [F.col("id").alias(x)]
    apart = (F.col("component_a") != F.col("component_b")) & F.col("asks_a") & (~F.col("asks_b") | (F.col("a") < F.col("b")))

    def reaches(common: Column) -> Column:
        return (100 + percent) * common >= percent * (F.col("n_a") + F.col("n_b"))

    close = placed.filter(100 * F.col("common") >= percent * F.col("n"))
    by_hub = close.filter("asks").select("key", *side("a")).join(close.select("key", *side("b")), "key").filter(
        apart & reaches(F.least("common_a", "common_b")))
    index = placed.drop("key").distinct().join(
        beyond.select(F.col("a").alias("id"), F.col("b").alias("hub"), F.explode("extras").alias("extra")), ["id", "hub"])
    arrays = beyond.select(F.col("b").alias("hub"), F.col("a").alias("id"), "extras")
    met = meeting(index, percent).join(arrays.toDF("hub", "a", "x_a"), ["hub", "a"]).join(arrays.toDF("hub", "b", "x_b"), ["hub", "b"]).filter(
        reaches(F.least("common_a", "common_b") + F.size(F.array_intersect("x_a", "x_b"))))
    cross = ordered(by_hub.select("a", "b").unionByName(met.select("a", "b"))).join(star, ["a", "b"], "left_anti")
    label = components(links.unionByName(linked(cross)))

    named = sets.select("h1", "h2", "n", "id").join(label, "id", "left").select(
        "h1", "h2", "n", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def op5_near_dedup(spark, sf_dir):
    """Near-duplicate group of every document."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLE_SQL = {
    "op5_near_dedup": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * c >= 75 * (m.n + n.n - c)
), reach AS (SELECT doc_id, doc_id AS other FROM texts UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM texts t JOIN groups g ON g.doc_id = t.doc_id LEFT JOIN sizes s ON s.doc_id = t.doc_id""",
}
