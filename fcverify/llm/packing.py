"""Best-fit packing by patterns.

Documents become token ids plus an end id; ids beyond ``capacity`` are cut from the end into pieces
of ``capacity`` ids, so the first piece of a document may be shorter. The packing itself only sees
the histogram of piece lengths (``capacity`` numbers at most, whatever the corpus):

1. Patterns of two and three lengths that fill a sequence exactly are enumerated, and repeat counts
   are fitted to the histogram by non-negative least squares (projected gradient).
2. Counts are rounded down to whole sequences and cut to the pieces there are.
3. The residual histogram is packed best fit, largest length first, again as patterns: each pattern
   is repeated as often as its lengths last, so the number of steps depends on ``capacity`` alone.

A piece's rank within its length picks its pattern repeat, so placing is a lookup in a plan of
bounded size; ranks come from salted groups, as one length may hold a third of all pieces.

Defined cases: null text is empty and has the end id alone; repeated rows are separate documents; a
null id is an id like any other; a text that holds the name of an added token gets its id, as the
library does it; runs of white space may be as long as a text can be; an empty table packs to no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fcverify.llm import token_ids
from fcverify.session import settle

CAPACITY = 2048
MIDDLE_LENGTHS = 48
FIT_STEPS = 400
SALT_ROWS = 50_000
#: Split of the byte-level pre-tokenizer (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WHITE = 50_000
LONG_RUN = re.compile(rf"\s{{{LONG_WHITE}}}")


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Function text -> ids of a BPE file of ``tokenizers``.

    A file with the usual byte-level split, no normalizer and ids in the order of its merges runs in tiktoken,
    which then gives the same ids several times faster. Texts that hold an added token or a very long run of
    white space, and all texts of other files, go through ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    added = [t["content"] for t in made["added_tokens"]]
    tool = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(tool.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if not same_in_ranks(made):
        return slow
    ranks = {t: i for i, t in enumerate(token_ids.byte_level_bytes(path)) if t.decode("utf-8", "replace") not in added}
    fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(a in text for a in added) or (len(text) >= LONG_WHITE and LONG_RUN.search(text)):
            return slow(text)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


def same_in_ranks(made: dict) -> bool:
    """Whether a file's encoding is that of its ids as ranks with the split ``SPLIT``."""
    split, model = made.get("pre_tokenizer") or {}, made["model"]
    if made.get("normalizer") or made.get("truncation") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges"):
        return False
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"].get(a + b, -1) for a, b in pairs]
    singles = [i for t, i in model["vocab"].items() if len(t) == 1]
    return len(singles) == 256 and max(singles) < order[0] and all(x < y for x, y in zip(order, order[1:], strict=False))


def pieces(docs: DataFrame, tokenizer: str, id: str, text: str, capacity: int, end_id: int, tokens: bool) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and with ``tokens`` the ids."""
    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", tokens array<long>" * tokens

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            place, number, start, length, crc, held = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for n, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    place.append(i), number.append(n), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if tokens:
                        held.append(ids[a:b].astype(np.int64))
            columns = [batch.column(0).take(pa.array(place, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if tokens:
                columns, names = [*columns, pa.array(held, pa.list_(pa.int64()))], [*names, "tokens"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id), F.col(text)).mapInArrow(run, schema)


def fill_patterns(have: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the capacity, of lengths that occur."""
    lengths = np.flatnonzero(have)
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    pairs = np.flatnonzero(((a + b) == capacity) & (a >= b))
    made = [np.stack([a.ravel()[pairs], b.ravel()[pairs], np.zeros(len(pairs), np.int64)], axis=1)]
    # middle lengths for triples: evenly spaced by the mass of the histogram
    mass = np.cumsum(have)
    middle = np.unique(np.searchsorted(mass, np.linspace(0, mass[-1], MIDDLE_LENGTHS + 2)[1:-1]))
    a, b = (x.ravel() for x in np.meshgrid(lengths, middle, indexing="ij"))
    c = capacity - a - b
    fits = (c > 0) & (c <= a)
    fits[fits] &= have[c[fits]] > 0
    triples = np.sort(np.stack([a[fits], b[fits], c[fits]], axis=1), axis=1)[:, ::-1]
    return np.unique(np.concatenate([*made, triples]), axis=0)


def fit_counts(patterns: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose lengths come closest to the histogram in the sum of squares."""
    x = np.zeros(len(patterns))
    if not len(x):
        return x
    size = len(have)

    def made(x):
        out = np.bincount(patterns.ravel(), np.repeat(x, 3), size)
        out[0] = 0
        return out

    used = made(np.ones(len(x)))
    # column-wise steps: a pattern's step is one over the number of patterns its lengths share
    step = 1.0 / np.maximum(used[patterns].max(axis=1) * 3, 1)
    momentum, t = x, 1.0
    for _ in range(FIT_STEPS):
        gap = have - made(momentum)
        gap[0] = 0
        new = np.maximum(momentum + step * gap[patterns].sum(axis=1), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def packing_plan(have: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, largest first) with repeat counts that use every piece exactly once."""
    left = have.astype(np.int64).copy()
    plan = []
    if left[capacity]:
        plan.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    patterns = fill_patterns(left, capacity) if left.any() else np.zeros((0, 3), np.int64)
    counts = fit_counts(patterns, left.astype(float))
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] < 1:
            break
        lengths = [int(v) for v in patterns[i] if v]
        times = min(int(counts[i]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if times > 0:
            plan.append((lengths, times))
            for v in lengths:
                left[v] -= times
    while left.any():
        space, lengths, rest = capacity, [], left.copy()
        while True:
            fits = np.flatnonzero(rest[1:space + 1])
            if not len(fits):
                break
            v = int(fits[-1]) + 1
            take = min(int(rest[v]), space // v)
            lengths += [v] * take
            rest[v] -= take
            space -= take * v
        times = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        plan.append((lengths, times))
        for v in lengths:
            left[v] -= times
    return plan


def slots(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows length, first rank, first sequence, offset, in order of length and rank."""
    out, used, sequence = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for v in lengths:
            out.append((v, used.get(v, 0), sequence, offset))
            used[v] = used.get(v, 0) + times
            offset += v
        sequence += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = 0, tokens: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, with ``tokens``)."""
    cut = settle(pieces(docs, tokenizer, id, text, capacity, end_id, tokens))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    have = np.zeros(capacity + 1, dtype=np.int64)
    for v, n in counts.items():
        have[v] = n
    table = slots(packing_plan(have, capacity))
    starts = table[:, 0] << 44 | table[:, 1]

    salts = max(1, -(-int(have.max()) // SALT_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within)).join(groups, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.col("nth") - 1)
    names, schema = cut.columns, _schema(cut)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, schema).withColumnRenamed("id", id)


def _schema(cut: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"


def op10_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
