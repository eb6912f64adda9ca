"""Suffix-array dedup of byte strings.

A byte is removed when a string of ``length`` bytes that covers it starts anywhere else in the
corpus as well. Suffixes are range-partitioned by sampled splitters on their leading token (the
first eight bytes, ties by the fingerprint that stands for the following ones), each bucket sorts
its suffixes by multikey quicksort, and equal neighbours are repeats. Splitters cut only between
different keys, so neighbours that are equal over the compared length never stand in two buckets.

Not every suffix has to be sorted. The anchor of a start p is the leftmost smallest hash of the
``GRAM``-byte strings starting in [p, p + SPAN): it lies inside the string of p and depends on it
alone, so repeated strings have equal anchors. Three sorts follow one another:

1. anchors: suffixes at anchors, compared over ``GRAM`` bytes. A start is a candidate when all the
   anchors inside its string occur again; this leaves repeats and little else.
2. stretches: consecutive candidate starts with one anchor, as one string. Where the whole string
   occurs again, all its starts are repeats.
3. suffixes: the single starts of stretches whose anchor has a stretch that does not, each
   compared over all ``length`` bytes (eight bytes and a 64-bit fingerprint of the whole string).

Keys travel packed by chunk and block, answers as bits (see ``exchange``); the text is shuffled
once. Defined cases: null text is empty; texts shorter than ``length`` keep everything; repeated
rows are separate documents; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm import exchange as X
from fcverify.llm.words import as_bytes, byte_table, covered, prefix_hash, span_hash

GRAM, SPAN = 40, 80
PLACE_BITS = 23
PIECE_BYTES = 1 << 20
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 32 << 20
SAMPLES_PER_BLOCK = 50
ANCHORS, STRETCHES, MIXED, SUFFIXES = 1, 2, 3, 4


class Pieces:
    """Texts (or overlapping parts of very long ones) side by side, with the starts each has to judge."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], length: int):
        self.parts = parts
        self.bytes = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint8)
        sizes = np.array([len(p[2]) for p in parts], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        n, reach = len(self.bytes), GRAM + SPAN - 1
        left = np.repeat(self.offsets[1:], sizes) - np.arange(n)
        self.has_anchor = left >= reach
        self.has_string = left >= length
        self.prefix = prefix_hash(byte_table(11)[self.bytes], 11)
        at = np.arange(max(n - GRAM + 1, 0))
        self.gram = span_hash(self.prefix, at, at + GRAM, 11)
        self.anchor = np.full(n, -1, dtype=np.int64)
        if n >= reach:
            low = X.U64((1 << PLACE_BITS) - 1)
            least = (self.gram & ~low) | at.astype(X.U64)
            span = 1
            while 2 * span <= SPAN:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            rest = SPAN - span
            least = np.minimum(least[:len(least) - rest], least[rest:])
            self.anchor[:len(least)] = (least & low).astype(np.int64)
        self.anchor[~self.has_anchor] = -1

    def lead(self, at: np.ndarray) -> np.ndarray:
        """The first eight bytes of suffixes as one number that sorts like them."""
        out = np.zeros(len(at), dtype=X.U64)
        for i in range(8):
            out = (out << X.U64(8)) | self.bytes[at + i].astype(X.U64)
        return out

    def anchors(self) -> np.ndarray:
        """Distinct anchor places."""
        a = self.anchor[self.has_anchor]
        return a[np.flatnonzero(np.diff(a, prepend=-1))]

    def candidates(self, repeated: np.ndarray, length: int) -> np.ndarray:
        """Starts whose anchors all occur again; ``repeated`` has a bit per distinct anchor place."""
        on = np.zeros(len(self.bytes), dtype=bool)
        on[self.anchors()[repeated]] = True
        missing = np.zeros(len(self.bytes) + 1, dtype=np.int64)
        np.cumsum(~(on[self.anchor] & self.has_anchor), out=missing[1:])
        p = np.flatnonzero(self.has_string)
        return p[missing[p + length - (GRAM + SPAN - 1) + 1] == missing[p]]

    def stretches(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last starts of runs of consecutive starts with one anchor."""
        if not len(starts):
            return starts, starts
        cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(self.anchor[starts]) != 0))
        return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


def pieces(column: pa.Array, length: int) -> Iterator[Pieces]:
    """All texts of a column; a text above ``PIECE_BYTES`` in parts that share length - 1 bytes."""
    parts, size = [], 0
    for i, value in enumerate(as_bytes(column)):
        data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
        for at in range(0, max(len(data), 1), PIECE_BYTES):
            parts.append((i, at, data[at:at + PIECE_BYTES + length - 1]))
            size += len(parts[-1][2])
            if size >= PIECE_BYTES:
                yield Pieces(parts, length)
                parts, size = [], 0
    if parts:
        yield Pieces(parts, length)


def block_of(splitters: np.ndarray, lead: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Bucket of each key; a leading token that fills several buckets is cut by the tie value."""
    low, high = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
    share = (tie >> X.U64(32)).astype(np.int64) if tie.dtype == X.U64 else tie.astype(np.int64)
    return np.where(high > low, low + ((share * (high - low + 1)) >> 32), low)


def stretch_rule(parts: X.Parts, multi: np.ndarray, stage: int) -> dict[int, np.ndarray]:
    """Stretches that occur again, and those whose anchor has one that does not."""
    found = X.repeated_keys(parts, multi, stage)[stage]
    new = ~X.same_as_before(parts[:2])
    group = np.cumsum(new) - 1
    open_ = np.bincount(group, weights=~found) > 0
    return {STRETCHES: found, MIXED: open_[group]}


class Judge:
    """The three sorts as a chunk sees them: what it sends, and what the answers so far say."""

    def __init__(self, column: pa.Array, length: int, splitters: np.ndarray, replies: list[dict]):
        self.length, self.splitters, self.replies = length, splitters, replies
        self.pieces = list(pieces(column, length))

    def _gather(self, made: list[X.Parts], kinds: tuple[type, ...]) -> X.Parts:
        return [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0, k) for k in kinds]

    def _sorted(self, parts: X.Parts):
        keys, multi, place = X.distinct(parts)
        return keys, multi, place, block_of(self.splitters, keys[0], keys[1])

    def _spread(self, stage: int, parts: X.Parts, sizes: list[int]) -> list[np.ndarray]:
        """The answers of a stage for each piece."""
        _, _, place, block = self._sorted(parts)
        return np.split(X.found_bits(self.replies, stage, block)[place], np.cumsum(sizes)[:-1]) if sizes else []

    def anchor_keys(self) -> X.Parts:
        made = []
        for p in self.pieces:
            at = p.anchors()
            made.append([p.lead(at), p.gram[at].astype(np.uint32)])
        self.anchor_sizes = [len(m[0]) for m in made]
        return self._gather(made, (X.U64, np.uint32))

    def stretch_keys(self) -> X.Parts:
        bits = self._spread(ANCHORS, self.anchor_keys(), self.anchor_sizes)
        made, self.runs = [], []
        for p, b in zip(self.pieces, bits, strict=True):
            first, last = p.stretches(p.candidates(b, self.length)) if b.any() else (np.zeros(0, np.int64),) * 2
            self.runs.append((first, last))
            a = p.anchor[first]
            made.append([p.lead(a), p.gram[a], span_hash(p.prefix, first, last + self.length, 11)])
        self.run_sizes = [len(f) for f, _ in self.runs]
        return self._gather(made, (X.U64,) * 3)

    def suffix_keys(self) -> X.Parts:
        keys = self.stretch_keys()
        self.whole = self._spread(STRETCHES, keys, self.run_sizes)
        mixed = self._spread(MIXED, keys, self.run_sizes)
        made, self.singles = [], []
        for p, (first, last), m in zip(self.pieces, self.runs, mixed, strict=True):
            at = expand(first[m], last[m])
            self.singles.append(at)
            made.append([p.lead(at), span_hash(p.prefix, at, at + self.length, 11)])
        return self._gather(made, (X.U64,) * 2)

    def repeated(self) -> Iterator[tuple[Pieces, np.ndarray]]:
        """Each piece with the starts of its repeated strings."""
        bits = self._spread(SUFFIXES, self.suffix_keys(), [len(s) for s in self.singles])
        for p, (first, last), whole, at, b in zip(self.pieces, self.runs, self.whole, self.singles, bits, strict=True):
            yield p, np.union1d(expand(first[whole], last[whole]), at[b])

    def send(self, chunk: int, stage: int, parts: X.Parts) -> pa.Table:
        keys, multi, _, block = self._sorted(parts)
        return X.send(chunk, stage, keys, multi, block)


def expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the runs first..last."""
    sizes = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(first) else first


def sampled_splitters(docs: DataFrame, text: str, size: int, length: int, blocks: int) -> np.ndarray:
    """Leading tokens that cut the suffixes into ``blocks`` about equal ranges.

    From the suffixes at every ``step``-th byte of all texts, as many as ``SAMPLES_PER_BLOCK`` a block.
    """
    step = max(1, size // (blocks * SAMPLES_PER_BLOCK))
    body = F.col(text).cast("binary")
    # the first sampled place of a text is spread over the step, so that short texts are sampled in proportion
    start = F.pmod(F.xxhash64(F.col(text)), F.lit(step)) + 1
    n = F.octet_length(F.col(text))
    rows = (
        docs.filter(n >= start + 7).select(F.explode(F.transform(F.sequence(start, n - 7, F.lit(step)), lambda i: F.substring(body, i.cast("int"), F.lit(8)))).alias("lead"))
    )
    found = rows.toArrow()["lead"].to_pylist()
    leads = np.sort(np.array([int.from_bytes(v, "big") for v in found], dtype=X.U64))
    at = (np.arange(1, blocks) * len(leads)) // blocks
    return leads[at] if len(leads) else leads


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 200,
                   chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes."""
    if length < GRAM + SPAN - 1:
        raise ValueError(f"length must be at least {GRAM + SPAN - 1}")
    size = X.corpus_bytes(docs, text)
    chunks = max(1, -(-size // chunk_bytes))
    splitters = sampled_splitters(docs, text, size, length, max(2, -(-size // block_bytes)))
    base = docs.select(
        X.chunk_of([F.col(id), F.col(text)], chunks).alias("chunk"), F.col(id).alias("id"), F.col(text).alias("text")
    )
    id_type = base.schema["id"].dataType.simpleString()

    def first(table: pa.Table) -> pa.Table:
        judge = Judge(table["text"], length, splitters, [])
        return judge.send(table["chunk"][0].as_py(), ANCHORS, judge.anchor_keys())

    def later(stage: int, keys: str):
        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows or not replies.num_rows:
                return X.KEYS_PA.empty_table()
            judge = Judge(table["text"], length, splitters, replies.to_pylist())
            return judge.send(table["chunk"][0].as_py(), stage, getattr(judge, keys)())

        return run

    def rewrite(table: pa.Table, replies: pa.Table) -> pa.Table:
        values = as_bytes(table["text"])
        gone = [None] * len(values)
        for p, starts in Judge(table["text"], length, splitters, replies.to_pylist()).repeated() if replies.num_rows else ():
            hit = covered(starts, length, len(p.bytes))
            for (i, at, data), a in zip(p.parts, p.offsets[:-1], strict=True):
                own = hit[a:a + len(data)]
                if own.any():
                    if gone[i] is None:
                        gone[i] = np.zeros(len(values[i].as_buffer()), dtype=bool)
                    gone[i][at:at + len(data)] |= own
        removed, spans, kept = [], [], []
        for value, g in zip(values, gone, strict=True):
            data = value.as_buffer()
            if g is None:
                removed.append(0), spans.append(0), kept.append(data.to_pybytes())
            else:
                removed.append(int(g.sum()))
                spans.append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])))
                kept.append(np.frombuffer(data, np.uint8)[~g].tobytes())
        sizes = [len(v.as_buffer()) for v in values]
        return pa.table({"id": table["id"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    def sorted_keys(sent: DataFrame, dtypes: tuple[str, ...], rule=X.repeated_keys) -> DataFrame:
        return sent.groupBy("block").applyInArrow(X.answer(dtypes, rule), X.REPLY_SCHEMA)

    def with_chunks(replies: DataFrame, run, schema: str) -> DataFrame:
        return base.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)

    replies = sorted_keys(base.groupBy("chunk").applyInArrow(first, X.KEYS_SCHEMA), ("uint32",))
    sent = with_chunks(replies, later(STRETCHES, "stretch_keys"), X.KEYS_SCHEMA)
    replies = replies.unionByName(sorted_keys(sent, ("uint64", "uint64"), stretch_rule))
    sent = with_chunks(replies, later(SUFFIXES, "suffix_keys"), X.KEYS_SCHEMA)
    replies = replies.unionByName(sorted_keys(sent, ("uint64",)))
    return with_chunks(
        replies, rewrite, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary"
    ).withColumnRenamed("id", id)


def op7_suffix_dedup(spark, sf_dir):
    """Bytes of every document that no repeated 200-byte string covers."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
