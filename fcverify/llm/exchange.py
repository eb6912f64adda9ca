"""Which keys of a corpus occur again: an exchange of packed key lists instead of one row per key.

Documents are dealt into chunks by a hash of the row. A chunk sends each block (a range of keys)
its distinct keys, sorted and packed; the block's task finds the keys seen more than once and
answers each chunk with one bit per key it sent. Keys that a chunk repeats count once per chunk
with a flag, so a passage that a third of all documents hold is one entry per chunk in its block.

Chunk tasks are pure functions of their rows: a lost executor recomputes the same keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
KEYS_SCHEMA = "block long, chunk long, stage int, n long, keys binary, more binary, multi binary"
REPLY_SCHEMA = "chunk long, stage int, block long, bits binary"
KEYS_PA = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("stage", pa.int32()), ("n", pa.int64()),
                     ("keys", pa.binary()), ("more", pa.binary()), ("multi", pa.binary())])
REPLY_PA = pa.schema([("chunk", pa.int64()), ("stage", pa.int32()), ("block", pa.int64()), ("bits", pa.binary())])


def corpus_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column: one aggregate row."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def chunk_of(columns: list[Column], chunks: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(chunks))


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values: the first one, then byte planes of the differences, as many as the largest needs."""
    if not len(values):
        return b""
    steps = np.diff(values).astype("<u8")
    planes = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return values[:1].astype("<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=U64)
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8)
    if n > 1:
        steps[1:, :(len(data) - 8) // (n - 1)] = np.frombuffer(data, np.uint8, offset=8).reshape(-1, n - 1).T
    return np.cumsum(steps.view("<u8").ravel().astype(U64), dtype=U64)


Parts = list[np.ndarray]


def same_as_before(parts: Parts) -> np.ndarray:
    """Of sorted keys, which equal the one before."""
    same = np.ones(len(parts[0]), dtype=bool)
    same[:1] = False
    for p in parts:
        same[1:] &= p[1:] == p[:-1]
    return same


def multikey_order(parts: Parts) -> np.ndarray:
    """Multikey sort: by the first part, then only the runs of ties by the following parts."""
    order = np.argsort(parts[0], kind="quicksort")
    if len(parts) > 1 and len(order) > 1:
        first = parts[0][order]
        tie = np.zeros(len(first), dtype=bool)
        tie[1:] = first[1:] == first[:-1]
        tie[:-1] |= tie[1:]
        at = np.flatnonzero(tie)
        inner = order[at]
        order[at] = inner[np.lexsort([p[inner] for p in reversed(parts)])]
    return order


def distinct(parts: Parts) -> tuple[Parts, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether each occurs again, and the place of every input key."""
    order = multikey_order(parts)
    ordered = [p[order] for p in parts]
    new = ~same_as_before(ordered)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return [p[at] for p in ordered], np.diff(np.append(at, len(order))) > 1, place


def send(chunk: int, stage: int, parts: Parts, multi: np.ndarray, block: np.ndarray) -> pa.Table:
    """One row per block from sorted distinct keys; ``block`` does not decrease along them."""
    at = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    rows = []
    for a, b in zip(at, [*at[1:], len(block)], strict=True) if at else ():
        rows.append({"block": int(block[a]), "chunk": chunk, "stage": stage, "n": b - a, "keys": pack(parts[0][a:b]),
                     "more": b"".join(p[a:b].tobytes() for p in parts[1:]), "multi": np.packbits(multi[a:b]).tobytes()})
    return pa.Table.from_pylist(rows, schema=KEYS_PA)


def repeated_keys(parts: Parts, multi: np.ndarray, stage: int) -> dict[int, np.ndarray]:
    """Rule: of sorted keys, those sent twice or flagged by their chunk."""
    same = same_as_before(parts)
    found = same | multi
    found[:-1] |= same[1:]
    return {stage: found}


def answer(dtypes: tuple[str, ...], rule: Callable[[Parts, np.ndarray, int], dict[int, np.ndarray]] = repeated_keys) -> Callable[[pa.Table], pa.Table]:
    """Block task: sort the keys of all chunks, apply the rule, return each chunk the bits of its keys."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [np.concatenate([unpack(r["keys"], r["n"]) for r in rows])]
        split = [_columns(r["more"], r["n"], dtypes) for r in rows]
        parts += [np.concatenate(c) for c in zip(*split, strict=True)]
        multi = np.concatenate([np.unpackbits(np.frombuffer(r["multi"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        order = multikey_order(parts)
        out = []
        for stage, found in rule([p[order] for p in parts], multi[order], rows[0]["stage"]).items():
            bits = np.empty(len(found), dtype=bool)
            bits[order] = found
            at = 0
            for r in rows:
                own = bits[at:at + r["n"]]
                at += r["n"]
                if own.any():
                    out.append({"chunk": r["chunk"], "stage": stage, "block": r["block"], "bits": np.packbits(own).tobytes()})
        return pa.Table.from_pylist(out, schema=REPLY_PA)

    return run


def _columns(data: bytes, n: int, dtypes: tuple[str, ...]) -> Parts:
    out, at = [], 0
    for t in dtypes:
        out.append(np.frombuffer(data, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out


def found_bits(replies: Iterable[dict], stage: int, block: np.ndarray) -> np.ndarray:
    """Bit of each sorted distinct key of a stage, from the answers of its blocks."""
    bits = np.zeros(len(block), dtype=bool)
    for r in replies:
        if r["stage"] == stage:
            a, b = np.searchsorted(block, [r["block"], r["block"] + 1])
            bits[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(b - a)).astype(bool)
    return bits
