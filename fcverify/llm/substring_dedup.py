"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one document. A word is removed when a window that
covers it occurs, as a sequence of words, anywhere else in the corpus, the same document included.

1. Every chunk of documents sketches its windows: the cells of a count-min row (a hash cut to
   ``log2(width)`` bits) with counts 1 or more. Block tasks merge the partial sketches of all
   chunks; a merged count never falls below a window's true count, so a cell counted once proves
   its window unique. The row has ``SPREAD`` cells for each window of the corpus, so few unique
   windows are estimated repeated.
2. Only windows in cells counted twice or more are grouped exactly, by 96-bit fingerprints.
3. Every document is rewritten without the words its repeated windows cover.

Partial sketches travel as sorted cell lists (2 to 3 bytes a window) and the verdicts as one bit a
cell, so a window never becomes a row. The text is shuffled once, by chunk.

Defined cases: null text and a text of fewer words than a window keep all their words (none for
null); repeated rows are separate documents; a null id is an id like any other; other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm import exchange as X
from fcverify.llm.words import Texts, Words, covered, texts

SPREAD = 16
CHUNK_BYTES = 4 << 20
BLOCK_KEYS = 4 << 20
SKETCH, EXACT = 1, 2


def _chunk_windows(column: pa.Array, window: int, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes by seed of all windows of a chunk."""
    parts = [t.words(seeds).windows(window)[1] for t in texts(column)]
    return [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=X.U64) for _ in seeds]


def _flagged(hashes: np.ndarray, replies: list[dict], cell_bits: int, block_bits: int) -> np.ndarray:
    """Windows in cells that the merged sketch counts twice or more."""
    cells = hashes >> X.U64(64 - cell_bits)
    keys, _, place = X.distinct([cells])
    return X.found_bits(replies, SKETCH, _block(keys[0], cell_bits, block_bits))[place]


def _block(cells: np.ndarray, cell_bits: int, block_bits: int) -> np.ndarray:
    return (cells >> X.U64(cell_bits - block_bits)).astype(np.int64)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 35,
                   chunk_bytes: int = CHUNK_BYTES, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """Per row: id, n_words, n_removed and the kept words joined by single spaces."""
    size = X.corpus_bytes(docs, text)
    chunks = max(1, -(-size // chunk_bytes))
    windows = max(size // 2, 1)  # a word takes two bytes at least
    cell_bits = min(62, int(np.ceil(np.log2(windows * SPREAD))))
    block_bits = max(1, int(np.ceil(np.log2(max(windows / 3 / block_keys, 2)))))
    base = docs.select(
        X.chunk_of([F.col(id), F.col(text)], chunks).alias("chunk"), F.col(id).alias("id"), F.col(text).alias("text")
    )

    def sketch(table: pa.Table) -> pa.Table:
        (h,) = _chunk_windows(table["text"], window, (0,))
        keys, multi, _ = X.distinct([h >> X.U64(64 - cell_bits)])
        return X.send(table["chunk"][0].as_py(), SKETCH, keys, multi, _block(keys[0], cell_bits, block_bits))

    def exact(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return X.KEYS_PA.empty_table()
        h, second = _chunk_windows(table["text"], window, (0, 1))
        on = _flagged(h, replies.to_pylist(), cell_bits, block_bits)
        keys, multi, _ = X.distinct([h[on], second[on].astype(np.uint32)])
        return X.send(table["chunk"][0].as_py(), EXACT, keys, multi, _block(keys[0], 64, block_bits))

    id_type = base.schema["id"].dataType.simpleString()

    def rewrite(table: pa.Table, replies: pa.Table) -> pa.Table:
        answers = replies.to_pylist()
        slices = list(texts(table["text"]))
        found = None
        if any(r["stage"] == EXACT for r in answers):
            h, second = _chunk_windows(table["text"], window, (0, 1))
            on = _flagged(h, answers, cell_bits, block_bits)
            keys, _, place = X.distinct([h[on], second[on].astype(np.uint32)])
            found = np.zeros(len(h), dtype=bool)
            found[on] = X.found_bits(answers, EXACT, _block(keys[0], 64, block_bits))[place]
        n_words, n_removed, kept, at = [], [], [], 0
        for t in slices:
            w = t.words(())
            first, _ = w.windows(window)
            hit = first[found[at:at + len(first)]] if found is not None else first[:0]
            at += len(first)
            _cut(t, w, covered(hit, window, len(w)), n_words, n_removed, kept)
        return pa.table({"id": table["id"], "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    sketched = base.groupBy("chunk").applyInArrow(sketch, X.KEYS_SCHEMA)
    seen = sketched.groupBy("block").applyInArrow(X.answer(()), X.REPLY_SCHEMA)
    grouped = base.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(exact, X.KEYS_SCHEMA)
    repeated = grouped.groupBy("block").applyInArrow(X.answer(("uint32",)), X.REPLY_SCHEMA)
    return (
        base.groupBy("chunk").cogroup(seen.unionByName(repeated).groupBy("chunk"))
        .applyInArrow(rewrite, f"id {id_type}, n_words long, n_removed long, kept string")
        .withColumnRenamed("id", id)
    )


def _cut(t: Texts, w: Words, gone: np.ndarray, n_words: list, n_removed: list, kept: list) -> None:
    data = t.bytes.tobytes()
    for i in range(len(t)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        n_words.append(b - a)
        stay = np.flatnonzero(~gone[a:b]) + a
        n_removed.append(b - a - len(stay))
        kept.append(b" ".join([data[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]).decode())


def op3_substring_dedup(spark, sf_dir):
    """Words of every document that no repeated 35-word window covers."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL = {
    "op3_substring_dedup": r"""
WITH texts AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35)
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.j) AS words, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM texts) p ANTI JOIN covered c ON c.doc_id = p.doc_id AND c.j = p.j
  GROUP BY p.doc_id
)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id""",
}
