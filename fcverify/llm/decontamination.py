"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document that holds at least ``percent`` % of its distinct ``width``-word
shingles (A-Z lower-cased; items of fewer words are compared as one run of all their words).

A short item inside a long document has almost no Jaccard similarity with it. So items are
partitioned by size, powers of two, and a document is seen, for each partition, as overlapping
windows about as large as its items: windows of four times the partition's smallest size, one
starting at every half. An item that stands in a document lies whole in one of them. Items and windows are
compared by one-permutation MinHash: hashes fall into bins (``BINS`` for each shingle of a window)
and the smallest of each bin is the signature; one equal bin makes a candidate. A shingle of the item
is the smallest of its bin with probability above 1 - 1/BINS, so an item with k shingles present is
overlooked with probability below BINS**-k (``TINY_BINS`` for items of under 8 shingles).

Every candidate is verified at once on the whole document by exact containment. A document's window
signature is only worked out for bins where it holds an item's value, as no other bin can be equal.

Documents are scanned in place, without a shuffle. Items are taken in blocks of ``block_items``, one
scan a block, so a task holds one block whatever the number of items.

Defined cases: null documents hold nothing; null items and items without words are found nowhere;
repeated documents give a row each, repeated items too; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from fcverify.llm.words import U64, texts, window_hash

WIDTH, PERCENT = 5, 75
BINS, TINY_BINS = 16, 1 << 16
BLOCK_ITEMS = 20_000
SCREEN_BITS = 22
SLICE = 256 << 10


@dataclass
class Item:
    id: object
    width: int
    shingles: np.ndarray

    @property
    def window(self) -> int:
        """Shingles in a window of this item's partition."""
        return 4 << (len(self.shingles).bit_length() - 1)

    @property
    def bins(self) -> int:
        return self.window * (TINY_BINS if len(self.shingles) < 8 else BINS)

    def signature(self) -> np.ndarray:
        """The smallest hash of every bin in use."""
        h = self.shingles  # ascending, so the first of a bin is its smallest
        _, first = np.unique(h & U64(self.bins - 1), return_index=True)
        return h[first]


class Block:
    """Items of one width with an index from signature values to items."""

    def __init__(self, width: int, items: list[Item]):
        self.width, self.items = width, items
        made = [i.signature() for i in items]
        values = np.concatenate(made)
        owner = np.repeat(np.arange(len(items)), [len(m) for m in made])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.screen = np.zeros(1 << SCREEN_BITS, dtype=bool)
        self.screen[self.values >> U64(64 - SCREEN_BITS)] = True

    def found(self, h: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Items (place, shingles present) inside one document, from the hashes of all its shingles."""
        at = np.flatnonzero(self.screen[h >> U64(64 - SCREEN_BITS)])
        low, high = np.searchsorted(self.values, h[at], "left"), np.searchsorted(self.values, h[at], "right")
        hits = defaultdict(list)
        for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for i in self.owner[a:b].tolist():
                hits[i].append(p)
        out, own = [], None
        for i, places in hits.items():
            item = self.items[i]
            if any(smallest_in_window(h, p, item.window, item.bins) for p in places):
                own = np.unique(h) if own is None else own
                shared = len(np.intersect1d(own, item.shingles, assume_unique=True))
                if 100 * shared >= percent * len(item.shingles):
                    out.append((i, shared))
        return out


def smallest_in_window(h: np.ndarray, p: int, window: int, bins: int) -> bool:
    """Whether shingle p is the smallest of its bin in a window that holds it."""
    half = window // 2
    for j in (p // half, p // half - 1):
        if j >= 0:
            part = h[j * half:j * half + window]
            if not ((part < h[p]) & ((part ^ h[p]) & U64(bins - 1) == 0)).any():
                return True
    return False


def read_items(rows: list[tuple[object, str | None]], width: int) -> list[Item]:
    column = pa.array([t for _, t in rows], pa.string())
    out = []
    for t in texts(column):
        w = t.words((0,), fold=True)
        for i in range(len(t)):
            own = w.hashes[0][w.first[i]:w.first[i + 1]]
            if len(own):
                k = min(width, len(own))
                out.append(Item(rows[t.first + i][0], k, np.unique(window_hash(own, k, 101))))
    return out


def search(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", width: int = WIDTH, percent: int = PERCENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Per document and item found in it: id, item_id, n_item, n_shared (distinct shingles), containment."""
    kinds = docs.schema[id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{id}` {kinds[0]}, `{item_id}` {kinds[1]}, n_item long, n_shared long, containment double"
    rows = items.select(F.col(item_id), F.col(item_text))
    out = None
    for block in _blocks(rows, block_items):
        found = _scan(docs.select(F.col(id), F.col(text)), read_items(block, width), percent, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _blocks(rows: DataFrame, size: int):
    """The items on the driver, one block after another."""
    block = []
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _scan(docs: DataFrame, items: list[Item], percent: int, schema: str) -> DataFrame:
    by_width = defaultdict(list)
    for i in items:
        by_width[i.width].append(i)
    held = docs.sparkSession.sparkContext.broadcast(dict(by_width))
    item_type = to_arrow_type(_parse_datatype_string(schema)[1].dataType)

    def run(batches):
        blocks = [Block(width, own) for width, own in held.value.items()]
        for batch in batches:
            place, item, n_item, n_shared = [], [], [], []
            for t in texts(batch.column(1), SLICE):
                w = t.words((0,), fold=True)
                for block in blocks:
                    at, (h,) = w.windows(block.width)
                    screened = block.screen[h >> U64(64 - SCREEN_BITS)]
                    bounds = np.searchsorted(at, w.first)
                    for i in np.unique(w.text[at[screened]]).tolist():
                        for k, shared in block.found(h[bounds[i]:bounds[i + 1]], percent):
                            place.append(t.first + i), item.append(block.items[k].id)
                            n_item.append(len(block.items[k].shingles)), n_shared.append(shared)
            if place:
                share = np.array(n_shared) / np.array(n_item)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(place, pa.int64())), pa.array(item, item_type), pa.array(n_item, pa.int64()),
                     pa.array(n_shared, pa.int64()), pa.array(share)],
                    [*batch.schema.names[:1], "item", "n_item", "n_shared", "containment"])

    return docs.mapInArrow(run, schema)


def op2_decontamination(spark, sf_dir):
    """Benchmark items found in documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE_SQL = {
    "op2_decontamination": r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
), sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE kind = 'i' AND len(w) > 0
), shingles AS (
  SELECT DISTINCT kind, id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT kind, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes
        WHERE len(w) >= k AND (kind = 'd' OR k = least(len(w), 5)))
), items AS (SELECT id, k, count(*) AS n_item FROM shingles WHERE kind = 'i' GROUP BY id, k)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_shared, count(*) / any_value(n_item) AS containment
FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.k = i.k AND d.s = i.s JOIN items ON items.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(n_item)""",
}
