"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

Each text is tokenised in full by both, as a space and the text. Byte offsets where a token of A and
a token of B both end cut the tokens into groups; a token of A and one of B are linked where their
byte ranges overlap.

Whitespace-token anchors make this cheap. An anchor is a shared end, verified on the running byte
lengths of both, before tokens that carry a space, or the end of the text. Anchors split a document
into windows of token ids. A window's groups and links depend on its ids alone, so they are worked
out once per distinct pair of id tuples and remembered (``ALIGNED``, per Python worker).

Texts are taken in slices of a few MB. A slice numbers the id pairs it holds; a document keeps its
pairs as packed numbers with multiplicities, and the slice keeps, per pair, in how many of its
documents the pair is linked. Spark adds these up over the corpus (partial sums first), finds the
highest count of each A id, and joins the counts back to the slices that asked. No task holds the
corpus-wide table; an A id has at most one row per B id.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space + text, have
no tokens: zeros and an empty digest; repeated rows are separate documents and count as such; a null id
is an id like any other; strings of special tokens inside texts are plain text; a text longer than a
slice is a slice of its own; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fcverify.llm import exchange as X
from fcverify.llm import token_ids
from fcverify.llm.words import U64, mix, prefix_hash, span_hash, texts
from fcverify.session import settle

SLICE_BYTES = 4 << 20
REMEMBERED = 200_000
B_BITS = 32
#: Stands between the ids of A and B in the key of a window; no id has this value.
BETWEEN = b"\xff\xff\xff\xff"

class Aligner:
    """Both tokenizers and the remembered windows."""

    def __init__(self, file_a: str, model_b: str):
        self.tools = [token_ids.byte_level(file_a, True), token_ids.piece_level(model_b)]
        self.encoder = token_ids.Encoder(self.tools)
        self.usable = all(t.sizes.all() for t in self.tools)
        self.sizes = [t.sizes for t in self.tools]
        #: ids as text, each with what follows it: inside a group, and at the end of its side of the group
        self.names = [f"{i}{sign}" for i in range(len(self.sizes[0])) for sign in ",|"] + [f"{i}{sign}" for i in range(len(self.sizes[1])) for sign in ",;"]
        self.space_a = np.array([t.startswith(b" ") for t in self.tools[0].tokens])
        #: groups by the packed id tuples; those of the last but one generation are kept as long as this one fills
        self.known: dict[bytes, str] = {}
        self.older: dict[bytes, str] = {}

    def tokens(self, value: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where the text counts as without tokens."""
        if not value:
            return None
        found = self.encoder.after_space(value)
        for tool, (ids, exact) in zip(self.tools, found, strict=True):
            if not exact and tool.bytes_of(ids.tolist()) != b" " + value.encode() or not self.usable and not tool.sizes[ids].all():
                return None
        return found[0][0], found[1][0]

    def windows(self, made: list[tuple[np.ndarray, np.ndarray]]):
        """Ids of all texts joined, first tokens of the windows in both (and the ends), first window and groups of each text."""
        a, b = (np.concatenate([m[i] for m in made]) for i in (0, 1))
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.zeros(int(ends_a[-1]) + 1, dtype=bool)
        at[ends_b] = True
        shared = at[ends_a]
        bounds = np.cumsum([0, *[len(m[0]) for m in made]])
        anchor = np.zeros(len(a), dtype=bool)
        anchor[:-1] = shared[:-1] & self.space_a[a[1:]]
        anchor[bounds[1:] - 1] = True  # whole texts have the same bytes
        edge_a = np.flatnonzero(anchor) + 1
        edge_b = np.searchsorted(ends_b, ends_a[edge_a - 1]) + 1
        first = np.concatenate([[0], np.searchsorted(edge_a, bounds[1:]) + 1])
        groups = np.diff(np.concatenate([[0], np.cumsum(shared)])[bounds])
        return a, b, np.concatenate([[0], edge_a]), np.concatenate([[0], edge_b]), first, groups

    def distinct(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One window of each kind, and the kind of every window; hashes propose, equal ids decide."""
        hashed = span_hash(prefix_hash(mix(a.astype(U64) + U64(1)), 301), wa[:-1], wa[1:], 301) ^ mix(
            span_hash(prefix_hash(mix(b.astype(U64) + U64(1)), 302), wb[:-1], wb[1:], 302) + U64(7))
        _, one, kind = np.unique(hashed, return_index=True, return_inverse=True)
        for ids, w in ((a, wa), (b, wb)):
            size = np.diff(w)
            same = size == size[one[kind]]
            if same.all():
                inner = np.arange(len(ids)) - np.repeat(w[:-1], size)
                same = ids == ids[np.repeat(w[:-1][one[kind]], size) + inner]
            if not same.all():  # two windows share a hash: tell them apart by their ids
                seen: dict[tuple, int] = {}
                kind = np.array([seen.setdefault((tuple(a[p:q].tolist()), tuple(b[r:s].tolist())), len(seen))
                                 for p, q, r, s in zip(wa, wa[1:], wb, wb[1:], strict=False)])
                return np.unique(kind, return_index=True)[1], kind
        return one, kind

    def groups(self, a, b, wa, wb, one) -> list[str]:
        """Groups of each kind of window; ``one`` is a window of each."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        bytes_a, bytes_b = a.tobytes(), b.tobytes()
        keys = [bytes_a[p:q] + BETWEEN + bytes_b[r:s] for p, q, r, s in zip(
            *((4 * x).tolist() for x in (wa[one], wa[one + 1], wb[one], wb[one + 1])), strict=True)]
        out = [self.known.get(k) or self.older.get(k) for k in keys]
        new = [i for i, found in enumerate(out) if found is None]
        if new:
            for i, found in zip(new, self.align(a, b, wa, wb, one[new]), strict=True):
                out[i] = found
        self.known.update(zip(keys, out, strict=True))
        return out

    def _gathered(self, a, b, wa, wb, one):
        """Per side: the ids of some windows joined, their byte ends, and the end of each window."""
        for own, w, sizes in ((a, wa, self.sizes[0]), (b, wb, self.sizes[1])):
            size = (w[1:] - w[:-1])[one]
            last = np.cumsum(size)
            ids = own[np.arange(last[-1]) + np.repeat(w[one] - last + size, size)].astype(np.int64)
            yield ids, np.cumsum(sizes[ids]), last

    def align(self, a, b, wa, wb, one) -> list[str]:
        """Groups of some windows as text: tokens up to each end that both sides share, those of A first."""
        (ids_a, ends_a, last_a), (ids_b, ends_b, last_b) = self._gathered(a, b, wa, wb, one)
        at = np.zeros((2, int(ends_a[-1]) + 1), dtype=bool)
        at[0, ends_a] = at[1, ends_b] = True
        closes_a, closes_b = at[1, ends_a], at[0, ends_b]
        stop_a, stop_b = (np.flatnonzero(c) + 1 for c in (closes_a, closes_b))  # tokens up to the end of each group
        group_a, group_b = (np.cumsum(c) - c for c in (closes_a, closes_b))
        names = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        names[np.arange(len(ids_a)) + np.concatenate([[0], stop_b])[group_a]] = 2 * ids_a + closes_a
        names[np.arange(len(ids_b)) + stop_a[group_b]] = 2 * (len(self.sizes[0]) + ids_b) + closes_b
        made, ends = list(map(self.names.__getitem__, names.tolist())), (last_a + last_b).tolist()
        return ["".join(made[p:q])[:-1] for p, q in zip([0, *ends], ends, strict=False)]

    def links(self, a, b, wa, wb, one) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs (a << 32 | b) of the windows ``one``, and how many each has.

        Every end of a token of either side closes one link: that of the two tokens before it.
        """
        (ids_a, ends_a, last_a), (ids_b, ends_b, _) = self._gathered(a, b, wa, wb, one)
        closes = np.zeros(int(ends_a[-1]) + 1, dtype=bool)
        closes[ends_a] = closes[ends_b] = True
        at = np.flatnonzero(closes)
        pairs = ids_a[np.searchsorted(ends_a, at)] << B_BITS | ids_b[np.searchsorted(ends_b, at)]
        return pairs, np.diff(np.searchsorted(at, ends_a[last_a - 1], "right"), prepend=0)


@lru_cache(maxsize=1)
def aligner(file_a: str, model_b: str) -> Aligner:
    return Aligner(file_a, model_b)


def _pack_links(at: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted numbers and their multiplicities, in as few bytes as the largest multiplicity needs."""
    kind = "<u1" if times.max(initial=0) < 256 else "<u4"
    return bytes([int(kind[2])]) + len(at).to_bytes(4, "little") + times.astype(kind).tobytes() + X.pack(at.astype(U64))


def _unpack_links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, n = data[0], int.from_bytes(data[1:5], "little")
    times = np.frombuffer(data, f"<u{size}", n, 5).astype(np.int64)
    return X.unpack(data[5 + size * n:], n).astype(np.int64), times


def slice_rows(tool: Aligner, values: list[str | None], groups: bool) -> tuple[dict[str, list], bytes]:
    """Columns of the texts of a slice, and its packed pairs: number of documents, A id and B id of each."""
    n = len(values)
    out = {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n, "groups_sha256": [""] * n, "links": [b""] * n}
    out |= {"groups": [""] * n} if groups else {}
    found = [(i, t) for i, v in enumerate(values) if (t := tool.tokens(v)) is not None]
    if not found:
        return out, b""
    a, b, wa, wb, first, count = tool.windows([t for _, t in found])
    one, kind = tool.distinct(a, b, wa, wb)
    text = tool.groups(a, b, wa, wb, one)
    pairs, size = tool.links(a, b, wa, wb, one)
    pairs, number = np.unique(pairs, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])

    total = size[kind]  # links of each window, then the number of every link and its document
    where = np.repeat(begin[:-1][kind] - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(int(total.sum()))
    links_first = np.concatenate([[0], np.cumsum(total)])[first]
    document = np.repeat(np.arange(len(found)), np.diff(links_first))
    held, times = np.unique(document * len(pairs) + number[where], return_counts=True)
    document, held = held // len(pairs), held % len(pairs)
    of = np.searchsorted(document, np.arange(len(found) + 1))
    kinds = kind.tolist()
    for k, (i, (ids_a, ids_b)) in enumerate(found):
        joined = ";".join(map(text.__getitem__, kinds[first[k]:first[k + 1]]))
        out["n_a"][i], out["n_b"][i] = len(ids_a), len(ids_b)
        out["n_groups"][i] = int(count[k])
        out["n_links"][i] = int(links_first[k + 1] - links_first[k])
        out["groups_sha256"][i] = hashlib.sha256(joined.encode()).hexdigest()
        out["links"][i] = _pack_links(held[of[k]:of[k + 1]], times[of[k]:of[k + 1]])
        if groups:
            out["groups"][i] = joined
    documents = np.bincount(held, minlength=len(pairs))
    return out, documents.astype("<u4").tobytes() + X.pack(pairs.astype(U64)) + len(pairs).to_bytes(4, "little")


def aligned(docs: DataFrame, file_a: str, model_b: str, id: str = "doc_id", text: str = "text", groups: bool = False,
            slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of the documents (``pairs`` null) and one row with the packed pairs of each slice; written once."""
    kind = docs.schema[id].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = f"slice long, id {kind}, " + ", ".join(f"{c} long" for c in numbers) + ", groups_sha256 string, links binary"
    schema += ", groups string" * groups + ", pairs binary"

    def run(batches):
        tool, n = aligner(file_a, model_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for t in texts(batch.column(1), slice_bytes):
                values = batch.column(1).slice(t.first, len(t)).to_pylist()
                columns, pairs = slice_rows(tool, values, groups)
                made = {"slice": pa.array([n] * len(values), pa.int64()), "id": batch.column(0).slice(t.first, len(t))}
                made |= {c: pa.array(columns[c], pa.int64()) for c in numbers}
                made |= {c: pa.array(v, pa.binary() if c == "links" else pa.string()) for c, v in columns.items() if c not in numbers}
                made["pairs"] = pa.nulls(len(values), pa.binary())
                yield pa.RecordBatch.from_pydict(made)
                own = {c: pa.nulls(1, v.type) for c, v in made.items()} | {"slice": pa.array([n], pa.int64()), "pairs": pa.array([pairs], pa.binary())}
                yield pa.RecordBatch.from_pydict(own)
                n += 1

    return settle(docs.select(F.col(id), F.col(text)).mapInArrow(run, schema))


def _slice_pairs(rows: DataFrame) -> DataFrame:
    """slice, at (number within the slice), a, b, n (documents of the slice)."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not data:
                    continue
                n = int.from_bytes(data[-4:], "little")
                pairs = X.unpack(data[4 * n:-4], n).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(np.full(n, name)), "at": pa.array(np.arange(n, dtype=np.int32)),
                    "a": pa.array((pairs >> B_BITS).astype(np.int32)), "b": pa.array((pairs & ((1 << B_BITS) - 1)).astype(np.int32)),
                    "n": pa.array(np.frombuffer(data, "<u4", n).astype(np.int64))})

    return rows.filter("pairs IS NOT NULL").select("slice", "pairs").mapInArrow(run, "slice long, at int, a int, b int, n long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n: in how many documents of the corpus an id pair is linked; best: whether no other b has more for this a."""
    counts = _slice_pairs(rows).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def alignment(docs: DataFrame, file_a: str, model_b: str, id: str = "doc_id", text: str = "text", groups: bool = False,
              slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and with ``groups`` the groups)."""
    rows = aligned(docs, file_a, model_b, id, text, groups, slice_bytes)
    counts = pair_counts(rows).toDF("of_a", "of_b", "of_n", "best")
    asked = _slice_pairs(rows).join(counts, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")))
    answers = asked.select(F.col("slice").alias("of"), "at", F.col("of_n").alias("n"), "best")
    documents = rows.filter("pairs IS NULL").drop("pairs")
    kind = rows.schema["id"].dataType.simpleString()
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if groups else []), "groups_sha256"]
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long" + ", groups string" * groups + ", groups_sha256 string, n_best long, count_sum long"

    def finish(own: pa.Table, known: pa.Table) -> pa.Table:
        n, best = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
        at = known["at"].to_numpy()
        n[at], best[at] = known["n"].to_numpy(), known["best"].to_numpy()
        sums, hits = [], []
        for data in own["links"].to_pylist():
            if not data:
                sums.append(0), hits.append(0)
                continue
            which, times = _unpack_links(data)
            sums.append(int((n[which] * times).sum())), hits.append(int(times[best[which]].sum()))
        return own.select(kept).append_column("n_best", pa.array(hits, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    made = documents.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(finish, schema)
    return made.withColumnRenamed("id", id).select(id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *(["groups"] if groups else []), "groups_sha256")


def op12_token_alignment(spark, sf_dir):
    """Alignment digest of every document for the byte-level and the piece tokenizer."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLE_SQL: dict[str, str] = {}
