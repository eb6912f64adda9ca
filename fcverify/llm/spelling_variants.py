"""Spelling variant grouping by permuterm rotations.

A word is marked with a terminator and rotated at every place: ``b$a`` for word ``ab``. Two words near
each other, by one replaced, inserted or deleted character, meet in a prefix range of the sorted
rotations that skips the edited character:

* ``a x b`` and ``a y b`` have the rotations ``b$a x`` and ``b$a y``, equal up to the last character;
* ``a b`` has the whole rotation ``b$a``, which is that same prefix.

So each word gives one prefix per character (the rotation that ends with it, without it) and one whole
rotation per place. Spark sorts them and scans each group of equal prefixes; a group holds one word per
letter of the alphabet and the shorter word, so it is small however large the corpus. A group tells its
members how many neighbours they have there and which of them is the most frequent; pairs are never
written out. A deletion inside a run of equal characters shows at several places and counts at the
first of the run only.

The form of a word is its most frequent neighbour (ties: first in code-point order) when that is
``ratio`` times as frequent; roots follow forms to the last one. Forms grow by the factor ``ratio``, so
a chain has at most log(largest count) links and a few rounds of pointer jumping reach its end.

Words travel as their place in the sorted word list. Prefixes of words longer than ``LONG`` code points
are replaced by 128-bit hashes of the rotation from running sums, so a very long word costs its length, not
its square.

Counting: runs of letters of whole texts, lower-cased in A-Z, are counted per slice of texts with
hashes inside Arrow, then summed by Spark with partial sums, so a frequent word or a hot document is a
few rows. With ``noise`` a run loses a character where a checksum of id and run is divisible by it.

Defined cases: null and empty texts have no words; a null id is empty in the checksum; repeated rows
count again; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fcverify.llm.words import U64, Texts, mix, prefix_hash, span_hash, texts
from fcverify.session import settle

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
NOISE = 199
LONG = 64
MARK = "$"
SLICE_BYTES = 8 << 20
#: How a word belongs to a prefix: the whole rotation, or all but its edited character (at the first of equal ones or not).
WHOLE, EDIT, EDIT_AGAIN = 0, 1, 2

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def letter_runs(t: Texts, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes), code points and text of the runs of letters with at least ``least`` code points."""
    data, bounds = t.bytes, t.bounds
    if not len(data):
        return (np.zeros(0, np.int64),) * 4
    follows = (data & 0xC0) == 0x80
    inside = _LETTER[data]
    inside[1:] |= follows[1:] & (data[:-1] == 0xC3)  # U+00C0 to U+00FF are 0xC3 and one byte
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    points = np.concatenate([[0], np.cumsum(~follows)])
    size = points[ends] - points[starts]
    keep = size >= least
    starts, ends, size = starts[keep], ends[keep], size[keep]
    return starts, ends, size, np.searchsorted(bounds, starts, "right") - 1


def checksums(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-32 of spans, each continued from a state: all spans advance one byte at a time together."""
    size = ends - starts
    out = states.copy()
    long = np.flatnonzero(size > 4 * LONG)
    for i in long.tolist():
        out[i] = np.uint32(zlib.crc32(lower[starts[i]:ends[i]].tobytes(), int(states[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    order = order[len(long):]
    size, at, state = size[order], starts[order], out[order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    for j, k in enumerate(active.tolist()):
        state[:k] = _CRC[(state[:k] ^ lower[at[:k] + j]) & 255] ^ (state[:k] >> np.uint32(8))
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


def slice_counts(t: Texts, names: list[str], least: int, noise: int | None) -> pa.RecordBatch:
    """word, n of some texts."""
    starts, ends, size, owner = letter_runs(t, least)
    lower = _LOWER[t.bytes]
    changed: Counter[str] = Counter()
    if noise and len(starts):
        states = np.array([zlib.crc32(f"{n}:".encode()) ^ 0xFFFFFFFF for n in names], dtype=np.uint32)
        sums = checksums(lower, starts, ends, states[owner])
        hit = sums % np.uint32(noise) == 0
        for i in np.flatnonzero(hit).tolist():
            word, gone = lower[starts[i]:ends[i]].tobytes().decode(), int(sums[i]) % int(size[i])
            if len(word) > least:
                changed[word[:gone] + word[gone + 1:]] += 1
        starts, ends = starts[~hit], ends[~hit]
    edge = np.zeros(len(lower) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    joined = lower[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    counts = pc.value_counts(words)
    word = pa.concat_arrays([counts.field("values").cast(pa.string()), pa.array(list(changed), pa.string())])
    n = pa.concat_arrays([counts.field("counts").cast(pa.int64()), pa.array(list(changed.values()), pa.int64())])
    return pa.RecordBatch.from_arrays([word, n], ["word", "n"])


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                noise: int | None = None) -> DataFrame:
    """word, n of the lower-cased letter runs of all texts."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            for t in texts(batch.column(1), SLICE_BYTES):
                yield slice_counts(t, names[t.first:t.first + len(t)], min_length, noise)

    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")), F.col(text)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _rotations(word: str) -> tuple[list[str], list[int]]:
    """Prefixes of a word and how it belongs to them; those over ``LONG`` code points as hashes."""
    size = len(word)
    edits = [EDIT if i == 0 or word[i] != word[i - 1] else EDIT_AGAIN for i in range(size)]
    marked = word + MARK + word if size <= LONG else ""
    own = [marked[i + 1:i + 1 + size] for i in range(size)] if marked else []
    if size < LONG:
        return own + [marked[i:i + size + 1] for i in range(size + 1)], edits + [WHOLE] * (size + 1)
    points = mix(np.array([ord(c) for c in word], dtype=U64) + U64(1))
    sums = [prefix_hash(points, seed) for seed in (401, 402)]

    def names(first_end: np.ndarray, second_start: np.ndarray) -> list[str]:
        """Hashes of the rotations word[second_start:] $ word[:first_end]."""
        zero, end = np.zeros(len(first_end), np.int64), np.full(len(first_end), size)
        made = [mix(span_hash(p, second_start, end, s) * U64(3) + span_hash(p, zero, first_end, s) * U64(7) + U64(s))
                for s, p in zip((401, 402), sums, strict=True)]
        return [f"{size - (b - a) + 1} {x:016x}{y:016x}" for a, b, x, y in zip(first_end.tolist(), second_start.tolist(), *(m.tolist() for m in made), strict=True)]

    at = np.arange(size + 1)
    return (own or names(at[:-1], at[1:])) + names(at, at), edits + [WHOLE] * (size + 1)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, how, place, n of all rotations of the words."""

    def run(batches):
        for batch in batches:
            place, n = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            prefixes, how, owner, of = [], [], [], []
            for p, word, k in zip(place, batch.column(1).to_pylist(), n, strict=True):
                own, kinds = _rotations(word)
                prefixes += own
                how += kinds
                owner += [p] * len(own)
                of += [k] * len(own)
                if len(prefixes) > 200_000:
                    yield _rotation_batch(prefixes, how, owner, of)
                    prefixes, how, owner, of = [], [], [], []
            yield _rotation_batch(prefixes, how, owner, of)

    return words.select("place", "word", "n").mapInArrow(run, "prefix string, how byte, place long, n long")


def _rotation_batch(prefixes: list[str], how: list[int], place: list[int], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), pa.array(how, pa.int8()), pa.array(place, pa.int64()),
                                       pa.array(n, pa.int64())], ["prefix", "how", "place", "n"])


def neighbours(words: DataFrame) -> DataFrame:
    """place, n_near and the most frequent neighbour (struct ``best``: minus its count, its place) of words with neighbours.

    Where a word is itself the most frequent of a group, the group names it no neighbour: none there is more frequent.
    """
    group = Window.partitionBy("prefix")
    own = F.struct((-F.col("n")).alias("less"), F.col("place").alias("place"))
    whole, edit, first = F.col("how") == WHOLE, F.col("how") != WHOLE, F.col("how") == EDIT
    seen = rotations(words).select(
        "place", "how", own.alias("own"),
        F.count(F.when(edit, 1)).over(group).alias("edits"), F.count(F.when(first, 1)).over(group).alias("firsts"),
        F.count(F.when(whole, 1)).over(group).alias("wholes"),
        F.min(F.when(edit, own)).over(group).alias("best_edit"), F.min(F.when(first, own)).over(group).alias("best_first"),
        F.min(F.when(whole, own)).over(group).alias("best_whole"))
    other = F.when(F.col("best_edit") != F.col("own"), F.col("best_edit"))
    near = F.when(whole, F.col("firsts")).when(first, F.col("edits") - 1 + F.col("wholes")).otherwise(F.col("edits") - 1)
    best = F.when(whole, F.col("best_first")).when(first, F.least(other, F.col("best_whole"))).otherwise(other)
    told = seen.select("place", near.alias("near"), best.alias("best")).filter("near > 0")
    return told.groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, rounds: int) -> DataFrame:
    """place, to: the end of the chain that starts with each link (place, to), by pointer jumping."""
    reach = settle(links)
    for _ in range(rounds):
        beyond = reach.toDF("of", "beyond")
        reach = settle(reach.join(beyond, F.col("to") == F.col("of"), "left").select("place", F.coalesce("beyond", "to").alias("to")))
    return reach


def variants(counts: DataFrame, ratio: int = RATIO, min_count: int = MIN_COUNT) -> DataFrame:
    """Per word of ``counts`` (word, n; words distinct): word, form, root, n, n_near, form_n."""
    words = settle(counts.select("word", "n").orderBy("word").withColumn("place", F.monotonically_increasing_id()))
    near = neighbours(words).select(F.col("place").alias("of"), "n_near", "best")
    known = settle(words.join(near, F.col("place") == F.col("of"), "left").select(
        "word", "n", "place", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")))
    links = known.filter("best IS NOT NULL").select("place", F.col("best.place").alias("to"))
    top = words.agg(F.max("n")).first()[0] or 1
    chain = max(1.0, math.log(max(top / min_count, 1)) / math.log(ratio))
    ends = roots(links, math.ceil(math.log2(chain + 1)))
    names = words.select(F.col("place").alias("named"), F.col("word").alias("name"))
    found = ends.select(F.col("place").alias("of"), F.col("to").alias("root_place"))
    told = known.filter("best IS NOT NULL").join(found, F.col("place") == F.col("of")).select(
        "place", F.col("best.place").alias("form_place"), (-F.col("best.less")).alias("form_n"), "root_place")
    forms = told.join(names.toDF("f", "form"), F.col("form_place") == F.col("f")).join(
        names.toDF("r", "root"), F.col("root_place") == F.col("r")).select(F.col("place").alias("of"), "form", "root", "form_n")
    return known.join(forms, F.col("place") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(word_counts(docs, noise=NOISE))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE_SQL = {
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (
  SELECT w, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS named FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w
), summed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(hex(encode(named))) / 2 AS BIGINT) + 1), lambda k: CAST('0x' || hex(encode(named))[2 * k - 1:2 * k] AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, crc
), changed AS (
  SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM summed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, word[1:i - 1] AS a, word[i + 1:] AS b, i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word
), near AS (
  SELECT word, count(*) AS n_near, max(m) AS top, min({'less': -m, 'word': other}) AS best FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN best.word END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN near USING (word)
), followed AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT f.word, x.form FROM followed f JOIN formed x ON x.word = f.at WHERE x.form IS NOT NULL
)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN followed r ON r.word = f.word JOIN formed e ON e.word = r.at AND e.form IS NULL""",
}
