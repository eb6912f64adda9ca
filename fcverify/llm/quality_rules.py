"""Quality rules with cross-document line frequency.

Base measures of every text (words, repeated words, duplicate lines, symbols) give ``base_failed``.
The method's verdict comes from lines that many documents of a host share:

1. A line is normalised (lower case, digits to 0, white space runs to one space, trimmed) and hashed.
2. Per host the distinct documents holding a line are counted. A document is its text here: copies of one
   text count as one, as copies alone must not turn that text's own lines into boilerplate (near-dedup
   deals with them).
3. Lines found in more than ``max(limit, share * documents of the host)`` documents are removed.
4. A document is depleted, and rejected, when lines were removed and fewer than ``min_left`` words,
   or less than ``min_share`` of its words, are left.

What is removed from a text, and the verdict, depend on host and text alone. They are worked out once per
distinct (host, text), named by 128 bits of hashes, and joined back to every row, whatever its id. Texts are
parsed once (``parsed``); counting is two aggregations with partial sums, so neither a host with a third of all
rows nor a line in most documents meets in one task. Adaptive execution splits a text that is a third of all
rows where rows are joined back.

Defined cases: null text has no words and fails the base rule; a null host is a host of its own; repeated rows,
repeated and null ids are judged row by row; other columns pass through untouched in ``clean`` and ``judged``, whatever
their names, and are not read by ``quality``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fcverify.llm.words import Texts, covered, texts
from fcverify.session import settle

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
LIMIT = 20
SHARE = 0.0005
MIN_SHARE, MIN_LEFT = 0.6, 20
SLICE = 256 << 10
SYMBOLS = b"[#*$%&|<>]"[1:-1]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, t: Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[t.bounds[1:]] - total[t.bounds[:-1]]


def measure(t: Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of some texts."""
    w = t.words((0, 1))
    n = np.diff(w.first)
    inside = np.zeros(len(t.bytes) + 1, dtype=np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    head = (t.bytes & 0xC0) != 0x80  # first byte of a code point
    chars = _per_text(head & (np.cumsum(inside[:-1], dtype=np.int8) > 0), t)
    symbols = _per_text(_SYMBOL[t.bytes], t)
    return [n, chars, symbols, _duplicate_lines(t, w), _repeat_words(w, len(t))]


def _duplicate_lines(t: Texts, w) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text, by their bytes."""
    out = np.zeros(len(t), dtype=np.int64)
    data = t.bytes.tobytes()
    for i, (a, b) in enumerate(zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True)):
        if data.find(b"\n", a, b) >= 0:
            lines = [x for x in data[a:b].split(b"\n") if x and not x.isspace()]
            out[i] = len(lines) - len(set(lines))
    return out


def _repeat_words(w, n: int) -> np.ndarray:
    """Words inside 8-word windows that the text holds twice or more, the first included."""
    at, (h, second) = w.windows(REPEAT_WINDOW)
    if not len(at):
        return np.zeros(n, dtype=np.int64)
    owner = w.text[at]
    order = np.lexsort((second, h, owner))
    same = (h[order[1:]] == h[order[:-1]]) & (second[order[1:]] == second[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    hit = np.zeros(len(at), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    total = np.concatenate([[0], np.cumsum(covered(at[hit], REPEAT_WINDOW, len(w)))])
    return total[w.first[1:]] - total[w.first[:-1]]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_DIGITS = bytes(48 if 48 <= i <= 57 else i for i in range(256))


def normalised(line: bytes) -> bytes:
    """Lower case, digits to 0, white space runs to one space, trimmed."""
    low = line.lower() if line.isascii() else line.decode().lower().encode()
    return b" ".join(low.translate(_DIGITS).split())


def line_words(text: bytes) -> dict[int, int]:
    """Hash of each distinct normalised line with a word, and the words of all its occurrences."""
    out: dict[int, int] = {}
    for raw in text.split(b"\n"):
        line = normalised(raw)
        if line:
            key = line_hash(line)
            out[key] = out.get(key, 0) + line.count(b" ") + 1
    return out


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _named(docs: DataFrame, text: str, host: str) -> list[Column]:
    """host_key, d1, d2: what the verdict of a row depends on."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host_key"),
            F.xxhash64(value).alias("d1"), F.xxhash64(F.lit(7), value).alias("d2")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``parsed``. Hashes take 40 to 80 times the bytes of a slice, and a worker keeps what it once took."""
    line_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
    for batch in batches:
        for t in texts(batch.column(4), SLICE):
            rows = batch.slice(t.first, len(t))
            own = [line_words(v.encode()) if v else {} for v in rows.column(4).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
            items = pa.StructArray.from_arrays([pa.array([k for x in own for k in x], pa.int64()), pa.array([w for x in own for w in x.values()], pa.int64())], ["line", "words"])
            columns = [pa.array(c.astype(np.int64)) for c in measure(t)]
            yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in range(4)], *columns, pa.ListArray.from_arrays(offsets, items).cast(line_type)],
                                             ["id", "host_key", "d1", "d2", *MEASURES, "lines"])


def parsed(docs: DataFrame, id: str, text: str, host: str) -> DataFrame:
    """Per row: id, host_key, d1, d2, the five counts, and lines (line, words); written once."""
    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, host_key string, d1 long, d2 long, " + ", ".join(f"{n} long" for n in MEASURES) + ", lines array<struct<line:bigint,words:bigint>>"
    return settle(docs.select(F.col(id), *_named(docs, text, host), F.col(text)).mapInArrow(_parse, schema))


def frequent_lines(found: DataFrame, limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """host_key, line of the lines in too many of the distinct documents of their host (host_key, d1, d2, lines)."""
    counts = found.select("host_key", F.explode("lines.line").alias("line")).groupBy("host_key", "line").agg(
        F.count("*").alias("documents")).filter(F.col("documents") > limit)
    hosts = found.filter(F.size("lines") > 0).groupBy(F.col("host_key").alias("of_host")).agg(F.count("*").alias("of"))
    return counts.join(hosts, F.col("host_key") == F.col("of_host")).filter(F.col("documents") > F.col("of") * share).select("host_key", "line")


def removals(rows: DataFrame, limit: int, share: float) -> DataFrame:
    """of_host, of_d1, of_d2, removed_words and gone (hashes of the lines) of each distinct document that loses lines."""
    found = rows.groupBy("host_key", "d1", "d2").agg(F.first("lines").alias("lines"))
    frequent = frequent_lines(found, limit, share).toDF("f_host", "f_line")
    lines = found.select("host_key", "d1", "d2", F.explode("lines").alias("x"))
    hit = lines.join(frequent, (F.col("x.line") == F.col("f_line")) & (F.col("host_key") == F.col("f_host")))
    return hit.groupBy(F.col("host_key").alias("of_host"), F.col("d1").alias("of_d1"), F.col("d2").alias("of_d2")).agg(
        F.sum("x.words").alias("removed_words"), F.collect_list("x.line").alias("gone"))


def verdicts(rows: DataFrame, min_words: int, limit: int, share: float, min_share: float, min_left: int) -> DataFrame:
    """``rows`` with base_failed, removed_words, gone, kept."""
    gone = removals(rows, limit, share)
    same = (F.col("host_key") == F.col("of_host")) & (F.col("d1") == F.col("of_d1")) & (F.col("d2") == F.col("of_d2"))
    joined = rows.drop("lines").join(gone, same, "left").drop("of_host", "of_d1", "of_d2").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0)))
    n, removed = F.col("n_words"), F.col("removed_words")
    left = n - removed
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    depleted = (removed > 0) & ((left < min_left) | (left < min_share * n))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = MIN_WORDS,
            limit: int = LIMIT, share: float = SHARE, min_share: float = MIN_SHARE, min_left: int = MIN_LEFT) -> DataFrame:
    """Per row: id, the base counts, base_failed, removed_words, kept."""
    found = verdicts(parsed(docs, id, text, host), min_words, limit, share, min_share, min_left)
    return found.select(F.col("id").alias(id), *MEASURES, "base_failed", "removed_words", "kept")


def judged(docs: DataFrame, text: str = "text", host: str = "source", reject: bool = True, min_words: int = MIN_WORDS,
           limit: int = LIMIT, share: float = SHARE, min_share: float = MIN_SHARE, min_left: int = MIN_LEFT) -> DataFrame:
    """``docs`` with the frequent lines of their host cut out of the texts, and without the rejected rows."""
    rows = parsed(docs.withColumn(_free("id", docs), F.lit(0)), _free("id", docs), text, host)
    one = rows.dropDuplicates(["host_key", "d1", "d2"])
    told = verdicts(one, min_words, limit, share, min_share, min_left).filter("NOT kept OR removed_words > 0").select(
        F.struct("host_key", "d1", "d2").alias("of"), F.struct(F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"), "kept").alias("told"))
    all_ = F.struct(*docs.columns).alias("doc")  # the row in one column: no name can clash
    joined = docs.select(all_, F.struct(*_named(docs, text, host)).alias("key")).join(told, F.col("key") == F.col("of"), "left")
    if reject:
        joined = joined.filter(F.coalesce("told.kept", F.lit(True)))
    # the join sorts copies of a text together: dealt anew, no batch of a later step holds copies of a very long one alone
    joined = joined.select("doc", "told").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = F.col("doc").getField(text)
    cut = F.when(F.size("told.gone") > 0, without_lines(whole, F.col("told.gone"))).otherwise(whole)
    return joined.select(*[(cut if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def _free(name: str, docs: DataFrame) -> str:
    """A column name that the table does not have."""
    while name in docs.columns:
        name += "_"
    return name


@F.pandas_udf(StringType())
def without_lines(values: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of these hashes."""
    out = []
    for value, lines in zip(values, gone, strict=True):
        if value is not None and lines is not None and len(lines):
            own = set(map(int, lines))
            value = b"\n".join(x for x in value.encode().split(b"\n") if line_hash(normalised(x)) not in own).decode()
        out.append(value)
    return pd.Series(out, dtype=object)


def clean(docs: DataFrame, text: str = "text", host: str = "source", limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """``docs`` with the frequent lines of their host cut out of the texts."""
    return judged(docs, text, host, reject=False, limit=limit, share=share)


def op6_quality_rules(spark, sf_dir):
    """Quality measures and verdict of every document."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL = {
    "op6_quality_rules": r"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8)
), repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, t, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, t, unnest(raw) AS line FROM texts)
), hosts AS (SELECT source, count(DISTINCT t) AS n_documents FROM texts WHERE len(raw) > 0 GROUP BY source
), frequent AS (
  SELECT n.source, n.line FROM lines n JOIN hosts h ON h.source IS NOT DISTINCT FROM n.source
  GROUP BY n.source, n.line HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > any_value(n_documents) * 0.0005
), removed AS (
  SELECT n.doc_id, sum(len(string_split(n.line, ' '))) AS n FROM lines n JOIN frequent f ON f.line = n.line AND f.source IS NOT DISTINCT FROM n.source GROUP BY n.doc_id
), counted AS (
  SELECT x.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(raw) - len(list_distinct(raw)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(m.n, 0)::BIGINT AS removed_words
  FROM texts x LEFT JOIN repeats r ON r.doc_id = x.doc_id LEFT JOIN removed m ON m.doc_id = x.doc_id
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.6 * n_words)) AS kept FROM counted""",
}
