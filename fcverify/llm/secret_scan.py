"""Secret scan: fixed patterns plus character Markov models.

Two first-order Markov models, of random strings and of ordinary identifiers, are trained from
labelled samples: counts of character pairs with add-one smoothing. A token of ``MIN_TOKEN`` or more
characters is a secret when the logarithm of its likelihood ratio, random against ordinary, exceeds
``MARGIN`` per character. Where the whole token does not, its sub-runs count, so that a path or a key
name glued to a secret does not hide it: the parts of ``MIN_TOKEN`` or more characters between the
separators / = _ -, and the windows of ``MIN_TOKEN`` characters. Windows that overlap are one run; its
ordinary ends are cut off where the sum of ratios above the margin is best, and it is then widened to
whole parts. Spans of the fixed patterns always stay; the models add spans.

Everything runs as DataFrame expressions, in time near linear in text, tokens and spans: a pattern's spans come from the pieces between its matches
and the matches themselves (both leftmost, non-overlapping), the ratio of a token from a table of
character pairs (128 x 128 numbers, a constant of the plan).

Spans are code points, end exclusive. Kinds in the order of ``KINDS``; spans are sorted by start,
then kind. Defined cases: null text counts as empty and has no spans (``redact`` leaves it null);
overlapping spans of different kinds are all reported and redacted as one; repeated rows and other
columns pass through, the internal columns are dropped again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "markov"]
#: Patterns and least lengths of the fixed kinds (fixed values).
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_SIZE = 20
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that have 24 or more
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
PART = r"[A-Za-z0-9+]+"
MARGIN = 0.5
ALPHABET = 128
LONG_WORD = 200
BLOCK, REDACT_BLOCK = 256, 512
SAMPLE_RANDOM = 3000
MARK = "[SECRET]"
#: Parts that ordinary identifiers are made of (fixed values).
PARTS = ("get set put add new old user name path file data list item node tree config service client server request response "
         "handler manager factory builder index count total value result error status update delete insert select "
         "parse format string number buffer stream reader writer thread queue table column window session token").split()


def random_samples(spark: SparkSession, size: int = SAMPLE_RANDOM) -> DataFrame:
    """text, random = true, n = 1: strings of 40 characters in the usual alphabets of keys, from a hash of the row number."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(digest))
    text = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(
        F.col("id") % 4 == 1, F.upper(F.substring(digest, 1, 40))).when(
        F.col("id") % 4 == 2, F.substring(F.translate(F.upper(raw), "+/=", ""), 1, 40)).otherwise(F.substring(raw, 1, 40))
    return spark.range(size).select(text.alias("text"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))


def ordinary_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """text, random = false, n: the alphabetic words of all documents with their counts, and identifiers made of common parts.

    A very long run of letters counts by its first ``LONG_WORD`` characters.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z]{{6,{LONG_WORD}}}"), F.lit(0))).alias("text"))
    spark = docs.sparkSession
    part = F.array(*[F.lit(p) for p in PARTS])
    pick = lambda salt: F.element_at(part, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(PARTS))) + 1).cast("int"))
    camel = F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)))
    snake = F.concat_ws("_", pick(1), pick(2), pick(3))
    dashed = F.concat_ws("-", pick(1), pick(2), F.pmod(F.xxhash64("id"), F.lit(100)).cast("string"))
    path = F.concat_ws("/", pick(1), pick(2), pick(3), pick(4))
    made = spark.range(4 * len(PARTS) ** 2).select(F.element_at(F.array(camel, snake, dashed, path, F.upper(snake)), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    counted = words.groupBy("text").agg(F.count("*").alias("n")).unionByName(made.withColumn("n", F.lit(1).cast("long")))
    return counted.select("text", F.lit(False).alias("random"), "n")


def pair_ratios(samples: DataFrame) -> list[float]:
    """Log ratio of the probability of each next character, random against ordinary, by 128 * first + second code."""
    pairs = samples.filter(F.length("text") > 1).select("random", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair"))
    rows = pairs.groupBy("random", F.ascii("pair").alias("a"), F.ascii(F.substring("pair", 2, 1)).alias("b")).agg(
        F.sum("n").alias("n")).filter((F.col("a") < ALPHABET) & (F.col("b") < ALPHABET)).collect()  # at most 2 * 128 * 128 rows
    seen = {r["b"] for r in rows} | {r["a"] for r in rows}
    out = [0.0] * (ALPHABET * ALPHABET)
    count = {(r["random"], r["a"], r["b"]): r["n"] for r in rows}
    first = {}
    for (kind, a, _), n in count.items():
        first[kind, a] = first.get((kind, a), 0) + n
    for a in range(ALPHABET):
        for b in range(ALPHABET):
            p, q = ((count.get((kind, a, b), 0) + 1) / (first.get((kind, a), 0) + max(len(seen), 1)) for kind in (True, False))
            out[ALPHABET * a + b] = math.log(p / q)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Of each element, ``step`` over all elements up to it.

    An array that grows by an element at a time is copied each time, so it only grows inside blocks of
    ``BLOCK`` elements; then the results of the blocks before are added to each.
    """
    def grow(block: Column) -> Column:
        return F.aggregate(
            block, F.struct(zero.alias("last"), F.slice(block, 1, 0).alias("all")),
            lambda s, x: _let(step(s["last"], x), lambda y: F.struct(y.alias("last"), F.concat(s["all"], F.array(y)).alias("all"))), lambda s: s["all"])

    def blocks(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: grow(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))
        return _let(cut, lambda own: _let(
            grow(F.transform(own, lambda x: F.element_at(x, -1))),
            lambda ends: F.flatten(F.zip_with(own, F.concat(F.array(zero), F.slice(ends, 1, F.size(ends) - 1)), lambda x, before: F.transform(x, lambda y: step(before, y))))))

    return _let(values, lambda all_: F.when(F.size(all_) > BLOCK, blocks(all_)).otherwise(grow(all_)))


def _sums(sizes: Column) -> Column:
    return _prefix(sizes, F.lit(0), lambda a, b: a + b)


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """Pieces between the matches of a pattern, and the matches; both empty where there is none."""
    has = text.rlike(pattern)
    none = F.array().cast("array<string>")
    return F.when(has, F.split(text, pattern, -1)).otherwise(none), F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int>>")


def _spans(pieces: Column, found: Column) -> Column:
    """start, end of every match, from running lengths."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda gap, hit: F.length(gap) + F.length(hit))
    return F.zip_with(_sums(steps), found, lambda end, hit: _span(end - F.length(hit), end))


def _ordinary_end(scores: Column) -> Column:
    """How many of the first pairs to leave out for the largest sum of the others above the margin."""
    least = F.aggregate(
        scores, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(0.0).alias("least"), F.lit(0).alias("cut")),
        lambda s, x: _let(s["sum"] + x - MARGIN, lambda total: F.struct(
            total.alias("sum"), (s["at"] + 1).alias("at"), F.least(s["least"], total).alias("least"),
            F.when(total < s["least"], s["at"] + 1).otherwise(s["cut"]).alias("cut"))))
    return least["cut"]


def _window_runs(parts: Column, scores: Column) -> Column:
    """start, end of the runs of windows above the margin, within the token.

    ``parts`` are the token's spans between separators, in order. Two tables with an entry per character
    tell where the part there starts (at a separator: the next part) and ends (the part before).
    """
    pairs = MIN_TOKEN - 1
    size = F.size(scores) + 1
    total = _prefix(scores, F.lit(0.0), lambda a, b: a + b)
    sums = _let(total, lambda t: F.zip_with(
        F.slice(t, pairs, F.size(t) - pairs + 1), F.concat(F.array(F.lit(0.0)), F.slice(t, 1, F.size(t) - pairs)), lambda new, old: new - old))
    hits = F.filter(F.transform(sums, lambda x, i: F.when(x > MARGIN * pairs, i)), lambda i: i.isNotNull())

    def runs(at: Column) -> Column:
        near = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: b > a + MIN_TOKEN)
        first = F.filter(F.zip_with(at, F.concat(F.array(F.lit(True)), near), lambda a, new: F.when(new, a)), lambda a: a.isNotNull())
        last = F.filter(F.zip_with(at, F.concat(near, F.array(F.lit(True))), lambda a, new: F.when(new, a)), lambda a: a.isNotNull())
        return F.zip_with(first, last, lambda a, b: _span(a, b + MIN_TOKEN))

    cut = F.transform(runs(hits), lambda r: _span(
        r["start"] + _ordinary_end(F.slice(scores, r["start"] + 1, pairs)),
        r["end"] - _ordinary_end(F.reverse(F.slice(scores, r["end"] - pairs, pairs)))))
    none = _no_spans()
    before = F.concat(F.array(_span(F.lit(0), F.lit(0))), F.slice(parts, 1, F.size(parts) - 1))
    after = F.concat(F.slice(parts, 2, F.size(parts) - 1), F.array(_span(size, size)))
    starts = F.concat(F.flatten(F.zip_with(parts, before, lambda p, q: F.array_repeat(p["start"], p["end"] - q["end"]))),
                      F.array_repeat(size, size - F.element_at(parts, -1)["end"]))
    ends = F.concat(F.array_repeat(F.lit(0), F.element_at(parts, 1)["start"]),
                    F.flatten(F.zip_with(parts, after, lambda p, q: F.array_repeat(p["end"], q["start"] - p["start"]))))
    wide = _let(F.struct(starts.alias("starts"), ends.alias("ends")), lambda t: F.transform(
        cut, lambda r: _span(F.element_at(t["starts"], r["start"] + 1), F.element_at(t["ends"], r["end"]))))
    return F.when(F.size(parts) > 0, F.when(F.size(hits) > 0, F.filter(wide, lambda r: r["end"] - r["start"] >= MIN_TOKEN)).otherwise(none)).otherwise(none)


def _joined(runs: Column) -> Column:
    """Runs in order, those that overlap as one."""
    def join(own: Column) -> Column:
        reach = _prefix(F.transform(own, lambda r: r["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return _let(reach, lambda far: _let(
            F.zip_with(F.slice(own, 2, F.size(own) - 1), F.slice(far, 1, F.size(far) - 1), lambda r, end: r["start"] >= end),
            lambda new: F.zip_with(
                F.filter(F.zip_with(own, F.concat(F.array(F.lit(True)), new), lambda r, k: F.when(k, r["start"])), lambda x: x.isNotNull()),
                F.filter(F.zip_with(far, F.concat(new, F.array(F.lit(True))), lambda end, k: F.when(k, end)), lambda x: x.isNotNull()), _span)))

    return _let(F.array_sort(runs), lambda own: F.when(F.size(own) > 1, join(own)).otherwise(own))


def scan(docs: DataFrame, ratios: list[float], text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with a column of its spans: array of start, kind (place in KINDS), end, sorted."""
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": TOKEN}
    step = docs
    for k, pattern in kinds.items():
        pieces, found = _matches(body, pattern)
        step = step.withColumns({f"{mark}{k}_pieces": pieces, f"{mark}{k}": found})
    step = step.withColumn(f"{mark}values", F.when(F.size(f"{mark}assign") > 0, F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to a constant

    def scores(token: Column) -> Column:
        return _let(F.split(token, ""), lambda c: F.zip_with(
            F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, F.ascii(a) * ALPHABET + F.ascii(b) + 1)))

    def high(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, r: s + r) / F.size(x) > MARGIN

    def part_spans(token: Column) -> Column:
        return _let(F.struct(*[c.alias(n) for c, n in zip(_matches(token, PART), ("pieces", "hits"), strict=True)]), lambda m: _spans(m["pieces"], m["hits"]))

    # one column after the other: nested at once, the expressions are too deep for the analyzer
    tokens = f"{mark}tokens"

    def each(**made: Callable[[Column], Column]) -> None:
        nonlocal step
        source = tokens if tokens in step.columns else f"{mark}markov"
        step = step.withColumn(tokens, F.transform(source, lambda t: F.struct(*[f(t).alias(n) for n, f in made.items()])))

    keep = {n: (lambda t, n=n: t[n]) for n in ("token", "x", "whole", "parts", "runs")}
    only = {n: keep[n] for n in ("token", "x", "whole", "parts")}
    each(token=lambda t: t, x=scores)
    each(token=keep["token"], x=keep["x"], whole=lambda t: high(t["x"]), parts=lambda t: part_spans(t["token"]))
    each(**only, runs=lambda t: F.when(t["whole"], _no_spans()).otherwise(_window_runs(t["parts"], t["x"])))
    each(**only, runs=lambda t: F.concat(t["runs"], F.filter(t["parts"], lambda r: F.when(
        r["end"] - r["start"] >= MIN_TOKEN, high(F.slice(t["x"], r["start"] + 1, r["end"] - r["start"] - 1))).otherwise(False))))
    each(own=lambda t: F.when(t["whole"], F.array(_span(F.lit(0), F.length(t["token"])))).otherwise(_joined(t["runs"])))

    good = {
        "assign": F.transform(f"{mark}values", lambda v: F.length(v) >= ASSIGN_VALUE),
        "access": F.transform(f"{mark}access", lambda m: F.length(m) >= ACCESS_SIZE),
        "hex": F.transform(f"{mark}hex", lambda m: F.lit(True)),
    }

    def kind_spans(n: int, k: str) -> Column:
        rows = F.arrays_zip(_spans(F.col(f"{mark}{k}_pieces"), F.col(f"{mark}{k}")).alias("span"), good[k].alias("good"))
        return F.transform(F.filter(rows, lambda r: r["good"]), lambda r: F.struct(
            r["span"]["start"].alias("start"), F.lit(n).alias("kind"), r["span"]["end"].alias("end")))

    def markov_spans(n: int) -> Column:
        rows = F.arrays_zip(_spans(F.col(f"{mark}markov_pieces"), F.col(f"{mark}markov")).alias("span"), F.transform(tokens, lambda t: t["own"]).alias("own"))
        return F.flatten(F.transform(rows, lambda r: F.transform(r["own"], lambda x: F.struct(
            (r["span"]["start"] + x["start"]).alias("start"), F.lit(n).alias("kind"), (r["span"]["start"] + x["end"]).alias("end")))))

    spans = [markov_spans(n) if k == "markov" else kind_spans(n, k) for n, k in enumerate(KINDS)]
    return step.withColumn(out, F.array_sort(F.concat(*spans))).drop(f"{mark}values", tokens, *[f"{mark}{k}" for k in kinds], *[f"{mark}{k}_pieces" for k in kinds])


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float], text: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with every secret of the text replaced by a mark."""
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    found = scan(docs, ratios, text, spans)
    body = F.col(text)

    def pieces(own: Column) -> Column:
        """The text up to the end of each block of spans, marks in place; a block is cut out once."""
        def of_block(b: Column) -> Column:
            block = F.slice(own, b * REDACT_BLOCK + 1, F.lit(REDACT_BLOCK))
            first = F.when(b > 0, F.element_at(own, F.greatest(b * REDACT_BLOCK, F.lit(1)))["end"]).otherwise(0)
            return _let(block, lambda some: _let(F.substring(body, first + 1, F.element_at(some, -1)["end"] - first), lambda part: F.array_join(F.zip_with(
                some, F.concat(F.array(first), F.transform(F.slice(some, 1, F.size(some) - 1), lambda r: r["end"])),
                lambda r, end: F.concat(F.substring(part, end - first + 1, r["start"] - end), F.lit(mark))), "")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / REDACT_BLOCK).cast("int")), of_block), "")

    cut = _let(_joined(F.transform(spans, lambda s: _span(s["start"], s["end"]))), lambda own: F.concat(
        pieces(own), F.substring(body, F.element_at(own, -1)["end"] + 1, F.length(body))))
    return found.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(body)).drop(spans)


def trained(docs: DataFrame, text: str = "text") -> list[float]:
    """Pair ratios from the random samples and the ordinary words of all documents."""
    return pair_ratios(random_samples(docs.sparkSession).unionByName(ordinary_samples(docs, text)))


def op4_secret_scan(spark, sf_dir):
    """Secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs.select("doc_id", "text"), trained(docs))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLE_SQL: dict[str, str] = {}
