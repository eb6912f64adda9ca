"""Main text of web pages, by a suffix array of each host.

A page is cut into blocks of text (scripts, styles, forms, menus, headers, footers, sidebars, adverts
and comments, recognised by element, role or exact class name are left out). Where a page has articles, their blocks are
its stream, else those of its main element, else all. Every page then goes through the suffixes of its host: the suffixes
of all streams are sorted by their first ``RUN`` tokens, a run is counted on the distinct pages it starts on, and the
tokens that boilerplate runs cover go:

* on pages that mark nothing, a run on ``MIN_PAGES`` or more of such pages is boilerplate;
* inside marked text, the markup is the check that follows: articles of a host share passages, and those are content. A run
  is boilerplate there (a notice, an advert in an article) if it stands on more than half of the host's marked pages and on
  ``MIN_MARKED`` at least. If such runs cover more than half of the tokens of a page, it is a copy of other articles
  rather than an article with notices, and keeps its text.

Suffixes travel as packed keys by chunk and block, see ``exchange``, in two rounds: cells of all runs with the number of
pages in the chunk (never too low; 255 stands for more), then the 64-bit keys of those runs whose cell is on enough pages. A chunk sends
a run once with its count, so a host with a third of all pages, or a line on all of them, is spread over chunks and blocks.
Pages with the same stream count once: copies of a page are no evidence for boilerplate. The text is shuffled once, compressed.

Defined cases: null or empty html and pages without text give an empty text; a null url has an empty
host; repeated rows are separate pages; unclosed elements end with the page; a block whose tokens are
all boilerplate is dropped; columns other than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.llm import exchange as X
from fcverify.llm.words import U64, covered, mix, texts

RUN, MIN_PAGES, MIN_MARKED = 8, 3, 8
CHUNK_BYTES, BLOCK_KEYS = 4 << 20, 4 << 20
MANY_CHUNKS, MOST_GROWTH = 1024, 4
PIECE_BYTES = 1 << 20
PAGES, CELLS, RUNS = 1, 2, 3

#: Elements, roles and class names by meaning (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math object canvas audio video select title".split())
OUTSIDE = RAW | set("head nav footer aside form button menu dialog label fieldset datalist".split())
MAIN = {"article", "main"}
BLOCKS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
             "h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = set("ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
            "footer header masthead menu nav navbar navigation newsletter notice notices pagination pager popup promo promoted related respond "
            "share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets "
            "ad-banner ad-container ad-slot comment-body comment-list comments-area cookie-banner cookie-consent cookie-notice main-nav nav-menu "
            "newsletter-signup related-posts share-buttons site-footer site-header social-links social-share".split())
WHITE = "[\\x20\\t\\n\\r\\f\\v\\u00a0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

_START = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_TO_END = re.compile("[^>\"']*")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(WHITE)


def _excluded(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in OUTSIDE or (tag == "header" and not in_main):
        return True
    if not attributes or attributes.isspace():
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    # whole names only: an article may well have a header-image or a share-price
    return tag not in ("body", "html", "main") and not NAMES.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split())


def tokens(page: str) -> Iterator[tuple[str, str, str | None]]:
    """(kind, value, attributes): text, open and close tags, in one pass; comments and declarations are left out.

    A quote that is never closed is an ordinary character of its tag; a tag that is never closed is text.
    """
    at, unclosed = 0, set()
    while True:
        m = _START.search(page, at)
        if m is None:
            yield "text", page[at:], None
            return
        if m.start() > at:
            yield "text", page[at:m.start()], None
        if m[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(close, m.end())
            if end < 0:
                return
            at = end + len(close)
            continue
        end = m.end()
        while True:
            end = _TO_END.match(page, end).end()
            if end == len(page):
                yield "text", page[m.start():], None
                return
            sign = page[end]
            if sign == ">":
                break
            closing = -1 if sign in unclosed else page.find(sign, end + 1)
            if closing < 0:
                unclosed.add(sign)
            end = max(end, closing) + 1
        at, tag = end + 1, m[2].lower()
        skip_to = yield ("close" if m[1] else "open"), tag, page[m.end():end]
        if skip_to:  # the text of this element is no markup
            ended = _RAW_END[tag].search(page, at)
            if ended is None:
                return
            at = ended.end()


def blocks(page: str) -> tuple[bool, list[str]]:
    """Whether the page marks its main text, and the texts of its blocks.

    Those of the articles, if there are any, else of the main element, if there is one, else all.
    """
    open_: list[tuple[str, bool, str]] = []  # tag, excluded, what it marks
    of_tag, inside = Counter(), Counter()
    out: list[tuple[str, bool, bool]] = []
    buffer: list[str] = []
    excluded, seen = 0, set()

    def flush() -> None:
        if buffer:
            value = _WHITE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if value:
                out.append((value, inside["article"] > 0, inside["main"] > 0))

    stream = tokens(page)
    raw = None
    while True:
        try:
            kind, tag, attributes = stream.send(raw)
        except StopIteration:
            break
        raw = None
        if kind == "text":
            if tag and not excluded:
                buffer.append(tag)
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br" and not excluded:
            buffer.append(" ")
        if kind == "close":
            while of_tag[tag]:
                name, bad, marks = open_.pop()
                of_tag[name] -= 1
                excluded -= bad
                inside[marks] -= 1
                if name == tag:
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            raw = True
            continue
        if tag == "body":
            excluded, open_ = 0, []
            of_tag.clear()
            inside.clear()
        bad = _excluded(tag, attributes, inside["article"] + inside["main"] > 0)
        marks = tag if tag in MAIN and not excluded and not bad else ""
        if not attributes.rstrip().endswith("/") or tag in BLOCKS:
            open_.append((tag, bad, marks))
            of_tag[tag] += 1
            excluded += bad
            inside[marks] += 1
            seen |= {marks} - {""}
    flush()
    for which in (1, 2):
        if any(b[which] for b in out):
            return True, [b[0] for b in out if b[which]]
    return bool(seen), [] if seen else [b[0] for b in out]


def parsed(pages: DataFrame, id: str, url: str, body: str, chunks: int) -> DataFrame:
    """Per row: chunk, id, url, group (hash of the host; the low bit says whether the page is marked), page (hash of
    its tokens), its blocks joined by line feeds (no block has one), compressed, and their size.
    """
    kind = pages.schema[id].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))

    def run(batches):
        for batch in batches:
            made = [blocks(v or "") for v in batch.column(3).to_pylist()]
            text = ["\n".join(b).encode() for _, b in made]
            page = [int.from_bytes(blake2b(t.replace(b"\n", b" "), digest_size=8).digest(), "little", signed=True) for t in text]
            marked = np.array([m for m, _ in made], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array(batch.column(4).to_numpy() & ~1 | marked), pa.array(page, pa.int64()),
                pa.array([len(t) for t in text], pa.int64()), pa.array([pa.compress(t, "zstd", asbytes=True) for t in text], pa.binary()),
            ], ["chunk", "id", "url", "group", "page", "size", "text"])

    return pages.select(
        X.chunk_of([F.col(id), F.col(url), F.col(body)], chunks).alias("chunk"), F.col(id).alias("id"), F.col(url).alias("url"),
        F.col(body).alias("html"), F.xxhash64(host).alias("host"),
    ).mapInArrow(run, f"chunk long, id {kind}, url string, group long, page long, size long, text binary")


def pieces(body: bytes, limit: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a stream and the number of their first token; they overlap so that every run is in just one part."""
    at = first = 0
    while len(body) - at > limit:
        end = body.find(b" ", at + limit)
        if end < 0:
            break
        back = end
        for _ in range(RUN - 1):
            back = body.rfind(b" ", at, back)
            if back < 0:
                break
        if back < 0:  # fewer tokens than a run in the part: a longer one
            limit *= 2
            continue
        yield first, body[at:end]
        first += body.count(b" ", at, back + 1)
        at = back + 1
    yield first, body[at:]


def _runs(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a chunk; key, page and first token of every run.

    A key holds the run and its host; the low bit says whether the page is marked.
    """
    bodies = [pa.decompress(t, n, "zstd", asbytes=True) for t, n in zip(table["text"].to_pylist(), table["size"].to_pylist(), strict=True)]
    group = table["group"].to_numpy().view(U64)
    parts = [(i, first, part) for i, b in enumerate(bodies) for first, part in pieces(b.replace(b"\n", b" "), PIECE_BYTES)]
    row, shift = np.array([p[:2] for p in parts], np.int64).reshape(-1, 2).T
    keys, pages, starts = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in texts(pa.array([p[2] for p in parts], pa.large_binary())):
        w = t.words((0,))
        at, (h,) = w.windows(RUN)
        part = w.text[at]
        page = row[t.first + part]
        keys.append(mix(h ^ mix(group[page])) & ~U64(1) | group[page] & U64(1))
        pages.append(page)
        starts.append(at - w.first[part] + shift[t.first + part])
    return bodies, np.concatenate(keys), np.concatenate(pages), np.concatenate(starts)


def counted(keys: np.ndarray, page: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, on how many of the pages that count each stands, and the place of every input key."""
    (k, p), _, place = X.distinct([keys, page])
    new = ~X.same_as_before([k])
    run = np.cumsum(new) - 1
    return k[new], np.bincount(run, weights=counts[p], minlength=int(new.sum())), run[place]


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each of the sorted keys, and the number of its key for every row."""
    new = ~X.same_as_before([keys])
    return np.flatnonzero(new), np.cumsum(new) - 1


def cells_on_pages(parts: X.Parts, multi: np.ndarray, stage: int) -> dict[int, np.ndarray]:
    """Rule: of sorted cells with numbers of pages, those on as many pages as boilerplate has at least."""
    at, cell = _by_key(parts[0])
    total = np.add.reduceat(parts[1].astype(np.int64), at)
    return {stage: (total >= np.where(parts[0][at] & U64(1), MIN_MARKED, MIN_PAGES))[cell]}


def runs_on_pages(parts: X.Parts, multi: np.ndarray, stage: int) -> dict[int, np.ndarray]:
    """Rule: of sorted runs with numbers of pages and the number needed (0 where it isn't known), the boilerplate."""
    at, run = _by_key(parts[0])
    return {stage: (np.add.reduceat(parts[1].astype(np.int64), at) >= np.maximum.reduceat(parts[2].astype(np.int64), at))[run]}


def distinct_pages(base: DataFrame) -> DataFrame:
    """The first chunk of every distinct page is told to count it, and how many its host has; rows as replies of ``exchange``."""

    def own(table: pa.Table) -> pa.Table:
        return table.select(["chunk", "group", "page"]).group_by(["chunk", "group", "page"]).aggregate([])

    def tell(table: pa.Table) -> pa.Table:
        own = b"".join(table[c].to_numpy().astype("<i8").tobytes() for c in ("group", "page", "n"))
        return pa.Table.from_pylist([{"chunk": table["chunk"][0].as_py(), "stage": PAGES, "block": 0, "bits": own}], schema=X.REPLY_PA)

    once = base.groupBy("chunk").applyInArrow(own, "chunk long, group long, page long").groupBy("group", "page").agg(F.min("chunk").alias("chunk"))
    hosts = once.groupBy("group").agg(F.count("*").alias("n"))
    return once.join(hosts, "group").groupBy("chunk").applyInArrow(tell, X.REPLY_SCHEMA)


def _own(table: pa.Table, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row of a chunk is counted, and how many pages make a run of it boilerplate (0: not known)."""
    told = [np.frombuffer(r["bits"], "<i8").reshape(3, -1) for r in replies if r["stage"] == PAGES]
    left = {(g, p): n for t in told for g, p, n in t.T.tolist()}
    need = {g: max(MIN_MARKED, n // 2 + 1) if g & 1 else MIN_PAGES for (g, _), n in left.items()}
    rows = list(zip(table["group"].to_pylist(), table["page"].to_pylist(), strict=True))
    return np.array([left.pop(r, None) is not None for r in rows]), np.array([need.get(g, 0) for g, _ in rows])


def chunk_count(size: int, chunk_bytes: int) -> int:
    """Chunks grow with a corpus of more than ``MANY_CHUNKS``, up to ``MOST_GROWTH`` times, else rows of the exchange get small."""
    grown = min(MOST_GROWTH, max(1, size / chunk_bytes / MANY_CHUNKS))
    return max(1, int(np.ceil(size / (chunk_bytes * grown))))


def _each_key_list(table: pa.Table, change: Callable[[bytes], bytes]) -> pa.Table:
    keys = pa.array([change(k) for k in table["keys"].to_pylist()], pa.binary())
    return table.set_column(table.schema.get_field_index("keys"), "keys", keys)


def deflated(table: pa.Table) -> pa.Table:
    """Key lists of a chunk made smaller: the highest byte plane of their steps is small numbers."""
    return _each_key_list(table, lambda k: zlib.compress(k, 1))


def answer(dtypes: tuple[str, ...], rule: Callable[[X.Parts, np.ndarray, int], dict[int, np.ndarray]]) -> Callable[[pa.Table], pa.Table]:
    """``exchange.answer`` to deflated key lists."""
    run = X.answer(dtypes, rule)
    return lambda table: run(_each_key_list(table, zlib.decompress))


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html",
            chunk_bytes: int = CHUNK_BYTES, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """Per row: id, url, text (blocks joined by an empty line), n_chars."""
    size = X.corpus_bytes(pages, body)
    base = parsed(pages, id, url, body, chunk_count(size, chunk_bytes))
    block_bits = max(1, int(np.ceil(np.log2(max(size / 8 / block_keys, 2)))))
    cell_bits = min(62, max(16, block_bits + 1, int(np.ceil(np.log2(max(size, 2))))))  # a run takes about eight bytes: eight cells a run

    def cells(keys: np.ndarray) -> np.ndarray:
        return keys >> U64(64 - cell_bits) << U64(1) | keys & U64(1)

    def block(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys >> U64(bits - block_bits)).astype(np.int64)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        _, keys, page, _ = _runs(table)
        own, _ = _own(table, replies.to_pylist())
        found, n, _ = counted(cells(keys), page, own)
        return deflated(X.send(table["chunk"][0].as_py(), CELLS, [found, np.minimum(n, 255).astype("u1")], np.zeros(len(found), bool),
                               block(found, cell_bits + 1)))

    def on_enough(keys: np.ndarray, replies: list[dict]) -> np.ndarray:
        """Which runs have a cell on enough pages."""
        (own,), _, place = X.distinct([cells(keys)])
        return np.flatnonzero(X.found_bits(replies, CELLS, block(own, cell_bits + 1))[place])

    def ask(table: pa.Table, replies: pa.Table) -> pa.Table:
        _, keys, page, _ = _runs(table)
        told = replies.to_pylist()
        own, need = _own(table, told)
        on = on_enough(keys, told)
        found, n, place = counted(keys[on], page[on], own)
        least = np.zeros(len(found), "<u4")
        least[place] = need[page[on]]
        return deflated(X.send(table["chunk"][0].as_py(), RUNS, [found, n.astype("<u4"), least], np.zeros(len(found), bool), block(found, 64)))

    def rewrite(table: pa.Table, replies: pa.Table) -> pa.Table:
        bodies, keys, page, start = _runs(table)
        told = replies.to_pylist()
        on = on_enough(keys, told)
        (own,), _, place = X.distinct([keys[on]])
        on = on[X.found_bits(told, RUNS, block(own, 64))[place]]
        marked = table["group"].to_numpy() & 1
        out = [b.decode().replace("\n", "\n\n") for b in bodies]
        hit, at = np.unique(page[on], return_index=True)
        for i, starts in zip(hit.tolist(), np.split(start[on], at[1:]), strict=False):
            gone = covered(starts, RUN, bodies[i].count(b" ") + bodies[i].count(b"\n") + 1)
            if not marked[i] or 2 * gone.sum() <= len(gone):
                out[i] = _without(bodies[i].decode(), gone)
        return pa.table({"id": table["id"], "url": table["url"], "text": pa.array(out, pa.string())})

    kind = pages.schema[id].dataType.simpleString()
    own = distinct_pages(base)
    seen = (base.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(send, X.KEYS_SCHEMA)
            .groupBy("block").applyInArrow(answer(("uint8",), cells_on_pages), X.REPLY_SCHEMA))
    judged = (base.groupBy("chunk").cogroup(seen.unionByName(own).groupBy("chunk")).applyInArrow(ask, X.KEYS_SCHEMA)
              .groupBy("block").applyInArrow(answer(("<u4", "<u4"), runs_on_pages), X.REPLY_SCHEMA))
    out = base.groupBy("chunk").cogroup(seen.unionByName(judged).groupBy("chunk")).applyInArrow(rewrite, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def _without(body: str, gone: np.ndarray) -> str:
    """Blocks joined by an empty line, without some tokens."""
    kept, n = [], 0
    for b in body.split("\n"):
        own = b.split(" ")
        left = [w for w, g in zip(own, gone[n:n + len(own)], strict=True) if not g]
        n += len(own)
        if left:
            kept.append(" ".join(left))
    return "\n\n".join(kept)


def op8_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
ORACLE_SQL: dict[str, str] = {}
