"""Packing, HTML extraction and the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from fcverify.llm import html_extraction, packing
from tests.llm import fixtures as fx

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packing(spark):
    from tokenizers import Tokenizer

    data = fx.rows() + [(90, "a <|endoftext|> b   c \n  d ", None, None, 0)]
    found = packing.pack(fx.frame(spark, data), PATH, capacity=300, tokens=True).collect()
    slow, expected = Tokenizer.from_file(PATH), []
    for r in data:
        ids = [*slow.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 300 or 300
        cuts = [0, *range(first, len(ids) + 1, 300)]
        expected += [(r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), *ids[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert fx.key_rows((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, *r.tokens) for r in found) == fx.key_rows(expected)
    assert_gapless(found, 300)


def assert_gapless(found, capacity):
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_long_white_space_is_packed_by_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    data = [(i, t, None, None, 0) for i, t in enumerate([" " * 2_000_000, "\n" * 2_000_000, "a" + " \n" * 50_000 + "b c"])]
    found = packing.pack(fx.frame(spark, data), PATH).collect()
    slow = Tokenizer.from_file(PATH)
    for i, t, *_ in data:
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in found if r.doc_id == i)
        assert own == [(a, n, zlib.crc32(ids[a:a + n].tobytes())) for a, n, _ in own] and sum(n for _, n, _ in own) == len(ids)


def test_files_are_checked_before_ranks_stand_for_merges():
    import json

    made = json.load(open(PATH, encoding="utf-8"))
    assert packing.same_in_ranks(made)
    other = {**made, "model": {**made["model"], "merges": made["model"]["merges"][::-1]}}
    assert not packing.same_in_ranks(other) and not packing.same_in_ranks({**made, "normalizer": {"type": "NFC"}})
    assert not packing.same_in_ranks({**made, "pre_tokenizer": {**made["pre_tokenizer"], "use_regex": False}})


def test_packing_of_an_empty_table(spark):
    assert packing.pack(fx.frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 20_000), 1, 2048).astype(int)
    have = np.bincount(lengths, minlength=2049)
    plan = packing.packing_plan(have, 2048)
    used = np.zeros(2049, dtype=int)
    for own, times in plan:
        assert sum(own) <= 2048 and times > 0
        for v in own:
            used[v] += times
    assert (used == have).all()
    assert sum(t for _, t in plan) <= 1.002 * -(-lengths.sum() // 2048) + 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>";</script></head><body>
<nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div><header>Top</header>{body}<aside>side</aside>
<form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>"""


def test_blocks_of_an_article():
    body = """<article class="post"><header><h1>Big  &amp;\n title</h1></header><p>One <b>two</b>th&eacute;<br>three<p>Four &lt;x&gt; a > b<!-- no -->
    <div class="share-buttons">Share</div><div id="comments"><p>First!</p></div><ul><li>five<li>six</ul><p hidden>gone</p></article>"""
    marked, found = html_extraction.blocks(PAGE.format(body=body))
    assert marked and found == ["Big & title", "One twothé three", "Four <x> a > b", "five", "six"]


def test_odd_pages():
    assert html_extraction.blocks("") == (False, [])
    assert html_extraction.blocks("plain text") == (False, ["plain text"])
    assert html_extraction.blocks("<p>a<script>never closed") == (False, ["a"])
    assert html_extraction.blocks("<article><p>cut <b>off")[1] == ["cut off"]
    assert html_extraction.blocks("<div class=ad>x<div>y</div></div><p title='a>b'>z")[1] == ["z"]


def test_host_boilerplate_goes_and_unique_text_stays(spark):
    menu = "Welcome to our shop please read the delivery terms below"
    pages = [(i, f"http://a.example/{i}", f"<div><p>{menu}</p><p>{fx.words_text(i, 30, 10**6)}</p></div>") for i in range(5)]
    pages += [(10, "http://b.example/", f"<p>{menu}</p>"), (11, None, None), (12, "http://a.example/x", ""), (0, *pages[0][1:])]
    pages += [(20 + i, f"http://c.example/{i}", "<p>the same mirrored page with words enough for a run</p>") for i in range(4)]
    table = spark.createDataFrame([(*p, "id", "chunk") for p in pages], "page_id long, url string, html string, id string, chunk string")
    found = {(r.page_id, r.url): r for r in html_extraction.extract(table, chunk_bytes=500).collect()}
    assert all(found[i, f"http://a.example/{i}"].text == fx.words_text(i, 30, 10**6) for i in range(5))
    assert found[10, "http://b.example/"].text == menu
    assert found[11, None].text == "" and found[12, "http://a.example/x"].n_chars == 0
    assert all(found[20 + i, f"http://c.example/{i}"].text.startswith("the same") for i in range(4))
    assert html_extraction.extract(table.limit(0)).count() == 0


def by_host(pages):
    """Brute force: texts without the runs that enough distinct pages of a host hold, by whether they mark an article."""
    split = [(i, u.split("/")[2], *html_extraction.blocks(h)) for i, u, h in pages]
    words = [" ".join(b).split() for *_, b in split]
    streams, places, out = defaultdict(set), defaultdict(set), {}
    for (_, host, marked, _), w in zip(split, words):
        streams[host, marked].add(tuple(w))
        for i in range(len(w) - 7):
            places[host, marked, tuple(w[i:i + 8])].add(tuple(w))
    for (page, host, marked, own), w in zip(split, words):
        least = max(8, len(streams[host, marked]) // 2 + 1) if marked else 3
        gone = {j for i in range(len(w) - 7) if len(places[host, marked, tuple(w[i:i + 8])]) >= least for j in range(i, i + 8)}
        if marked and 2 * len(gone) > len(w):
            gone = set()
        kept, n = [], 0
        for b in own:
            left = [x for j, x in enumerate(b.split(" "), n) if j not in gone]
            n += len(b.split(" "))
            kept += [" ".join(left)] if left else []
        out[page] = "\n\n".join(kept)
    return out


@pytest.mark.parametrize("chunk_bytes", [600, 1 << 20])
def test_every_page_goes_through_the_suffixes_of_its_host(spark, chunk_bytes):
    notice = "This page may hold paid links and we get a share"
    shared = fx.words_text(99, 12, 10**6)
    unique = [fx.words_text(i, 30, 10**6) for i in range(40)]
    pages = [(i, f"http://a.example/{i}", f"<article><p>{unique[i]}</p><p>{notice}</p>{f'<p>{shared}</p>' if i < 9 else ''}</article>") for i in range(20)]
    pages += [(20 + i, "http://a.example/copy", pages[0][2]) for i in range(30)]  # no evidence for what they hold
    pages += [(50 + i, f"http://b.example/{i}", f"<main>{notice}<p>{unique[i]}</main>") for i in range(7)]  # too few
    pages += [(60 + i, f"http://c.example/{i}", f"<article>{unique[20]}<p>{shared}<p>{unique[20 + i][:40]}</article>") for i in range(1, 13)]  # versions of one article
    pages += [(80 + i, f"http://a.example/o{i}", f"<p>{unique[i]}<p>{shared}<p>{notice if i else ''}") for i in range(3)]  # marked pages tell nothing of others
    wanted = by_host(pages)
    assert wanted[0] == f"{unique[0]}\n\n{shared}" and wanted[15] == unique[15] and notice in wanted[50] and wanted[61].startswith(unique[20])
    assert wanted[80] == unique[0] and wanted[81] == f"{unique[1]}\n\n{notice}"
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extract(table, chunk_bytes=chunk_bytes).collect()} == wanted


def test_long_pages_are_hashed_in_parts(monkeypatch):
    import pyarrow as pa

    bodies = ["", "one", "a b c d e f g h", "long" * 40 + " " + " ".join("ab" * (i % 5 + 1) for i in range(300)).replace(" ab ", "\n", 9), "x" * 500]
    table = pa.table({"text": [pa.compress(b.encode(), "zstd", asbytes=True) for b in bodies], "size": [len(b) for b in bodies], "group": [2, 3, 5, 7, 8]})
    whole = html_extraction._runs(table)
    for limit in (1, 20, 50, 333):
        monkeypatch.setattr(html_extraction, "PIECE_BYTES", limit)
        assert all(np.array_equal(a, b) for a, b in zip(whole[1:], html_extraction._runs(table)[1:]))
    assert len(whole[1]) == 1 + len(bodies[3].split()) - 7 and list(whole[3][:3]) == [0, 0, 1]


def test_chunks_grow_with_a_large_corpus():
    mb = 1 << 20
    assert [html_extraction.chunk_count(n, 4 * mb) for n in (0, 1, 4 * mb + 1, 4096 * mb)] == [1, 1, 2, 1024]
    assert html_extraction.chunk_count(8192 * mb, 4 * mb) == 1024 and html_extraction.chunk_count(65536 * mb, 4 * mb) == 4096


def test_given_articles_keep_what_their_hosts_share(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    wanted = {r.page_id: "\n\n".join(html_extraction.blocks(r.html)[1]) for r in table.collect()}
    assert {r.page_id: r.text for r in html_extraction.extract(table).collect()} == wanted


@pytest.mark.parametrize("page, wanted", [
    ("<article>x</article><article class='comment'>reader says</article>", ["x"]),
    ("<main><article>x</article><section><ol><li>reader says</ol></section></main>", ["x"]),
    ("<article><div class='header-image'>a</div><p class=share-price>b<h2 class='comment-syntax'>c</h2></article>", ["a", "b", "c"]),
    ("<article>it <b title='unclosed>is</b> here</article>", ["it is here"]),
    ("<article>a<br>b <a href=\"x>y\">c</a> &amp; 1 < 2</article><p", ["a b c & 1 < 2"]),
    ("<main><p>only</main><p>outside", ["only"]), ("plain <i>text", ["plain text"]), ("<script>var a='<p>'", []), ("", []),
])
def test_blocks_of_small_pages(page, wanted):
    assert html_extraction.blocks(page)[1] == wanted


@pytest.mark.parametrize("page", ["<a '" * 100_000, "<div>" * 60_000 + "</b>" * 60_000, "<a \">\" " * 100_000, "<p x='" * 50_000 + ">" * 50_000, "<!--" * 100_000])
def test_parsing_is_linear(page):
    import time

    started = time.process_time()
    html_extraction.blocks(page)
    assert time.process_time() - started < 2


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    quality = {d for d, *m in ((r[0], *fx.measures(r[1])) for r in data) if not m[-1]}
    kept = pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == quality
    left = [r for r in data if r[0] in quality]
    unique = {r[0] for r in fx.near_groups(left) if r[3]}
    kept = pipeline.STAGES[1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == unique
    from tests.llm.test_filters import brute_containment

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute_containment([r for r in left if r[0] in unique], items)}
    kept = pipeline.STAGES[2][1](spark, kept, sf_dir)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == unique - dirty
    clean = pipeline.STAGES[3][1](spark, kept, sf_dir)
    assert clean.columns == docs.columns and not any(fx.base_spans(r.text) for r in clean.collect())
    found = pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in found} == unique - dirty
    assert_gapless(found, 2048)


def test_pipeline_with_awkward_rows(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = fx.frame(spark, fx.rows())
    for data in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, data, sf_dir)
            if name != "packing":
                assert out.columns == data.columns
                data = out
        out.collect()


def test_near_stage_keeps_one_of_repeated_rows(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = fx.frame(spark, [(1, "a b c d e f g", None, None, 0)] * 3 + [(2, "a b c d e f g", None, None, 0), (3, None, None, None, 0)])
    out = pipeline.STAGES[1][1](spark, docs, sf_dir).select("doc_id").collect()
    assert sorted(r.doc_id for r in out) == [1, 3]
