"""Substring, suffix and near dedup against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fcverify.llm import near_dedup, substring_dedup, suffix_dedup
from fcverify.llm import exchange as X
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.frame(spark, fx.rows())


def sha(column):
    return F.sha2(F.col(column).cast("binary"), 256)


def test_substring_dedup(docs):
    out = substring_dedup.remove_repeats(docs, chunk_bytes=4000, block_keys=500)
    found = out.select("doc_id", "n_words", "n_removed", sha("kept")).collect()
    assert fx.key_rows(found) == fx.key_rows(fx.substring_dedup(fx.rows()))


def test_suffix_dedup(docs):
    out = suffix_dedup.remove_repeats(docs, chunk_bytes=4000, block_bytes=3000)
    found = out.select("doc_id", "n_bytes", "n_removed", "n_spans", sha("kept")).collect()
    assert fx.key_rows(found) == fx.key_rows(fx.suffix_dedup(fx.rows()))


def test_suffix_dedup_in_parts_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    data = [r for r in fx.rows() if r[1] is None or len(r[1]) < 9000]
    judged = suffix_dedup.Judge(pa.array([r[1] for r in data]), 200, np.zeros(0, np.uint64), [])
    assert sum(int(p.has_string.sum()) for p in judged.pieces) == sum(max(0, len((r[1] or "").encode()) - 199) for r in data)


def test_near_groups(docs):
    found = near_dedup.near_groups(docs).collect()
    assert fx.key_rows(found) == fx.key_rows(fx.near_groups(fx.rows()))


def test_near_groups_of_edited_copies(spark):
    """A large group whose members differ from each other by a few words each, and chains of links."""
    import random

    rng = random.Random(5)
    base = fx.words_text(40, 150).split()
    data = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        data.append((i, " ".join(own), None, None, 0))
    chain = fx.words_text(41, 100).split()
    data += [(1000 + i, " ".join([*chain[3 * i:], *fx.words_text(50, 60).split()[:3 * i]]), None, None, 0) for i in range(12)]
    found = near_dedup.near_groups(fx.frame(spark, data)).collect()
    assert fx.key_rows(found) == fx.key_rows(fx.near_groups(data))


def test_likelihood_follows_the_similarity():
    rng = np.random.default_rng(3)
    for goal in (0.3, 0.6, 0.75, 0.9):
        n, both = 400, int(round(2 * 400 * goal / (1 + goal)))
        estimates = []
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.int64).astype(np.uint64)
            regs = near_dedup.registers(np.concatenate([np.sort(pool[:n]), np.sort(pool[n - both:])]), np.array([0, n, 2 * n]))
            estimates.append(near_dedup.jaccard_likelihood(regs[:1], regs[1:], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(estimates) - goal) < 0.04


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.sort(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        assert (X.unpack(X.pack(keys), n) == keys).all()


def test_empty_tables(spark):
    empty = fx.frame(spark, [])
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert near_dedup.near_groups(empty).count() == 0


def test_pairs_beyond_a_hub_are_met_by_their_rare_shingles(spark):
    """All members hold ten common shingles beyond the hub; only pairs that could reach the threshold are compared."""
    import random
    from itertools import combinations

    rng = random.Random(9)
    sets = {i: (rng.randint(95, 105), rng.randint(68, 74), {*range(10), *rng.sample(range(10, 3000), 8)}) for i in range(200)}
    for i in range(0, 40, 2):
        shared = rng.sample(range(5000, 9000), 12)
        sets[i][2].update(shared)
        sets[i + 1][2].update(shared[:rng.randint(2, 12)])
    asks = {i: i % 3 > 0 for i in sets}
    index = spark.createDataFrame(
        [(0, i, x, n, i, c, asks[i]) for i, (n, c, extras) in sets.items() for x in extras],
        "hub long, id long, extra long, n long, component long, common long, asks boolean")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in near_dedup.meeting(index, 75).collect()}
    able = {(a, b) for a, b in combinations(sets, 2) if (asks[a] or asks[b])
            and 175 * (min(sets[a][1], sets[b][1]) + len(sets[a][2] & sets[b][2])) >= 75 * (sets[a][0] + sets[b][0])
            and 100 * min(sets[a][0], sets[b][0]) >= 75 * max(sets[a][0], sets[b][0])}
    assert able and able <= found and len(found) < 500
