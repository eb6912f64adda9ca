"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fcverify.llm import spelling_variants as sv
from fcverify.llm.words import texts
from tests.llm import fixtures as fx


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(data, noise):
    out = Counter()
    for r in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts):
    form, near = {}, {}
    for w, n in counts.items():
        close = [x for x in counts if distance_one(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return out


def noisy(seed, n):
    rng = random.Random(seed)
    base = ["banana", "bananas", "letters", "lettters", "leters", "straße", "éclairs", "eclairs", "aaaaaaa", "aaaaaaaa", "Zebras"]
    long = ["q" * 63, "q" * 64, "q" * 65, "q" * 64 + "z", "xy" * 40, "xy" * 40 + "x", "xy" * 20 + "y" + "xy" * 20, "longer" * 300, "longer" * 300 + "r"]
    out = []
    for w in base + long:
        for _ in range(rng.choice([5, 6, 30, 160])):
            k = rng.randrange(len(w))
            out.append(w if rng.random() < .6 else w[:k] + rng.choice("abcé") * rng.choice([0, 1]) + w[k + 1:])
    return " ".join(rng.choices(out, k=n)) + " × ÷ don’t co-operate 12abc3 ñandúes"


@pytest.mark.parametrize("noise", [None, 3])
def test_variants_of_all_texts(spark, noise):
    data = [(i % 7 if i % 5 else None, noisy(i // 2, 150), None, None, 0) for i in range(30)] + [r for r in fx.rows() if len(r[1] or "") < 5000]
    docs = fx.frame(spark, data)
    found = sv.variants(sv.word_counts(docs, noise=noise).repartition(3)).collect()
    wanted = plain_variants(plain_counts(data, noise))
    assert fx.key_rows(found) == fx.key_rows(wanted)
    assert any(r.form for r in found)


def test_chains_ties_and_empty(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 625, "abgggg": 3125, "zzzzzz": 5, "zzzzzy": 30, "zzzzzx": 30, "alone0": 9}
    made = {r.word: r for r in sv.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert made["abcdef"].root == "abgggg" and made["abcdef"].form == "abcdeg"
    assert made["zzzzzz"].form == "zzzzzx" and made["zzzzzz"].n_near == 2 and made["alone0"].root == "alone0"
    assert sv.variants(sv.word_counts(fx.frame(spark, []))).count() == 0


def test_checksums_and_long_runs():
    value = "é" * 3 + " " + "k" * 2000 + " short abcdefgh"
    t = next(iter(texts(pa.array([value]))))
    starts, ends, size, owner = sv.letter_runs(t, 3)
    assert size.tolist() == [3, 2000, 5, 8] and not owner.any()
    states = np.full(len(starts), zlib.crc32(b"7:") ^ 0xFFFFFFFF, dtype=np.uint32)
    assert sv.checksums(t.bytes, starts, ends, states).tolist() == [zlib.crc32(f"7:{w}".encode()) for w in value.split(" ")]
    assert len(sv._rotations("ab" * 50_000)[0]) == 200_001
