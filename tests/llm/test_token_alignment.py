"""Token alignment against a brute-force version."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from fcverify.llm import token_alignment, token_ids
from tests.llm import fixtures as fx

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [" a  b\n\n c d   e", "  x", "a <|endoftext|> b", "<s> </s> don 't I 'll", "é à  ü x y　z", "漢字 テスト x", "\t\t a \n b",
           "ﬁ ﬂ x́ y", "x▁y z", "a\u0000b c", "idea ideas idea", "1 2 3 a1 b", "🙂🙂 x"]


def plain(texts):
    """Digest of each text by whole encodings and all pairs of ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(A)
    tool.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a, bytes_b = token_ids.byte_level_bytes(A), token_ids.piece_bytes(B)
    per, held = [], Counter()
    for t in texts:
        ids = [tool.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)] if t else [[], []]
        parts = [[table[i] for i in own] for table, own in zip((bytes_a, bytes_b), ids, strict=True)]
        if not t or any(b"".join(p) != b" " + t.encode() for p in parts):
            per.append(None)
            continue
        ends = [[sum(map(len, p[:k + 1])) for k in range(len(p))] for p in parts]
        links, groups, at = Counter(), [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [x.index(e) + 1 for x in ends]
            own = [range(f, n) for f, n in zip(at, to, strict=True)]
            groups.append("|".join(",".join(str(ids[s][k]) for k in own[s]) for s in (0, 1)))
            for x in own[0]:
                for y in own[1]:
                    if max(ends[0][x] - len(parts[0][x]), ends[1][y] - len(parts[1][y])) < min(ends[0][x], ends[1][y]):
                        links[ids[0][x], ids[1][y]] += 1
            at = to
        per.append((len(ids[0]), len(ids[1]), groups, links))
        held.update(links.keys())
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (
        p[0], p[1], len(p[2]), sum(p[3].values()), sum(n for k, n in p[3].items() if held[k] == top[k[0]]),
        sum(n * held[k] for k, n in p[3].items()), hashlib.sha256(";".join(p[2]).encode()).hexdigest()) for p in per]


@pytest.mark.parametrize("slice_bytes", [1, 3000, 4 << 20])
def test_alignment_is_that_of_whole_texts(spark, slice_bytes):
    data = [r for r in fx.rows() if len(r[1] or "") < 5000]
    data += [(100 + i, t, None, None, 0) for i, t in enumerate(AWKWARD)] + [(200 + i, AWKWARD[0], None, None, 0) for i in range(12)]
    found = token_alignment.alignment(fx.frame(spark, data).repartition(3), A, B, slice_bytes=slice_bytes).drop("groups").collect()
    wanted = [(r[0], *p) for r, p in zip(data, plain([r[1] for r in data]), strict=True)]
    assert fx.key_rows(found) == fx.key_rows(wanted)


def test_groups_and_pair_counts_are_real_outputs(spark):
    docs = fx.frame(spark, [(1, "some words here", None, None, 0), (1, "some words here", None, None, 0), (2, None, None, None, 0)])
    rows = token_alignment.alignment(docs, A, B, groups=True).collect()
    assert [hashlib.sha256(r.groups.encode()).hexdigest() for r in rows if r.groups] == [r.groups_sha256 for r in rows if r.groups]
    counts = token_alignment.pair_counts(token_alignment.aligned(docs, A, B)).collect()
    assert counts and all(r.n == 2 and r.best for r in counts)
    assert token_alignment.alignment(docs.limit(0), A, B).count() == 0


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    tool = token_alignment.Aligner(A, B)
    texts = ["alpha beta gamma alpha", "beta beta delta"]
    right, _ = token_alignment.slice_rows(tool, texts, True)
    monkeypatch.setattr(token_alignment, "span_hash", lambda p, s, e, seed: (e - e).astype("u8"))
    assert token_alignment.slice_rows(tool, texts, True)[0] == right


def test_stretches_encode_like_whole_texts():
    from tokenizers import Tokenizer

    tool, fast = Tokenizer.from_file(A), token_ids.Encoder([token_ids.byte_level(A)])
    for t in [*AWKWARD, " " * 70_000 + "x", "\n" * 70_000, "x\n \n y  z 'tis", fx.words_text(5, 3000, 100000)]:
        assert fast.ids(t).tolist() == tool.encode(t, add_special_tokens=False).ids
    small = token_ids.Encoder(fast.tools, memory=5)
    for t in [fx.words_text(9, 50), fx.words_text(10, 50)] * 2:
        assert small.after_space(t)[0][0].tolist() == tool.encode(" " + t, add_special_tokens=False).ids
