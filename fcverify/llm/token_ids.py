"""Token ids of whole texts, with a memory of what the stretches between single spaces encode to.

Neither tokenizer joins anything across a single space between two visible characters to what stands
before it: the byte-level split pattern starts a new pre-token there, and no piece of the piece model
has a space mark after another sign. A text is therefore cut before such spaces, each distinct
stretch is encoded by the tokenizer's own library once, and the ids are put together again. The
fields of the file that this rests on are checked; a file without them is run on uncut texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: A single space between characters that no tokenizer counts as white space.
CUT = re.compile("(?<=[!-~À-ÿ]) (?=[!-~À-ÿ])")
MEMORY, TOGETHER = 200_000, 2000
#: Stretches that may stand next to others: their ends are such characters.
VISIBLE = re.compile("[!-~À-ÿ](?s:.*[!-~À-ÿ])?")
ODD = 0xFFFFFFFF
PIECE_SPACE = "▁"


class Tool:
    """A tokenizer: ``library`` encodes a text, ``tokens`` are the bytes of each id, ``lead`` is what a stretch
    gets in front (nothing where the library itself adds the space), ``cut`` whether texts may be cut."""

    def __init__(self, library: Callable[[str], list[int]], tokens: list[bytes], cut: bool, lead: str):
        self.library, self.tokens, self.cut, self.lead = library, tokens, cut, lead
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def stretches(self, parts: list[str]) -> list[bytes]:
        """Packed ids of stretches after a space; ``ODD`` follows where the tokens have other bytes than the stretch.

        Visible stretches are encoded as one text that is taken apart again by the lengths of its tokens.
        """
        text = " ".join(parts)
        if self.cut and len(parts) > 1 and all(map(VISIBLE.fullmatch, parts)):
            ids = self.library(self.lead + text)
            if self.bytes_of(ids) == b" " + text.encode():
                size = [len(p) for p in parts] if text.isascii() else [len(p.encode()) for p in parts]
                wanted = np.cumsum(size) + np.arange(1, len(parts) + 1)
                ends = np.cumsum(self.sizes[ids])
                at = np.searchsorted(ends, wanted)
                if (ends[at] == wanted).all():
                    packed, cuts = _pack(ids), [0, *(4 * at + 4).tolist()]
                    return [packed[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        out = []
        for p in parts:
            ids = self.library(self.lead + p)
            out.append(_pack(ids) + (b"" if self.bytes_of(ids) == b" " + p.encode() else _pack([ODD])))
        return out


class Encoder:
    """Ids of texts by one or more tools, with a common memory of stretches."""

    def __init__(self, tools: list[Tool], memory: int = MEMORY):
        self.tools, self.memory = tools, memory
        self.cut = all(t.cut for t in tools)
        #: packed ids of stretches; those of the last but one generation are kept as long as this one fills
        self.known: dict[str, tuple[bytes, ...]] = {}
        self.older: dict[str, tuple[bytes, ...]] = {}

    def after_space(self, text: str) -> list[tuple[np.ndarray, bool]]:
        """Per tool: ids of a space and the text, and whether each stretch is known to keep its bytes."""
        return [_read(b"".join(x)) for x in zip(*self._found(CUT.split(text) if self.cut else [text]), strict=True)]

    def ids(self, text: str) -> np.ndarray:
        """Ids of the text alone by the first tool."""
        parts = CUT.split(text) if self.cut else [text]
        rest = b"".join(f[0] for f in self._found(parts[1:]))
        return _read(_pack(self.tools[0].library(parts[0])) + rest)[0]

    def _found(self, parts: list[str]) -> list[tuple[bytes, ...]]:
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        new = [p for p in set(parts) if p not in self.known]
        if new:
            self.known.update((p, self.older[p]) for p in new if p in self.older)
            new = [p for p in new if p not in self.older]
            visible = [p for p in new if VISIBLE.fullmatch(p)]
            for some in (visible, [p for p in new if not VISIBLE.fullmatch(p)]):
                for at in range(0, len(some), TOGETHER):
                    own = some[at:at + TOGETHER]
                    self.known.update(zip(own, zip(*(t.stretches(own) for t in self.tools), strict=True), strict=True))
        return list(map(self.known.__getitem__, parts))


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _read(packed: bytes) -> tuple[np.ndarray, bool]:
    ids = np.frombuffer(packed, dtype="<u4")
    odd = ids == ODD
    return (ids[~odd], False) if odd.any() else (ids, True)


@lru_cache(maxsize=4)
def byte_level(path: str, plain_specials: bool = False) -> Tool:
    """Tool of a file of ``tokenizers``; with ``plain_specials`` the strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    before = made.get("pre_tokenizer") or {}
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    tight = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in made["added_tokens"])
    cut = split and tight and made.get("normalizer") is None and made["model"]["type"] == "BPE" and not made.get("truncation")
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = plain_specials
    return Tool(lambda text: tool.encode(text, add_special_tokens=False).ids, byte_level_bytes(path), bool(cut), " ")


@lru_cache(maxsize=2)
def piece_level(path: str) -> Tool:
    """Tool of a piece model; the library itself puts a space in front of each text."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [tool.id_to_piece(i) for i in range(tool.get_piece_size())]
    inner = any(PIECE_SPACE in p.lstrip(PIECE_SPACE) for p in pieces)
    prefixed = tool.encode("a", out_type=str)[0].startswith(PIECE_SPACE)
    return Tool(lambda text: tool.encode(text), piece_bytes(path), prefixed and not inner, "")


@lru_cache(maxsize=4)
def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level file."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    # the file writes bytes as printable characters: those of Latin-1 as themselves, others from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = {t["id"]: t["content"].encode() for t in made["added_tokens"]}
    out = [b""] * (1 + max(*made["model"]["vocab"].values(), *added))
    for token, i in made["model"]["vocab"].items():
        out[i] = added[i] if i in added else bytes(signs[c] for c in token)
    for i, content in added.items():
        out[i] = content
    return out


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a piece model: the piece with its mark as a space, a byte piece as its byte."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [(tool.id_to_piece(i), tool.is_byte(i)) for i in range(tool.get_piece_size())]
    return [bytes([int(n[3:5], 16)]) if byte else n.replace(PIECE_SPACE, " ").encode() for n, byte in names]
