"""Encoding texts with a public BPE tokenizer at the speed of a word cache.

The tokenizer's own rules lower-case a text, drop white space and cut it into letter runs, single digits and runs of
other signs, each of which is encoded alone. For texts of plain Latin-1 characters those rules are a small
regular expression, so pieces are looked up in a bounded cache and only new pieces go through the tokenizer;
any other text, and one that holds the string of an added token, goes through it whole. Both ways give the ids
that the tokenizer itself gives with ``add_special_tokens=False``.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from functools import cached_property

#: Characters on which both ways agree: printable Latin-1 with tab, line feed and carriage return.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
#: The tokenizer's split rule, restricted to those characters (after lower-casing): fixed values.
LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: Pieces that a worker remembers, and the longest piece it does.
CACHE_PIECES, CACHE_LENGTH = 250_000, 64


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for the characters from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens; ``path`` is the tokenizer's file."""

    def __init__(self, path: str):
        self.path = path
        self.cache: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def added(self) -> re.Pattern[str] | None:
        """Strings that the tokenizer maps to one id before its own rules apply, in any case of their letters."""
        found = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        return re.compile("|".join(map(re.escape, found)), re.IGNORECASE) if found else None

    @cached_property
    def model(self):
        return self.tokenizer.model

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, p: str) -> bytes:
        """Ids of a piece that the split rule leaves whole: it goes straight to the model's merges."""
        word = p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as bytes of 4 for each id."""
        out: list[bytes] = [b""] * len(texts)
        cache, known, added = self.cache, self.cache.get, self.added
        waiting, rest, new = [], [], {}
        for i, text in enumerate(texts):
            if not PLAIN.fullmatch(text) or (added and added.search(text)):
                rest.append(i)
                continue
            pieces = PIECE.findall(text.lower())
            ids = list(map(known, pieces))
            if None in ids:
                gaps, at = [], -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    gaps.append((at, pieces[at]))
                    new[pieces[at]] = b""
                waiting.append((i, ids, gaps))
            else:
                out[i] = b"".join(ids)
        new = {p: self.piece(p) for p in new}
        for i, ids, gaps in waiting:
            for at, p in gaps:
                ids[at] = new[p]
            out[i] = b"".join(ids)
        for p, b in new.items():
            if len(cache) >= CACHE_PIECES:
                break
            if len(p) <= CACHE_LENGTH:
                cache[p] = b
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = ids
        return out


def worker_encoder(path: str) -> WordEncoder:
    """The encoder that this Python worker keeps from task to task: loaded once, with one bounded cache."""
    state = sys.modules.setdefault("_loomvec_worker", types.ModuleType("_loomvec_worker"))
    encoders = state.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders.clear()
        encoders[path] = WordEncoder(path)
    return encoders[path]
