"""Byte-level BPE by backtracking: exact merges in linear time, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary lists, for each position of a piece, the tokens that start there. The
encoder takes the longest, checks it against the token before it, and goes to shorter ones, or back a token, where the
two can't stand side by side. Two tokens can if the merges, taken in order, would not join across their border; the
answers are kept in a pair-compatibility table. The first sequence that reaches the end is the one that merging gives.

Texts are cut at spaces into units that the pre-tokenizer's pattern never joins, so a unit's ids depend on nothing
around it and are kept in a bounded cache. Where white space comes in runs of three or more, the border of two units may
shift; such a text is cut by the pattern itself.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import regex

#: Fixed by the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_SPACE = re.compile(r"\s{3}")
#: White space besides the space and the line feed: a fixed list.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = ("  ", "\n\n", " \n", "\n ")


def _plainly_spaced(text: str) -> bool:
    """Whether no run of three white spaces occurs; runs need a pair or a rare space, which are quicker to look for."""
    return not (any(p in text for p in _PAIRS) or any(c in text for c in _OTHER_SPACE)) or not _LONG_SPACE.search(text)


#: Letters, then marks that are neither letters, digits, white space nor an apostrophe: two pieces by the pattern.
_PLAIN_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Below this, every version of Unicode in use agrees on what is a letter.
_STABLE = "\u0558"

#: Letters and digits that Unicode 16.0 added: fixed values, known to the pre-tokenizer's tables but not to Python's.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)


def _newer(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in UNICODE_16)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Kept(dict):
    """Two generations of answers: when the young one is full it becomes the old one, whose unused answers go."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """A byte-level BPE tokenizer read from a ``tokenizers`` file; ``kept`` bounds each cache."""

    def __init__(self, path: str, kept: int = 200_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.alphabet = byte_alphabet()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        never = len(spec["model"]["merges"])
        #: For each token the order of the merge that makes it, and the two tokens merged (itself twice if none).
        self.rank = [-1] * self.size
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.joined: dict[tuple[int, int], int] = {}
        for order, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            token = vocab[a + b]
            self.joined[vocab[a], vocab[b]] = order
            if self.rank[token] < 0:
                self.rank[token], self.left[token], self.right[token] = order, vocab[a], vocab[b]
        self.never = never
        self.vocab = vocab
        self.length = [0] * self.size
        #: The longest other token that a token starts with, or -1.
        self.shorter = [-1] * self.size
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.length[i] = len(token)
            self.shorter[i] = next((vocab[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in vocab), -1)
            self.automaton.add_word(token, (len(token) - 1, i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = _Kept(lambda p: self._compatible(*divmod(p, self.size)), 4 * kept)
        self.pieces = _Kept(self._piece, kept)
        self.units = _Kept(lambda word: self._unit(" " + word), kept)  # by what follows the space
        self.split = regex.compile(PATTERN)
        self._table = bytes(range(256)).decode("latin-1")
        self._chars = {b: c for b, c in zip(self._table, (self.alphabet[i] for i in range(256)), strict=True)}
        self._map = str.maketrans(self._chars)
        back = {c: b for b, c in self.alphabet.items()}
        token_bytes = [b""] * self.size
        for token, i in vocab.items():
            token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            token_bytes[i] = token.encode()
        #: The offset table: token i is store[offsets[i]:offsets[i + 1]].
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in token_bytes])]).astype(np.int64)
        self.store = np.frombuffer(b"".join(token_bytes), np.uint8)

    def _compatible(self, one: int, two: int) -> bool:
        """Whether merging, in order, leaves the border of the two tokens alone: undo the later of the two last merges,
        again and again, and see whether the tokens that then meet at the border would have been joined before it."""
        rank, limit = self.rank, self.never
        while True:
            order = self.joined.get((one, two))
            if order is not None and order < limit:
                return False
            a, b = rank[one], rank[two]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, one = a, self.right[one]
            else:
                limit, two = b + (a != b), self.left[two]
                if a == b:
                    limit = b + 1

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece that the pattern cut, as little-endian 32-bit numbers."""
        chars = (piece if piece.isascii() else piece.encode().decode("latin-1")).translate(self._map)
        whole = self.vocab.get(chars)
        if whole is not None:
            return whole.to_bytes(4, "little")
        out = array("I", self.encode_piece(chars))
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode_piece(self, chars: str) -> list[int]:
        """Ids of a piece written in the byte alphabet."""
        n, size, length, shorter, pairs = len(chars), self.size, self.length, self.shorter, self.pairs
        longest = [0] * n
        for end, (back, token) in self.automaton.iter(chars):  # by end: of those that start together the longest comes last
            longest[end - back] = token
        out: list[int] = []
        dead: set[int] = set()  # positions from which no way leads on
        at, token = 0, longest[0]
        while True:
            to = at + length[token]
            if (not out or pairs[out[-1] * size + token]) and to not in dead:
                out.append(token)
                if to == n:
                    return out
                at, token = to, longest[to]
                continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def _unit(self, unit: str) -> bytes:
        pieces = self.pieces
        if m := _PLAIN_WORD.fullmatch(unit):
            return pieces[m[1]] + pieces[m[2]] if m[2] else pieces[unit]
        if unit.isascii() or max(unit) < _STABLE:
            return b"".join([pieces[x] for x in self.split.findall(unit)])
        # Code points that Unicode has assigned since the tables of the pre-tokenizer are neither letters nor digits to it.
        known = "".join("\uffff" if c >= _STABLE and unicodedata.category(c) == "Cn" and not _newer(c) else c for c in unit)
        return b"".join([pieces[unit[m.start() : m.end()]] for m in self.split.finditer(known)])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if not _plainly_spaced(text):
            return self._unit(text)
        first, *rest = text.split(" ")
        return self._unit(first) + b"".join(map(self.units.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers; null is empty."""
        text = text or ""
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered through the offset table."""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        before = np.cumsum(size) - size
        return self.store[np.repeat(start - before, size) + np.arange(int(size.sum()))].tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(np.asarray(list(ids), np.int64)).decode("utf-8", "replace")


class RankEncoder(Encoder):
    """The same ids, with ``tiktoken`` merging the units that aren't in the cache: faster where the encoder itself isn't the point.

    All new units of a run of texts go to it at once, with a special token between them. Needs ids in the order of the
    merges, as byte-level vocabularies have them; for other files it is the backtracking encoder.
    """

    def __init__(self, path: str, kept: int = 300_000) -> None:
        super().__init__(path, kept)
        ids = sorted(self.vocab.values())
        self.fast = all(self.rank[a] < self.rank[b] or self.rank[b] < 0 for a, b in zip(ids, ids[1:], strict=False))
        if self.fast:
            import tiktoken

            ends = self.offsets
            ranks = {self.store[ends[i] : ends[i + 1]].tobytes(): i for i in ids}
            self.border = self.size  # an id that no token has
            self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={_BORDER: self.border})

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as ``encode`` gives them."""
        if not self.fast:
            return [self.encode(x) for x in texts]
        out: list[bytes | list[str]] = []
        words: set[str] = set()
        for text in texts:
            text = text or ""
            if not text or self._added and self._added.search(text) or _BORDER in text or not _plainly_spaced(text):
                out.append(self.encode(text))
            else:
                out.append(text.split(" "))
                words.update(out[-1][1:])
        self._learn([x for x in words if x not in self.units and x not in self.units.old])
        kept = self.units.__getitem__
        return [x if isinstance(x, bytes) else self._unit(x[0]) + b"".join(map(kept, x[1:])) for x in out]

    def _learn(self, words: list[str]) -> None:
        if len(self.units) + len(words) > self.units.most:
            self.units.old = dict(self.units)
            self.units.clear()
        words = [x for x in words if x.isascii() or max(x) < _STABLE]
        if words:
            ids = np.array(self.merge.encode(_BORDER.join([" " + x for x in words]), allowed_special="all"), "<u4")
            ends = np.append(np.flatnonzero(ids == self.border), len(ids)) * 4
            mem = ids.tobytes()
            self.units.update(zip(words, [mem[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)], strict=True))


#: Separates units for the merging library; a text that holds it is encoded by itself.
_BORDER = "<|unit|>"


@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder for each worker process, file and kind."""
    return kind(path)
