"""Byte-level BPE: ids by the tokenizers library for packing, and an encoder of its own by per-prefix dynamic programming.

Prefix programme. For every prefix of a pre-token's bytes exactly one token can end the prefix's BPE encoding. An
automaton over the vocabulary lists, for each position, the tokens that end there, longest first; a token is the last
one of the prefix if it and the last token of the shorter prefix are compatible, that is, if merging their bytes alone
gives just the two again. Following the stored tokens backwards from the end emits the exact ids.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

import ahocorasick
import numpy as np
import tokenizers

#: Words kept with their ids in each of two generations; when the young one is full, it replaces the old one.
MEMO_WORDS = 400_000
#: Parts of texts that LibraryEncoder keeps in each of its two generations.
LIBRARY_WORDS = 200_000
#: Letters that no contraction or number can touch, or marks, up to the next of the other kind or white space; else all up
#: to a space or line feed. A space or line feed by itself says that the text can't be cut.
PART = re.compile(r"[ \n]?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^ \n.,!?;:|*#$%&])|[.,!?;:|*#$%&]+(?![^ \nA-Za-zÀ-ÖØ-öø-ÿ])|[^ \n]+)|[ \n]")
#: Parts that are one pre-token.
PRE_TOKEN = re.compile(" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,!?;:|*#$%&]+)")
#: Letters that no contraction or number can touch, then perhaps marks: two pre-tokens at most.
PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|*#$%&]*)")
#: Longer pieces are not kept.
MEMO_CHARS = 48


@functools.cache
def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Exact encoder and decoder for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        back = byte_symbols()
        raw = lambda t: bytes(back[c] for c in t)
        vocab = held["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank_of: dict[int, int] = {}
        for n, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in held["model"]["merges"]):
            left, right = vocab[a], vocab[b]
            whole = vocab[a + b]
            self.rank[left, right] = n
            if whole not in self.halves:
                self.halves[whole], self.rank_of[whole] = (left, right), n
        self.fits: dict[tuple[int, int], bool] = {}
        # A token that its own bytes don't merge to never ends a prefix.
        self.whole = {i for i in vocab.values() if i not in self.special.values() and (i not in self.halves or self._merged(self.bytes_of[i]) == [i])}
        self.automaton = ahocorasick.Automaton()
        for i in self.whole:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.automaton.make_automaton()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pre = tokenizers.Tokenizer.from_file(path).pre_tokenizer
        self.memo, self.old = _Words(self._add), {}

    def _merged(self, word: bytes) -> list[int]:
        """Merge by rank, for short byte strings."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best, at = min((self.rank.get(p, 1 << 40), k) for k, p in enumerate(zip(ids, ids[1:])))
            if best == 1 << 40:
                break
            ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of two whole tokens, merged alone, give the two tokens again."""
        if len(self.fits) >= 1_000_000:
            self.fits.clear()
        known = self.fits[a, b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Undo merges along the seam, the latest first: the two stay apart if at no time an earlier merge crossed it.

        Of equal merges the left one comes first, so one across the seam wins against the same merge inside b, not inside a.
        """
        rank, made, halves = self.rank, self.rank_of, self.halves
        until = len(rank) + 1
        while True:
            crossing = rank.get((a, b))
            if crossing is not None and crossing < until:
                return False
            of_a, of_b = made.get(a, -1), made.get(b, -1)
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                until, a = of_a, halves[a][1]
            else:
                until, b = of_b + 1, halves[b][0]

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        direct = self.id_of.get(word)
        if direct in self.whole:
            return [direct]
        n, fits, done = len(word), self.fits.get, -1
        last = [-1] * n
        for end, (size, token) in self.automaton.iter(word.decode("latin-1")):
            if end != done:
                if size > end:
                    last[end], done = token, end
                else:
                    pair = last[end - size], token
                    ok = fits(pair)
                    if self.compatible(*pair) if ok is None else ok:
                        last[end], done = token, end
        ids, at = [], n - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def piece(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                for _, (a, b) in self.pre.pre_tokenize_str(part):
                    out += self.encode_word(part[a:b].encode())
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """As piece(), with the words between single spaces kept in a table of bounded size.

        A pre-token holds a space only at its start or in a run of white space. So a text may be cut before every
        space that does not touch other white space; a text with any other space goes through piece() as a whole.
        """
        if not text or "  " in text:
            return self.piece(text)
        words = text.split(" ")
        try:
            return self.piece(words[0]) + b"".join(map(self.memo.__getitem__, words[1:]))
        except Unsafe:
            return self.piece(text)

    def _add(self, word: str) -> bytes:
        got = self.old.get(word) or self.memo.get(word)
        if got is None:
            if m := PLAIN_WORD.fullmatch(word):
                ids = self.encode_word(b" " + m[1].encode())
                if m[2]:
                    ids += self.encode_word(m[2].encode())
                got = struct.pack(f"<{len(ids)}I", *ids)
            elif word[:1].isspace():
                raise Unsafe
            else:
                got = self.piece(" " + word)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo, self.old = _Words(self._add), self.memo
            self.memo[word] = got
        return got

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)]).decode("utf-8", "replace")


class _Words(dict):
    """Words with their ids; one that is missing is encoded."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, word: str) -> bytes:
        return self.add(word)


class Unsafe(Exception):
    """A word that starts with white space: the text is not cut at spaces."""


class LibraryEncoder:
    """Ids as the tokenizers library gives them, each part of a text asked for once as long as it is kept.

    A pre-token of a byte-level vocabulary holds a space only at its start or in a run of white space, a line feed only in
    such a run, and never both letters and marks. So a text may be cut before every space or line feed that no white space
    follows, and there between letters and the marks of PART. Texts that can't be cut so, that hold strings of special
    tokens, or whose tokenizer isn't byte-level, go to the library as a whole.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        self.model = self.library.model
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        pre = self.library.pre_tokenizer
        self.can_cut = self.library.normalizer is None and isinstance(pre, tokenizers.pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        self.printed = {b: c for c, b in byte_symbols().items()}
        self.bytes_of_id = [struct.pack("<I", i) for i in range(max(self.library.get_vocab(with_added_tokens=True).values()) + 1)]
        self.feed = self._whole("\n")
        self.forget()

    def forget(self) -> None:
        self.parts, self.old = _Words(self._add), {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _add(self, part: str) -> bytes:
        got = self.old.get(part) or self.parts.get(part) or self._ids(part)
        if len(part) <= MEMO_CHARS:
            if len(self.parts) >= LIBRARY_WORDS:
                self.parts, self.old = _Words(self._add), self.parts
            self.parts[part] = got
        return got

    def _ids(self, part: str) -> bytes:
        feed = part[0] == "\n"
        one = part[1:] if feed else part
        if PRE_TOKEN.fullmatch(one):
            ids = self.bytes_of_id
            got = b"".join([ids[t.id] for t in self.model.tokenize((one if one.isascii() else one.encode().decode("latin-1")).translate(self.printed))])
            return self.feed + got if feed else got
        if part[0] in " \n" and (len(part) == 1 or part[1].isspace()):
            raise Unsafe
        return self._whole(part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        return [self._encode(t) if t else b"" for t in texts]

    def _encode(self, text: str) -> bytes:
        if self.can_cut and not any(x in text for x in self.special):
            try:
                return b"".join(map(self.parts.__getitem__, PART.findall(text)))
            except Unsafe:
                pass
        return self._whole(text)


@functools.cache
def library(path: str) -> LibraryEncoder:
    # A task has one core; the library's own threads would each keep an arena of memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return LibraryEncoder(path)


@functools.cache
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)
