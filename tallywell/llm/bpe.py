"""Encodings of a byte-level BPE tokenizer file, whole and by pre-token.

Two tiers serve token counts. The first is a compact table of the pre-tokens that
are most frequent in the texts themselves, as measured on a bounded sample of
them; it decides how fast a count is, and never what it is. The second is a
bounded cache in each Python worker, filled by encoding the pre-tokens the table
lacks. But for the counts of the sample, no pre-token is shuffled.

Plain texts (characters whose class no Unicode version changes, and no special
token's string) are cut here and encoded from the file's vocabulary by tiktoken,
which gives the same ids and is several times faster. All other texts go to the
file's own library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: Letters of plain texts: Latin, Greek, Cyrillic, Hebrew, Arabic, kana, Han and Hangul, as far as no version differs.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0400-\u045f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u3041-\u3094\u30a1-\u30fa\u30fc-\u30fe\u4e00-\u9fa5\uac00-\ud7a3"
#: Neither letters, numbers nor white space: punctuation in common use, arrows, box drawing, symbols, emoji and what joins them.
_MARKS = "¡-©«-±´¶-¸»¿\u200b-\u200f\u2010-\u2026\u20ac\u2190-\u21f3\u2500-\u259f\u2600-\u26ff\u3001-\u3003\u3008-\u3011\ufe0f\uff01-\uff0f\uff1a-\uff20\U0001f300-\U0001f5ff\U0001f600-\U0001f64f\U0001f680-\U0001f6c5"
_PLAIN = re.compile(rf"[\t\n\x0b\x0c\r\x20-\x7e\xa0\u3000{_LETTERS}{_MARKS}]*")
#: public_tokenizers.PATTERN for plain texts, where letters and digits are just these.
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _fast(path: str, special: set[str]):
    """The same vocabulary for tiktoken: an entry's id is its rank, and its characters stand for bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(0x100) if b not in shown)}
    ranks = {bytes(byte[c] for c in s): i for s, i in vocab.items() if s not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Where a text may be cut without changing a pre-token: white space ends whatever came before it.
_BETWEEN = re.compile(r"(?<=[A-Za-z0-9.,])(?=[ \n])")


def segments(s: str, size: int = 1 << 20) -> list[str]:
    """s in parts of about ``size`` characters that are encoded each by itself to the same ids."""
    out, a = [], 0
    while len(s) - a > 2 * size and (m := _BETWEEN.search(s, a + size)):
        out.append(s[a : m.start()])
        a = m.start()
    return [*out, s[a:]]


class Encoder:
    """Encodes texts in a worker. ids(): an array for each text; lengths(): their number.

    table: the first tier. limit: entries of the worker's cache, which is emptied when full.
    """

    def __init__(self, path: str, table: dict[str, int] | None = None, limit: int = 400_000):
        self.library, self.table, self.limit = load(path), table or {}, limit
        special = {x.content for x in self.library.get_added_tokens_decoder().values()}
        self.fast = _fast(path, special)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, int] = {}
        self.newline = int(self.fast.encode_ordinary("\n")[0])

    def _plain(self, s: str) -> bool:
        return _PLAIN.fullmatch(s) is not None and self.special(s) is None

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.concatenate([self._ids(x) for x in segments(s)]) for s in texts]

    def _ids(self, s: str) -> np.ndarray:
        return np.asarray(self.fast.encode_ordinary(s) if self._plain(s) else self.library.encode(s, add_special_tokens=False).ids, self.dtype)

    def _learn(self, pieces: set[str]) -> None:
        """Puts the lengths of pre-tokens into the cache. A line break parts words and is a token of its own."""
        words = [p for p in pieces if not p.isspace()]
        ids = np.asarray(self.fast.encode_ordinary("\n".join(words)), np.int64)
        ends = np.r_[np.flatnonzero(ids == self.newline), len(ids)]
        self.cache.update(zip(words, np.diff(ends, prepend=-1) - 1))
        self.cache.update((p, len(self.fast.encode_ordinary(p))) for p in pieces if p.isspace())

    def lengths(self, texts: list[str]) -> list[int]:
        if len(texts) == 1 and len(some := segments(texts[0])) > 1:
            return [sum(self.lengths([x])[0] for x in some)]
        plain = [self._plain(s) for s in texts]
        cut = [_CUT.findall(s) if p else () for s, p in zip(texts, plain)]
        if len(self.cache) > self.limit:
            self.cache = {}
        new = set(chain.from_iterable(cut)).difference(self.table, self.cache)
        if new:
            self._learn(new)
        table, cache = self.table, self.cache
        return [sum([table[p] if p in table else cache[p] for p in pieces]) if p else len(self.library.encode(s, add_special_tokens=False).ids) for s, pieces, p in zip(texts, cut, plain)]


    def cut(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of plain texts, and none of others."""
        return [_CUT.findall(s) if self._plain(s) else [] for s in texts]


def frequent_lengths(path: str, pieces: list[str]) -> dict[str, int]:
    """The first tier for some pre-tokens: pre-token -> number of tokens."""
    e = Encoder(path)
    e._learn(set(pieces))
    return {s: int(e.cache[s]) for s in sorted(set(pieces))}
