"""Words of a text as numbers, without a loop over characters."""

from __future__ import annotations

import unicodedata

import numpy as np

_WIDE = 0x20000
_BASE = np.uint64(1_000_003)


class Words:
    """Word hashes that are equal for words alike but for case, accents, width, look-alike letters and invisible characters."""

    def __init__(self) -> None:
        from veilgauge.llm.lookalikes import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES

        self.low = np.arange(_WIDE, dtype=np.uint64)
        self.word = np.zeros(_WIDE, bool)
        self.drop = np.zeros(_WIDE, bool)
        like = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES
        for o in range(_WIDE):
            ch = chr(o)
            cat = unicodedata.category(ch)
            if cat in ("Cf", "Mn"):
                self.drop[o] = True
            elif cat[0] == "L" or cat == "Nd":
                self.word[o] = True
                if o > 127 and not 0x3400 <= o < 0xD7B0:
                    plain = unicodedata.normalize("NFKD", like.get(ch, ch))
                    ch = plain[0] if len(plain) and (len(plain) == 1 or unicodedata.category(plain[1]) == "Mn") else ch
                ch = ch.lower()
                self.low[o] = ord(ch[0])
        self.han = np.zeros(_WIDE, bool)
        self.han[0x3400:0xA000] = True
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(63, _BASE, np.uint64)]))

    def codes(self, text: str) -> np.ndarray:
        c = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _WIDE - 1)
        gone = self.drop[c]
        return c[~gone] if gone.any() else c

    def __call__(self, text: str) -> np.ndarray:
        """Hashes of the words in order; each Han character is a word."""
        return self.spans(self.codes(text))[0]

    def spans(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the words of `c`."""
        inside, han = self.word[c], self.han[c]
        no = np.zeros(1, bool)
        before, after = np.concatenate([no, inside[:-1]]), np.concatenate([inside[1:], no])
        first, last = inside & ~before, inside & ~after
        if han.any():
            first |= inside & (han | np.concatenate([no, han[:-1]]))
            last |= inside & (han | np.concatenate([han[1:], no]))
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            return np.zeros(0, np.uint64), start, end
        length = end - start
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = np.repeat(start - first, length) + np.arange(int(length.sum()))
        place = at - np.repeat(start, length)
        h = np.add.reduceat(self.low[c[at]] * self.power[np.minimum(place, 63)], first)
        return mixed(h), start, end


def mixed(h: np.ndarray) -> np.ndarray:
    """`h` with its bits spread."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : i + n]
    return mixed(out)
