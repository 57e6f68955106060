"""String similarities that Spark lacks, in Arrow batches: Indel ratio, token sort, partial ratio, matching blocks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits of one big integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """200 LCS / (|a| + |b|); 100 for two empty strings, 0 if one is null."""
    if a is None or b is None:
        return 0.0
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_window(a: str | None, b: str | None) -> float:
    """The best ratio of the shorter string with windows of the longer, windows at the ends may be shorter; 0 if one is empty."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    n = len(a)
    return max(indel_ratio(a, b[max(0, i):i + n]) for i in range(1 - n, len(b)))


def reaches(word: str, text: str, percent: float) -> bool:
    """best_window(word, text) >= percent, for a word no longer than the text, looking only where it can be.

    A window of m' <= m letters at a ratio r shares at least r (m + m') / 2 letters, so word and window differ by at most
    `most` letters left out or put in. Of most + 1 parts of the word one stands in the window unbroken: windows are only tried
    around such parts. Below one letter a part every window is tried.
    """
    if not word or not text:
        return False
    if len(word) > len(text):
        return best_window(word, text) >= percent
    if word in text:
        return True
    m = len(word)
    most = int(2 * m * (1 - percent / 100) / (percent / 100) + 1e-9)
    if most + 1 > m:
        return best_window(word, text) >= percent
    cuts = [m * i // (most + 1) for i in range(most + 2)]
    starts: set[int] = set()
    for a, b in zip(cuts, cuts[1:]):
        at = text.find(word[a:b])
        while at >= 0:
            starts.update(range(at - a - most, at - a + most + 1))
            at = text.find(word[a:b], at + 1)
    return any(indel_ratio(word, text[max(0, i):i + m]) >= percent for i in starts if 1 - m <= i < len(text))


class Packed:
    """Texts by length as one array of code points, each behind a 0, with bit vectors of their letters (each counted) and bigrams."""

    def __init__(self, texts: list[str], words: int) -> None:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(lens, kind="stable")
        self.texts, self.lens = [texts[i] for i in self.order], lens[self.order]
        self.flat = np.frombuffer("\0".join(["", *self.texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.at = np.cumsum(self.lens + 1) - self.lens - 1
        chars, rows = self.flat[:-1], np.repeat(np.arange(len(texts)), self.lens + 1)
        by = np.lexsort((chars, rows))
        new = np.flatnonzero(np.append(True, (np.diff(rows[by]) != 0) | (chars[by][1:] != chars[by][:-1])))
        nth = np.empty(len(by), np.uint64)  # how often the letter stood in its text before
        nth[by] = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
        self.letters = self._bits(chars << np.uint64(6) | np.minimum(nth, np.uint64(63)), max(1, words // 2))
        self.bigrams = self._bits(chars << np.uint64(21) | self.flat[1:], words)

    def _bits(self, features: np.ndarray, words: int) -> np.ndarray:
        h = (features * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) * np.uint64(64 * words) >> np.uint64(31)
        bit, word = np.uint64(1) << (h & np.uint64(63)), h >> np.uint64(6)
        return np.array([np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), self.at) for w in range(words)])


def _common(a: Packed, b: Packed, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lcs() of pairs, many at once by words of 64 bits; of pairs with a long first text one by one."""
    out = np.empty(len(i), np.int64)
    long = a.lens[i] > 256
    for k in np.flatnonzero(long):
        out[k] = lcs(a.texts[i[k]], b.texts[j[k]])
    rest = np.flatnonzero(~long)
    if not len(rest):
        return out
    rest = rest[np.argsort(i[rest], kind="stable")]
    alphabet = np.unique(a.flat)
    slots, width = len(alphabet) + 1, int(a.lens[i[rest]].max() + 63) // 64
    code = np.minimum(np.searchsorted(alphabet, b.flat), len(alphabet) - 1)
    code = np.where(alphabet[code] == b.flat, code, len(alphabet))
    own, nth = np.unique(i[rest], return_inverse=True)
    cuts = np.unique(np.concatenate([np.arange(0, len(rest), 200_000), np.searchsorted(nth, np.arange(0, len(own), max(1, 4_000_000 // (width * slots)))), [len(rest)]]))
    for lo, hi in zip(cuts, cuts[1:]):
        rows = own[nth[lo]:nth[hi - 1] + 1]
        n = a.lens[rows]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        slot = np.repeat(np.arange(len(rows)) * slots, n) + np.searchsorted(alphabet, a.flat[np.repeat(a.at[rows] + 1, n) + inside])
        masks = np.zeros((width, len(rows) * slots), np.uint64)
        np.bitwise_or.at(masks, (inside >> 6, slot), np.uint64(1) << (inside & 63).astype(np.uint64))
        by = np.argsort(-b.lens[j[rest[lo:hi]]], kind="stable")  # the longest first: those still running stay in front
        part, slot = rest[lo:hi][by], ((nth[lo:hi] - nth[lo]) * slots)[by]
        size, start = b.lens[j[part]], b.at[j[part]] + 1
        v = np.full((width, len(part)), ~np.uint64(0))
        for k in range(size[0]):
            live = np.searchsorted(-size, -k)
            at = slot[:live] + code[start[:live] + k]
            carry = np.zeros(live, np.uint64)
            for w in range(width):
                x = v[w, :live]
                u = x & masks[w].take(at)
                s = x + u
                over = s < x
                s += carry
                over |= s < carry
                carry = over.astype(np.uint64)
                v[w, :live] = s | (x - u)
        out[part] = 0
        for w in range(width):
            left = np.clip(a.lens[i[part]] - 64 * w, 0, 64).astype(np.uint64)
            keep = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
            out[part] += np.bitwise_count(~v[w] & keep)
    return out


def similar(left: list[str], right: list[str], percent: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, ratios) of all pairs of texts with an indel_ratio() of at least `percent`; no text may be empty.

    A pair that reaches it is `most` letters left out or put in apart. Each changes one counted letter and at most three
    bigrams, and so at most as many bits of the vectors that hash them: pairs with more different bits can't reach it. All
    pairs of a possible length are tested so, first by letters, block by block; the rest is counted exactly.
    """
    if not left or not right:
        return
    words = min(64, max(2, -(-max(map(len, left)) // 16)))
    a, b = Packed(left, words), Packed(right, words)
    high, wide = 8, 8_192
    count = np.uint8 if len(a.letters) < 4 else np.uint16
    xor, bits, sums, near = (np.empty(high * wide, t) for t in (np.uint64, np.uint8, count, bool))
    for m in np.unique(a.lens):
        total = m + b.lens
        most = np.floor(total * (100 - percent) / 100 + 1e-9).astype(np.int64)
        most -= (most - total) & 1  # as even or odd as the lengths' sum
        ok = np.flatnonzero(np.abs(b.lens - m) <= most)
        if not len(ok):
            continue
        few = np.minimum(most, np.iinfo(count).max).astype(count)
        first, last = np.searchsorted(a.lens, [m, m + 1])
        met, waiting = [], 0
        for r in range(first, last, high):
            for c in range(ok[0], ok[-1] + 1, wide):
                shape = min(high, last - r), min(wide, ok[-1] + 1 - c)
                x, n, t, g = (v[:shape[0] * shape[1]].reshape(shape) for v in (xor, bits, sums, near))
                for w in range(len(a.letters)):
                    np.bitwise_xor(a.letters[w, r:r + shape[0], None], b.letters[w, None, c:c + shape[1]], out=x)
                    np.bitwise_count(x, out=n if w else t)
                    if w:
                        np.add(t, n, out=t)
                np.less_equal(t, few[None, c:c + shape[1]], out=g)
                at = np.flatnonzero(g)
                if len(at):
                    i, j = r + at // shape[1], c + at % shape[1]
                    good = np.bitwise_count(a.bigrams[:, i] ^ b.bigrams[:, j]).sum(0, dtype=np.int64) <= 3 * most[j]
                    met.append((i[good], j[good]))
                    waiting += len(met[-1][0])
            if waiting > 500_000 or met and r + high >= last:
                i, j = (np.concatenate(v) for v in zip(*met))
                met, waiting = [], 0
                score = 200.0 * _common(a, b, i, j) / (a.lens[i] + b.lens[j])
                good = score >= percent
                yield a.order[i[good]], b.order[j[good]], score[good]


def _sorted_tokens(t: str | None) -> str | None:
    return None if t is None else " ".join(sorted(t.split()))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _token_sort(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(_sorted_tokens(x), _sorted_tokens(y)) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_window(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float:
        return sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) / len(x) if x and y else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def ratio(a: Column, b: Column) -> Column:
    """Normalised Indel similarity, 0 to 100."""
    return _ratio(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """ratio() of the texts with their words sorted."""
    return _token_sort(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio() of the shorter text with a window of the longer."""
    return _partial(a, b)


def any_partial_ratio(x: Column, words: list[str], percent: int) -> Column:
    """True if one of the words has a partial_ratio() of at least `percent` with x; false for null."""
    @F.pandas_udf(T.BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t is not None and any(reaches(w, t, percent) for w in words) for t in texts], dtype=bool)

    return run(x)


def share_contained(a: Column, b: Column) -> Column:
    """How much of a lies in blocks that match b, 0 to 1 (not symmetric)."""
    return _blocks(a, b)


def may_reach(a: Column, b: Column, percent: int) -> Column:
    """True wherever ratio(a, b) may reach `percent`: no pair is lost.

    A ratio of t needs an Indel distance of at most (100 - t) (|a| + |b|) / 100, and Levenshtein's is never larger.
    """
    total = F.length(a) + F.length(b)
    most = F.floor(total * (100 - percent) / 100 + 1e-9).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)
