"""String similarities as Arrow UDFs over pairs of columns.

The longest common subsequence is found bit-parallel (Hyyro 2004) on Python
integers; a batch scores each distinct pair of strings once.  Conventions for empty
strings: two empties have ratio 100, token-set scores with an empty side are 0.
Levenshtein distance and set overlap are built in and need no UDF.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _places(a: str) -> dict[str, int]:
    """For each letter, the set of its places as bits."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


def _lcs(at: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    row = full
    for ch in b:
        if ch in at:
            hit = row & at[ch]
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _lcs(_places(a), len(a), b) if a and b else 0


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _parts(a: str, b: str) -> tuple[str, str, str] | None:
    """Shared words, and those of one side only, each sorted and joined."""
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return None
    return " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))


def token_set_ratio(a: str, b: str) -> float:
    parts = _parts(a, b)
    if parts is None:
        return 0.0
    both, left, right = parts
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    one, two = len(both) + gap + len(left), len(both) + gap + len(right)
    apart = len(left) + len(right) - 2 * lcs(left, right)
    best = 100.0 - 100.0 * apart / (one + two)
    if both:
        for rest, whole in ((left, one), (right, two)):
            best = max(best, 100.0 - 100.0 * (gap + len(rest)) / (len(both) + whole))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with any stretch of the longer one, cut ends included.

    The letters that needle and stretch have in common, however ordered, are kept count of as the stretch
    moves on; they bound its ratio, and only a stretch that could be better than all before is compared.
    """
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n, best = len(a), 0.0
    for needle, hay in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        at, lacks, common = _places(needle), Counter(needle), 0
        for end in range(1, len(hay) + n):
            start = max(0, end - n)
            if end <= len(hay):  # one letter comes in
                ch = hay[end - 1]
                common += lacks[ch] > 0
                lacks[ch] -= 1
            if end > n:  # and one goes out
                ch = hay[start - 1]
                lacks[ch] += 1
                common -= lacks[ch] > 0
            size = min(end, len(hay)) - start
            # a stretch that ends in a letter the needle lacks is no better than its neighbour
            if (end <= len(hay) and hay[end - 1] not in at) or (end > len(hay) and hay[start] not in at):
                continue
            if 200.0 * common / (n + size) > best:
                best = max(best, 200.0 * _lcs(at, n, hay[start : start + size]) / (n + size))
            if best == 100.0:
                return best
    return best


def partial_token_set_ratio(a: str, b: str) -> float:
    parts = _parts(a, b)
    if parts is None:
        return 0.0
    return 100.0 if parts[0] else partial_ratio(parts[1], parts[2])


def jaro_winkler(a: str, b: str) -> float:
    """Winkler 1990: Jaro similarity, raised by up to four shared first letters where it is over 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    reach = max(reach, 0)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    other = [ch for ch, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(mine, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def _udf(score: Callable[[str, str], float]):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


ratio_col, token_sort_col, token_set_col = _udf(ratio), _udf(token_sort_ratio), _udf(token_set_ratio)
partial_col, partial_token_set_col, jaro_winkler_col = _udf(partial_ratio), _udf(partial_token_set_ratio), _udf(jaro_winkler)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
