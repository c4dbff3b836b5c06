"""Join keys for the similarity joins: small per-string helpers that run in Arrow batches.

Nested higher-order functions built the same keys at tens of times the cost per string.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, floor

EPS = 1e-9
LONGEST = 2**31 - 1

#: Occurrences of a character in a string that are told apart when characters are counted; further ones come first.
COUNTED = 8
#: Keys that a string may have for each class and partner bucket before fewer characters are combined.
MOST_KEYS = 64


def edit_budget(longer: int, threshold: float) -> int:
    return floor(longer * (1 - threshold) + EPS)


@lru_cache(maxsize=None)
def segments(n: int, threshold: float) -> tuple[tuple[int, int], ...]:
    """(start, length) of the pieces a string of length n is cut into: one more than the edits
    allowed against its longest possible partner."""
    parts = edit_budget(floor(n / threshold + EPS), threshold) + 1
    size, rest = divmod(n, parts)
    cuts, at = [], 0
    for i in range(parts):
        length = size + (i >= parts - rest)
        cuts.append((at, length))
        at += length
    return tuple(cuts)


def index_keys(text: str, threshold: float) -> list[str]:
    n = len(text)
    return [f"{n}|{i}|{text[at:at + size]}" for i, (at, size) in enumerate(segments(n, threshold))]


def probe_keys(text: str, threshold: float) -> list[str]:
    """Pieces of this string that an indexed partner of any fitting length may contain unchanged.

    A piece can have moved by at most half the edit budget, give or take half the length
    difference, since edits on both sides of it add up.
    """
    m = len(text)
    keys = set()
    for n in range(max(ceil(m * threshold - EPS), 1), floor(m / threshold + EPS) + 1):
        budget, longer = edit_budget(max(m, n), threshold), m - n
        for i, (at, size) in enumerate(segments(n, threshold)):
            low = max(at - (budget - longer) // 2, 0)
            high = min(at + (budget + longer) // 2, m - size)
            keys.update(f"{n}|{i}|{text[p:p + size]}" for p in range(low, high + 1))
    return list(keys)


@lru_cache(maxsize=None)
def length_edges(ratio: float) -> tuple[int, ...]:
    """Lower edges of length buckets that grow by ``ratio`` up to the longest possible string."""
    edges = [1]
    while edges[-1] < LONGEST:
        edges.append(min(max(edges[-1] + 1, int(edges[-1] * ratio)), LONGEST))
    return tuple(edges)


def common_needed(n: int, m: int, jaro: float) -> int:
    """Characters that strings of lengths n and m must have in common to reach a Jaro level."""
    return ceil((3 * jaro - 1) * n * m / (n + m) - EPS)


def prefix_classes(threshold: float) -> list[tuple[int, float, float, int]]:
    """(shared first characters, Jaro level, bucket ratio, characters combined less than in the first class)."""
    without_bonus = lambda p: (threshold - 0.1 * p) / (1 - 0.1 * p)
    return [(0, without_bonus(0), 1.19, 0), (1, without_bonus(2), 1.19, 0), (3, without_bonus(4), 2.0, 1)]


def characters_combined(strings: int) -> int:
    """Characters of a key, so that the strings of a key stay few as the vocabulary grows."""
    return min(6, max(2, len(str(max(strings, 1))) - 1))


@lru_cache(maxsize=None)
def combined(shared: int, own: int, other: int, jaro: float, ratio: float, most: int) -> int:
    """Characters per key of two buckets: the same seen from either, no more than any of their pairs have in common, and
    no more than lets a string of either have ``MOST_KEYS`` keys, if two or more do."""
    edges = length_edges(ratio)
    sure = common_needed(edges[own], edges[other], jaro) - shared

    def keys(bucket: int, partner: int, size: int) -> int:
        longest = edges[bucket + 1] - 1 if bucket + 1 < len(edges) else LONGEST
        needed = max(common_needed(longest, edges[partner], jaro) - shared, 0)
        return comb(max(longest - shared - needed + size, 0), size)

    size = max(min(sure, most), 0)
    while size > 2 and max(keys(own, other, size), keys(other, own, size)) > MOST_KEYS:
        size -= 1
    return size


@lru_cache(maxsize=None)
def key_plan(n: int, threshold: float, is_left: bool, characters: int = 2) -> tuple[tuple[int, str, int, int], ...]:
    """(shared, key head, rarest characters to use, characters per key) per partner bucket."""
    plan = []
    for shared, jaro, ratio, less in prefix_classes(threshold):
        if n < max(shared, 1):
            continue
        edges = length_edges(ratio)
        own = bisect_right(edges, n) - 1
        for other, low in enumerate(edges):
            high = edges[other + 1] - 1 if other + 1 < len(edges) else LONGEST
            nearest = min(max(n, low), high)
            if common_needed(n, nearest, jaro) > min(n, nearest):
                continue
            needed = max(common_needed(n, low, jaro) - shared, 0)
            size = combined(shared, own, other, jaro, ratio, max(characters - less, 1))
            pair = (own, other) if is_left else (other, own)
            plan.append((shared, f"{shared}|{pair[0]}|{pair[1]}", n - shared - needed + size, size))
    return tuple(plan)


def numbered(text: str) -> list[tuple[str, int]]:
    """The characters with their occurrence number."""
    seen = Counter()
    tokens = []
    for c in text:
        seen[c] += 1
        tokens.append((c, seen[c]))
    return tokens


def rarest_first(text: str, counts: dict[tuple[str, int], int]) -> list[str]:
    """The characters with their occurrence number, those with the smallest counts first; any counts give the same pairs."""
    return [f"{c}{k}" for _, c, k in sorted((counts.get((c, k), -1), c, k) for c, k in numbered(text))]


def bag_bits(text: str) -> tuple[int, int]:
    """Two 64-bit masks of the characters with their occurrence number, hashed to 128 bits.

    Common bits plus the smaller count of characters without a bit of their own bound the number
    of common characters from above, whatever collides.
    """
    seen = Counter()
    bits = 0
    for c in text:
        seen[c] += 1
        bits |= 1 << ((ord(c) * 37 + seen[c] * 11) % 128)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(bits & (2**64 - 1)), signed(bits >> 64)


def name_keys(text: str, threshold: float, is_left: bool, counts: dict[tuple[str, int], int], characters: int = 2) -> list[str]:
    keys = set()
    tokens = {}
    for shared, head, take, size in key_plan(len(text), threshold, is_left, characters):
        if shared not in tokens:
            tokens[shared] = rarest_first(text[shared:], counts)
        start = f"{head}|{text[:shared]}|"
        keys.update(start + " ".join(c) for c in combinations(tokens[shared][:take], size))
    return list(keys)
