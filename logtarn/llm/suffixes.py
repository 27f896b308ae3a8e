"""Order of suffixes by a difference cover, to a depth.

The positions 1 and 2 mod 3 are sorted by their triples of letters and named; where names repeat,
the same is done with the string of names, in which a name stands for three letters, so each round
triples what is compared. From the ranks of these two thirds follow those of the rest, by a letter
and the rank behind it, and both parts are merged. Only ``depth`` letters matter here: names that
cover as many need no further round, and suffixes that agree so far are equal.
"""

import numpy as np


def ranks(letters: np.ndarray, depth: int) -> np.ndarray:
    """A rank for each suffix, in order; equal for suffixes that agree in ``depth`` letters.

    ``letters`` are above 0; behind the end lie letters 0. Ranks may tell suffixes apart that
    differ only behind ``depth`` letters.
    """
    n = len(letters)
    padded = np.zeros(n + 3, np.int64)
    padded[:n] = letters
    if n < 3 or depth <= 1:
        found = padded[:n] * (padded.max(initial=0) + 1) + padded[1 : n + 1] * (depth > 1)
        return np.unique(found, return_inverse=True)[1].astype(np.int64) + 1
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)  # with the empty suffix, if sampled
    sample = np.concatenate([one, two])
    names = _named(*(padded[sample + k] for k in range(3)))
    if names.max() < len(names) and depth > 3:
        # In the string of names, both residues one behind the other, a letter covers three. The
        # letter 0 between them keeps a suffix of the first from running into the second.
        joined = np.concatenate([names[: len(one)], [0], names[len(one) :]]) + 1
        found = ranks(joined, -(-depth // 3))
        names = np.concatenate([found[: len(one)], found[len(one) + 1 :]])
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    return _merged(padded, rank, n)


def _named(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dense ranks of triples, from 1."""
    span_b, span_c = int(b.max(initial=0)) + 1, int(c.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * span_b * span_c < 1 << 62:
        key = (a * span_b + b) * span_c + c
        return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    order = np.lexsort((c, b, a))
    new = np.ones(len(order), np.int64)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)
    found = np.empty(len(order), np.int64)
    found[order] = np.cumsum(new)
    return found


def _merged(letters: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Ranks of all suffixes from those of the sample; they keep equal what is equal."""
    base = int(rank.max()) + 1
    span = int(letters.max()) + 1
    zero, one, two = (np.arange(k, n, 3) for k in range(3))
    # A rest suffix compares with one of residue 1 by a letter and the ranks behind, with one of
    # residue 2 by two letters and the ranks behind them: those ranks are of sampled suffixes.
    near = lambda i: letters[i] * base + rank[i + 1]
    far_letters = lambda i: letters[i] * span + letters[i + 1]
    pairs, numbers = np.unique(np.concatenate([far_letters(zero), far_letters(two)]), return_inverse=True)
    far_zero = numbers[: len(zero)] * base + rank[zero + 2]
    far_two = numbers[len(zero) :] * base + rank[two + 2]
    order = np.argsort(near(zero), kind="stable")
    near_zero, far_zero = near(zero)[order], far_zero[order]
    near_one, far_two = np.sort(near(one)), np.sort(far_two)
    # Places count all suffixes before: equal ones get the same place.
    place = np.zeros(n, np.int64)
    place[zero[order]] = (
        np.searchsorted(near_zero, near_zero) + np.searchsorted(near_one, near_zero)
        + np.searchsorted(far_two, far_zero)
    )
    sampled = np.sort(rank[np.concatenate([one, two])])
    place[one] = np.searchsorted(sampled, rank[one]) + np.searchsorted(near_zero, near(one))
    far_of_two = numbers[len(zero) :] * base + rank[two + 2]
    place[two] = np.searchsorted(sampled, rank[two]) + np.searchsorted(np.sort(far_zero), far_of_two)
    return place + 1
