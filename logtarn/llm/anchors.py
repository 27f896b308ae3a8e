"""Content-defined anchors: of all strings of a length, those that begin at one anchor.

Each string of ``length`` bytes has an anchor, its k-gram of the smallest hash (the leftmost of
several). Equal strings have their anchors at equal distances, wherever they stand. Strings of one
text that share an anchor begin side by side; what they cover together is a segment.
"""

from dataclasses import dataclass

import numpy as np

from logtarn.llm.textbytes import mixed

KGRAM = 18
_POSITION_BITS = 28
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


@dataclass(frozen=True)
class Segments:
    """Arrays with an entry per segment, in the order of the texts."""

    text: np.ndarray  # index of the text
    begin: np.ndarray  # of the first string, from the beginning of its text
    strings: np.ndarray  # how many strings, that is bytes beyond ``length`` - 1
    offset: np.ndarray  # of the anchor from ``begin``
    anchor: np.ndarray  # hash of the anchor
    content: np.ndarray  # hash of all bytes of the segment


def _rolled(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, built up by doubling."""
    out, size, multiplier = None, 0, _ODD
    power, span = values, 1
    while k:
        if k & 1:
            if out is None:
                out, size = power, span
            else:
                n = len(power) - size if len(power) > size else 0
                out = out[:n] * multiplier + power[size : size + n]
                size += span
        k >>= 1
        if k:
            n = max(len(power) - span, 0)
            multiplier = mixed(np.array([span], np.uint64))[0] | np.uint64(1)
            power = power[:n] * multiplier + power[span : span + n]
            span *= 2
    return out


def _smallest(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest value of each window."""
    span = 1
    while span * 2 <= window:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = window - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> Segments:
    """All segments of texts that lie end to end in ``data``."""
    starts = len(data) - length + 1
    none = np.empty(0, np.int64)
    if starts <= 0:
        return Segments(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    grams = mixed(_rolled(_BYTES[data], KGRAM))
    position = np.arange(len(grams), dtype=np.uint64)
    ranked = (grams >> np.uint64(_POSITION_BITS)) << np.uint64(_POSITION_BITS) | position
    anchor = _smallest(ranked, length - KGRAM + 1) & np.uint64((1 << _POSITION_BITS) - 1)
    # Strings that lie within one text.
    whole = np.ones(starts + 1, bool)
    late = ends[1:-1, None] - np.arange(1, length)
    late = late[(late >= 0) & (late < starts)]
    whole[late] = False
    whole[starts] = False
    first = whole[:-1].copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-2]
    same_text = np.zeros(starts, bool)
    same_text[ends[:-1][ends[:-1] < starts]] = True
    first |= same_text & whole[:-1]
    begin = np.flatnonzero(first)
    stop = np.append(begin[1:], starts)
    # A run ends before the next one or before strings that cross into the next text.
    counts = np.concatenate([[0], np.cumsum(whole[:-1])])
    strings = counts[stop] - counts[begin]
    text = np.searchsorted(ends, begin, "right") - 1
    powers = np.full(len(data) + 1, _ODD)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[:-1], out=prefix[1:])
    inverse = np.full(int(begin[-1]) + 1 if len(begin) else 1, _INVERSE)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    content = (prefix[begin + strings + length - 1] - prefix[begin]) * inverse[begin]
    at = anchor[begin].astype(np.int64)
    return Segments(
        text, begin - ends[text], strings, at - begin, grams[at],
        mixed(content + strings.astype(np.uint64)),
    )
