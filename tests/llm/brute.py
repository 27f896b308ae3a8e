"""What the operators must give, the long way round."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def repeated(words, n):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + n))
    return inside


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    again = [x for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i]]
    n_repeat = len(repeated(words, 3))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(again),
        "n_repeat_words": n_repeat,
        "base_failed": len(words) < 50 or 100 * n_repeat > 50 * len(words),
        "dup_line_chars": sum(len(w) for x in again for w in WORD.findall(x)),
        "dup_ngram_chars": [sum(len(words[i]) for i in repeated(words, n)) for n in (5, 8, 10)],
    }


def simhash(text, n=3):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows, bits=2):
    """Component of each (id, fingerprint) by all pairs."""
    least = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a, (_, f) in enumerate(rows):
            for b, (_, g) in enumerate(rows):
                if (f ^ g).bit_count() <= bits and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def cut_repeats(rows, size=50):
    first = {}
    for i, t in rows:
        for p in range(len(t) - size + 1):
            w = t[p : p + size]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(kept)))
    return sorted(out)


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def private_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PRIVATE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


SECRET = [
    (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def secret_spans(text):
    return sorted(
        (m.start(), k, m.end())
        for k, (pattern, good) in enumerate(SECRET)
        for m in pattern.finditer(text or "")
        if good(m)
    )


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return BENCH_WORD.findall(ascii_lower(text or ""))


def overlaps(text, items):
    """(words, hit words, items) against {item id: text}."""
    words, hit, found = bench_words(text), set(), set()
    for item, other in items.items():
        theirs = bench_words(other)
        n = min(10, len(theirs))
        windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def edits(a, b):
    """Letters put in, left out or changed, and neighbours swapped, to get from one word to the other."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]
