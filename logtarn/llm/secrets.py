"""Secret scans: keyword prefilter, anchored patterns only at hits, embedded checksums.

One Aho-Corasick pass finds all keywords; a pattern is tried only where one of its keywords is.
Long hex strings have no keyword and are found as runs of marked bytes. Tokens that carry a
checksum or a decodable structure count beyond the base kinds only if it holds.

Texts are scanned as bytes, a megabyte at a time; positions are code points, the end exclusive.
Texts of any length are read in linear time.
Null or empty text has no secrets. Rows are judged alone, so repeats and null ids need no care.
"""

import base64
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm.registry import registered, table
from logtarn.llm.textbytes import ASCII_LOWER, byte_set, owner, pieces, runs, total, utf8

HEX = byte_set(b"0123456789abcdef")
HEX_LENGTH = 32

#: All kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]

#: Keyword, in lower case, and the kind whose pattern is tried there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "api_key": "assign", "apikey": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}

PATTERNS = {
    "assign": re.compile(
        r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++"),
    "pem": re.compile(
        r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----\s([A-Za-z0-9+/=\s]+)-----END \1-----"
    ),
}
#: What a token's first part runs through. Where the token fails, so it does from any keyword
#: further on in the same run, which are not tried again: a run of keywords is read once.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]++")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(number: int) -> str:
    digits = ""
    while number:
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0")


def _decoded(segment: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(segment + "=" * (-len(segment) % 4)))
    except ValueError:
        return None


def _der_length_fits(body: str) -> bool:
    """Whether the outer sequence of an encoded key is as long as it says."""
    try:
        data = base64.b64decode(re.sub(r"\s", "", body), validate=True)
    except ValueError:
        return False
    if len(data) < 2 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return len(data) == 2 + data[1]
    size = data[1] & 0x7F
    return len(data) == 2 + size + int.from_bytes(data[2 : 2 + size], "big")


VALID = {
    "assign": lambda m: len(m[1]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "github": lambda m: _base62(zlib.crc32(m[1].encode())) == m[2],
    "npm": lambda m: _base62(zlib.crc32(m[1].encode())) == m[2],
    "jwt": lambda m: isinstance(head := _decoded(m[1]), dict) and "alg" in head
    and isinstance(_decoded(m[2]), dict),
    "pem": lambda m: _der_length_fits(m[2]),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find(column: pa.Array, words: ahocorasick.Automaton) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind, end), sorted; positions in code points."""
    data, ends = utf8(column)
    # One character per byte, so positions are those of the bytes and case keeps the length.
    text = data.tobytes().decode("latin-1")
    hits = [
        (end + 1 - size, kind)
        for end, (size, kind) in words.iter(ASCII_LOWER[data].tobytes().decode("latin-1"))
    ]
    hits.sort()
    begin = np.array([h[0] for h in hits], np.int64)
    doc = owner(begin, ends) if hits else begin
    spans: list[tuple[int, int, int, int]] = []
    free = dict.fromkeys(PATTERNS, 0)  # where the next match of a kind may begin
    for (start, kind), at in zip(hits, doc.tolist(), strict=True):
        if start < free[kind]:
            continue
        match = PATTERNS[kind].match(text, start, int(ends[at + 1]))
        if match:
            free[kind] = match.end()
            if VALID[kind](match):
                spans.append((at, start, KINDS.index(kind), match.end()))
        elif kind in RUNS:
            free[kind] = RUNS[kind].match(text, start, int(ends[at + 1])).end()
    begin, end = runs(HEX[data], ends)
    long = end - begin >= HEX_LENGTH
    begin, end = begin[long], end[long]
    hexes = zip(owner(begin, ends).tolist(), begin.tolist(), end.tolist(), strict=True)
    spans += [(at, a, KINDS.index("hex"), b) for at, a, b in hexes]
    spans.sort()
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(ends) - 1)]
    if spans:
        chars = total((data & 0xC0) != 0x80)
        for at, a, kind, b in spans:
            zero = chars[ends[at]]
            found[at].append((int(chars[a] - zero), kind, int(chars[b] - zero)))
    return found


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (start, kind, end) in order; kinds by ``KINDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in pieces(batches, 1):
            found = [
                [{"start": a, "kind": k, "end": b} for a, k, b in spans]
                for spans in find(batch.column(1), words)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"]
            )

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {ids}, spans array<struct<start:long,kind:int,end:long>>"
    )


@registered()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document."""
    found = secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE_KINDS)],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
