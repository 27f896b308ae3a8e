"""Removal of long substrings that an earlier document has, by ordered suffixes.

Sorting every suffix of a corpus would shuffle many times the corpus. So suffixes are first divided
by what they begin with, and only those that can have an equal are sorted:

1. Strings of ``length`` bytes are divided by their anchors (see ``anchors``), which equal strings
   share. Strings of one text with one anchor form a segment. Segments go by the hash of their
   anchor to tasks that name equal ones: all but those of the smallest id are removed.
2. Where an anchor has different segments, they may still share strings near their ends. Those
   segments are cut out of the texts, divided further by a longer piece around the anchor, and
   their suffixes sorted by a difference cover (see ``suffixes``). Neighbours in this order that
   agree in ``length`` bytes are equal strings; all but those of the smallest id are removed.
3. What is removed of each document is put together and its text cut.

Before a shuffle, a batch of documents keeps of equal segments only those of its smallest id and
settles the rest itself, so a passage that a third of all documents have is sent once per batch.
Anchors with many different contexts are found in a sample and spread by their content; pieces
with more than ``MEMBERS`` members have their strings grouped by Spark instead, with partial minima.

Strings are judged on the input. Null counts as empty; texts below ``length`` keep everything. A
null ``doc_id`` comes after all others. Rows of one ``doc_id`` are one document as to what is
earlier, but each is cut by itself. Content is compared by a 64-bit hash of the anchor and another
of the whole segment in step 1, byte by byte in step 2.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm.anchors import KGRAM, Segments, segments
from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored
from logtarn.llm.suffixes import ranks
from logtarn.llm.textbytes import mixed, owner, pieces, utf8

LENGTH = 50
#: Text per group of documents or segments, and bytes to be sorted per task, about.
GROUP_BYTES = 8 << 20
SORT_BYTES = 1 << 20
LEAST_GROUPS = 64
#: Bytes beside the anchor that divide its segments further.
ASIDE = 16
#: Largest set of segments that are sorted together for one piece of text.
MEMBERS = 20_000
#: Anchors that so many documents of a sample of so many have are spread by content.
SAMPLE_DOCUMENTS, COMMON = 4000, 12

_LAST_ID = (1 << 63) - 1


def _identified(docs: DataFrame, groups: int) -> DataFrame:
    """``doc_id``, ``text``, ``id`` without null, and the group ``part`` of the document."""
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    return docs.select(
        "doc_id", "text", identity.alias("id"), F.pmod(F.xxhash64(identity), F.lit(groups)).cast("int").alias("part")
    )


def _part_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The same group as Spark's xxhash64 gives (XXH64 of 8 bytes, seed 42)."""
    p1, p2, p3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    p4, p5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)
    left = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    x = left(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
    x = left((p5 + np.uint64(50)) ^ x, 27) * p1 + p4
    x = (x ^ (x >> np.uint64(33))) * p2
    x = (x ^ (x >> np.uint64(29))) * p3
    return ((x ^ (x >> np.uint64(32))).view(np.int64) % groups).astype(np.int64)


# Arrays travel end to end in one binary value: their length, then each column.


def _packed(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpacked(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for column, kind in zip(found, kinds, strict=True):
            column.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in found]


_ASKED = ("u8", "u8", "i8", "u4")  # anchor, content, change of the id, address
_TOLD = ("i8", "u4", "u1")  # id, address, whether it is to be cut out


def _located(batch: pa.RecordBatch | pa.Table, text: int) -> tuple[np.ndarray, np.ndarray, Segments, np.ndarray, np.ndarray]:
    """Bytes and ends of texts, their segments, and an address for each segment and text.

    An address is the number of the segment, counted from a hash of the text, so it tells apart
    rows that share an id.
    """
    column = batch.column(text)
    data, ends = utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    found = segments(data, ends, LENGTH)
    raw = data.tobytes()
    tags = np.array(
        [xxhash.xxh32_intdigest(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
        np.uint32,
    )
    number = np.arange(len(found.text)) - np.searchsorted(found.text, found.text, "left")
    return data, ends, found, tags[found.text] + number.astype(np.uint32), tags


def _first(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Marks, in order, where a value differs from the one before."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for column in columns:
            new[1:] |= column[order[1:]] != column[order[:-1]]
    return new


def _later(order: np.ndarray, new: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Marks members of a group that are not of its smallest id. Groups follow in ``order``."""
    later = np.zeros(len(order), bool)
    if len(order):
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[order], at)
        later[order] = ids[order] > np.repeat(least, np.diff(np.append(at, len(order))))
    return later


def _asking(groups: int, common: np.ndarray):
    """Of each batch the segments to be compared with those of others, by the task that does it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, contents, ids, addresses = [], [], [], []
            for piece in pieces(iter([batch]), 1):
                _, _, found, address, _ = _located(piece, 1)
                anchors.append(found.anchor)
                contents.append(found.content)
                ids.append(piece.column(0).to_numpy()[found.text])
                addresses.append(address)
            if not anchors:
                continue
            anchor, content, of, address = map(np.concatenate, (anchors, contents, ids, addresses))
            order = np.lexsort((content, anchor))
            later = _later(order, _first(order, anchor, content), of)
            spread = np.where(np.isin(anchor, common), mixed(anchor ^ content), anchor)
            target = np.where(later, -1 - _part_of(of, groups), (spread % np.uint64(groups)).astype(np.int64))
            order = np.argsort(target, kind="stable")
            cuts = np.append(np.flatnonzero(_first(order, target)), len(order))
            targets, blobs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some = order[a:b]
                targets.append(int(target[some[0]]))
                if targets[-1] < 0:
                    blobs.append(_packed(of[some], address[some], np.zeros(b - a, np.uint8)))
                else:
                    change = np.diff(of[some], prepend=np.int64(0))
                    blobs.append(_packed(anchor[some], content[some], change, address[some]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(targets, pa.int64()), pa.array(blobs, pa.binary())], ["target", "blob"]
            )

    return run


def _telling(groups: int, common: np.ndarray):
    """Which segments an earlier document has, and which are to be cut out for a closer look."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        target = key[0].as_py()
        blobs = asked["blob"].to_pylist()
        if target < 0:  # settled already
            return pa.table({"part": pa.array([-1 - target] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})
        columns = [_unpacked([b], _ASKED) for b in blobs]
        anchor, content, address = (np.concatenate([c[k] for c in columns]) for k in (0, 1, 3))
        ids = np.concatenate([np.cumsum(c[2]) for c in columns])
        order = np.lexsort((content, anchor))
        new = _first(order, anchor, content)
        later = _later(order, new, ids)
        new_anchor = _first(order, anchor)
        of_anchor = np.cumsum(new_anchor) - 1
        several = np.zeros(len(order), bool)
        several[order] = (np.bincount(of_anchor, new) > 1)[of_anchor] if len(order) else False
        several |= np.isin(anchor, common)
        told = np.flatnonzero(later | several)
        part = _part_of(ids[told], groups)
        told, part = told[np.argsort(part, kind="stable")], np.sort(part, kind="stable")
        cuts = np.append(np.flatnonzero(_first(np.arange(len(part)), part)), len(part))
        parts, answers = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = told[a:b]
            parts.append(int(part[a]))
            answers.append(_packed(ids[some], address[some], (~later[some]).astype(np.uint8)))
        return pa.table({"part": pa.array(parts, pa.int32()), "blob": pa.array(answers, pa.binary())})

    return run


_CUT = "part int, id long, tag long, start int, stop int, piece long, bytes binary"


def _rows(part: int, ids, tags, starts, stops, pieces_=None, content=None) -> pa.Table:
    n = len(ids)
    return pa.table({
        "part": pa.array(np.full(n, part), pa.int32()),
        "id": pa.array(ids, pa.int64()),
        "tag": pa.array(tags, pa.int64()),
        "start": pa.array(starts, pa.int32()),
        "stop": pa.array(stops, pa.int32()),
        "piece": pa.nulls(n, pa.int64()) if pieces_ is None else pa.array(pieces_, pa.int64()),
        "bytes": pa.nulls(n, pa.binary()) if content is None else pa.array(content, pa.binary()),
    })


def _united(owners: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each owner, those that touch or overlap made one."""
    if not len(owners):
        return owners, start, stop
    order = np.lexsort((start, owners))
    owners, start, stop = owners[order], start[order], stop[order]
    # A running maximum within each owner: owners are set far apart first.
    gap = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + owners * gap) - owners * gap
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return owners[at], start[at], reach[np.append(at[1:], len(owners)) - 1]


def _cutting(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Of a group of documents: the ranges to be removed so far, and the segments to be sorted."""
    ids, address, cut = _unpacked(told["blob"].to_pylist(), _TOLD)
    if not len(ids) or not docs.num_rows:
        return _rows(0, [], [], [], [])
    part = docs["part"][0].as_py()
    known = np.unique(ids)
    key = np.searchsorted(known, ids).astype(np.int64) << 32 | address
    order = np.argsort(key)
    key, cut = key[order], cut[order]
    out = []
    for piece in pieces(iter(docs.select(["id", "text"]).combine_chunks().to_batches()), 1):
        data, ends, found, here, tags = _located(piece, 1)
        if not len(found.text):
            continue
        of = piece.column(0).to_numpy()
        at = np.minimum(np.searchsorted(known, of), len(known) - 1)
        mine = np.where(known[at] == of, at, -1)[found.text]
        wanted = mine << 32 | here
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        hit = (mine >= 0) & (key[place] == wanted)
        gone = np.flatnonzero(hit & (cut[place] == 0))
        text, start, stop = _united(found.text[gone], found.begin[gone], found.begin[gone] + found.strings[gone] + LENGTH - 1)
        out.append(_rows(part, of[text], tags[text], start, stop))
        some = np.flatnonzero(hit & (cut[place] == 1))
        out.append(_divided(part, data, ends, found, some, of, tags))
    return pa.concat_tables(out) if out else _rows(part, [], [], [], [])


def _divided(part: int, data: np.ndarray, ends: np.ndarray, found: Segments, some: np.ndarray, of: np.ndarray, tags: np.ndarray) -> pa.Table:
    """Segments in two, by whether a string has ASIDE bytes before the anchor; each half is named
    by a longer piece of text that all its strings have."""
    begin, strings, offset, text = (x[some] for x in (found.begin, found.strings, found.offset, found.text))
    anchor = begin + offset
    left = np.clip(offset - ASIDE + 1, 0, strings)  # strings that begin ASIDE or more before it
    halves = []
    for first, count, name_from, name_size in (
        (begin, left, anchor - ASIDE, ASIDE + KGRAM),
        (begin + left, strings - left, anchor, LENGTH - ASIDE + 1),
    ):
        has = np.flatnonzero(count > 0)
        name = np.zeros(len(has), np.uint64)
        for k in range(name_size):
            name = mixed(name + data[(ends[text] + name_from)[has] + k])
        halves.append((has, first[has], count[has], name))
    which, first, count, name = (np.concatenate([h[k] for h in halves]) for k in range(4))
    raw, at = data.tobytes(), ends[text[which]] + first
    content = [raw[a : a + n + LENGTH - 1] for a, n in zip(at.tolist(), count.tolist(), strict=True)]
    return _rows(part, of[text[which]], tags[text[which]], first, first + count, name.view(np.int64), content)


def _sorted(cut: pa.Table) -> pa.Table:
    """Of segments with the same pieces: the ranges whose strings an earlier document has."""
    piece, ids = cut["piece"].to_numpy(), cut["id"].to_numpy()
    # A piece that one document has is of no interest.
    order = np.lexsort((ids, piece))
    of_piece = np.cumsum(_first(order, piece)) - 1
    several = np.zeros(len(order), bool)
    if len(order):
        several[order] = (np.bincount(of_piece, _first(order, piece, ids)) > 1)[of_piece]
    cut, ids = cut.filter(pa.array(several)), ids[several]
    if not len(ids):
        return _rows(0, [], [], [], [])
    column = cut["bytes"].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    data, ends = _binary(column)
    # Segments end to end, with a smaller letter behind each.
    size = np.diff(ends)
    letters = np.ones(len(data) + len(size), np.int64)
    home = np.arange(len(data)) + np.repeat(np.arange(len(size)), size)
    letters[home] = data.astype(np.int64) + 2
    rank = ranks(letters, LENGTH)
    count = size - LENGTH + 1
    of = np.repeat(np.arange(len(size)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    position = (ends[:-1] + np.arange(len(size)))[of] + inside
    order = np.argsort(rank[position], kind="stable")
    # Neighbours that agree in LENGTH bytes are equal.
    packed = letters.astype(np.uint64)
    for width in (1, 2):
        packed = packed[: len(packed) - width] << np.uint64(16 * width) | packed[width:]
    a, b = position[order[:-1]], position[order[1:]]
    new = np.ones(len(order), bool)
    different = np.zeros(len(a), bool)
    for k in [*range(0, LENGTH - 4, 4), LENGTH - 4]:
        different |= packed[a + k] != packed[b + k]
    new[1:] = different
    gone = np.flatnonzero(_later(order, new, ids[of]))
    segment, start, stop = _united(of[gone], inside[gone], inside[gone] + LENGTH)
    begin = cut["start"].to_numpy()[segment]
    tags, parts = cut["tag"].to_numpy()[segment], cut["part"].to_numpy()[segment]
    found = _rows(0, ids[segment], tags, begin + start, begin + stop)
    return found.set_column(0, "part", pa.array(parts, pa.int32()))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _grouped(cut: DataFrame) -> DataFrame:
    """The same by Spark alone, string by string: for pieces with very many members."""
    string = F.expr(f"transform(sequence(0, length(bytes) - {LENGTH}), k -> struct(k, substring(bytes, k + 1, {LENGTH}) AS s))")
    strings = cut.select("part", "id", "tag", "start", F.explode(string).alias("at"))
    least = strings.groupBy("at.s").agg(F.min("id").alias("least"))
    begin = F.col("start") + F.col("at.k")
    return strings.join(least, F.col("at.s") == least["s"]).where("id > least").select(
        "part", "id", "tag", begin.alias("start"), (begin + LENGTH).alias("stop")
    )


_KEPT = "spans array<struct<start:int,stop:int>>, kept binary"


def _finishing(id_type: pa.DataType):
    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        ids, tags = ranges["id"].to_numpy(), ranges["tag"].to_numpy()
        start, stop = ranges["start"].to_numpy(), ranges["stop"].to_numpy()
        order = np.lexsort((start, tags, ids))
        ids, tags, start, stop = (x[order].tolist() for x in (ids, tags, start, stop))
        of: dict[tuple[int, int], list[int]] = {}
        for k, owner_ in enumerate(zip(ids, tags, strict=True)):
            of.setdefault(owner_, []).append(k)
        spans, kept = [], []
        for identity, text in zip(docs["id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            raw = (text or "").encode()
            mine: list[dict[str, int]] = []
            for k in of.get((identity, xxhash.xxh32_intdigest(raw)), ()):
                if mine and start[k] <= mine[-1]["stop"]:
                    mine[-1]["stop"] = max(mine[-1]["stop"], stop[k])
                else:
                    mine.append({"start": start[k], "stop": stop[k]})
            edges = [0, *(e for s in mine for e in (s["start"], s["stop"])), len(raw)]
            spans.append(mine)
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table({
            "doc_id": docs["doc_id"].cast(id_type), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())
        })

    return run


def _common_anchors(docs: DataFrame, documents: int) -> np.ndarray:
    """Anchors that a good part of the documents have, from a sample; their number is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1):
            _, _, found, _, _ = _located(piece, 1)
            pair = np.unique(np.stack([found.text.view(np.uint64), found.anchor], 1), axis=0)
            anchor, count = np.unique(pair[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(count)], ["anchor", "documents"]
            )

    sample = docs.sample(min(1.0, SAMPLE_DOCUMENTS / max(documents, 1)), seed=1)
    counted = sample.select("id", "text").mapInArrow(run, "anchor long, documents long")
    common = counted.groupBy("anchor").agg(F.sum("documents").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r.anchor for r in common.select("anchor").collect()], np.int64).view(np.uint64))


def without_repeated_strings(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``spans`` (byte ranges removed, apart from each other) and ``kept`` (the bytes left)."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(LEAST_GROUPS, -(-(size.bytes or 0) // GROUP_BYTES))
    work = _identified(docs, groups)
    common = _common_anchors(work, size.n)
    asked = work.select("id", "text").mapInArrow(_asking(groups, common), "target long, blob binary")
    told = stored(asked.groupBy("target").applyInArrow(_telling(groups, common), "part int, blob binary"), "told")
    cut = stored(
        work.select("id", "text", "part").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_cutting, _CUT), "cut"
    )
    pieces_ = cut.where("piece IS NOT NULL")
    amount = pieces_.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = max(LEAST_GROUPS, -(-amount // SORT_BYTES))
    many = stored(pieces_.groupBy("piece").count().where(F.col("count") > MEMBERS).select("piece"), "many")
    ranges = cut.where("piece IS NULL").select("part", "id", "tag", "start", "stop")
    few = pieces_
    if not many.isEmpty():
        few = pieces_.join(many, "piece", "left_anti")
        ranges = ranges.union(_grouped(pieces_.join(many, "piece", "left_semi")))
    columns = ["part", "id", "tag", "start", "piece", "bytes"]
    ordered = (
        few.select(*columns, F.pmod("piece", F.lit(tasks)).alias("task")).groupBy("task").applyInArrow(_sorted, _CUT)
    )
    ranges = stored(ranges.union(ordered.select("part", "id", "tag", "start", "stop")), "ranges")
    kind = docs.schema["doc_id"].dataType
    finish = _finishing(pa.int64())
    return (
        work.withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("part").cogroup(ranges.groupBy("part"))
        .applyInArrow(finish, f"doc_id long, {_KEPT}").withColumn("doc_id", F.col("doc_id").cast(kind))
    )


@registered()
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings that an earlier one has."""
    found = without_repeated_strings(table(spark, sf_dir, "documents"))
    removed: Column = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]).cast("long")
    )
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
