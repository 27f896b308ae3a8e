"""Centroid clustering over a vector-approximation file.

Each dimension is cut into sixteen cells at its quantiles, so that a vector's approximation is four
bits a dimension. The file holds approximation and full vector of a row side by side. For a set of
centroids two lookup tables, indexed by the cells of two dimensions at a time, give the least and
the greatest squared distance a cell allows; their sums are an interval for each centroid. A vector
whose intervals leave one nearest centroid is decided by its approximation alone; its full vector
is taken out of the file only where intervals overlap, where it changes its cluster (the sums of
both clusters follow), and for the distances of the result. Intervals are bounds, not estimates, so
results are exact whatever the cells.

A round is one pass over the file without a shuffle of vectors: a task sends a row for each
centroid, sums and counts of what moved. Centroids, tables and sums are as large as the number of
centroids and dimensions, whatever the rows; they alone meet on the driver. A lost task repeats its
part of a pass.

Vectors that are null, of another length, or with a null or non-finite component are left out. A
vector without ``vec_id`` is assigned like any other and never starts a centroid. Rows may repeat;
each counts, and rows that share an id start centroids in the order of their components. With fewer
vectors than centroids there are as many centroids as vectors; with none that has an id the result
is empty.
Scaled components beyond 2**27 in size count as that bound, inertias beyond a long as the greatest
long. Other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.llm.registry import registered, table
from logtarn.llm.stored import stored

CELLS = 16
MOST = 1 << 27
#: Vectors at a time, so that their sums of intervals stay in a core's cache.
ROWS = 8192


@dataclass(frozen=True)
class Setting:
    """``centroids`` of ``dimensions`` whole components (``scale`` times a component, rounded
    down), moved ``rounds`` times."""

    dimensions: int = 64
    centroids: int = 16
    rounds: int = 3
    scale: int = 64
    seed: int = 1


def whole(vectors: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``vec_id`` and whole ``components`` of the vectors that count."""

    def odd(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def component(x):
        scaled = F.floor(F.lit(float(setting.scale)) * x.cast("double"))
        return F.greatest(F.least(scaled, F.lit(MOST)), F.lit(-MOST)).cast("int")

    right = (F.size("embedding") == setting.dimensions) & ~F.exists("embedding", odd)
    return vectors.select("vec_id", "embedding").where(right).select(
        "vec_id", F.transform("embedding", component).alias("components")
    )


def cell_bounds(kept: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The least and the greatest component of each cell of each dimension, over all vectors.

    None if there are no vectors. Quantiles are approximate, least and greatest values are not.
    """
    shares = [k / CELLS for k in range(1, CELLS)]
    at = [F.get("components", F.lit(d)) for d in range(dimensions)]
    row = kept.agg(
        F.count(F.lit(1)),
        *[F.percentile_approx(x, shares, 1000) for x in at],
        *[f(x) for f in (F.min, F.max) for x in at],
    ).first()
    if not row[0]:
        return None
    cuts = np.sort(np.array(row[1 : 1 + dimensions], np.int64), axis=1)
    least, most = np.array(row[1 + dimensions :], np.int64).reshape(2, dimensions, 1)
    # Cell k holds what lies from cut k - 1 up to, but not at, cut k; it may be empty.
    return np.concatenate([least, cuts], 1), np.concatenate([cuts - 1, most], 1)


def approximated(
    kept: DataFrame, bounds: tuple[np.ndarray, np.ndarray]
) -> DataFrame:
    """The file: ``vec_id``, ``cells`` of four bits, and the full vector as ``full``."""
    cuts = bounds[0][:, 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            cells = np.stack(
                [np.searchsorted(cuts[d], full[:, d], "right") for d in range(len(cuts))], 1
            ).astype(np.uint8)
            if cells.shape[1] % 2:
                cells = np.concatenate([cells, np.zeros((len(cells), 1), np.uint8)], 1)
            packed = cells[:, ::2] | (cells[:, 1::2] << 4)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "cells": _binary(packed), "full": _binary(full.astype("<i4")),
            })

    ids = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {ids}, cells binary, full binary")


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    data = np.ascontiguousarray(rows)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def _rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Fixed-width binary values as a matrix; nothing is copied."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    size = width * np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[first : first + size * len(column)].view(kind).reshape(-1, width)


@dataclass(frozen=True)
class Assigned:
    """The nearest centroid of each vector, and how many centroids its cells left."""

    cluster: np.ndarray
    left: np.ndarray


class Lookup:
    """Distance intervals by cell for one set of centroids."""

    def __init__(self, centroids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]):
        self.centroids = centroids
        least, most = (b[None, :, :] for b in bounds)
        at = centroids[:, :, None]
        near = np.maximum(np.maximum(least - at, at - most), 0) ** 2
        far = np.maximum(np.abs(least - at), np.abs(most - at)) ** 2
        both = np.concatenate([near, far]).transpose(1, 2, 0)  # dimension, cell, bound
        if len(both) % 2:
            both = np.concatenate([both, np.zeros((1, *both.shape[1:]), both.dtype)])
        # The first dimension of a pair is the lower half of the byte.
        pairs = both[::2][:, None, :, :] + both[1::2][:, :, None, :]
        self.pairs = pairs.reshape(len(pairs), CELLS * CELLS, -1)
        if self.pairs.max(1).sum(0).max() < 1 << 31:
            self.pairs = self.pairs.astype(np.int32)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest, by the cells alone."""
        sums = self.pairs[0][cells[:, 0]]
        for pair in range(1, len(self.pairs)):
            sums += self.pairs[pair][cells[:, pair]]
        k = len(self.centroids)
        return sums[:, :k] <= sums[:, k:].min(1)[:, None]

    def assign(self, cells: np.ndarray, full: np.ndarray) -> Assigned:
        """The nearest centroid, the first of several; ``full`` is taken where cells leave several."""
        possible = self.candidates(cells)
        left = possible.sum(1)
        cluster = possible.argmax(1)
        open_ = np.flatnonzero(left > 1)
        if len(open_):
            vectors = full[open_].astype(np.int64)
            distance = np.full((len(open_), len(self.centroids)), np.iinfo(np.int64).max)
            for c, centroid in enumerate(self.centroids):
                of = np.flatnonzero(possible[open_, c])
                distance[of, c] = ((vectors[of] - centroid) ** 2).sum(1)
            cluster[open_] = distance.argmin(1)
        return Assigned(cluster, left)


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        yield (
            part,
            _rows(part.column(1), "u1", -(-width // 2)),
            _rows(part.column(2), "<i4", width),
        )


def moved(
    file: DataFrame, before: np.ndarray | None, now: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]
) -> list:
    """What the step from one set of centroids to the next changes: sums and count of each cluster,
    a row each. Without a set before, all vectors come."""
    k, width = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = Lookup(now, bounds)
        old = Lookup(before, bounds) if before is not None else None
        sums, counts, seen = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for _, cells, full in _parts(batch, width):
                to = new.assign(cells, full).cluster
                was = old.assign(cells, full).cluster if old else np.full(len(to), -1)
                changed = np.flatnonzero(to != was)
                seen += len(to)
                vectors = full[changed].astype(np.int64)
                for c in range(k):
                    into, out = to[changed] == c, was[changed] == c
                    sums[c] += vectors[into].sum(0) - vectors[out].sum(0)
                    counts[c] += np.count_nonzero(into) - np.count_nonzero(out)
        if seen:
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(np.arange(k, dtype=np.int32)),
                "n": pa.array(counts), "sums": pa.array(list(sums), pa.list_(pa.int64())),
            })

    found = file.mapInArrow(run, "cluster int, n long, sums array<long>")
    return found.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d))).alias(f"d{d}") for d in range(width)]
    ).collect()


def seeds(kept: DataFrame, setting: Setting = Setting()) -> np.ndarray:
    """The vectors that the centroids start as: those with the least hash of their id."""
    named = F.sha2(F.concat(F.lit(f"{setting.seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(named.alias("named"), "components").where("named IS NOT NULL")
    rows = first.orderBy("named", "components").limit(setting.centroids).collect()
    return np.array([row.components for row in rows], np.int64).reshape(len(rows), setting.dimensions)


def nearest(file: DataFrame, centroids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``vec_id``, ``cluster``, its squared ``distance`` and how many centroids the cells left."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(centroids, bounds)
        for batch in batches:
            for part, cells, full in _parts(batch, width):
                found = lookup.assign(cells, full)
                distance = ((full - centroids[found.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0),
                    "cluster": pa.array(found.cluster.astype(np.int32)),
                    "distance": pa.array(distance),
                    "n_overlapping": pa.array(found.left.astype(np.int32)),
                })

    ids = file.schema["vec_id"].dataType.simpleString()
    return file.mapInArrow(run, f"vec_id {ids}, cluster int, distance long, n_overlapping int")


def clustered(vectors: DataFrame, setting: Setting = Setting()) -> tuple[DataFrame, np.ndarray]:
    """:func:`nearest` for the final centroids, and these."""
    kept = stored(whole(vectors, setting), "vectors")
    bounds = cell_bounds(kept, setting.dimensions)
    centroids = seeds(kept, setting)
    if bounds is None or not len(centroids):
        ids = kept.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {ids}, cluster int, distance long, n_overlapping int"
        return kept.sparkSession.createDataFrame([], schema), centroids
    file = stored(approximated(kept, bounds), "approximations")
    sums = [[0] * setting.dimensions for _ in centroids]
    counts = [0] * len(centroids)
    before = None
    for _ in range(setting.rounds):
        for row in moved(file, before, centroids, bounds):
            counts[row.cluster] += row.n
            sums[row.cluster] = [a + b for a, b in zip(sums[row.cluster], row[2:], strict=True)]
        before = centroids
        centroids = np.array([
            [total // n for total in of] if n else list(old)
            for of, n, old in zip(sums, counts, before, strict=True)
        ], np.int64)
    return nearest(file, centroids, bounds), centroids


def _sql(setting: Setting = Setting()) -> str:
    """Brute force: every vector against every centroid in each round."""
    text = f"""
WITH kept AS (
    SELECT row_number() OVER () AS row, vec_id,
        list_transform(embedding, lambda x: floor({setting.scale} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {setting.dimensions}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {setting.dimensions}
),
c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('{setting.seed}:' || vec_id), v) - 1 AS cluster, v AS c
    FROM kept WHERE vec_id IS NOT NULL
    QUALIFY cluster < {setting.centroids}
)"""
    for r in range(setting.rounds + 1):
        text += f""",
a{r} AS (
    SELECT row, vec_id, v, cluster, distance FROM (
        SELECT row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c),
            lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
        FROM kept, c{r})
    QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1
)"""
        if r < setting.rounds:
            text += f""",
s{r} AS (
    SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n
    FROM (SELECT cluster, unnest(v) AS x, unnest(range({setting.dimensions})) AS d FROM a{r})
    GROUP BY cluster, d
),
m{r} AS (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS c FROM s{r} GROUP BY cluster
),
c{r + 1} AS (
    SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster)
)"""
    last = setting.rounds
    return text + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance,
    sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (cluster)
"""


@registered(_sql())
def op12_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector and the inertias after three rounds."""
    assigned, centroids = clustered(table(spark, sf_dir, "embeddings"))
    assigned = stored(assigned, "clusters")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia"))
    of = {row.cluster: int(row.inertia) for row in sums.collect()}
    greatest = (1 << 63) - 1
    rows = [
        (c, min(of.get(c, 0), greatest), min(sum(of.values()), greatest),
         sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for c, centroid in enumerate(centroids.tolist())
    ]
    named = spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
