"""Centroid clustering over zone maps of a space-filling curve.

Vectors become integers, so that distances, sums and means are exact. They are
ordered along a Hilbert curve through their leading principal directions and
written as blocks with the least and greatest value of each component. In a
round, a block's box bounds the distance of its vectors to every centroid: a
centroid farther from the whole box than another one is at most can win no
vector. The remaining candidates are compared exactly; a block with one
candidate is added as a whole, by the sums it was written with.

Blocks are written once and read in every round. What moves between rounds are
sums by centroid and component, so a round shuffles a bounded number of rows
for each task, whatever the sizes of clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from crossfade.sources.staging import stage

#: Components beyond this are held at it; sums of squares stay below 2^63.
LARGEST = 1 << 27
#: Up to this, double precision adds up products without rounding.
_IN_DOUBLE = 1 << 22
#: Directions and bits of the curve.
AXES, BITS = 8, 8
_BLOCK = "ids array<bigint>, data binary, low binary, high binary, total binary"


def integers(vectors: DataFrame, components: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: the vectors with exactly ``components`` finite components, as ``floor(scale * component)``.

    Values are held within :data:`LARGEST`. Other vectors take no part.
    """
    found = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = found.filter(F.coalesce((F.size("v") == components) & finite, F.lit(False)))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    return kept.select("vec_id", F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def directions(rows: DataFrame, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(mean, axes, spread)``: the leading principal directions of the vectors, from sums of products.

    They only decide which vectors share a block, never a result.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components + 1))
        for batch in batches:
            x = np.concatenate([_matrix(batch.column(0), components).astype(np.float64), np.ones((batch.num_rows, 1))], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(components + 1)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    sums = rows.select("x").mapInArrow(products, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # (components + 1)^2 rows
    total = np.zeros((components + 1, components + 1))
    for cell in cells:
        total[cell["i"], cell["j"]] = cell["v"]
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    values, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    order = np.argsort(-values)[: min(AXES, components)]
    return mean, axes[:, order], np.sqrt(np.maximum(values[order], 1e-12))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``points``, cells of ``bits`` bits a side, as an unsigned number.

    Cells become transposed Gray codes by undoing the turns of every level from
    the coarsest on, whose bits are then taken level by level.
    """
    x = points.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q, p = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << one | (axis >> np.uint64(level)) & one
    return key


def blocks(rows: DataFrame, components: int, block_rows: int = 256) -> DataFrame:
    """The written blocks of :func:`integers` rows: ids, the matrix, its box and its sums.

    Equal vectors have one place on the curve, so the hash of the id deals them
    out; no range is held up by a vector that many rows hold.
    """
    mean, axes, spread = directions(rows, components)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), components)
            along = (x - mean) @ axes / spread
            cells = np.clip((along + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
            key = (hilbert(cells, BITS) ^ np.uint64(1 << 63)).view(np.int64)  # in the order of signed numbers
            data = [row.tobytes() for row in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), pa.array(data, pa.binary())], ["key", "vec_id", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            for vec_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(vec_id)
                held.append(data)
                if len(ids) == block_rows:
                    yield _block(ids, held, components)
                    ids, held = [], []
        if ids:
            yield _block(ids, held, components)

    keyed = rows.select("vec_id", "x").mapInArrow(placed, "key bigint, vec_id bigint, data binary").withColumn("salt", F.xxhash64("vec_id"))
    ordered = keyed.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").select("vec_id", "data")
    return stage(ordered.mapInArrow(packed, _BLOCK), "zone-blocks")


def _block(ids: list[int | None], held: list[bytes], components: int) -> pa.RecordBatch:
    x = np.frombuffer(b"".join(held), "<i4").reshape(-1, components).astype(np.int64)
    cells = [pa.array([ids], pa.list_(pa.int64()))]
    cells += [pa.array([b], pa.binary()) for b in (b"".join(held), x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), x.sum(axis=0).tobytes())]
    return pa.RecordBatch.from_arrays(cells, ["ids", "data", "low", "high", "total"])


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector of the box, or as near."""
    below, above = low - centroids, centroids - high
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(nearest <= farthest.min())


def compare(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(number, distance)`` of each vector's nearest centroid, the smaller number of equal ones; exact."""
    if max(np.abs(x).max(), np.abs(centroids).max()) <= _IN_DOUBLE:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        distance = ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    else:
        distance = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(x)), best]


def _opened(batch: pa.RecordBatch, components: int) -> Iterator[tuple]:
    """``(ids, low, high, total, data)`` of each block."""
    for ids, data, low, high, total in zip(*batch.columns):
        yield ids, *(np.frombuffer(v.as_py(), np.int64) for v in (low, high, total)), data


def _sums(blocked: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """By centroid, the sums of its vectors' components and, last, their number."""
    k, components = centroids.shape

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, components + 1), dtype=np.int64)
        for batch in batches:
            for ids, low, high, total, data in _opened(batch, components):
                near = candidates(low, high, centroids)
                if len(near) == 1:
                    sums[near[0]] += np.append(total, len(ids))
                    continue
                x = np.frombuffer(data.as_py(), "<i4").reshape(-1, components).astype(np.int64)
                best, _ = compare(x, centroids[near])
                order = np.argsort(best, kind="stable")
                numbers, starts = np.unique(best[order], return_index=True)
                x = np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1)
                sums[near[numbers]] += np.add.reduceat(x[order], starts, axis=0)
        won = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(won.astype(np.int32)), pa.array(list(sums[won]), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = blocked.mapInArrow(compute, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("i", "v"))
    cells = parts.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # k * (components + 1) rows
    found: dict[int, list[int]] = {}
    for cell in cells:
        found.setdefault(cell["cluster"], [0] * (components + 1))[cell["i"]] = int(cell["v"])
    return found


def _assigned(blocked: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""
    components = centroids.shape[1]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, low, high, _, data in _opened(batch, components):
                near = candidates(low, high, centroids)
                x = np.frombuffer(data.as_py(), "<i4").reshape(-1, components).astype(np.int64)
                best, distance = compare(x, centroids[near])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(near[best].astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return blocked.mapInArrow(compute, "vec_id bigint, cluster int, distance bigint")


def smallest(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``salt:vec_id``, in that order; all if there are fewer.

    Of rows with one id the smaller vector comes first; those without an id come last.
    """
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    found: list[Row] = rows.orderBy(mark.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in found], dtype=np.int64)


def clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", components: int = 64, scale: int = 256, block_rows: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of the vectors of :func:`integers`, and the centroids.

    Centroids start as those of :func:`smallest`. Each round assigns every vector
    to the nearest (squared Euclidean distance, ties to the smaller number) and
    replaces every centroid that has vectors by their mean, rounded down by
    component; then vectors are assigned once more. Rows without an id and
    repeated rows are vectors like any other. ``k`` centroids go to every task
    and as many sums of components to the driver. Without a usable vector there
    are no rows and no centroids. The rows are a stage table.
    """
    rows = integers(vectors, components, scale, id_col, vector_col)
    centroids = smallest(rows, k, salt)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).filter(F.lit(False)), np.zeros((0, components), np.int64)
    blocked = blocks(rows, components, block_rows)
    for _ in range(rounds):
        centroids = centroids.copy()
        for cluster, (*sums, n) in _sums(blocked, centroids).items():
            centroids[cluster] = [s // n for s in sums]
    return stage(_assigned(blocked, centroids), "zone-clusters"), centroids


def summarised(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with ``cluster_inertia`` and ``inertia`` (sums of distances, at most 2^63 - 1) and ``centroid_sha256``.

    The digest is of the centroid's components as decimal numbers with commas
    between. There is one summary row per centroid, a number the caller chose.
    """
    most = (1 << 63) - 1
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(sum(sums.values()), most)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, min(sums.get(c, 0), most), inertia, d) for c, d in enumerate(digests)]
    about = found.sparkSession.createDataFrame(rows, "of int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), F.col("cluster") == F.col("of")).drop("of")
