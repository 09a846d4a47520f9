"""Clustering around centroids by exponion search, in whole numbers.

Each vector keeps its centroid, an upper bound of the distance to it and a
lower bound of the distance to any other.  After the centroids have moved, the
bounds are widened by the ways they went; only where they meet the vector is
looked at again, and then only against centroids inside a ball around its
current one.  Lists of the distances between centroids, sorted, tell which
those are.  The radius is inclusive and rounded up, so equal distances stay in
the search and go to the smaller number.  Distances and sums are exact.

Vectors lie in blocks, in buckets by block; what a round writes is the bounds
of each block, which the next one joins, and sums of each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize, tidy

CENTROIDS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Vectors of a block, and blocks of a bucket.
BLOCK_ROWS, BUCKET_BLOCKS = 1024, 256
#: Components up to here keep squared distances of 64 (or fewer) of them in a long; larger ones are worked on as Python's integers.
NARROW = 1 << 27
#: Scaled components beyond count as non-finite.
LARGEST = 1e50
#: Sums go through decimals in two parts, base this.
PART = 10**28
LONG = (1 << 63) - 1
_ROUND = "block_id long, state binary, cluster int, place int, n long, high decimal(38,0), low decimal(38,0)"
_DECIMAL = pa.decimal128(38, 0)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """id, v: the vectors that are kept, each component times ``scale`` as a double."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == width) & ~F.exists("v", bad))


def whole(x: np.ndarray) -> np.ndarray:
    """The floor of each component: int64 where all are narrow, else Python's integers."""
    x = np.floor(x)
    if not x.size or np.abs(x).max() <= NARROW:
        return x.astype(np.int64)
    return np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape)


def _packed(x: np.ndarray) -> bytes:
    if x.dtype != object:
        return b"n" + x.astype("<i4").tobytes()
    return b"w" + ",".join(map(str, x.ravel().tolist())).encode()


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    if blob[:1] == b"n":
        return np.frombuffer(blob, "<i4", offset=1).astype(np.int64).reshape(-1, width)
    return np.array([int(y) for y in blob[1:].split(b",")], object).reshape(-1, width)


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, rows, held = [], [], 0

        def block():
            nonlocal number
            x = whole(np.concatenate(rows))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([_packed(x)], pa.binary())], ["block_id", "ids", "body"])

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                ids.append(part.column("id"))
                rows.append(np.asarray(part.column("v").flatten(), dtype=np.float64).reshape(-1, width))
                held += part.num_rows
                if held >= BLOCK_ROWS:
                    yield block()
                    ids, rows, held = [], [], 0
        if held:
            yield block()

    return run


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or to one each."""
    if x.dtype != object and c.dtype == object:
        x = x.astype(object)
    d = x - c
    return (d * d).sum(-1)


def root(d: np.ndarray) -> np.ndarray:
    """Square roots as doubles."""
    if d.dtype == object:
        d = np.array([float(min(y, 10**300)) for y in d.ravel()]).reshape(d.shape)
    return np.sqrt(d.astype(np.float64))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


class Centroids:
    """Centroids, the lists of their distances to each other, and how far each has come."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        narrow = all(abs(y) <= NARROW for row in rows for y in row)
        self.x = np.array(rows, np.int64 if narrow else object)
        k = len(rows)
        apart = np.stack([root(squared(self.x, c)) for c in self.x])
        # a centroid itself comes first, also before others of the same place
        apart[np.arange(k), np.arange(k)] = -1.0
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.nearest = self.apart[:, 1] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k)
        if before is not None:
            self.moved = root(np.array([sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(rows, before, strict=True)], object))
        top = np.sort(self.moved)[::-1]
        # the farthest way of the others
        self.others = np.where(self.moved == top[0], top[min(1, k - 1)] if (self.moved == top[0]).sum() == 1 else top[0], top[0])


def assign(x: np.ndarray, c: Centroids, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), an upper bound of the distance to it, a lower one of that to others, and how many distances were taken."""
    k, n = len(c.x), len(x)
    if state is None:
        at, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.full(n, -np.inf, np.float32)
        todo, radius = np.arange(n), np.full(n, np.inf)
        taken = 0
    else:
        at, upper, lower = state[0].copy(), up(state[1] + c.moved[state[0]]), down(state[2] - c.others[state[0]])
        # ties decide by number, so only a strictly smaller bound ends the search
        limit = np.maximum(lower, down(c.nearest / 2)[at])
        todo = np.flatnonzero(upper >= limit)
        upper[todo] = up(root(squared(x[todo], c.x[at[todo]])))
        taken = len(todo)
        todo = todo[upper[todo] >= limit[todo]]
        radius = (2.0 * upper[todo] + c.nearest[at[todo]]) * (1 + 1e-6) + 1e-6
    if not len(todo):
        return at, upper, lower, taken
    own = at[todo]
    y = x[todo]
    best, number = squared(y, c.x[own]), own.copy()
    second = np.full(len(todo), np.inf)
    for step in range(1, k):
        live = np.flatnonzero(c.apart[own, step] <= radius)
        if not len(live):
            break
        taken += len(live)
        j = c.order[own[live], step]
        d = squared(y[live], c.x[j])
        b, m = best[live], number[live]
        nearer = (d < b) | ((d == b) & (j < m))
        worse = np.where(nearer, b, d)
        second[live] = np.minimum(second[live], root(worse))
        best[live], number[live] = np.where(nearer, d, b), np.where(nearer, j, m)
    at[todo], upper[todo], lower[todo] = number, up(root(best)), down(second)
    return at, upper, lower, taken


def _state(at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> bytes:
    return at.astype("<i4").tobytes() + upper.astype("<f4").tobytes() + lower.astype("<f4").tobytes()


def _opened(blob: bytes | None):
    if blob is None:
        return None
    n = len(blob) // 12
    return np.frombuffer(blob, "<i4", n).astype(np.int64), np.frombuffer(blob, "<f4", n, 4 * n), np.frombuffer(blob, "<f4", n, 8 * n)


def _parts(value: int) -> tuple[Decimal, Decimal]:
    high, low = divmod(value, PART)
    return Decimal(high), Decimal(low)


def _round(centroids: Centroids, width: int):
    """The state of each block after this round, then sums of the task by cluster and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block_id", "state", "cluster", "place", "n", "high", "low"]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), _DECIMAL, _DECIMAL]
        k = len(centroids.x)
        sums, counts = np.zeros((k, width), object), np.zeros(k, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                x = _unpacked(batch.column("body")[row].as_py(), width)
                at, upper, lower, _ = assign(x, centroids, _opened(batch.column("state")[row].as_py()))
                for j in np.unique(at).tolist():
                    sums[j] += x[at == j].sum(0).astype(object)
                counts += np.bincount(at, minlength=k)
                cells = [batch.column("block_id")[row].as_py(), _state(at, upper, lower), None, None, None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, types, strict=True)], names)
        for j in np.flatnonzero(counts).tolist():
            parts = [_parts(int(s)) for s in sums[j]]
            columns = [[None] * width, [None] * width, [j] * width, list(range(width)), [int(counts[j])] * width, [p[0] for p in parts], [p[1] for p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names)

    return run


def _labels(centroids: Centroids, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = _unpacked(batch.column("body")[row].as_py(), width)
                at, _, _, _ = assign(x, centroids, _opened(batch.column("state")[row].as_py()))
                d = squared(x, centroids.x[at])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, pa.array(at.astype(np.int32)), pa.array([y if y <= LONG else None for y in d.tolist()], pa.int64())], ["id", "cluster", "distance"])

    return run


def seeds(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``salt:id``, in that order; equal hashes by their components."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = kept.withColumn("digest", digest).orderBy("digest", "v").select("v").limit(k).collect()
    return [whole(np.array([row.v])).tolist()[0] for row in found]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Clusters of the vectors with ``width`` components, none of them null or non-finite.

    Components are floor(scale * x).  The first centroids are the k vectors
    with the smallest sha256 of ``salt:id`` (a null id counts as empty text);
    with fewer vectors there are fewer.  Each round assigns every vector to
    the nearest centroid (ties: the smaller number) and moves centroids that
    have vectors to the floor of their mean.

    One row for each row kept, also of repeated or null ids: id, cluster,
    distance (squared), cluster_inertia, inertia, centroid_sha256.  Distances
    and inertias that no long holds are null.  Components beyond 1e50 after
    scaling count as non-finite.  Other columns aren't read; without a vector
    that is kept there is no row.
    """
    spark = vectors.sparkSession
    kept = scaled(vectors, id_col, vector_col, width, scale)
    kind = vectors.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = seeds(kept, k, salt)
    if not rows:
        return spark.createDataFrame([], out)
    n_blocks = kept.count() // BLOCK_ROWS
    blocks = bucketed(kept.mapInArrow(tidy(_blocks(width)), "block_id long, ids array<long>, body binary"), "cluster-blocks", "block_id", n_blocks // BUCKET_BLOCKS)
    centroids, state = Centroids(rows), None
    for _ in range(rounds):
        told = blocks.withColumn("state", F.lit(None).cast("binary")) if state is None else blocks.join(state.where("block_id is not null").select("block_id", "state").hint("merge"), "block_id")
        done = materialize(told.select("block_id", "body", "state").mapInArrow(tidy(_round(centroids, width)), _ROUND), "cluster-round")
        if state is not None:
            discard(state)
        state = done
        # at most a row for each cluster and component
        sums = state.where("cluster is not null").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
        before, rows = rows, [list(row) for row in rows]
        for s in sums:
            rows[s.cluster][s.place] = (int(s.high) * PART + int(s.low)) // s.n
        centroids = Centroids(rows, before)
    told = blocks.join(state.where("block_id is not null").select("block_id", "state").hint("merge"), "block_id") if rounds else blocks.withColumn("state", F.lit(None).cast("binary"))
    labels = materialize(told.select("ids", "body", "state").mapInArrow(tidy(_labels(centroids, width)), "id long, cluster int, distance long"), "cluster-labels")
    discard(blocks, *([state] if rounds else []))
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    each = labels.groupBy("cluster").agg(total.alias("whole"))
    of_all = each.agg(F.when(F.count("*") == F.count("whole"), F.sum("whole")).alias("all"))
    digests = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(rows)], "cluster int, centroid_sha256 string")
    # k rows
    known = F.broadcast(each.join(digests, "cluster").join(of_all))
    return labels.join(known, "cluster").select(F.col("id").cast(kind).alias(id_col), "cluster", "distance", F.col("whole").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), "centroid_sha256")
