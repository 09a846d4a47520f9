"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  Each pivot has an
inverted file, in which the vectors are posted that have it among their very
nearest; a query asks the files of the pivots nearest to itself.  In a file
the vectors are ranked by Spearman's footrule between their orders and the
query's, and the best of them are reranked by exact distance.  Equal vectors
are indexed once, with the smallest of their ids, which is all that a ranking
by id can ask of them.

How many files a query asks, and what share of a file is reranked, is measured
on the table itself: a bounded sample of queries is compared with all vectors,
and both are chosen so that nearly all true neighbours of the sample are met.
Tables with structure need few files; tables without need many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window as W

from .common import discard, materialize, opened, shipped, tidy

#: Vectors for each pivot, and the least and most pivots; distinct vectors with the smallest hashes serve.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 200, 16, 4096
#: Nearest pivots that represent a vector, and files that it is posted in.
NEAREST, POSTED = 64, 2
#: Queries that the search is fitted on, and the share of their true neighbours that must be met by each of its two cuts.
FITTED_ON, TARGET = 128, 0.99
#: Rows of a file, and queries that ask it, in one task.
FILE_ROWS, QUERY_ROWS = 20_000, 5_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: vectors that aren't null, zero or with null or non-finite components."""
    kind = vectors.schema[vector_col].dataType
    kept = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kept).alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)


def permutations(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first."""
    d = (pivots**2).sum(1)[None] - 2 * (x @ pivots.T)
    if nearest < len(pivots):
        part = np.argpartition(d, nearest - 1, axis=1)[:, :nearest]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(d, axis=1, kind="stable")


class Query:
    """A query's view of the pivots."""

    def __init__(self, order: np.ndarray, pivots: int, nearest: int, posted: int):
        self.posted = posted
        #: place of each pivot among all, nearest first
        self.rank = np.empty(pivots, np.int32)
        self.rank[order] = np.arange(pivots)
        # pivots that one of two orders lacks count as at place ``nearest``, so shared ones decide
        place = np.minimum(self.rank, nearest)
        self.table = (nearest - np.maximum(place[:, None], np.arange(nearest)[None])).ravel()

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """For orders of vectors, a number that falls as the footrule to the query's order rises."""
        nearest = order.shape[1]
        return self.table[order * nearest + np.arange(nearest)].sum(1)

    def file(self, order: np.ndarray) -> np.ndarray:
        """Of the files that vectors are posted in, the place of the one that the query asks first."""
        return self.rank[order[:, : self.posted]].min(1)


def views(q: np.ndarray, pivots: np.ndarray, nearest: int, posted: int) -> Iterator[Query]:
    for low in range(0, len(q), 256):
        for order in permutations(q[low : low + 256], pivots, len(pivots)):
            yield Query(order, len(pivots), nearest, posted)


def search(ids: np.ndarray, at: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, distance: of each query the ``k`` nearest rows; vector n has ids[at[n] : at[n + 1]].

    ``chosen`` gives for the number of a query the vectors to compare it with.
    """
    rows = np.diff(at)
    vector = np.repeat(np.arange(len(x)), rows)
    out_q, out_id, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for n in range(len(q)):
        # rows of each vector but the query's own
        others = rows - np.bincount(vector[ids == query_ids[n]], minlength=len(x))
        met = chosen(n, others > 0)
        d = np.sqrt(((x[met] - q[n]) ** 2).sum(1))
        if k < len(met):
            near = d <= np.partition(d, k - 1)[k - 1]
            met, d = met[near], d[near]
        found = np.concatenate([np.zeros(0, np.int64), *(ids[at[m] : at[m + 1]] for m in met)])
        d = np.repeat(d, rows[met])
        other = found != query_ids[n]
        found, d = found[other], d[other]
        best = np.lexsort((found, d))[:k]
        out_q.append(np.full(len(best), query_ids[n]))
        out_id.append(found[best])
        out_d.append(d[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_d)


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: each vector once, with its k + 1 smallest ids, each as often as it has rows (up to ``k``)."""
    counted = rows.groupBy("v", "id").agg(F.count(F.lit(1)).alias("n"))
    few = counted.withColumn("place", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.flatten(F.collect_list(F.array_repeat("id", F.least("n", F.lit(k)).cast("int")))).alias("ids"))


def sampled(rows: DataFrame, column: str, total: int, most: int) -> list:
    """``most`` rows with the smallest hashes of ``column``; about four times as many are gathered."""
    hashed = rows.withColumn("h", F.xxhash64(column)).withColumn("few", F.pmod(F.col("h"), F.lit(1 << 30)))
    found = hashed.where(F.col("few") < max(1, min(1 << 30, (1 << 30) * 4 * most // max(1, total)))).collect()
    return sorted(found, key=lambda r: (r.few, r.h, r[column]))[:most]


def fitted(vectors: DataFrame, sample: np.ndarray, pivots: np.ndarray, k: int, nearest: int, posted: int) -> tuple[int, float]:
    """How many files to ask and what share of a file to rerank, so that TARGET of the sample's true neighbours are met by each."""
    spark = vectors.sparkSession
    width = pivots.shape[1]
    shared = shipped(spark, sample)

    def exact(batches):
        q = opened(shared)
        held: list[list] = [[] for _ in q]
        for batch in batches:
            x = matrix(batch.column("v"), width)
            for s, row in enumerate(q):
                d = ((x - row) ** 2).sum(1)
                d[d == 0] = np.inf
                best = np.argpartition(d, k - 1)[:k] if k < len(d) else np.arange(len(d))
                held[s] = sorted([*held[s], *((d[b], x[b].tolist()) for b in best.tolist() if np.isfinite(d[b]))])[:k]
        for s, found in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(found), pa.int32()), pa.array([d for d, _ in found], pa.float64()), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["s", "d", "v"])

    near = vectors.select("v").mapInArrow(tidy(exact), "s int, d double, v array<double>")
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("s").orderBy("d", "v"))).where(F.col("rank") <= k).select("s", "v").collect()  # k for each of the sample
    if not near:
        return 1, 1.0
    asks = list(views(sample, pivots, nearest, posted))
    order = permutations(np.array([r.v for r in near]), pivots, nearest)
    needs = [(r.s, int(asks[r.s].file(o[None])[0]), int(asks[r.s].agreement(o[None])[0])) for r, o in zip(near, order, strict=True)]
    files = int(np.quantile([f for _, f, _ in needs], TARGET, method="higher")) + 1
    told = shipped(spark, (asks, needs, pivots))

    def places(batches):
        asks, needs, pivots = opened(told)
        before, of = np.zeros(len(needs), np.int64), np.zeros(len(needs), np.int64)
        by_query: dict[int, list[int]] = {}
        for n, (s, _, _) in enumerate(needs):
            by_query.setdefault(s, []).append(n)
        for batch in batches:
            order = permutations(matrix(batch.column("v"), width), pivots, nearest)
            for s, own in by_query.items():
                file, agree = asks[s].file(order), asks[s].agreement(order)
                for n in own:
                    inside = agree[file == needs[n][1]]
                    of[n] += len(inside)
                    before[n] += (inside > needs[n][2]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(needs))), pa.array(before), pa.array(of)], ["n", "before", "of"])

    counts = vectors.select("v").mapInArrow(tidy(places), "n long, before long, of long").groupBy("n").agg(F.sum("before").alias("before"), F.sum("of").alias("of")).collect()
    share = float(np.quantile([(r.before + 1) / max(1, r.of) for r in counts if needs[r.n][1] < files], TARGET, method="higher"))
    return files, min(1.0, share)


EMPTY = "query_id long, rank int, vec_id long, score double"
FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query=None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, per_vector: int = NEAREST, files: int | None = None, rerank: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each query its ``k`` nearest rows found (all others, if fewer).

    By default rows whose id is divisible by 100 are queries.  All rows but
    the query's own are candidates.  The score is the Euclidean distance in
    double precision; ties go to the smaller id.  Null, zero and non-finite
    vectors and rows without an id take no part, and vectors meet vectors of
    their own length only: each length is searched by itself, so there should
    be few.  An empty table gives no rows.  Rows repeated under one id all
    count as candidates of other queries; a query that is repeated is asked
    once, with the least of its vectors.  Extra columns aren't read.

    The pivots are a bounded sample of the distinct vectors; every distinct
    vector is indexed, with as many of its smallest ids as a query can get.
    ``files`` and ``rerank`` are fitted (`fitted`) unless given.  Files with
    many rows or many queries are dealt to several tasks.  Queries that meet
    fewer than ``k`` rows are compared with all.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    widths = [r[0] for r in rows.groupBy(F.size("v")).count().collect()]
    out = spark.createDataFrame([], EMPTY)
    for width in sorted(widths):
        own = rows.where(F.size("v") == width)
        asks = own.where(is_query if is_query is not None else F.col("id") % 100 == 0).groupBy("id").agg(F.min("v").alias("v"))
        out = out.unionByName(_nearest(own, asks, width, k, pivots, per_vector, files, rerank))
    return out


def _nearest(rows: DataFrame, asks: DataFrame, width: int, k: int, n_pivots: int | None, per_vector: int, files: int | None, rerank: float | None) -> DataFrame:
    spark = rows.sparkSession
    vectors, asks = materialize(distinct(rows, k), "vectors-distinct"), materialize(asks, "vectors-queries")
    total, n_asks = vectors.count(), asks.count()
    n_pivots = n_pivots or int(np.clip(2 ** np.round(np.log2(max(1, total) / PER_PIVOT)), LEAST_PIVOTS, MOST_PIVOTS))
    pivots = np.array([r.v for r in sampled(vectors, "v", total, n_pivots)], np.float64).reshape(-1, width)
    per_vector = min(per_vector, len(pivots))
    posted = min(POSTED, per_vector)
    if files is None or rerank is None:
        sample = np.array([r.v for r in sampled(asks, "id", n_asks, FITTED_ON)], np.float64).reshape(-1, width)
        fit = fitted(vectors, sample, pivots, k, per_vector, posted) if len(sample) else (1, 1.0)
        files, rerank = files or fit[0], rerank or fit[1]
    files = min(files, len(pivots))
    shared = shipped(spark, pivots)

    def spread(names: list[str], each: int):
        """Rows of a vector, one for each of its ``each`` nearest pivots."""

        def run(batches):
            pivots = opened(shared)
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    order = permutations(matrix(part.column("v"), width), pivots, each)
                    again = part.take(pa.array(np.repeat(np.arange(part.num_rows), order.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), *[again.column(c) for c in names]], ["file", *names])

        return tidy(run)

    kind = vectors.schema["v"].dataType.simpleString()
    posts = vectors.select("ids", "v").mapInArrow(spread(["ids", "v"], posted), f"file int, ids array<long>, v {kind}")
    wants = asks.select("id", "v").mapInArrow(spread(["id", "v"], files), f"file int, id long, v {kind}")
    # how many tasks share the rows of a file, and how many its queries: one row for each pivot
    size = lambda df, per, name: df.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    plan = materialize(size(posts, FILE_ROWS, "parts").join(size(wants, QUERY_ROWS, "blocks"), "file"), "vectors-files")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = posts.join(F.broadcast(plan), "file").withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts"))).withColumn("block", each("blocks"))
    queries = wants.join(F.broadcast(plan), "file").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", each("parts"))

    def from_file(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _told(*[np.zeros(0)] * 3)
        pivots = opened(shared)
        ids, at, x = _indexed(left, width)
        order = permutations(x, pivots, per_vector)
        query_ids, q = np.asarray(right["id"]), matrix(right["v"], width)
        seen = views(q, pivots, per_vector, posted)

        def chosen(n: int, ok: np.ndarray) -> np.ndarray:
            query = next(seen)
            met = np.flatnonzero(ok & (query.file(order) == query.rank[key[0].as_py()]))  # others are met in another file
            most = max(2 * k, int(np.ceil(rerank * len(met))))
            if most < len(met):
                agree = query.agreement(order[met])
                met = met[agree >= -np.partition(-agree, most - 1)[most - 1]]  # with all that tie at the cut
            return met

        return _told(*search(ids, at, x, query_ids, q, k, chosen))

    index = index.select("file", "part", "block", "ids", "v").withColumn("part", F.col("part").cast("int"))
    found = index.groupBy("file", "part", "block").cogroup(queries.select("file", "part", "block", "id", "v").groupBy("file", "part", "block")).applyInArrow(from_file, FOUND)
    found = materialize(_ranked(found, k), "vectors-found")

    # queries that met fewer than k rows, if there are more
    lacking = asks.join(found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id")), "id", "left_anti")
    lacking = materialize(lacking, "vectors-lacking")
    n_lacking = lacking.count()
    if n_lacking:
        n_index, n_query = -(-total // FILE_ROWS), -(-n_lacking // QUERY_ROWS)

        def from_all(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _told(*[np.zeros(0)] * 3)
            return _told(*search(*_indexed(left, width), np.asarray(right["id"]), matrix(right["v"], width), k, lambda _, ok: np.flatnonzero(ok)))

        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        index = vectors.withColumn("ib", dealt("v", n_index)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
        queries = lacking.withColumn("qb", dealt("id", n_query)).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))))
        rest = index.groupBy("ib", "qb").cogroup(queries.groupBy("ib", "qb")).applyInArrow(from_all, FOUND)
        found = found.join(lacking.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_ranked(rest, k))
    else:
        discard(lacking)
    return found.select("query_id", "rank", "vec_id", "score")


def _indexed(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = table["ids"].combine_chunks()
    return np.asarray(ids.flatten()), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(ids), np.int64)))), matrix(table["v"], width)


def _told(q: np.ndarray, i: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(i.astype(np.int64)), "score": pa.array(d, pa.float64())})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
