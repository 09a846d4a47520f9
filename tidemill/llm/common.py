"""What the operators share: intermediate tables, Arrow slices and words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task works on at once.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch; with it a batch of long texts stays small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (master
    local) a temporary folder is taken and set; elsewhere that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemill-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: With it Spark deletes the shuffle files of a query when the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    It cuts the lineage: a lost executor costs no more than the tasks that
    read these files.  The shuffle files behind them are deleted once they are
    written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def bucketed(df: DataFrame, tag: str, key: str, n: int = 0) -> DataFrame:
    """Like ``materialize``, in ``n`` buckets by ``key``: joins by it shuffle the other side only.

    There are at least as many buckets as shuffle partitions.  The files are
    in the shared folder; the session's catalog names them only while they
    are written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = min(100_000, max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.table(name)
    out.schema  # noqa: B018  the plan holds the files and buckets from here on
    spark.sql(f"DROP TABLE `{name}`")
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(conf).delete(path, True)


def trim() -> None:
    """Give the system back what this process has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(free := ctypes.CDLL(None), "malloc_trim"):
        free.malloc_trim(0)


def shipped(spark: SparkSession, value) -> Broadcast:
    """A broadcast of bytes that hold ``value`` with its classes: executors need no copy of this package.

    A task opens it by ``opened``; nothing stays in the worker afterwards but
    the compressed bytes.
    """
    raw = cloudpickle.dumps(value)
    body = b"%d:" % len(raw) + pa.compress(raw, codec="zstd", asbytes=True)
    del raw, value
    trim()
    return spark.sparkContext.broadcast(body)


def opened(shared: Broadcast):
    size, _, body = shared.value.partition(b":")
    return cloudpickle.loads(pa.decompress(body, int(size), codec="zstd"))


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` of a task, before and after which the worker gives memory back.

    Python workers serve one task after the other; what a task leaves in
    cycles and in the allocators would add up to what the next one needs.
    """

    def run(batches: Iterator) -> Iterator:
        trim()
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def at_least(rows: DataFrame, count: str, most: int) -> int:
    """The least number n so that at most ``most`` rows have a ``count`` of n or more.

    What is gathered is a histogram of some thousand bins; above 1,024 a bin
    is a 64th of a doubling wide.
    """
    n = F.col(count)
    fine = F.lit(1024)
    bin_of = F.when(n < fine, n).otherwise(fine + F.floor(64 * F.log2(n / 1024)))
    bins = rows.groupBy(bin_of.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("low"), F.max(n).alias("high")).collect()
    cut, held = None, 0
    for b in sorted(bins, key=lambda b: -b.bin):
        held += b.rows
        if held > most:
            return int(b.high) + 1 if cut is None else cut
        cut = int(b.low)
    return 0


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of the Arrow batches that Python workers get.

    The setting is one of the session and stays: the queries returned are run
    later.  A smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Join and cut the batches of a task into record batches of about ``limit`` text bytes."""
    held, size = [], 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            start = stop
            if size >= limit or start < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    r"""Words ``[^\x20\x09-\x0D]+`` of all texts, end to end, and where each text's words start."""
    raw, at = utf8_buffer(texts)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    inner = at[1:-1][at[1:-1] < len(raw)]
    first[inner] = ~space[inner]
    last = ~space
    last[:-1] &= space[1:]
    last[inner - 1] = ~space[inner - 1]
    starts = np.flatnonzero(first)
    offsets = starts_of(np.flatnonzero(last) + 1 - starts)
    return binary_array(raw[~space], offsets), np.searchsorted(starts, at)


def coded(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """A code for each word and the distinct words by code."""
    found = words.dictionary_encode()
    return np.asarray(found.indices, dtype=np.int64), found.dictionary.to_pylist()


#: Text bytes of a slice, the unit that slice tables hold.
TABLE_SLICE_BYTES = 8 << 20
SLICES = "slice_id long, doc_ids array<long>, n_words array<int>, codes binary, words binary"


def packed(codes: np.ndarray) -> bytes:
    """uint32 codes, byte planes apart, compressed."""
    return b"%d:" % len(codes) + pa.Codec("zstd", compression_level=5).compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    head, _, body = blob.partition(b":")
    n = int(head)
    planes = np.frombuffer(pa.decompress(body, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed_words(words: pa.Array) -> bytes:
    """The lengths of words, then their bytes, both compressed."""
    raw, at = utf8_buffer(words)
    lengths = packed(np.diff(at))
    return b"%d:%d:" % (len(lengths), len(raw)) + lengths + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpacked_words(blob: bytes) -> pa.Array:
    n, size, rest = blob.split(b":", 2)
    at = np.concatenate(([0], np.cumsum(unpacked(rest[: int(n)])))).astype(np.int64)
    raw = pa.decompress(rest[int(n) :], int(size), codec="zstd")
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), raw])


def word_slices(docs: DataFrame, id_col: str, text_col: str, lower: bool, limit: int = TABLE_SLICE_BYTES) -> DataFrame:
    r"""Slices of documents with their words as codes: columns SLICES.

    Words are ``[^\x20\x09-\x0D]+``, with A-Z lower-cased if asked; a null
    text has none.  ``codes`` index ``words``, the slice's distinct words, the
    most frequent first; both are packed.
    """
    small_batches(docs.sparkSession)

    def code(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", limit)):
            words, at = words_of(batch.column("text"), lower)
            found = words.dictionary_encode()
            codes = np.asarray(found.indices)
            order = np.argsort(-np.bincount(codes, minlength=len(found.dictionary)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array([base + k], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(at)], pa.list_(pa.int32())),
                pa.array([packed(rank[codes])], pa.binary()), pa.array([packed_words(found.dictionary.take(pa.array(order)))], pa.binary()),
            ], ["slice_id", "doc_ids", "n_words", "codes", "words"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(code, SLICES)


_PLACES = 64
_TABLE: list[np.ndarray] = []


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit tabulation hash of each word: the sum of a random number for each place and byte."""
    if not _TABLE:
        _TABLE.append(np.random.default_rng(20240229).integers(0, 1 << 64, (_PLACES, 256), dtype=np.uint64).ravel())
    raw, at = utf8_buffer(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    with np.errstate(over="ignore"):
        each = _TABLE[0][(place % _PLACES << 8) | raw]
        if len(place) and place.max() >= _PLACES:
            each *= (2 * (place // _PLACES) + 1).astype(np.uint64)
        ends = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
        out = ends[at[1:]] - ends[at[:-1]]
        out ^= out >> np.uint64(31)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on; the last n - 1 places are left out."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


def starts_of(n_words: np.ndarray) -> np.ndarray:
    """Where the words of each document start, and the end."""
    return np.concatenate(([0], np.cumsum(n_words))).astype(np.int64)
