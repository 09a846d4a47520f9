"""Spelling variants: words one edit apart, by two-dimensional range reporting.

A word is a point: its place among all words in order, and its place among all
words read from the end.  Words that share what stands before an edit are an
interval of the one order, words that share what stands after it an interval
of the other; a wavelet tree over the points reports those that lie in both.
So each place of a word where a letter may be replaced or inserted is one
rectangle, and the words in it are the near ones, no others.

Words are dealt to shards by what near ones share: an edit lies in the first
or in the second half of a word, so the other half stays, with the length a
key that both words have.  A key that too many words have is split: half of
the places that are left for the edit stay free, and the rest joins the key.
At the end one place is free, and few words can share a key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .fm import WaveletMatrix

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One run in so many, by crc32 of ``<doc_id>:<run>``, loses a letter.
ONE_IN = 31
#: Words of a key from which it is split, and of a shard.
KEY_WORDS, SHARD_WORDS = 20_000, 60_000
#: Rectangles that are asked at once.
QUERIES = 1 << 19
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int, least_count: int, one_in: int) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, one in ``one_in`` less a letter."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _UPPER.lower())).otherwise(F.col("run")))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % one_in == 0, less).otherwise(F.col("run")) if one_in else F.col("run")
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _key(word: Column, size: Column, first: Column, stop: Column) -> Column:
    """A hash of what words share whose edit lies at the places from ``first`` on and below ``stop`` of ``size`` + 1."""
    rest = F.greatest(F.lit(0), size - stop)
    return F.xxhash64(size, first, stop, F.substring(word, F.lit(1), first), F.substring(word, F.length(word) - rest + 1, rest))


def keyed(words: DataFrame, least: int) -> DataFrame:
    """key, word, n, size, first, stop: each word as one of its own length and as one that is a letter longer, with both halves of the places."""
    sizes = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda x: x >= least)
    rows = words.withColumn("size", F.explode(sizes))
    middle = F.floor((F.col("size") + 1) / 2).cast("int")
    rows = rows.withColumn("part", F.explode(F.array(F.struct(F.lit(0).alias("first"), middle.alias("stop")), F.struct(middle.alias("first"), (F.col("size") + 1).alias("stop")))))
    return rows.select("word", "n", "size", "part.first", "part.stop").withColumn("key", _key(F.col("word"), F.col("size"), F.col("first"), F.col("stop")))


def split_hot(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows with the keys split that more than ``most`` words have, and the number of rows."""
    while True:
        rows = materialize(rows, "spelling-keys")
        sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("stop") - F.col("first")).alias("places")), "spelling-sizes")
        hot = sizes.where((F.col("rows") > most) & (F.col("places") > 1)).select(F.col("key").alias("hot"))
        if hot.isEmpty():
            total = int(sizes.agg(F.sum("rows")).first()[0] or 0)
            discard(sizes)
            return rows, total
        marked = rows.join(hot, rows["key"] == hot["hot"], "left")
        middle = F.floor((F.col("first") + F.col("stop")) / 2).cast("int")
        parts = F.when(F.col("hot").isNull(), F.array(F.struct("first", "stop"))).otherwise(F.array(F.struct("first", middle.alias("stop")), F.struct(middle.alias("first"), "stop")))
        marked = marked.withColumn("part", F.explode(parts)).select("word", "n", "size", "part.first", "part.stop")
        before, rows = rows, marked.withColumn("key", _key(F.col("word"), F.col("size"), F.col("first"), F.col("stop")))
        rows = materialize(rows, "spelling-split")
        discard(before, sizes)


class Order:
    """Words of keys in order: the place of each, and how far each one agrees with the one before."""

    def __init__(self, key: np.ndarray, words: list[bytes]):
        n = len(words)
        heads = [int(k).to_bytes(8, "big") for k in key.tolist()]
        full = [h + w for h, w in zip(heads, words, strict=True)]
        self.rows = np.array(sorted(range(n), key=full.__getitem__), np.int64)
        self.place = np.empty(n, np.int64)
        self.place[self.rows] = np.arange(n)
        size = np.array([len(w) for w in words], np.int64)
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[:-1]
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        a, b = self.rows[:-1], self.rows[1:]
        self.agree = np.full(n + 1, -1, np.int64)
        live = np.flatnonzero(key[a] == key[b])
        self.agree[1:n][live] = 0
        step, both = 0, np.minimum(size[a], size[b])
        while len(live):
            live = live[both[live] > step]
            live = live[raw[at[a[live]] + step] == raw[at[b[live]] + step]]
            step += 1
            self.agree[live + 1] = step
        #: least agreement of 2^k neighbours from each place on
        self.least = [self.agree]
        while 2 << len(self.least) - 1 <= n:
            last, k = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(last[:-k], last[k:]))

    def most(self) -> np.ndarray:
        """The longest start that each word shares with another."""
        return np.maximum(self.agree[self.place], self.agree[self.place + 1])

    def interval(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words that share the first ``length`` letters of each row."""
        low = self.place[rows]
        high = low.copy()
        for k in range(len(self.least) - 1, -1, -1):
            step, least = 1 << k, self.least[k]
            at = low - step + 1
            ok = (at >= 0) & (least[np.maximum(at, 0)] >= length)
            low = np.where(ok, low - step, low)
            at = high + 1
            ok = (at < len(least)) & (least[np.minimum(at, len(least) - 1)] >= length)
            high = np.where(ok, high + step, high)
        return low, high + 1


class Points:
    """The words of one kind as points of the two orders."""

    def __init__(self, forward: Order, backward: Order, kind: np.ndarray):
        self.x = np.concatenate((np.zeros(1, np.int64), np.cumsum(kind[forward.rows])))
        self.y = np.concatenate((np.zeros(1, np.int64), np.cumsum(kind[backward.rows])))
        self.rows = backward.rows[kind[backward.rows]]
        own = forward.rows[kind[forward.rows]]
        self.tree = WaveletMatrix(self.y[backward.place[own]], max(1, len(own))) if len(own) else None

    def within(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """query, row: the words in each rectangle."""
        if self.tree is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, place = self.tree.report(self.x[x[0]], self.x[x[1]], self.y[y[0]], self.y[y[1]])
        return query, self.rows[place]


def near_rows(key: np.ndarray, words: list[bytes], size: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key whose words are one edit apart, both ways, each pair under the one key that has its edit."""
    length = np.array([len(w) for w in words], np.int64)
    short = length == size
    forward, backward = Order(key, words), Order(key, [w[::-1] for w in words])
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))[:-1]
    raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    shared, ended = forward.most(), backward.most()
    asks = np.flatnonzero(short)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for points, longer in ((Points(forward, backward, short), 0), (Points(forward, backward, ~short), 1)):
        # a replaced letter leaves length - 1 - i letters after it, an inserted one length - i
        low = np.maximum(first[asks], size[asks] - 1 + longer - ended[asks])
        high = np.minimum(np.minimum(stop[asks], size[asks] + longer), shared[asks] + 1)
        count = np.maximum(0, high - low)
        ends = np.cumsum(count)
        for start in range(0, int(ends[-1]) if len(ends) else 0, QUERIES):
            number = np.arange(start, min(start + QUERIES, int(ends[-1])))
            own = np.searchsorted(ends, number, side="right")
            row, i = asks[own], low[own] + number - (ends[own] - count[own])
            query, found = points.within(forward.interval(row, i), backward.interval(row, size[row] - 1 + longer - i))
            row, i = row[query], i[query]
            ok = (found != row) & (size[found] == size[row]) & (first[found] == first[row])
            if longer:  # of equal letters in a row the first counts as the inserted one
                ok &= (i == 0) | (raw[at[found] + i] != raw[at[row] + np.maximum(i - 1, 0)])
            row, found = row[ok], found[ok]
            out_a += [row, found] if longer else [row]
            out_b += [found, row] if longer else [found]
    return np.concatenate(out_a), np.concatenate(out_b)


def _near(table: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: of the near words under the keys of a shard their number, and the first by n and order."""
    names = table["word"].to_pylist()
    words = [w.encode("latin-1") for w in names]
    columns = [np.asarray(table[c]).astype(np.int64) for c in ("key", "size", "first", "stop", "n")]
    key, size, first, stop, n = columns
    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    a, b = near_rows(key, words, size, first, stop)
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    by = np.lexsort((rank[b], -n[b], a))
    a, b = a[by], b[by]
    head = np.flatnonzero(np.concatenate((np.ones(1, bool), a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(a)))
    return pa.table({"word": pa.array([names[k] for k in a[head]], pa.string()), "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n[b[head]], pa.int64()), "best": pa.array([names[k] for k in b[head]], pa.string())})


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, one_in: int = ONE_IN) -> DataFrame:
    """Words with the more frequent word one edit away that they are a form of.

    Words are maximal runs of the letters A-Z, a-z and U+00C0-U+00FF, A-Z
    lower-cased, of ``least`` letters and ``least_count`` occurrences or more;
    one run in ``one_in`` loses a letter first (0: none does).  A word's form
    is its near word of largest n (ties: the smallest by code points) if that
    n is ``times`` its own or more, else null; its root is found by following
    forms.  One row for each word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null id counts as empty text, and
    rows of one id count each.  Other columns aren't read.  Without words
    there is no row.
    """
    words = materialize(word_counts(docs, id_col, text_col, least, least_count, one_in), "spelling-words")
    rows, total = split_hot(keyed(words, least), KEY_WORDS)
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_WORDS + 1)
    dealt = rows.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)))
    near = dealt.groupBy("shard").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    known = words.join(near, "word", "left").withColumn("form_n", F.when(-F.col("first.less") >= times * F.col("n"), -F.col("first.less")))
    known = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("first.best")).alias("form"), "form_n"), "spelling-forms")
    # each form has ``times`` the occurrences of its word at least, which bounds the way to a root
    most = int(known.agg(F.max("n")).first()[0] or 1)
    steps = int(math.log(most / least_count, times)) + 1 if most > least_count and times > 1 else 1
    links = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        on = links.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        links = materialize(links.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
