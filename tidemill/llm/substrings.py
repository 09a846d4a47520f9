"""Substring dedup by FM-indexes of shards.

A window is a run of words of one document.  Every window is sent to the shard
of its anchor, the short run of words in it that a fixed order puts first, so
that equal windows meet; neighbouring windows with one anchor travel as one
segment.  Only anchors that occur in more than one document are of interest.
Anchors with many segments have a shard of their own, and the segments of
those with more than a shard holds are cut into their windows, which go to the
shards of their words.  A shard lays its distinct segments end to end, indexes them, and streams them
through the index by backward search.  Windows whose matching statistic is as
long as the window are repeats, and the interval of their suffixes tells the
smallest document that has them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, bucketed, discard, grams, materialize, starts_of, tidy, unpacked, unpacked_words, utf8_buffer, word_hashes, word_slices
from .fm import FMIndex, interval_minima

WINDOW = 13
#: Words of an anchor.
ANCHOR = 3
#: Segments that a shard holds at most, copies of one segment from other slices aside.
SHARD_SEGMENTS = 15_000
#: Text bytes of a slice.
SLICE_BYTES = 4 << 20
#: Segments of an anchor from which it has a shard of its own, as a share of SHARD_SEGMENTS.
OWN_SHARD = 15
#: Segments of an anchor in a slice from which equal ones are counted once.
COUNTED = 32
#: How the segments of an anchor find their shard.
SHARED, OWN, CUT = 0, 1, 2
#: Bits of a segment of which all windows are repeats.
ALL = (1 << 41) - 1
#: A document id that counts as larger than all others.
LAST = np.iinfo(np.int64).max


class Slice:
    """A row of the slice table."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.words = unpacked_words(batch.column("words")[row].as_py())
        self.ids = batch.column("doc_ids")[row].values
        self.at = starts_of(np.asarray(batch.column("n_words")[row].values))
        self.codes = unpacked(batch.column("codes")[row].as_py())
        self.hashes = word_hashes(self.words)
        self.order_ids = np.asarray(self.ids.fill_null(LAST), dtype=np.int64)

    def segments(self, window: int):
        """anchor, first window, number of windows and document of each segment."""
        h = self.hashes[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        gram = grams(h, ANCHOR)
        if len(h) < window:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        # longer words are rarer, so runs of more bytes come first
        raw = np.diff(utf8_buffer(self.words)[1])[self.codes]
        size = sum(raw[k : k + len(gram)] for k in range(ANCHOR))
        key = (np.uint64(63) - np.minimum(size, 63).astype(np.uint64)) << np.uint64(58) | gram >> np.uint64(6)
        span = window - ANCHOR + 1
        least = key
        have = 1
        while have < span:  # sliding minimum over ``span`` places
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        n = len(least)
        doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        whole = doc[:n] == doc[window - 1 : window - 1 + n]
        # the place of the anchor: the first with the least key
        place = np.zeros(n, np.int64)
        todo = np.arange(n)
        for k in range(span):
            hit = key[todo + k] == least[todo]
            place[todo[hit]] = todo[hit] + k
            todo = todo[~hit]
            if not len(todo):
                break
        begins = whole.copy()
        begins[1:] &= ~(whole[:-1] & (place[1:] == place[:-1]) & (doc[1:n] == doc[: n - 1]))
        first = np.flatnonzero(begins)
        inside = np.cumsum(whole)
        stop = np.append(first[1:], n)
        count = inside[stop - 1] - inside[first] + 1
        return gram[place[first]].view(np.int64), first, count, doc[first]

    def cut(self, anchor: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, hot: np.ndarray):
        """The segments, those of anchors of ``hot`` cut into their windows."""
        if not len(hot) or not len(anchor):
            return anchor, first, count, doc
        times = np.where(np.isin(anchor, hot), count, 1)
        number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        parts = np.repeat(times, times) > 1
        anchor, first, count, doc = (np.repeat(x, times) for x in (anchor, first, count, doc))
        return anchor, first + number, np.where(parts, 1, count), doc

    def contents(self, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
        """A hash of the words of each segment."""
        h = self.hashes[self.codes]
        with np.errstate(over="ignore"):
            size = count + window - 1
            sums = np.zeros(len(first), np.uint64)
            for k in range(int(size.max(initial=0))):
                live = size > k
                sums[live] = (sums[live] ^ h[first[live] + k]) * np.uint64(0x9E3779B97F4A7C15)
                sums[live] ^= sums[live] >> np.uint64(32)
            return (sums ^ size.astype(np.uint64)).view(np.int64)


def _anchors(window: int):
    """slice_id, anchor, several, n: each anchor once in a slice; several says that two documents of the slice have it, n how many segments."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = Slice(batch, row)
                anchor, begin, count, doc = own.segments(window)
                by = np.lexsort((doc, anchor))
                a, d = anchor[by], doc[by]
                first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(a)) - 1
                n = last - first + 1
                many = np.flatnonzero(np.repeat(n >= COUNTED, n))
                if len(many):
                    x, y = a[many], own.contents(begin[by[many]], count[by[many]], window)
                    y = y[np.lexsort((y, x))]  # x is in order
                    unlike = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                    n[n >= COUNTED] = np.unique(x[unlike], return_counts=True)[1]
                slice_id = batch.column("slice_id")[row].as_py()
                for low in range(0, len(first), 65_536):
                    f, end = first[low : low + 65_536], last[low : low + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), slice_id)), pa.array(a[f]), pa.array(d[f] != d[end]), pa.array(n[low : low + 65_536])], ["slice_id", "anchor", "several", "n"])

    return run


def _segments(window: int, shards: int):
    """shard, content, doc_id, words, slice_id: distinct segments of a slice whose anchors are wanted, with the smallest document."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = Slice(batch, row)
                anchor, first, count, doc = own.segments(window)
                shared, alone, hot = (np.asarray(batch.column(c)[row].values) for c in ("shared", "alone", "cut"))
                hit = np.flatnonzero(np.isin(anchor, np.concatenate((shared, alone, hot))))
                anchor, first, count, doc = own.cut(anchor[hit], first[hit], count[hit], doc[hit], hot)
                ids = own.order_ids[doc]
                content = own.contents(first, count, window) if len(first) else np.zeros(0, np.int64)
                by = np.lexsort((ids, content))
                by = by[np.concatenate(([True], content[by][1:] != content[by][:-1]))] if len(by) else by
                slice_id = batch.column("slice_id")[row].as_py()
                size = count[by] + window - 1
                for low in range(0, len(by), 8192):
                    part, n = by[low : low + 8192], size[low : low + 8192]
                    ends = np.cumsum(n)
                    places = np.repeat(first[part] - (ends - n), n) + np.arange(ends[-1])
                    words = binary_array(own.hashes[own.codes[places]].view(np.uint8), np.concatenate(([0], 8 * ends))).cast(pa.binary())
                    # the windows of a cut anchor go by their words, other segments by their anchor
                    key = np.where(np.isin(anchor[part], hot), content[part], anchor[part])
                    shard = np.where(np.isin(key, alone) & (key == anchor[part]), -1 - (key & LAST), (key.view(np.uint64) % np.uint64(shards)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(content[part]), pa.array(ids[part]), words, pa.array(np.full(len(part), slice_id))], ["shard", "content", "doc_id", "words", "slice_id"])

    return run


def shard_matches(content: np.ndarray, doc_id: np.ndarray, words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contents, the smallest document of each, and bits for its windows that a still smaller document has."""
    by = np.lexsort((doc_id, content))
    by = by[np.concatenate(([True], content[by][1:] != content[by][:-1]))]
    content, doc_id = content[by], doc_id[by]
    size = np.array([len(words[k]) // 8 for k in by], np.int64)
    flat = np.frombuffer(b"".join(words[k] for k in by), np.uint64)
    # symbols are the distinct words, 0 closes a segment
    distinct, symbol = np.unique(flat, return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    symbols = np.zeros(begin[-1], np.int64)
    inner = np.ones(begin[-1], bool)
    inner[begin[1:] - 1] = False
    symbols[inner] = symbol + 1
    index = FMIndex(symbols, len(distinct) + 1, window)
    n = size - window + 1
    owner = np.repeat(np.arange(len(size)), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    low, high, reached = index.search(symbols, begin[owner] + number + window, window)
    hit = np.flatnonzero(reached == window)
    document = np.repeat(doc_id, size + 1)[index.suffixes]
    least = interval_minima(document, low[hit], high[hit])
    earlier = least < doc_id[owner[hit]]
    bits = np.bincount(owner[hit][earlier], (1 << number[hit][earlier]).astype(np.float64), minlength=len(size)).astype(np.int64)
    return content, doc_id, bits


def _match(window: int):
    def match(table: pa.Table) -> pa.Table:
        own = np.asarray(table["content"])
        content, doc_id, bits = shard_matches(own, np.asarray(table["doc_id"]), table["words"].to_pylist(), window)
        at = np.searchsorted(content, own)
        # a slice whose first document with the segment isn't the first of all loses all windows of it
        flags = np.where(np.asarray(table["doc_id"]) > doc_id[at], ALL, bits[at])
        told = pa.table({"slice_id": table["slice_id"], "content": table["content"], "bits": flags})
        return told.filter(pa.array(flags != 0))

    return match


def _remove(window: int, id_col: str):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = Slice(batch, row)
                found = batch.column("found")[row]
                start = np.zeros(len(own.codes) + 1, np.int64)  # +1 where a repeated window starts, -1 where it ends
                hot = batch.column("cut")[row]
                _, first, count, doc = own.cut(*own.segments(window), np.asarray(hot.values) if hot.is_valid else np.zeros(0, np.int64))
                content, ids = own.contents(first, count, window) if len(first) else first, own.order_ids[doc]
                by = np.lexsort((ids, content))
                groups = np.concatenate(([True], content[by][1:] != content[by][:-1])) if len(by) else np.zeros(0, bool)
                number = np.cumsum(groups) - 1
                flags = np.zeros(int(groups.sum()), np.int64)
                if found.is_valid and len(found.values):
                    told, bits = (np.asarray(found.values.field(k)) for k in range(2))
                    flags[np.searchsorted(content[by][groups], told)] = bits
                # later documents of the slice repeat its first one with the segment
                each = np.where(ids[by] > ids[by][groups][number], ALL, flags[number])
                hit = np.flatnonzero(each)
                each, first, count = each[hit], first[by[hit]], count[by[hit]]
                for k in range(int(count.max(initial=0))):
                    places = first[(each >> k & 1 == 1) & (count > k)] + k
                    np.add.at(start, places, 1)
                    np.add.at(start, places + window, -1)
                keep = np.cumsum(start)[:-1] == 0
                doc = np.repeat(np.arange(len(own.at) - 1), np.diff(own.at))
                kept = np.bincount(doc[keep], minlength=len(own.at) - 1)
                texts = joined(own, keep, kept)
                digests = [hashlib.sha256(x).hexdigest() for x in texts]
                n = np.diff(own.at)
                yield pa.RecordBatch.from_arrays([own.ids, pa.array(n), pa.array(n - kept), pa.array(digests, pa.string()), pa.array(texts, pa.binary())], [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def joined(own: Slice, keep: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    raw, at = utf8_buffer(own.words)
    codes = own.codes[keep]
    size = np.diff(at)[codes] + 1
    ends = np.cumsum(size)
    source = np.append(raw, np.uint8(0x20))
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(at[codes] - (ends - size), size) + np.arange(total)
    places[ends - 1] = len(raw)
    data = source[places].tobytes()
    cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(kept)))]
    return [data[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def routed(slices: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The segments with their shards, and the anchors of each slice whose segments are cut."""
    anchors = slices.mapInArrow(tidy(_anchors(window)), "slice_id long, anchor long, several boolean, n long")
    # totals are combined first, and only anchors that matter meet the slices' rows again: a join, which Spark may split where an anchor is hot
    totals = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("slices"), F.max("several").alias("any"), F.sum("n").alias("total")).where("slices > 1 or any")
    totals = materialize(totals.select("anchor", "total"), "substring-totals")
    counted = anchors.select("slice_id", "anchor", "n").join(totals, "anchor")
    way = F.when(F.col("total") > SHARD_SEGMENTS, CUT).when(F.col("total") * OWN_SHARD > SHARD_SEGMENTS, OWN).otherwise(SHARED)
    # rows that go to shared shards; a cut segment has at most as many windows as there are places for its anchor
    load = F.when(F.col("way") == CUT, F.col("n") * (window - ANCHOR + 1)).when(F.col("way") == SHARED, F.col("n")).otherwise(0)
    lists = [F.collect_list(F.when(F.col("way") == k, F.col("anchor"))).alias(name) for k, name in ((SHARED, "shared"), (OWN, "alone"), (CUT, "cut"))]
    wanted = materialize(counted.withColumn("way", way).groupBy("slice_id").agg(*lists, F.sum(load).alias("load")), "substring-anchors")
    discard(totals)
    shards = 2 * int(wanted.agg(F.sum("load")).first()[0] or 0) // SHARD_SEGMENTS + 1
    segments = slices.join(wanted.hint("merge"), "slice_id").mapInArrow(tidy(_segments(window, shards)), "shard long, content long, doc_id long, words binary, slice_id long")
    return segments, wanted.where(F.size("cut") > 0).select("slice_id", "cut")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Remove each word that lies in a window which a document with a smaller id has too.

    One row for each row of ``docs``: id, n_words, n_removed, kept_sha256,
    kept_text (binary, the kept words joined by one space).  Words are
    ``[^\x20\x09-\x0D]+``, unchanged; windows are judged on the input.  Null
    and short texts lose nothing.  Rows repeated under one id don't count
    against each other; a null id counts as larger than all others.  Other
    columns aren't read.
    """
    if not ANCHOR < window <= ANCHOR + 40:
        raise ValueError("windows have 4 to 43 words")
    # slices are large rows: they meet their anchors and their findings where they are
    slices = bucketed(word_slices(docs, id_col, text_col, lower=False, limit=SLICE_BYTES), "substring-slices", "slice_id")
    segments, cut = routed(slices, window)
    matched = segments.groupBy("shard").applyInArrow(_match(window), "slice_id long, content long, bits long")
    found = matched.groupBy("slice_id").agg(F.collect_list(F.struct("content", "bits")).alias("found"))
    found = found.join(cut, "slice_id", "full")
    kind = docs.schema[id_col].dataType.simpleString()
    out = slices.join(found.hint("merge"), "slice_id", "left").mapInArrow(tidy(_remove(window, "__id")), "`__id` long, n_words long, n_removed long, kept_sha256 string, kept_text binary")
    return out.select(F.col("__id").cast(kind).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text")
