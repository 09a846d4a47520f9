"""Byte-wise removal of repeated strings by suffix order.

A window is a run of bytes of one document.  The anchor of a window is the
short string in it whose hash is least, so equal windows have equal anchors;
neighbouring windows with one anchor travel as one segment.  Anchors that
occur once in the corpus are left out, and of equal segments only those of the
first document go on.  Segments go to the shard of their anchor; those of
anchors with more segments than a shard holds are cut into their windows,
which go to shards by their bytes.  A shard lays its segments end to end,
sorts all suffixes by the difference-cover algorithm (``suffixes``) and
compares the bytes of neighbours: windows that are equal stand together, and
all but the first of them are repeats.

What slices ask each other travels as packed arrays, one for each slice and
bucket of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize, slices, small_batches, starts_of, tidy, utf8_buffer
from .suffixes import equal_to_last, suffix_ranks

WINDOW, ANCHOR = 100, 32
#: Bits of a place within a stretch.
PLACE = 21
#: Text bytes of a slice of documents, and windows that are worked on at once.
SLICE_BYTES, STRETCH = 4 << 20, (1 << PLACE) - 4096
#: Bytes that a shard is to hold, and segments of an anchor from which they are cut into windows.
SHARD_BYTES, CUT_FROM = 2 << 20, 10_000
#: Numbers of a bucket.
BUCKET_ROWS = 400_000
#: A document id that counts as larger than all others.
LAST = np.iinfo(np.int64).max
ONCE, SHARED, CUT = 0, 1, 2
_RNG = np.random.default_rng(20240917)
_BYTE = [_RNG.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(2)]
_BASE = [int(_RNG.integers(0, 1 << 63)) * 2 + 1 for _ in range(2)]
SEGMENT = np.dtype([("anchor", "<u8"), ("first", "<i8"), ("count", "<i4"), ("doc", "<i4"), ("one", "<u8"), ("two", "<u8")])
TOLD = "slice_id long, bucket long, body binary"
ASKED = "slice_id long, bucket long, load long, body binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` bytes from each place on."""

    def run(n: int) -> np.ndarray:
        if n == 1:
            return _BYTE[0][raw]
        half = n // 2
        h = run(half)
        h = h[: len(h) - half] * np.uint64(pow(_BASE[0], half, 1 << 64)) + h[half:]
        return h[:-1] * np.uint64(_BASE[0]) + _BYTE[0][raw[n - 1 :]] if n % 2 else h

    if len(raw) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mixed(run(n))


def string_hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray, kind: int) -> np.ndarray:
    """A 64-bit hash of ``size`` bytes from each place on."""
    if kind not in _POWERS:
        _POWERS[kind] = []
        for base in (pow(_BASE[kind], -1, 1 << 64), _BASE[kind]):
            powers = np.full(STRETCH + 2 * WINDOW, np.uint64(base))
            powers[0] = 1
            _POWERS[kind].append(np.cumprod(powers))
    with np.errstate(over="ignore"):
        inverse, powers = (_powers(p, len(raw) + 1) for p in _POWERS[kind])
        # of the inverse, so that hashes don't depend on the place
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[kind][raw] * inverse[:-1], out=sums[1:])
        return mixed((sums[first + size] - sums[first]) * powers[first] + size.astype(np.uint64))


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(known: np.ndarray, n: int) -> np.ndarray:
    if n <= len(known):
        return known[:n]
    more = np.full(n, known[1])
    more[0] = 1
    return np.cumprod(more)


def segments(raw: np.ndarray, at: np.ndarray, window: int, hashes: int = 2) -> np.ndarray:
    """The segments of documents that lie end to end: anchor, first window, number of windows, document, and two hashes of the bytes (or one)."""
    out = [np.zeros(0, SEGMENT)]
    span = window - ANCHOR + 1
    for low in range(0, len(raw) - window + 1, STRETCH):
        part = raw[low : low + STRETCH + window - 1]
        gram = gram_hashes(part, ANCHOR)
        # a place in the low bits: of equal hashes the first counts
        least, have = (gram >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(gram), dtype=np.uint64), 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        n = len(least)
        # the document of each window, and whether it ends there too
        docs = np.arange(np.searchsorted(at, low, side="right") - 1, np.searchsorted(at, low + n - 1, side="right"))
        starts, stops = np.clip(at[docs] - low, 0, n), np.clip(at[docs + 1] - window + 1 - low, 0, n)
        stops = np.maximum(starts, stops)
        change = np.zeros(n + 1, np.int8)
        some = stops > starts
        change[starts[some]] += 1
        np.subtract.at(change, stops[some], 1)
        whole = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
        place = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        begins = whole.copy()
        begins[1:] &= ~(whole[:-1] & (place[1:] == place[:-1]))
        first = np.flatnonzero(begins)
        if not len(first):
            continue
        inside = np.cumsum(whole)
        stop = np.append(first[1:], n)
        count = inside[stop - 1] - inside[first] + 1
        found = np.zeros(len(first), SEGMENT)
        found["anchor"], found["first"], found["count"] = gram[place[first]], first + low, count
        found["doc"] = np.searchsorted(at, found["first"], side="right") - 1
        size = count + window - 1
        for kind, name in enumerate(("one", "two")[:hashes]):
            found[name] = string_hashes(part, first, size, kind)
        out.append(found)
    return np.concatenate(out)


def cut(found: np.ndarray, raw: np.ndarray, hot: np.ndarray, window: int) -> np.ndarray:
    """The segments, those marked in ``hot`` cut into their windows; the anchor of such a window is a hash of its bytes."""
    if not hot.any():
        return found
    times = np.where(hot, found["count"], 1).astype(np.int64)
    out = np.repeat(found, times)
    number = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
    hot = np.repeat(hot, times)
    out["first"] += number
    out["count"][hot] = 1
    for low in range(0, len(raw), STRETCH):
        part = np.flatnonzero(hot & (out["first"] >= low) & (out["first"] < low + STRETCH))
        if len(part):
            text, size = raw[low : low + STRETCH + window], np.full(len(part), window)
            out["one"][part], out["two"][part] = (string_hashes(text, out["first"][part] - low, size, kind) for kind in range(2))
    out["anchor"][hot] = out["one"][hot]
    return out


class Slice:
    """A row of the table of slices: documents end to end."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.ids = batch.column("ids")[row].values
        self.at = starts_of(np.asarray(batch.column("sizes")[row].values, dtype=np.int64))
        body = batch.column("body")[row].as_py()
        self.raw = np.frombuffer(pa.decompress(body, int(self.at[-1]), codec="zstd"), np.uint8) if self.at[-1] else np.zeros(0, np.uint8)
        self.order_ids = np.asarray(self.ids.fill_null(LAST), dtype=np.int64)
        self.ties = np.asarray(batch.column("ties")[row].values, dtype=np.int64)

    def order(self, found: np.ndarray) -> np.ndarray:
        """doc_id, tie, start of each segment, which order them."""
        out = np.empty((len(found), 3), "<i8")
        out[:, 0], out[:, 1] = self.order_ids[found["doc"]], self.ties[found["doc"]]
        out[:, 2] = found["first"] - self.at[found["doc"]]
        return out


def text_slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """slice_id, n_bytes, ids, ties (a hash of the text, which orders rows of one id), sizes, body."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, "text", SLICE_BYTES)):
            raw, at = utf8_buffer(batch.column("text"))
            text = raw.tobytes()
            ties = [int.from_bytes(hashlib.blake2b(text[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            cells = [([base + k], pa.int64()), ([len(raw)], pa.int64()), ([batch.column("id").to_pylist()], pa.list_(pa.int64())), ([ties], pa.list_(pa.int64())), ([np.diff(at)], pa.list_(pa.int64())), ([pa.compress(text, codec="zstd", asbytes=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cells], ["slice_id", "n_bytes", "ids", "ties", "sizes", "body"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "slice_id long, n_bytes long, ids array<long>, ties array<long>, sizes array<long>, body binary")


def by_slice(told: DataFrame, name: str) -> DataFrame:
    """slice_id and all that its buckets told it."""
    return told.groupBy("slice_id").agg(F.collect_list(F.struct("bucket", "body")).alias(name))


def told_to(batch: pa.RecordBatch, row: int, name: str) -> dict[int, bytes]:
    cell = batch.column(name)[row]
    return {t["bucket"]: t["body"] for t in cell.as_py()} if cell.is_valid else {}


def _send(names: list[str], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of longs, then a binary."""
    for low in range(0, len(rows), 256):
        part = list(zip(*rows[low : low + 256], strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in part[:-1]), pa.array(part[-1], pa.binary())], names)


def grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and the places that have it, in order."""
    if len(keys):
        by = np.argsort(keys, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(keys[by])) + 1):
            yield int(keys[part[0]]), part


def _local(found: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments sorted by their bytes and their order, and where other bytes begin."""
    by = np.lexsort((order[:, 2], order[:, 1], order[:, 0], found["two"], found["one"]))
    a = found[by]
    new = np.concatenate((np.ones(1, bool), (a["one"][1:] != a["one"][:-1]) | (a["two"][1:] != a["two"][:-1]))) if len(a) else np.zeros(0, bool)
    return by, new


def _ask_anchors(window: int, buckets: int):
    """Each anchor of a slice once, with how many segments have it (2 at least where it occurs twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = Slice(batch, row)
                anchor, n = anchors_of(segments(own.raw, own.at, window, 1))
                number = batch.column("slice_id")[row].as_py()
                rows = [(number, bucket, anchor[part].tobytes() + np.minimum(n[part], 1 << 31).astype("<u4").tobytes()) for bucket, part in grouped((anchor % np.uint64(buckets)).astype(np.int64))]
                yield from _send(["slice_id", "bucket", "body"], rows)

    return run


def anchors_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors, in order, and the number of segments of each; equal segments count as one, but two at least if there are several."""
    anchor, times = np.unique(found["anchor"], return_counts=True)
    n = times.astype(np.int64)
    # most anchors stand once; the bytes of others are compared by one hash, which may count some as one
    several = np.flatnonzero(times > 1)
    at = np.searchsorted(anchor[several], found["anchor"])
    at = np.minimum(at, max(0, len(several) - 1))
    own = np.flatnonzero(anchor[several][at] == found["anchor"]) if len(several) else np.zeros(0, np.int64)
    by = np.lexsort((found["one"][own], at[own]))
    group, one = at[own][by], found["one"][own][by]
    unlike = np.concatenate((np.ones(1, bool), (group[1:] != group[:-1]) | (one[1:] != one[:-1]))) if len(own) else np.zeros(0, bool)
    n[several] = np.maximum(2, np.bincount(group[unlike], minlength=len(several)))
    return anchor, n


def _tell_anchors(most: int):
    def tell(table: pa.Table) -> pa.Table:
        bodies = table["body"].to_pylist()
        sizes = [len(b) // 12 for b in bodies]
        anchor = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(bodies, sizes, strict=True)])
        n = np.concatenate([np.frombuffer(b, "<u4", k, 8 * k) for b, k in zip(bodies, sizes, strict=True)]).astype(np.int64)
        by = np.argsort(anchor)
        ordered = anchor[by]
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), ordered[1:] != ordered[:-1])))
        times = np.diff(np.append(first, len(by)))
        total = np.empty(len(by), np.int64)
        total[by] = np.repeat(np.add.reduceat(n[by], first), times)
        way = np.where(total < 2, ONCE, np.where(total > most, CUT, SHARED)).astype(np.uint8)
        parts = np.split(way, np.cumsum(sizes)[:-1])
        return pa.table({"slice_id": table["slice_id"], "bucket": table["bucket"], "body": pa.array([p.tobytes() for p in parts], pa.binary())})

    return tell


def _ask_first(window: int, buckets: int):
    """The segments of a slice that matter (bucket null) with the bytes of distinct ones, and for each bucket the hashes of their bytes with the order of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = Slice(batch, row)
                found = segments(own.raw, own.at, window)
                told = told_to(batch, row, "ways")
                anchor = np.unique(found["anchor"])
                way = np.zeros(len(anchor), np.uint8)
                for bucket, part in grouped((anchor % np.uint64(buckets)).astype(np.int64)):
                    way[part] = np.frombuffer(told[bucket], np.uint8)
                way = way[np.searchsorted(anchor, found["anchor"])]
                found, way = found[way != ONCE], way[way != ONCE]
                found = cut(found, own.raw, way == CUT, window)
                order = own.order(found)
                by, new = _local(found, order)
                number = batch.column("slice_id")[row].as_py()
                names = ["slice_id", "bucket", "load", "body"]
                if len(found):
                    load = int(found["count"][by[new]].sum()) + len(by[new]) * window
                    yield from _send(names, [(number, None, load, b"%d:" % len(found) + pa.compress(found.tobytes(), codec="zstd", asbytes=True))])
                heads = by[new]
                body = np.empty((len(heads), 5), "<i8")
                body[:, 0], body[:, 1], body[:, 2:] = found["one"][heads].view("<i8"), found["two"][heads].view("<i8"), order[heads]
                yield from _send(names, [(number, bucket, None, body[part].tobytes()) for bucket, part in grouped((found["one"][heads] % np.uint64(buckets)).astype(np.int64))])

    return run


def _tell_first(table: pa.Table) -> pa.Table:
    """For each of a slice's strings whether a document before has it."""
    bodies = table["body"].to_pylist()
    x = np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 5) for b in bodies])
    by = np.lexsort(x.T[::-1])
    y = x[by]
    new = np.concatenate((np.ones(1, bool), (y[1:, :2] != y[:-1, :2]).any(1)))
    first = y[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.empty(len(x), bool)
    later[by] = (y != first).any(1)
    parts = np.split(later, np.cumsum([len(b) // 40 for b in bodies])[:-1])
    return pa.table({"slice_id": table["slice_id"], "bucket": table["bucket"], "body": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _opened(batch: pa.RecordBatch, row: int) -> np.ndarray:
    cell = batch.column("found")[row]
    if not cell.is_valid:
        return np.zeros(0, SEGMENT)
    n, _, body = cell.as_py().partition(b":")
    return np.frombuffer(pa.decompress(body, int(n) * SEGMENT.itemsize, codec="zstd"), SEGMENT)


def later_ones(own: Slice, found: np.ndarray, told: dict[int, bytes], buckets: int) -> np.ndarray:
    """Of each segment whether equal bytes stand in a document before, or earlier in the same one."""
    order = own.order(found)
    by, new = _local(found, order)
    heads = by[new]
    later = np.zeros(len(heads), bool)
    for bucket, part in grouped((found["one"][heads] % np.uint64(buckets)).astype(np.int64)):
        later[part] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=len(part)).astype(bool)
    out = np.empty(len(found), bool)
    group = np.cumsum(new) - 1
    out[by] = later[group] | (order[by] != order[heads][group]).any(1)
    return out


def _to_shards(window: int, buckets: int, shards: int):
    """For each shard the segments of a slice that no earlier one equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, found = Slice(batch, row), _opened(batch, row)
                number = batch.column("slice_id")[row].as_py()
                go = np.flatnonzero(~later_ones(own, found, told_to(batch, row, "later"), buckets))
                order = own.order(found)
                rows = []
                for shard, part in grouped((found["anchor"][go] % np.uint64(shards)).astype(np.int64)):
                    k = go[part]
                    size = found["count"][k] + window - 1
                    text = b"".join(own.raw[a : a + n].tobytes() for a, n in zip(found["first"][k].tolist(), size.tolist(), strict=True))
                    rows.append((number, shard, b"%d:%d:" % (len(k), len(text)) + pa.compress(order[k].tobytes() + size.astype("<i4").tobytes() + text, codec="zstd", asbytes=True)))
                yield from _send(["slice_id", "bucket", "body"], rows)

    return run


def repeated(text: np.ndarray, sizes: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """For each window of each string, the strings end to end in ``text``, whether it stands in a string that comes before, or earlier in one of the same document.

    ``order`` has a row of document and start for each string: (doc_id, tie, start).
    """
    symbols = np.zeros(len(text) + len(sizes), np.int16)
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes + 1)))
    inner = np.ones(len(symbols), bool)
    inner[begin[1:] - 1] = False
    symbols[inner] = text
    symbols[inner] += 1
    count = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    places = begin[owner] + number
    wanted = np.zeros(len(symbols), bool)
    wanted[places] = True
    rank = suffix_ranks(symbols, window, wanted)[places]
    by = np.argsort(rank)
    plain = np.zeros(len(symbols), np.uint8)
    plain[inner] = text
    same = equal_to_last(plain, places[by], window)
    first = np.flatnonzero(~same)
    # the order of a window: its document's among those of the shard, then its start
    docs = np.lexsort((order[:, 1], order[:, 0]))
    unlike = (order[docs][1:, :2] != order[docs][:-1, :2]).any(1)
    doc = np.empty(len(sizes), np.int64)
    doc[docs] = np.concatenate((np.zeros(min(1, len(docs)), np.int64), np.cumsum(unlike)))
    key = doc[owner[by]] << 40 | (order[owner[by], 2] + number[by])
    least = np.repeat(np.minimum.reduceat(key, first), np.diff(np.append(first, len(key)))) if len(first) else key
    out = np.empty(len(by), bool)
    out[by] = key > least
    return out


def _in_shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        orders, sizes, texts = [], [], []
        for body in table["body"].to_pylist():
            n, size, rest = body.split(b":", 2)
            n = int(n)
            rest = pa.decompress(rest, 28 * n + int(size), codec="zstd")
            orders.append(np.frombuffer(rest, "<i8", 3 * n).reshape(n, 3))
            sizes.append(np.frombuffer(rest, "<i4", n, 24 * n).astype(np.int64))
            texts.append(np.frombuffer(rest, np.uint8, -1, 28 * n))
        flags = repeated(np.concatenate(texts), np.concatenate(sizes), np.concatenate(orders), window)
        ends = np.cumsum([int((s - window + 1).sum()) for s in sizes])[:-1]
        parts = [pa.compress(np.packbits(p).tobytes(), codec="zstd", asbytes=True) for p in np.split(flags, ends)]
        return pa.table({"slice_id": table["slice_id"], "bucket": table["bucket"], "body": pa.array(parts, pa.binary())})

    return run


def _remove(window: int, buckets: int, shards: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, found = Slice(batch, row), _opened(batch, row)
                edges = np.zeros(len(own.raw) + 1, np.int32)
                later = later_ones(own, found, told_to(batch, row, "later"), buckets)
                gone = found[later]
                np.add.at(edges, gone["first"], 1)
                np.subtract.at(edges, gone["first"] + gone["count"] + window - 1, 1)
                told = told_to(batch, row, "flags")
                go = np.flatnonzero(~later)
                for shard, part in grouped((found["anchor"][go] % np.uint64(shards)).astype(np.int64)):
                    own_part = found[go[part]]
                    count = own_part["count"].astype(np.int64)
                    total = int(count.sum())
                    bits = np.unpackbits(np.frombuffer(pa.decompress(told[shard], (total + 7) // 8, codec="zstd"), np.uint8), count=total)
                    places = np.repeat(own_part["first"] - (np.cumsum(count) - count), count) + np.arange(total)
                    places = places[bits.astype(bool)]
                    np.add.at(edges, places, 1)
                    np.subtract.at(edges, places + window, 1)
                keep = np.cumsum(edges[:-1]) == 0
                kept = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[own.at]
                # a removed run begins where the byte before stays or the document starts
                starts = ~keep
                starts[1:] &= keep[:-1]
                inner = own.at[:-1][own.at[:-1] < len(own.raw)]
                starts[inner] = ~keep[inner]
                spans = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(starts)))[own.at])
                left = own.raw[keep].tobytes()
                texts = [left[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
                n = np.diff(own.at)
                digests = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([own.ids, pa.array(n), pa.array(n - np.diff(kept)), pa.array(spans), pa.array(digests, pa.string()), pa.array(texts, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return run


def exchange(asked: DataFrame, tell: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return asked.groupBy("bucket").applyInArrow(tell, TOLD)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that lies in a string of ``window`` bytes which also starts earlier, in a smaller document or the same.

    One row for each row of ``docs``: id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256, kept_bytes (binary; a cut may fall
    inside a character).  Texts are UTF-8, matches never cross documents, may
    overlap, and are judged on the input.  Null and short texts lose nothing.
    A null id counts as larger than all others; rows of one id come in the
    order of a hash of their text, and with equal texts count as one document,
    so each loses the same.  Other columns aren't read.
    """
    if window <= ANCHOR:
        raise ValueError(f"windows have more than {ANCHOR} bytes")
    parts = bucketed(text_slices(docs, id_col, text_col), "repeat-slices", "slice_id")
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = int(parts.agg(F.sum("n_bytes")).first()[0] or 0)
    # a window of n grams has 2 / (n + 1) anchors a byte
    buckets = max(least, 2 * total // (window - ANCHOR + 2) // BUCKET_ROWS + 1)
    ways = exchange(parts.mapInArrow(tidy(_ask_anchors(window, buckets)), TOLD), _tell_anchors(CUT_FROM))
    asked = parts.join(by_slice(ways, "ways").hint("merge"), "slice_id", "left").mapInArrow(tidy(_ask_first(window, buckets)), ASKED)
    asked = materialize(asked, "repeat-segments")
    found = asked.where("bucket is null").select("slice_id", F.col("body").alias("found"))
    shards = max(least, int(asked.agg(F.sum("load")).first()[0] or 0) // SHARD_BYTES + 1)
    later = materialize(found.join(by_slice(exchange(asked.where("bucket is not null").drop("load"), _tell_first), "later").hint("merge"), "slice_id"), "repeat-later")
    discard(asked)
    known = parts.join(later.hint("merge"), "slice_id", "left")
    flags = by_slice(exchange(known.mapInArrow(tidy(_to_shards(window, buckets, shards)), TOLD), _in_shard(window)), "flags")
    kind = docs.schema[id_col].dataType.simpleString()
    out = known.join(flags.hint("merge"), "slice_id", "left").mapInArrow(tidy(_remove(window, buckets, shards, "__id")), "`__id` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return out.select(F.col("__id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")
