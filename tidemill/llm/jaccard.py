"""N-gram Jaccard join by a grouped prefix join, and its components.

Two sets of shingles can only be similar enough if they share one of the
first shingles of each, under any order that all documents keep.  The order
here puts the most frequent shingles last.  Documents with the same first
shingles and size form a group; only groups are posted.  Lists of groups that
share a shingle are read in order of size, and pairs that size and place rule
out are left.  The other pairs of groups are expanded into members, filtered
by parity bitmaps (an exact bound), and verified on whole sets.

A list is paired along a sliding window only; of longer lists only the nearest
entries are paired.  That is complete for short lists.  The members of longer
lists, which are mostly groups of near copies, are taken up again once the
links found so far have joined them: then only pairs from different components
are left to compare, in blocks.  At first each member meets the likeliest of
these only, which joins most of a group; then all that are left are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_least, discard, grams, materialize, starts_of, tidy, unpacked, unpacked_words, word_hashes, word_slices
from .components import components

SHINGLE, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Bits of a shingle's hash, and documents that are sorted together.
HASH_BITS, TOGETHER = 52, 512
MASK = np.uint64((1 << HASH_BITS) - 1)
#: Shingles of this many documents of a slice are told of, and as many of the most frequent go last.
#: Any order gives the same links; this one makes lists short.
FREQUENT_IN_SLICE, FREQUENT = 8, 1 << 18
#: Entries of a list that go to one task, neighbours that an entry is paired with, and pairs of members that two groups expand into.
LIST_ROWS, NEIGHBOURS, EXPANDED = 10_000, 3, 16
#: Bits of a bitmap: a power of two, about one for each shingle, between these.  They bound a filter only.
BITS, MOST_BITS = 512, 1 << 16
BLOCK = 2_000
#: Rounds in which a member of long lists meets only the likeliest member of another component, before all pairs are verified.
LIKELIEST_ROUNDS = 1
#: Shingles of the pairs that a task verifies, and of the sets that it keeps unpacked.
VERIFY_SHINGLES, OPEN_SHINGLES = 3_000_000, 1_500_000

POSTING, MEMBER, OVERFLOW = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(batch: pa.RecordBatch, row: int, k: int):
    """For parts of a slice: first document, shingles of each document in order, and where each one's start.

    With fewer than ``k`` words, the whole sequence is one shingle.
    """
    words = unpacked_words(batch.column("words")[row].as_py())
    at = starts_of(np.asarray(batch.column("n_words")[row].values))
    codes = unpacked(batch.column("codes")[row].as_py())
    hashes = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    for low in range(0, len(at) - 1, TOGETHER):
        own = at[low : low + TOGETHER + 1]
        h = hashes[own[0] : own[-1]]
        own = own - own[0]
        size = np.diff(own)
        doc = np.repeat(np.arange(len(size), dtype=np.uint64), size)
        g = grams(h, k)
        whole = doc[: len(g)] == doc[k - 1 :] if len(g) else np.zeros(0, bool)
        found = [doc[: len(g)][whole] << np.uint64(HASH_BITS) | (g[whole] & MASK)]
        for n in range(1, k):
            short = np.flatnonzero(size == n)
            if len(short):
                one = grams(h, n)[own[short]] if n > 1 else h[own[short]]
                found.append(short.astype(np.uint64) << np.uint64(HASH_BITS) | (_mix(one + np.uint64(n)) & MASK))
        key = np.sort(np.concatenate(found))
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        yield low, key & MASK, np.searchsorted(key >> np.uint64(HASH_BITS), np.arange(len(size) + 1, dtype=np.uint64))
    pa.default_memory_pool().release_unused()


def set_ids(tokens: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(tokens + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)))
        return _mix((sums[start[1:]] - sums[start[:-1]]) * np.uint64(0x2545F4914F6CDD1D) + np.diff(start).astype(np.uint64))


def bitmaps(tokens: np.ndarray, start: np.ndarray) -> list[bytes]:
    """For each set, which of its places (hash modulo bits) an odd number of shingles have; longer for larger sets."""
    size = np.diff(start)
    bits = np.full(len(size), BITS)
    while (short := (bits < size) & (bits < MOST_BITS)).any():
        bits[short] *= 2
    out = [b""] * len(size)
    for b in np.unique(bits).tolist():
        docs = np.flatnonzero(bits == b)
        step = max(1, TOGETHER * BITS // b)
        for low in range(0, len(docs), step):
            own = docs[low : low + step]
            place = np.concatenate([tokens[start[d] : start[d + 1]] for d in own]) % np.uint64(b)
            odd = np.bincount(np.repeat(np.arange(len(own)), size[own]) * b + place.astype(np.int64), minlength=len(own) * b) & 1
            for d, x in zip(own.tolist(), np.packbits(odd.astype(np.uint8).reshape(len(own), b), axis=1), strict=True):
                out[d] = x.tobytes()
    return out


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that fewer bits would have given: its parts added without carry."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words)) if len(bitmap) > words else bitmap


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, at the length of the shorter: no more than the shingles that only one set has."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum())


def _describe(k: int):
    """doc_id, n, gid, bitmap of each document; rows without a bitmap are frequent shingles (gid) and their documents (n)."""

    def describe(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("doc_ids")[row].values
                slice_id = batch.column("slice_id")[row].as_py()
                every = [np.zeros(0, np.uint64)]
                for low, tokens, start in shingle_sets(batch, row, k):
                    n = len(start) - 1
                    every.append(tokens)
                    names = ["doc_id", "slice_id", "n", "gid", "bitmap"]
                    yield pa.RecordBatch.from_arrays([ids.slice(low, n), pa.array(np.full(n, slice_id)), pa.array(np.diff(start).astype(np.int64)), pa.array(set_ids(tokens, start).view(np.int64)), pa.array(bitmaps(tokens, start), pa.binary())], names)
                each = np.sort(np.concatenate(every))
                first = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1]))) if len(each) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(each)))
                many = times >= FREQUENT_IN_SLICE
                m = int(many.sum())
                if m:
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(times[many].astype(np.int64)), pa.array(each[first[many]].view(np.int64)), pa.nulls(m, pa.binary())], names)

    return describe


def prefixes(tokens: np.ndarray, start: np.ndarray, frequent: np.ndarray, times: np.ndarray, num: int, den: int):
    """Index into ``tokens`` and place of each document's first shingles, in order of document and place."""
    size = np.diff(start)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    often = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    plain = np.concatenate(([0], np.cumsum(~often)))
    place = plain[:-1] - np.repeat(plain[start[:-1]], size)
    late = np.flatnonzero(often)
    late = late[np.lexsort((tokens[late], times[at[late]], doc[late]))]
    n_plain = plain[start[1:]] - plain[start[:-1]]
    rank = np.arange(len(late)) - np.searchsorted(doc[late], np.arange(len(size)))[doc[late]]
    place[late] = n_plain[doc[late]] + rank
    length = size + num * size // -den + 1  # size - ceil(size * num / den) + 1
    chosen = np.flatnonzero(place < length[doc])
    chosen = chosen[np.lexsort((place[chosen], doc[chosen]))]
    return chosen, place[chosen], doc[chosen]


def _post(shared, k: int, num: int, den: int):
    """kind, t, salt, n, e, place: groups by shingle, and sets by group; each once in a slice."""

    def post(batches):
        frequent, times = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                seen = [np.zeros(0, np.uint64)] * 2
                for _, tokens, start in shingle_sets(batch, row, k):
                    gid = set_ids(tokens, start)
                    size = np.diff(start)
                    chosen, place, doc = prefixes(tokens, start, frequent, times, num, den)
                    cut = np.searchsorted(doc, np.arange(len(size) + 1))
                    group = set_ids(tokens[chosen], cut) ^ _mix(size.astype(np.uint64))
                    live = size > 0
                    _, first = np.unique(np.where(live, gid, 0), return_index=True)
                    first = first[live[first] & ~np.isin(gid[first], seen[0])]
                    seen[0] = np.concatenate((seen[0], gid[first]))
                    yield _rows(MEMBER, group[first], np.zeros(len(first), np.int64), size[first], gid[first], np.zeros(len(first), np.int64))
                    _, first = np.unique(np.where(live, group, 0), return_index=True)
                    first = first[live[first] & ~np.isin(group[first], seen[1])]
                    seen[1] = np.concatenate((seen[1], group[first]))
                    mine = np.isin(doc, first)
                    t, owner, where = tokens[chosen[mine]], doc[mine], place[mine]
                    at = np.minimum(np.searchsorted(frequent, t), max(0, len(frequent) - 1))
                    often = np.where(frequent[at] == t, times[at], 0) if len(frequent) else np.zeros(len(t), np.int64)
                    parts = often // LIST_ROWS + 1
                    salt = np.where(parts > 1, (_mix(group[owner]) % parts.astype(np.uint64)).astype(np.int64) + 1, 0)
                    yield _rows(POSTING, t, salt, size[owner], group[owner], where)

    return post


def _rows(kind: int, t, salt, n, e, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(t), kind, np.int8)), pa.array(t.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(e.view(np.int64)), pa.array(place.astype(np.int32))], ["kind", "t", "salt", "n", "e", "place"])


def _pair_up(num: int, den: int):
    """Pairs along sorted lists: (kind, t, a, b, n).  OVERFLOW rows, and MEMBER rows without b, are entries."""

    def out(kind, t, a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(t), kind, np.int8)), pa.array(t), pa.array(a), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(t), pa.int64()), pa.array(n)], ["kind", "t", "a", "b", "n"])

    def pair_up(batches):
        held: list[np.ndarray] | None = None
        for part in _gathered(batches, 65_536):
            own = [np.asarray(part.column(c)) for c in ("kind", "t", "salt", "n", "e", "place")]
            own = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            old = len(held[0]) if held else 0
            # copies of an entry from several slices stand together
            same = np.zeros(len(own[0]), bool)
            same[1:] = (own[1][1:] == own[1][:-1]) & (own[4][1:] == own[4][:-1]) & (own[0][1:] == own[0][:-1]) & (own[2][1:] == own[2][:-1])
            fresh = np.arange(len(same)) >= old
            keep = ~same
            fresh = fresh[keep]
            kind, t, salt, n, e, place = own = [x[keep] for x in own]
            member = fresh & (kind == MEMBER)
            yield out(MEMBER, t[member], e[member], None, n[member])
            salted = fresh & (salt > 0)
            yield out(OVERFLOW, t[salted], e[salted], None, n[salted])
            long = salt > 0  # entries that are known to be OVERFLOW rows
            for k in range(NEIGHBOURS + 1, 0, -1):
                if k >= len(t):
                    continue
                a, b = slice(None, -k), slice(k, None)
                ok = (t[a] == t[b]) & (kind[a] == kind[b]) & (salt[a] == salt[b]) & (den * n[a].astype(np.int64) >= num * n[b].astype(np.int64))
                if k > NEIGHBOURS:
                    long[a] |= ok
                    long[b] |= ok
                ok &= fresh[b]
                if k > NEIGHBOURS:
                    for side in (a, b):
                        yield out(OVERFLOW, t[side][ok], e[side][ok], None, n[side][ok])
                    continue
                if k > 1:  # of a long list only the nearest are paired here: all its members are taken up again
                    ok &= ~(long[a] & long[b])
                # if this is the first shingle that both have, no more can be shared than what follows it
                need = -(-num * (n[a].astype(np.int64) + n[b]) // (num + den))
                ok &= np.minimum(n[a] - place[a], n[b] - place[b]) >= need
                ia, ib = np.flatnonzero(ok), np.flatnonzero(ok) + k
                low, high = np.minimum(e[ia], e[ib]), np.maximum(e[ia], e[ib])
                for this in (POSTING, MEMBER):
                    m = kind[ia] == this
                    if m.any():
                        yield out(this, t[ia][m], low[m], high[m], n[ia][m])
            held = [x[-(NEIGHBOURS + 1) :] for x in own]

    return pair_up


def _gathered(batches, rows: int):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _emit_sets(k: int):
    """at, gid, shingles of the sets that a slice is asked for, once for each task that asks."""

    def emit(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                asked = batch.column("asked")[row].values
                wanted, task = np.asarray(asked.field(0)), np.asarray(asked.field(1))
                by = np.argsort(wanted, kind="stable")
                wanted, task = wanted[by], task[by]
                for _, tokens, start in shingle_sets(batch, row, k):
                    gid, first = np.unique(set_ids(tokens, start).view(np.int64), return_index=True)
                    at = np.searchsorted(gid, wanted)
                    hit = np.flatnonzero(gid[np.minimum(at, len(gid) - 1)] == wanted) if len(gid) else np.zeros(0, np.int64)
                    blobs = {d: _blob(tokens[start[d] : start[d + 1]]) for d in np.unique(first[at[hit]]).tolist()}
                    for low in range(0, len(hit), 256):
                        rows = hit[low : low + 256]
                        yield pa.RecordBatch.from_arrays([pa.array(task[rows]), pa.array(wanted[rows]), pa.array([blobs[d] for d in first[at[rows]].tolist()], pa.binary())], ["at", "gid", "shingles"])

    return emit


def _blob(tokens: np.ndarray) -> bytes:
    """Sorted shingles as differences, seven bytes each, byte planes apart and compressed: the high ones are small."""
    return pa.compress(np.diff(tokens, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T[:7].tobytes(), codec="zstd", asbytes=True)


def _tokens(blob: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    planes[:7] = np.frombuffer(pa.decompress(blob, 7 * n, codec="zstd"), np.uint8).reshape(7, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def verified(pairs: DataFrame, slices: DataFrame, sets_of: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b: a forest, within each task, of the pairs whose sets are similar enough.

    ``pairs`` has a, b, their sizes and t, a shingle that both have.  Pairs go
    to tasks by t, so that the sets of a group of near copies are sent once; a
    t of many pairs goes to many tasks.  A set is taken from one slice.
    """
    spark = pairs.sparkSession
    made = []
    for _ in range(2):
        # each set draws its pairs to the least shingle of any of them, so that it is sent to few tasks, however many there are
        home = pairs.select(F.col("a").alias("gid"), "t").unionByName(pairs.select(F.col("b").alias("gid"), "t")).groupBy("gid").agg(F.min("t").alias("home"))
        of_a, of_b = (home.select(F.col("gid").alias(c), F.col("home").alias(f"{c}_home")) for c in "ab")
        pairs = materialize(pairs.join(of_a.hint("merge"), "a").join(of_b.hint("merge"), "b").select("a", "b", F.least("a_home", "b_home").alias("t"), "a_n", "b_n"), "jaccard-homes")
        made.append(pairs)
    shingles = F.sum(F.col("a_n") + F.col("b_n"))
    parts = lambda name: F.ceil(shingles / VERIFY_SHINGLES).cast("int").alias(name)
    hot = pairs.groupBy("t").agg(parts("parts")).where("parts > 1")
    hubs = pairs.groupBy("t", "a").agg(parts("a_parts")).where("a_parts > 1")  # a set with so many partners that they are dealt out too
    tasks = max(spark.sparkContext.defaultParallelism, (pairs.agg(shingles).first()[0] or 0) // VERIFY_SHINGLES + 1)
    own = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("a"), F.col("parts")))
    of_hub = F.when(F.col("a_parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("a_parts")))
    task = F.pmod(F.xxhash64("t", own, of_hub), F.lit(tasks)).cast("int")
    dealt = materialize(pairs.join(hot, "t", "left").join(hubs, ["t", "a"], "left").select(task.alias("task"), "a", "b", "a_n", "b_n"), "jaccard-dealt")
    needed = dealt.select(F.col("a").alias("gid"), F.col("task").alias("at")).union(dealt.select("b", "task")).distinct().join(sets_of.select("gid", "slice_id"), "gid")
    asked = needed.groupBy("slice_id").agg(F.collect_list(F.struct("gid", "at")).alias("asked"))
    sets = slices.join(asked.hint("merge"), "slice_id").select("n_words", "codes", "words", "asked").mapInArrow(tidy(_emit_sets(k)), "at int, gid long, shingles binary")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = dict(zip(right["gid"].to_pylist(), right["shingles"], strict=True)) if right.num_rows else {}
        root: dict[int, int] = {}
        opened: dict[int, np.ndarray] = {}
        n_open = 0

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        def tokens(gid: int, n: int) -> np.ndarray:
            nonlocal n_open
            if gid not in opened:
                if n_open > OPEN_SHINGLES:
                    opened.clear()
                    n_open = 0
                opened[gid] = _tokens(blobs[gid].as_py(), n)
                n_open += n
            return opened[gid]

        linked = []
        for a, b, n, m in zip(*(left[c].to_pylist() for c in ("a", "b", "a_n", "b_n")), strict=True) if left.num_rows else ():
            ra, rb = find(a), find(b)
            if ra == rb or a not in blobs or b not in blobs:
                continue
            x, y = tokens(a, n), tokens(b, m)
            x, y = (x, y) if n <= m else (y, x)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if den * both >= num * (n + m - both):
                root[max(ra, rb)] = min(ra, rb)
                linked.append((a, b))
        return pa.table({"a": pa.array([p[0] for p in linked], pa.int64()), "b": pa.array([p[1] for p in linked], pa.int64())})

    links = materialize(dealt.groupBy("task").cogroup(sets.groupBy("at")).applyInArrow(check, "a long, b long"), "jaccard-links")
    discard(dealt, *made)
    return links


def near_components(docs: DataFrame, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Words are lower-cased (A-Z); two documents link if den * intersection is
    at least num * union of their sets of ``k``-word shingles.  component_id
    is the smallest id that links reach.  Documents without words (null or
    empty text) have no shingles and stand alone.  Equal sets, repeated rows
    among them, link; a null id counts in no component but its own.  Other
    columns of ``docs`` aren't read, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    slices = materialize(word_slices(docs, id_col, text_col, lower=True), "jaccard-slices")
    described = materialize(slices.mapInArrow(tidy(_describe(k)), "doc_id long, slice_id long, n long, gid long, bitmap binary"), "jaccard-sets")
    rows = described.where("bitmap is not null")
    often = materialize(described.where("bitmap is null").groupBy("gid").agg(F.sum("n").alias("n")), "jaccard-frequent")
    top = often.where(F.col("n") >= at_least(often, "n", FREQUENT)).toPandas().sort_values("gid")  # bounded by FREQUENT
    shared = spark.sparkContext.broadcast((top["gid"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)))
    entries = slices.mapInArrow(tidy(_post(shared, k, num, den)), "kind byte, t long, salt int, n int, e long, place int")
    lists = entries.repartition("kind", "t", "salt").sortWithinPartitions("kind", "t", "salt", "n", "e")
    found = materialize(lists.mapInArrow(tidy(_pair_up(num, den)), "kind byte, t long, a long, b long, n int"), "jaccard-pairs")

    # expand pairs of groups into pairs of members
    members = found.where(f"kind = {MEMBER} and b is null").select(F.col("t").alias("g"), F.col("a").alias("gid")).distinct()
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("gid").alias("first"))
    members = materialize(members.join(sizes, "g"), "jaccard-members")
    groups = found.where(f"kind = {POSTING} and a <> b").groupBy("a", "b").agg(F.min("t").alias("t"))
    left, right = (members.select(F.col("g").alias(c), F.col("gid").alias(f"{c}_gid"), F.col("m").alias(f"{c}_m"), (F.col("gid") == F.col("first")).alias(f"{c}_first")) for c in "ab")
    few = F.col("a_m") * F.col("b_m") <= EXPANDED
    crossed = groups.join(left.where(f"a_m <= {EXPANDED} or a_first"), "a").join(right.where(f"b_m <= {EXPANDED} or b_first"), "b").where(few | (F.col("a_first") & F.col("b_first")))
    crossed = materialize(crossed.select("t", "a", "b", "a_gid", "b_gid", few.alias("few")), "jaccard-crossed")
    large = crossed.where("not few").select("t", "a", "b")
    inner = found.where(f"kind = {MEMBER} and b is not null and a <> b").select("a", "b", "t")
    pairs = crossed.select(F.least("a_gid", "b_gid").alias("a"), F.greatest("a_gid", "b_gid").alias("b"), "t").unionByName(inner).where("a <> b").groupBy("a", "b").agg(F.min("t").alias("t"))

    sets_of = rows.groupBy("gid").agg(F.min("slice_id").alias("slice_id"), F.first("bitmap").alias("bitmap"), F.first("n").alias("n"))
    sets_of = materialize(sets_of.where("n > 0"), "jaccard-distinct")
    set_of_row = materialize(rows.select("doc_id", F.col("n").alias("n_shingles"), "gid"), "jaccard-rows")
    discard(described)
    over = found.where(f"kind = {OVERFLOW}").select("t", F.col("a").alias("g")).unionByName(large.select("t", F.col("a").alias("g"))).unionByName(large.select("t", F.col("b").alias("g")))
    over = materialize(over.distinct(), "jaccard-overflow")
    kept = materialize(bounded(pairs, sets_of, num, den), "jaccard-kept")
    discard(found, crossed)
    links = verified(kept, slices, sets_of, k, num, den)
    discard(kept)
    roots = materialize(components(links), "jaccard-roots")

    # entries of long lists, where they still lie in different components
    in_groups = over.join(members.select("g", "gid"), "g").select("t", "gid")
    in_members = over.join(members.select("gid", F.lit(True).alias("is_set")).distinct(), F.col("g") == F.col("gid")).select("t", "gid")
    entries = materialize(in_groups.unionByName(in_members).distinct(), "jaccard-long")
    for likeliest in [True] * LIKELIEST_ROUNDS + [False]:
        long_lists = materialize(entries.join(roots.select(F.col("node").alias("gid"), "root"), "gid", "left").withColumn("root", F.coalesce("root", "gid")), "jaccard-rooted")
        open_lists = long_lists.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("t", "m")
        rest = materialize(across(long_lists.join(open_lists, "t"), sets_of, num, den, likeliest), "jaccard-rest")
        none = rest.isEmpty()
        if not none:
            more = verified(rest, slices, sets_of, k, num, den)
            roots = materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "jaccard-roots")
        discard(rest, long_lists)
        if none:  # no pair is left that could be similar enough
            break

    own = set_of_row.join(roots.select(F.col("node").alias("gid"), "root"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    own = materialize(own, "jaccard-own")
    discard(slices, sets_of, set_of_row, members, over, entries)
    least = own.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = own.where("n_shingles > 0").join(least, "root").select("doc_id", "n_shingles", "component_id")
    out = linked.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumnRenamed("doc_id", id_col)


def bounded(pairs: DataFrame, sets_of: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and bitmaps leave: the intersection is at most half of both sizes less the bits that differ."""
    a, b = (sets_of.select(F.col("gid").alias(c), F.col("bitmap").alias(f"{c}_bits"), F.col("n").alias(f"{c}_n")) for c in "ab")

    def run(batches):
        for batch in batches:
            differ = np.array([differing(x, y) for x, y in zip(*(batch.column(c).to_pylist() for c in ("a_bits", "b_bits")), strict=True)], np.int64)
            total = np.asarray(batch.column("a_n")) + np.asarray(batch.column("b_n"))
            most = (total - differ) // 2
            yield batch.select(["a", "b", "t", "a_n", "b_n"]).filter(pa.array(den * most >= num * (total - most)))

    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "t", "a_bits", "b_bits", "a_n", "b_n").mapInArrow(tidy(run), "a long, b long, t long, a_n long, b_n long")


def across(entries: DataFrame, sets_of: DataFrame, num: int, den: int, likeliest: bool = False) -> DataFrame:
    """Pairs (a, b, t) of one list from different components that sizes and bitmaps leave.

    ``entries`` has t, gid, root and m, the length of the list t.  Members
    outside a list's largest component meet all members of other components,
    block by block; members of the largest need not meet each other.  With
    ``likeliest`` each member outside keeps, over all its lists, only the pair
    for which sizes and bitmaps allow the greatest similarity.
    """
    main = entries.groupBy("t", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("t").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    own = entries.join(main, "t").withColumn("minor", F.col("root") != F.col("main")).join(sets_of.select("gid", "n", "bitmap").hint("merge"), "gid")
    # lists are cut into blocks of members, and those that ask into blocks as well; each pair of blocks is a group
    own = own.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).join(own.where("minor").groupBy("t").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ask_blocks")), "t")
    columns = ["t", "block", "ask_block", "asks", "gid", "root", "minor", "n", "bitmap"]
    dealt = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = own.withColumn("block", dealt("blocks")).withColumn("ask_block", each("ask_blocks")).withColumn("asks", F.lit(False)).select(*columns)
    asking = own.where("minor").withColumn("block", each("blocks")).withColumn("ask_block", dealt("ask_blocks")).withColumn("asks", F.lit(True)).select(*columns)

    def compare(table: pa.Table) -> pa.Table:
        gid, root, n, minor, asks = (np.asarray(table[c]) for c in ("gid", "root", "n", "minor", "asks"))
        bitmaps_of = table["bitmap"].to_pylist()
        bits = np.array([_folded(np.frombuffer(x, np.uint64), BITS // 64) for x in bitmaps_of]).reshape(-1, BITS // 64)
        found_x, found_y, bounds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        columns = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks).tolist():
            y = columns[root[columns] != root[x]]
            if not likeliest:
                y = y[~(minor[y] & (gid[y] < gid[x]))]
            y = y[(den * np.minimum(n[y], n[x]) >= num * np.maximum(n[y], n[x]))]
            total = n[y] + n[x]
            most = (total - np.bitwise_count(bits[y] ^ bits[x]).sum(1).astype(np.int64)) // 2
            ok = den * most >= num * (total - most)
            y, total, most = y[ok], total[ok], most[ok]
            if n[x] > BITS:
                most = (total - np.array([differing(bitmaps_of[z], bitmaps_of[x]) for z in y.tolist()], np.int64)) // 2
                ok = den * most >= num * (total - most)
                y, total, most = y[ok], total[ok], most[ok]
            bound = most / total
            if likeliest:
                best = np.flatnonzero(bound == bound.max(initial=0))[:1]
                y, bound = y[best], bound[best]
            found_x.append(np.full(len(y), gid[x]))
            found_y.append(gid[y])
            bounds.append(bound)
        xs = np.concatenate(found_x)
        return pa.table({"x": xs, "y": np.concatenate(found_y), "t": np.full(len(xs), table["t"][0].as_py()), "bound": np.concatenate(bounds)})

    pairs = members.unionByName(asking).groupBy("t", "block", "ask_block").applyInArrow(compare, "x long, y long, t long, bound double")
    if likeliest:
        pairs = pairs.groupBy("x").agg(F.max_by(F.struct("y", "t"), F.struct("bound", "y", "t")).alias("best")).select("x", "best.y", "best.t")
    pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("t").alias("t"))
    sizes = [sets_of.select(F.col("gid").alias(c), F.col("n").alias(f"{c}_n")).hint("merge") for c in "ab"]
    return pairs.join(sizes[0], "a").join(sizes[1], "b").select("a", "b", "t", "a_n", "b_n")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id") -> DataFrame:
    """All columns of one row of each component: that with the smallest id, any of several; null ids come last.

    Rows are told apart by numbers of their own, so that ids may be null or
    repeated.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "jaccard-numbered")
    found = near_components(rows, k, num, den, "__row").select("__row", "component_id").join(rows.select("__row", F.col(id_col).alias("__id")), "__row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("first"))
    return rows.join(first.select("first.__row"), "__row", "left_semi").select(*docs.columns)
