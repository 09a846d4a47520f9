"""SentencePiece encoding and decoding over distinct words, many at once.

An Aho-Corasick automaton over the UTF-8 bytes of the pieces reads each word
once.  At every place the output links give the pieces that end there, longest
first, and each relaxes the best way to that place.  For unigram files the
best way has the largest sum of scores.  For BPE files a sum of scores isn't
what the file means: there exactly one of the pieces that end at a place
follows the best way to its start as merging would have it, and the relaxing
step looks for that one.

Texts are cut between two characters that stand together in no piece, which
no piece can cross; so each distinct part is encoded once, and long texts
without spaces fall into short parts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, shipped, slices, small_batches, tidy, trim, utf8_buffer

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct words whose pieces a task remembers.
REMEMBERED = 100_000
#: Words of more bytes are read one by one, shorter ones many at once.
LONG_WORD = 256
#: Text bytes that are encoded together.
ENCODE_BYTES = 1 << 20
#: Bits by which pairs of neighbouring characters are told apart; a collision only leaves words together.
PAIR_BITS = 20
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(raw: bytes):
    """Field number and value of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """What encoding needs of a model file.  The automaton is built where it is first used."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.types = [], [], []
        trainer, normal = {}, {}
        for field, value in _fields(raw):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x.get(1, b""))
                self.scores.append(float(np.frombuffer(x[2], "<f4")[0]) if 2 in x else 0.0)
                self.types.append(x.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix = bool(normal.get(3, 1))
        if self.kind not in (UNIGRAM, BPE) or normal.get(1, b"identity") != b"identity" or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only unigram and BPE files with identity normalisation are read")
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = np.array([next((i for i, p in enumerate(self.pieces) if t == f"<0x{b:02X}>".encode() and self.types[i] == BYTE and p == t), self.unknown) for b in range(256) for t in [f"<0x{b:02X}>".encode()]]) if BYTE in self.types else None
        self._tables = None
        self._known: dict[bytes, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    @property
    def tables(self) -> Tables:
        if self._tables is None:
            self._tables = Tables(self)
        return self._tables


def pair_slots(points: np.ndarray) -> np.ndarray:
    """A slot for each pair of neighbouring code points."""
    with np.errstate(over="ignore"):
        mixed = (points[:-1] * np.uint32(0x9E3779B1) ^ points[1:]) * np.uint32(0x85EBCA6B)
        return mixed >> np.uint32(32 - PAIR_BITS)


def merge(word: list[int], pairs: dict[tuple[int, int], int], scores) -> list[tuple[int, int, int]]:
    """BPE by merging.  Returns the merges as (left, right, merged), then what is left with left -1."""
    n = len(word)
    after, before, piece = [*range(1, n), -1], list(range(-1, n - 1)), list(word)
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (m := pairs.get((piece[i], piece[j]))) is not None:
            heapq.heappush(heap, (-scores[m], i, piece[i], piece[j], m))

    for i in range(n - 1):
        offer(i)
    done = []
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if piece[i] != a or j < 0 or piece[j] != b:
            continue
        done.append((a, b, m))
        piece[i], piece[j], after[i] = m, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return done + [(-1, -1, p) for p in piece if p >= 0]


class Tables:
    """The automaton and, for BPE, how each piece is merged."""

    def __init__(self, model: PieceModel):
        usable = {p: i for i, p in reversed(list(enumerate(model.pieces))) if model.types[i] in (NORMAL, USER) and p}
        self.length = np.array([len(p) for p in model.pieces], np.int64)
        self.score = np.array(model.scores)
        if model.kind == BPE:
            self._merges(usable, model)
            usable = {p: i for p, i in usable.items() if self.reached[i]}
        self._automaton(usable)
        self.cache_key = np.full(1 << 18, -1, np.int64)
        self.cache_ok = np.zeros(1 << 18, bool)
        #: Pairs of characters that stand together in a piece, and whether a space's mark ever follows another character.
        texts = [p.decode("utf-8", "replace") for p in usable]
        self.together = np.zeros(1 << PAIR_BITS, bool)
        self.together[pair_slots(np.frombuffer("\0\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))] = True
        self.mark_inside = any(a != SPACE and b == SPACE for t in texts for a, b in zip(t, t[1:], strict=False))
        self._pairs: dict[int, int] | None = None

    def _merges(self, usable: dict[bytes, int], model: PieceModel) -> None:
        """left and right part of each piece; the pairs that merge; the pieces that merging makes of their own text."""
        size = len(model.pieces)
        self.left, self.right, self.reached = np.arange(size), np.arange(size), np.zeros(size, bool)
        texts = {p: p.decode("utf-8", "replace") for p in usable}
        pairs = {}
        for p, text in texts.items():
            for k in range(1, len(text)):
                a, b = usable.get(text[:k].encode()), usable.get(text[k:].encode())
                if a is not None and b is not None:
                    pairs[a, b] = usable[p]
        for p, i in usable.items():
            chars = [usable.get(c.encode()) for c in texts[p]]
            if None in chars:
                continue
            steps = merge(chars, pairs, model.scores)
            if steps[-1][2] == i and (len(steps) < 2 or steps[-2][0] >= 0):
                self.reached[i] = True
                if len(steps) > 1:
                    self.left[i], self.right[i] = steps[-2][:2]
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_piece = keys[order], np.array(list(pairs.values()), np.int64)[order]
        # place of each piece in the order of merging; single characters come before all
        rank = np.unique(-self.score, return_inverse=True)[1] + 1  # equal scores merge from the left
        self.rank = np.where(self.left == np.arange(size), 0, rank)

    def _automaton(self, usable: dict[bytes, int]) -> None:
        goto: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for p, i in usable.items():
            at = 0
            for b in p:
                step = goto[at].get(b)
                if step is None:
                    step = goto[at][b] = len(goto)
                    goto.append({})
                    ends.append(-1)
                at = step
            ends[at] = i
        used = sorted({b for g in goto for b in g})
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        table = np.zeros((len(goto), width), np.int32)
        #: The piece that ends at a state, or at the next state by output links.
        self.piece, self.link = np.array(ends, np.int64), np.zeros(len(goto), np.int64)
        fail = np.zeros(len(goto), np.int64)
        level = [0]
        while level:
            below = []
            for s in level:
                row = table[fail[s]].copy() if s else table[0]
                f = fail[s]
                self.link[s] = f if self.piece[f] >= 0 else self.link[f]
                for b, t in goto[s].items():
                    c = self.column[b]
                    fail[t] = row[c] if s else 0
                    row[c] = t
                    below.append(t)
                table[s] = row
            level = below
        self.step, self.width = table.ravel(), width

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece b after piece a; -1 is a place where nothing merges."""
        out = (a < 0) | (b < 0)
        ask = np.flatnonzero(~out)
        key = a[ask] << 32 | b[ask]
        slot = (key * 0x9E3779B97F4A7C1 >> 24) & (len(self.cache_key) - 1)
        hit = self.cache_key[slot] == key
        out[ask[hit]] = self.cache_ok[slot[hit]]
        ask, key, slot = ask[~hit], key[~hit], slot[~hit]
        if len(ask):
            key, back = np.unique(key, return_inverse=True)
            ok = self._follows(key >> 32, key & 0xFFFFFFFF)
            out[ask] = ok[back]
            self.cache_key[slot], self.cache_ok[slot] = key[back], ok[back]
        return out

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo merges on both sides of the border, latest first; no pair across it may merge before what it would break."""
        ok, a, b = np.ones(len(a), bool), a.copy(), b.copy()
        limit = np.full(len(a), 1 << 60)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1) if len(self.pair_key) else np.zeros(len(key), np.int64)
            found = self.pair_key[at] == key if len(self.pair_key) else np.zeros(len(key), bool)
            bad = found & (self.rank[self.pair_piece[at]] < limit[live]) if len(self.pair_key) else found
            ok[live[bad]] = False
            # the side merged last is undone; a tie on the left goes first, as merging goes from the left
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            atom = (rx == 0) & (ry == 0)
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~bad & ~atom]
        return ok


    def follows_one(self, a: int, b: int) -> bool:
        """`_follows` of one pair."""
        if a < 0 or b < 0:
            return True
        if self._pairs is None:
            self._pairs = dict(zip(self.pair_key.tolist(), self.pair_piece.tolist(), strict=True))
        limit = 1 << 60
        while True:
            merged = self._pairs.get(a << 32 | b)
            if merged is not None and self.rank[merged] < limit:
                return False
            ra, rb = int(self.rank[a]), int(self.rank[b])
            if ra == 0 and rb == 0:
                return True
            if ra > rb:
                limit, a = ra, int(self.right[a])
            else:
                limit, b = rb + 1, int(self.left[b])


def encode_words(model: PieceModel, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word, where a word is what no piece crosses the border of."""
    return [np.frombuffer(x, np.int32) for x in coded_words(model, words)]


def coded_words(model: PieceModel, words: list[bytes]) -> list[bytes]:
    """The ids of each word as the bytes of 32-bit integers."""
    known = model._known
    fresh = [w for w in words if w not in known]
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
        fresh = words
    for start in range(0, len(fresh), 50_000):
        part = [w for w in fresh[start : start + 50_000] if len(w) <= LONG_WORD]
        known.update(zip(part, _encode(model, part), strict=True))
        known.update((w, _encode_long(model, w)) for w in fresh[start : start + 50_000] if len(w) > LONG_WORD)
    out = [known[w] for w in words]
    if len(known) > REMEMBERED:
        known.clear()
    return out


def _encode_long(model: PieceModel, word: bytes) -> bytes:
    """One long word, byte by byte."""
    t = model.tables
    size = len(word)
    last, since, best = [-2] * (size + 1), [0] * (size + 1), [-np.inf] * (size + 1)
    last[0], best[0] = -1, 0.0
    state = char_start = 0
    floor = float(t.score.min()) - 10.0
    fits: dict[tuple[int, int], bool] = {}
    for k, byte in enumerate(word):
        if byte & 0xC0 != 0x80:
            char_start = k
        state = int(t.step[state * t.width + t.column[byte]])
        node = state if t.piece[state] >= 0 else int(t.link[state])
        while node:
            piece = int(t.piece[node])
            length = int(t.length[piece])
            came = last[k + 1 - length]
            if came != -2 and model.kind == BPE:
                if (came, piece) not in fits:
                    fits[came, piece] = t.follows_one(came, piece)
                if fits[came, piece]:
                    last[k + 1], since[k + 1] = piece, length
                    break
            elif came != -2 and (reach := best[k + 1 - length] + float(t.score[piece])) > best[k + 1]:
                last[k + 1], since[k + 1], best[k + 1] = piece, length, reach
            node = int(t.link[node])
        if last[k + 1] == -2 and (k + 1 == size or word[k + 1] & 0xC0 != 0x80):
            length = k + 1 - char_start
            last[k + 1], since[k + 1], best[k + 1] = -1, length, best[char_start] + floor
    out, at = [], size
    while at > 0:
        if last[at] >= 0:
            out.append(last[at])
        else:
            text = np.frombuffer(word[at - since[at] : at], np.uint8)
            out += model.byte_ids[text].tolist()[::-1] if model.byte_ids is not None else [model.unknown]
        at -= since[at]
    return np.array(out[::-1], np.int32).tobytes()


def _encode(model: PieceModel, words: list[bytes]) -> list[bytes]:
    t = model.tables
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    raw = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    # of each place in each word, from 0 to its length: the piece that the best way ends with, and its start
    place = start + np.arange(len(words))
    total = len(raw) + len(words)
    last, since, best = np.full(total, -2, np.int64), np.zeros(total, np.int32), np.full(total, -np.inf)
    last[place], best[place] = -1, 0.0
    char_start = np.zeros(len(words), np.int64)
    state = np.zeros(len(words), np.int64)
    floor = t.score.min() - 10.0
    columns, high = t.column[raw], (raw & 0xC0) != 0x80
    live = len(words)
    for k in range(int(size[0]) if len(size) else 0):
        while size[live - 1] <= k:
            live -= 1
        at = start[:live] + k
        begins = high[at]
        char_start[:live] = np.where(begins, k, char_start[:live])
        state[:live] = t.step[state[:live] * t.width + columns[at]]
        node = state[:live]
        node = np.where(t.piece[node] >= 0, node, t.link[node])
        rows = np.flatnonzero(node)
        node = node[rows]
        here = place[:live] + k + 1
        while len(rows):
            piece = t.piece[node]
            length = t.length[piece]
            came = here[rows] - length
            if model.kind == BPE:
                good = last[came] != -2
                good[good] = t.follows(last[came[good]], piece[good])
                to = here[rows[good]]
                last[to], since[to] = piece[good], length[good]
                rows, node = rows[~good], node[~good]
            else:
                reach = best[came] + t.score[piece]
                good = (reach > best[here[rows]]) & (last[came] != -2)
                to = here[rows[good]]
                last[to], since[to], best[to] = piece[good], length[good], reach[good]
            node = t.link[node]
            rows, node = rows[node > 0], node[node > 0]
        # a character that no piece ends with stands for itself
        ends = np.append(high, True)[np.minimum(at + 1, len(high))] | (k + 1 == size[:live])
        rows = np.flatnonzero(ends & (last[here] == -2))
        length = k + 1 - char_start[rows]
        last[here[rows]], since[here[rows]] = -1, length
        best[here[rows]] = best[here[rows] - length] + floor
    return _traced(model, words, order, size, start, place, raw, last, since)


def _traced(model, words, order, size, start, place, raw, last, since) -> list[bytes]:
    rows, at = np.arange(len(words)), size.copy()
    found_row, found_at, found_id = [], [], []
    live = at > 0
    rows, at = rows[live], at[live]
    while len(rows):
        slot = place[rows] + at
        piece, length = last[slot], since[slot].astype(np.int64)
        plain = piece >= 0
        found_row.append(rows[plain])
        found_at.append(at[plain])
        found_id.append(piece[plain])
        for r, a, n in zip(rows[~plain].tolist(), at[~plain].tolist(), length[~plain].tolist(), strict=True):
            text = raw[start[r] + a - n : start[r] + a]
            ids = model.byte_ids[text] if model.byte_ids is not None else np.array([model.unknown])
            found_row.append(np.full(len(ids), r))
            found_at.append(np.arange(a - len(ids) + 1, a + 1))
            found_id.append(ids)
        at = at - length
        rows, at = rows[at > 0], at[at > 0]
    out = [b""] * len(words)
    if found_row:
        row, pos, ids = np.concatenate(found_row), np.concatenate(found_at), np.concatenate(found_id)
        by = np.lexsort((pos, row))
        flat = ids[by].astype(np.int32).tobytes()
        cut = 4 * np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(words)))))
        for r, a, b in zip(order.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[r] = flat[a:b]
    return out


def escaped(model: PieceModel, texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), " ", SPACE)
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()) if model.prefix else pa.scalar("", pa.large_string()), texts, pa.scalar("", pa.large_string())))


def encode(model: PieceModel, texts: pa.Array) -> pa.ListArray:
    """The ids of each text; null and empty texts have none."""
    raw, at = utf8_buffer(escaped(model, texts))
    if not len(raw):
        return pa.array([[]] * len(texts), pa.list_(pa.int32()))
    t = model.tables
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.ones(len(points), bool)
    first[1:] = ~t.together[pair_slots(points)]
    if not t.mark_inside:
        first[1:] |= (points[1:] == ord(SPACE)) & (points[:-1] != ord(SPACE))
    first[np.searchsorted(begins, at[:-1][at[:-1] < len(raw)])] = True
    starts = begins[first]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    found = words.dictionary_encode()
    each = coded_words(model, found.dictionary.to_pylist())
    codes = np.asarray(found.indices, dtype=np.int64)
    count = np.array([len(x) // 4 for x in each], np.int64)
    pool, begin = np.frombuffer(b"".join(each), np.int32), np.concatenate(([0], np.cumsum(count)))
    n = count[codes]
    ends = np.cumsum(n)
    ids = pool[np.repeat(begin[codes] - (ends - n), n) + np.arange(ends[-1])]
    text_at = np.concatenate(([0], ends))[np.searchsorted(starts, at)]
    return pa.ListArray.from_arrays(pa.array(text_at.astype(np.int32)), pa.array(ids, pa.int32()))


def decode(model: PieceModel, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids, as binary: bytes of byte pieces need not be UTF-8."""
    pool = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (UNKNOWN, CONTROL) else p.replace(SPACE.encode(), b" ") for p, t in zip(model.pieces, model.types, strict=True)]
    size = np.array([len(p) for p in pool], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b"".join(pool), np.uint8)
    flat = np.asarray(ids.flatten(), dtype=np.int64)
    offsets = np.asarray(ids.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    n = size[flat]
    ends = np.concatenate(([0], np.cumsum(n)))
    raw = data[np.repeat(begin[flat] - ends[:-1], n) + np.arange(ends[-1])]
    at = ends[offsets]
    if model.prefix and len(raw):  # the space that stands before a text
        drop = at[:-1][at[:-1] < at[1:]]
        drop = drop[raw[drop] == 0x20]
        kept = np.ones(len(raw), bool)
        kept[drop] = False
        raw, at = raw[kept], at - np.searchsorted(drop, at)
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def load_model(path: str = MODEL_PATH) -> PieceModel:
    """The model of a file, with its automaton."""
    with open(path, "rb") as f:
        model = PieceModel(f.read())
    assert model.tables
    trim()
    return model


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode it again: id, ids, n_ids, round_trip.

    One row for each row of ``docs``, repeated rows too; null and empty texts
    have no ids and round_trip is true.  round_trip says that decoding gives
    the text back, which fails only where the text holds the mark that stands
    for a space.  Other columns of ``docs`` are not read.  The driver reads
    the model file and builds the automaton; both go to the executors by
    broadcast, and their size doesn't depend on the data.  Nothing is
    shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = shipped(spark, load_model(model_path))

    def run(batches):
        model = opened(shared)
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids = encode(model, batch.column("text"))
            same = pc.equal(decode(model, ids), pc.fill_null(batch.column("text"), "").cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pc.list_value_length(ids).cast(pa.int64()), same], ["id", "ids", "n_ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, ids array<int>, n_ids long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each list of ids, one row for each row.

    Bytes that are no UTF-8 become replacement characters; a null list gives
    a null text, an empty one an empty text.  An id that the model doesn't
    have, or a null in a list, raises.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    shared = shipped(spark, load_model(model_path))

    def run(batches):
        model = opened(shared)
        for batch in batches:
            lists = batch.column("ids")
            texts = decode(model, pc.fill_null(lists, pa.scalar([], lists.type)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if null else x.decode("utf-8", "replace") for x, null in zip(texts.to_pylist(), lists.is_null().to_pylist(), strict=True)], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(run), f"id {kind}, text string").withColumnRenamed("id", id_col)
