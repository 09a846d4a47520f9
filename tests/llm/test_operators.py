"""Operators against brute force on small tables with nulls, empties, ties and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def near_copies():
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(k, " ".join(f"w{rng.randrange(60)}" if rng.random() < p else w for w in base)) for k, p in enumerate([0.02] * 60 + [0.06] * 30)]
    rows += [(100 + k, " ".join(f"u{rng.randrange(3000)}" for _ in range(rng.randrange(1, 60)))) for k in range(30)]
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "a b"), (205, rows[3][1]), (206, "  \n "), (207, "x " * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in near_copies()], "doc_id long, text string, lang string, gid string").repartition(3).cache()


def components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * (n := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (3, 60, 100)])
def test_jaccard(docs, k, num, den, monkeypatch):
    from tidemill.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "VERIFY_SHINGLES", 2_000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(docs, k, num, den).collect()}
    assert got == components(near_copies(), k, num, den)


def test_substrings(docs):
    from tidemill.llm.substrings import dedup_substrings

    rows = near_copies()
    least = {}
    for i, t in sorted(rows):
        w = words(t)
        for p in range(len(w) - 12):
            least.setdefault(tuple(w[p : p + 13]), i)
    got = {r.doc_id: r for r in dedup_substrings(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - 12) if least[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_exact_dedup(docs):
    from tidemill.llm.dedup import exact_dedup

    rows = near_copies()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        assert got[i] == (max(same), len(same), i == max(same))


def test_empty_tables(spark):
    from tidemill.llm import dedup, jaccard, langid, lm, mixing, pieces, pivots, secrets, substrings

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    for out in (dedup.exact_dedup(none), jaccard.near_components(none), langid.identify(none), lm.lm_scores(none), mixing.mix_order(none), pieces.encode_documents(none), secrets.scan_secrets(none), substrings.dedup_substrings(none)):
        assert out.count() == 0
    assert pivots.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pieces_equal_the_library():
    import sentencepiece

    from tidemill.llm import pieces

    model = pieces.load_model()
    texts = ["", None, " ", "  a b\n c 語\U0001f600", "e" * 3000 + " " * 40 + "ee", "the  the   the", "naïve Straße", *[t for _, t in near_copies()[:20]]]
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH).encode([t or "" for t in texts])
    ids = pieces.encode(model, pa.array(texts, pa.string()))
    assert ids.to_pylist() == want
    assert [t.decode() for t in pieces.decode(model, ids).to_pylist()] == [t or "" for t in texts]


def test_unigram_viterbi():
    from tidemill.llm import pieces

    model = pieces.PieceModel.__new__(pieces.PieceModel)
    rng = random.Random(1)
    model.pieces = [b"<unk>", *sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))).encode() for _ in range(40)} | {b"a", b"b", b"c"})]
    model.scores = [0.0, *[-rng.random() * 5 for _ in model.pieces[1:]]]
    model.types = [pieces.UNKNOWN, *[pieces.NORMAL] * (len(model.pieces) - 1)]
    model.kind, model.prefix, model.unknown, model.byte_ids, model._tables, model._known = pieces.UNIGRAM, True, 0, None, None, {}
    score = dict(zip(model.pieces, model.scores, strict=True))
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14))) for _ in range(100)]
    for text, ids in zip(texts, pieces.encode_words(model, texts), strict=True):
        best = [0.0] + [-1e9] * len(text)
        for e in range(1, len(text) + 1):
            best[e] = max(best[s] + score[text[s:e]] for s in range(e) if text[s:e] in score)
        assert b"".join(model.pieces[i] for i in ids) == text
        assert sum(model.scores[i] for i in ids) == pytest.approx(best[-1])


def test_language_id(spark):
    from tidemill.llm import langid

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, None, None), (-2, "123 456", "en"), (-3, "", None)], "doc_id long, text string, lang string")
    out = langid.identify(rows.unionByName(more)).join(rows, "doc_id", "left").collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id < 0} == {-1: ("und", 0.0), -2: ("und", 0.0), -3: ("und", 0.0)}
    held = [r for r in out if r.held_out and r.doc_id >= 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_neighbours(spark):
    from tidemill.llm import pivots

    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[50] = x[60]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None])]
    got = {}
    for r in pivots.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(600), d))[:10]) & set(got[q]))
    assert set(got) == set(range(0, 600, 100)) and hits >= 54


def test_lm(spark):
    from tidemill.llm import lm

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["the cat sat", "The cat ran", None, "", "dog dog dog"] * 12)], "doc_id long, text string")
    out = lm.lm_scores(rows).collect()
    train = [r for r in out if not r.held_out]
    counts = {}
    texts = {r.doc_id: (r.text or "").lower() for r in rows.collect()}
    for r in train:
        for w in [*words(texts[r.doc_id]), "\n"]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in out:
        tokens = [*words(texts[r.doc_id]), "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r.score < 0


def test_substrings_split_hot_anchors(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemill.llm import common, substrings

    rng = random.Random(8)
    shared = [f"passage{k}" for k in range(30)]
    texts = []
    for k in range(400):
        own = [f"w{rng.randrange(90_000)}" for _ in range(60)]
        texts.append(own[:30] + (shared if k % 2 else []) + own[30:] if k % 7 else texts[k - 1][:45] if k else own)
    monkeypatch.setattr(substrings, "SHARD_SEGMENTS", 100)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(16)
    got = {r.doc_id: (r.n_removed, r.kept_text.decode()) for r in substrings.dedup_substrings(docs).collect()}
    first = {}
    for k, t in enumerate(texts):
        for j in range(len(t) - 12):
            first.setdefault(tuple(t[j : j + 13]), k)
    for k, t in enumerate(texts):
        gone = {x for j in range(len(t) - 12) if first[tuple(t[j : j + 13])] < k for x in range(j, j + 13)}
        assert got[k] == (len(gone), " ".join(w for x, w in enumerate(t) if x not in gone))
    slices = common.materialize(common.word_slices(docs, "doc_id", "text", lower=False), "test-slices")
    segments, cut = substrings.routed(slices, 13)
    assert cut.count() > 0
    assert segments.groupBy("shard").agg(F.countDistinct("content").alias("n")).agg(F.max("n")).first()[0] <= 100


def test_nearest_among_copies(spark):
    from pyspark.sql import functions as F

    from tidemill.llm import pivots

    rng = np.random.default_rng(5)
    made = rng.normal(size=(9000, 8))
    made[rng.permutation(9000)[:3000]] = made[0]
    made[1::1500] = -made[0]  # far from all pivots that others have first
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)] + [(100, made[100].tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in pivots.nearest(rows, F.col("id") % 150 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    every, ids = np.vstack([made, made[100:101]]), np.append(np.arange(9000), 100)
    met = []
    for q in range(0, 9000, 150):
        d = np.where(ids == q, np.inf, np.sqrt(((every - made[q]) ** 2).sum(1)))
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        met.append(len(set(want) & set(got[q].values())) / len(set(want)))
        if (made[q] == made[0]).all():
            assert [got[q][k] for k in range(1, 11)] == want
    assert np.mean(met) > 0.97
    # fewer than k rows met: the others of the block count as well
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))], "vec_id long, embedding array<double>")
    assert pivots.nearest(few, F.col("id") >= 0, pivots=40, per_vector=1).count() == 600


def test_mix_keeps_pace(spark):
    from tidemill.llm.mixing import mix_order

    rows = spark.createDataFrame([(k, "ab"[k % 3 == 0]) for k in range(3000)], "doc_id long, source string")
    out = mix_order(rows, {"a": 3.0, "b": 1.0}, block_rows=1, slots=40).collect()
    assert len(out) == 3000
    share = {r.source: r.weight_slots / 40 for r in out}
    taken = {"a": 0, "b": 0}
    for r in sorted(out, key=lambda r: (r.slot, r.slot_row)):
        if r.slot >= 1200:
            break
        taken[r.source] += 1
        assert abs(taken[r.source] - share[r.source] * (r.slot + 1)) < 1


def test_mix_keeps_to_the_target(spark):
    from fractions import Fraction

    from tidemill.llm.mixing import mix_order, schedule, target_weights

    cases = [
        ([1.0, 1.0, 1.0], [20_000] * 3), ([0.5, 0.3, 0.15, 0.05], [25_000, 15_000, 7_500, 2_500]), ([0.9995, 0.0005], [30_000, 15]), ([1.0 + k % 7 for k in range(1500)], [8] * 1500),
    ]
    for wished, blocks in cases:
        weights = target_weights([(k, n) for k, n in enumerate(blocks)], dict(enumerate(wished)))
        total = sum(Fraction(w) for w in wished)
        assert [Fraction(a, sum(weights)) for a in weights] == [Fraction(w) / total for w in wished]
        taken = [0] * len(blocks)
        for s, block, slot in schedule(weights, blocks):
            assert block == taken[s] and block * sum(weights) < (slot + 1) * weights[s]  # less than one block ahead at the end of the slot
            assert slot * weights[s] < (block + 1) * sum(weights)  # and less than one behind where it begins
            taken[s] += 1
        assert taken == blocks

    # many periods of 40 slots, and a source without weight after all others
    rows = spark.createDataFrame([(k, "abcz"[k % 4] if k % 4 < 3 or k < 400 else None) for k in range(12_000)], "doc_id long, source string")
    out = mix_order(rows, {"a": 1, "b": 1, "c": 1, "z": 0}, block_rows=1, slots=40).collect()
    assert len(out) == 12_000 and len({(r.slot, r.slot_row) for r in out}) == 12_000
    taken = dict.fromkeys("abc", 0)
    named = sorted((r for r in out if r.source in taken), key=lambda r: r.slot)
    for t, r in enumerate(named):
        taken[r.source] += 1
        assert r.slot == t and all(abs(n - (t + 1) / 3) < 1 for n in taken.values())
    assert min(r.slot for r in out if r.source not in taken) == len(named)

    # more sources than slots; a block is in one slot, whatever runs its rows were numbered in
    rows = spark.range(12_000).selectExpr("id as doc_id", "cast(if(id < 9000, -1, id % 1100) as string) as source")
    out = mix_order(rows).collect()
    blocks = {}
    for r in out:
        blocks.setdefault((r.source, r.source_block), set()).add(r.slot)
    assert len(out) == 12_000 and all(len(x) == 1 for x in blocks.values()) and len(set.union(*blocks.values())) == len(blocks)


def test_warc_and_secrets(spark):
    from tidemill.llm import secrets, warc

    pages = spark.createDataFrame([(1, "u", "x" * 100_000), (2, "u", "x" * 100_000), (3, None, None), (4, "v", "WARC/1.1\r\n" * 9000), (5, "v", "tiny"), (6, "v", "tiny")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.ok) for r in warc.warc_round_trip(pages).collect()}
    assert got == {1: (100_000, "response", None, True), 2: (100_000, "revisit", 1, True), 3: (0, "response", None, True), 4: (90_000, "response", None, True), 5: (4, "response", None, True), 6: (4, "response", None, True)}
    docs = spark.createDataFrame([(1, 'password = "abcdefghijkl"'), (2, None), (3, "key = 'Zx9!kQ27mNp4rT'\napi_key := key")], "doc_id long, text string")
    out = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert out[1].n_assign == 1 and out[2].spans == "" and out[3].n_assign == 0
