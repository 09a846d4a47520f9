"""Spelling variants, exponion clusters and repeats by suffix order, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

EDGE = [(None, "null id null id null id " * 12), (None, None), (900, ""), (901, None), (902, "x"), (903, "árvíztűrő tükörfúrógép " * 9), (903, "árvíztűrő tükörfúrógép " * 9), (903, "other text of one id " * 9)]


def clashing(spark, rows, **extra):
    """Rows with columns whose names the operators use themselves."""
    names = {"slice_id": "long", "bucket": "long", "word": "string", "n": "long", "key": "string", "body": "string", **extra}
    return spark.createDataFrame([(i, t, *[None] * len(names)) for i, t in rows], ", ".join(["doc_id long", "text string", *[f"{k} {v}" for k, v in names.items()]]))


# suffix order
def test_suffix_ranks():
    from tidemill.llm.suffixes import suffix_ranks

    rng = np.random.default_rng(1)
    for t in range(200):
        n, k = int(rng.integers(0, 150)), int(rng.integers(1, 5))
        s = rng.integers(1, k + 1, n)
        if t % 4 == 0:
            s = np.concatenate((s, [0], s[: n // 2], [0], s))
        rank = suffix_ranks(s, 10**6)
        assert np.argsort(rank).tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist())
        wanted = rng.random(len(s)) < 0.4
        some = suffix_ranks(s, 10**6, wanted)
        places = np.flatnonzero(wanted)
        assert places[np.argsort(some[places])].tolist() == sorted(places.tolist(), key=lambda i, s=s: s[i:].tolist())
        depth = int(rng.integers(1, 20))
        tops = [s[i : i + depth].tolist() for i in np.argsort(suffix_ranks(s, depth))]
        assert all(a <= b for a, b in itertools.pairwise(tops) if len(a) == len(b) == depth)


def removed(rows, window):
    """What brute force keeps of each row; rows of one id in the order of a hash of their text, equal ones as one."""
    order = lambda r: (r[0] is None, r[0] or 0, int.from_bytes(hashlib.blake2b((r[1] or "").encode(), digest_size=8).digest(), "little", signed=True))
    seen, out = {}, {}
    for r in sorted(set(rows), key=order):
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen.setdefault(b[p : p + window], (r, p)) != (r, p):
                gone[p : p + window] = b"\1" * window
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[r] = (len(b), len(b) - len(left), len([1 for g, _ in itertools.groupby(gone) if g]), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("stretch", "cut_from", "shard"), [(1 << 20, 10_000, 1 << 20), (700, 3, 2_000)])
def test_repeats(spark, monkeypatch, stretch, cut_from, shard):
    from tidemill.llm import repeats

    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "CUT_FROM", cut_from)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 6_000)
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(("alpha", "beta", "gamma", "é", "漢字", "0", "zz" * 4)) + str(rng.randrange(300)) for _ in range(n))
    passage, base = words(30), words(200)
    rows = [(k, words(rng.randrange(1, 40)) + (passage if k % 3 == 0 else "") + words(9)) for k in range(40)]
    rows += [(100 + k, base[: rng.randrange(300, len(base))] + words(k)) for k in range(20)]
    rows += [(200, "a" * 3_000), (201, "ab" * 90), (202, "b" + "a" * 150), (203, base), (204, base), (205, base[:99]), (206, base[:100]), (207, words(4_000)), *EDGE]
    rng.shuffle(rows)
    docs = clashing(spark, rows).repartition(4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).drop("kept_bytes").collect())
    want = removed(rows, 100)
    assert got == sorted((r[0] is None, r[0] or 0, *want[r]) for r in rows)
    out = repeats.remove_repeats(docs)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"] and all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in out.collect())
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    assert repeats.remove_repeats(docs.where("doc_id >= 901").where("doc_id < 903")).count() == 2


def test_repeats_of_hot_passages(spark):
    """A passage in every slice and in a third of the rows goes but once; unlike texts stay whole."""
    from tidemill.llm import repeats

    rng = random.Random(2)
    words = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    passage = words(60)
    rows = [(k, words(12) + (" " + passage + " " if k % 3 == 0 else " ") + words(12)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    want = removed(rows, 100)
    assert all((got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want[i, t] for i, t in rows)
    assert got[0].n_removed == 0 and got[3].n_removed >= len(passage) and got[1].n_removed == 0


# spelling variants
def variants(rows, least, count, times, one_in):
    n = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
        near[w] = sorted((edits - {w}) & set(n), key=lambda v: (-n[v], v))
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= times * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize(("key_words", "shard_words", "times", "one_in"), [(20_000, 60_000, 10, 31), (12, 60, 2, 3), (3, 20, 2, 0)])
def test_spelling(spark, monkeypatch, key_words, shard_words, times, one_in):
    from tidemill.llm import spelling

    monkeypatch.setattr(spelling, "KEY_WORDS", key_words)
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(spelling, "QUERIES", 50)
    rng = random.Random(key_words)
    bases = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaab", "qqqqqqqqq"]

    def typo(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + rng.choice("abézZ") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :], w[:k] + w[k + 1 :], w.upper()])

    text = lambda n: " ".join(typo(w) if rng.random() < 0.4 else w for w in rng.choices(bases, [3**-k for k in range(len(bases))], k=n))
    rows = [(k, text(60) + ", 12 x") for k in range(50)] + [(70, "z" * 500 + " " + "z" * 500 + " " + ("z" * 501 + " ") * 2), *EDGE]
    docs = clashing(spark, rows).repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs, times=times, one_in=one_in).collect()}
    want = variants(rows, 7, 2, times, one_in)
    assert got == want and any(v[0] for v in want.values()) and (key_words != 12 or any(v[1] not in (v[0], w) for w, v in want.items()))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0 and spelling.spelling_variants(docs.where("doc_id = 902")).count() == 0


def test_wavelet_report():
    from tidemill.llm.fm import WaveletMatrix

    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 300):
        y = rng.permutation(n)
        tree = WaveletMatrix(y, n)
        boxes = rng.integers(0, n + 1, (60, 4))
        query, found = tree.report(*boxes.T)
        for k, (a, b, c, d) in enumerate(boxes.tolist()):
            assert sorted(found[query == k].tolist()) == sorted(v for v in y[a:b].tolist() if c <= v < d)


# exponion clusters
def lloyd(rows, k, rounds, scale, salt, width):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (d(v, centroids[j]), j))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = [nearest(v) for _, v in kept]
    dist = [d(v, centroids[a]) for (_, v), a in zip(kept, at, strict=True)]
    own = [sum(x for x, b in zip(dist, at, strict=True) if b == a) for a in at]
    return sorted((i is None, i or 0, a, x, s, sum(dist), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for (i, _), a, x, s in zip(kept, at, dist, own, strict=True))


@pytest.mark.parametrize(("k", "span", "grid"), [(8, 1.0, None), (5, 2.0, 0.5), (1, 1.0, None), (40, 3.0, 1.0), (8, 200_000.0, None)])
def test_clusters(spark, monkeypatch, k, span, grid):
    from tidemill.llm import exponion

    monkeypatch.setattr(exponion, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(k)
    x = rng.normal(0, span, (90, 3)) + rng.integers(-2, 3, (90, 1)) * span
    x = np.round(x / grid) * grid if grid else x  # on a grid there are many ties
    rows = [(n, v) for n, v in enumerate(x.tolist())] + [(3, x[5].tolist()), (3, x[5].tolist()), (None, x[1].tolist()), (200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 2.0]), (205, [float("inf"), 0.0, 0.0]), (206, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "c", 1, "s") for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int, state string").repartition(3)
    out = exponion.cluster(vectors, k=k, width=3)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())
    assert got == lloyd(rows, k, 10, 1024, "3", 3)
    assert exponion.cluster(vectors.limit(0), width=3).count() == 0 and exponion.cluster(vectors.where("vec_id = 202"), width=3).count() == 0
    # fewer vectors than centroids
    assert {r.cluster for r in exponion.cluster(vectors.where("vec_id in (1, 2)"), width=3).collect()} == {0, 1}


def test_ball_leaves_centroids_out():
    """Far centroids aren't looked at, and the result is that of looking at all."""
    from tidemill.llm import exponion

    rng = np.random.default_rng(0)
    centers = rng.integers(-10**6, 10**6, (30, 4))
    x = (centers[rng.integers(0, 30, 2_000)] + rng.integers(-9, 10, (2_000, 4))).astype(np.int64)
    first = exponion.Centroids(centers.tolist())
    at, upper, lower, taken = exponion.assign(x, first, None)
    assert taken == 2_000 * 29
    moved = exponion.Centroids((centers + rng.integers(-40, 41, centers.shape)).tolist(), centers.tolist())
    again, _, _, few = exponion.assign(x, moved, (at, upper, lower))
    whole, _, _, _ = exponion.assign(x, moved, None)
    assert (again == whole).all() and few < 2_000 * 3
