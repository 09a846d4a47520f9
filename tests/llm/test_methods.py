"""The methods by themselves, and operators on awkward tables."""

import hashlib
import random
import re
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SPACE = re.compile("[\x20\x09-\x0d]+")


# pieces


@pytest.fixture(scope="module")
def piece_model():
    from tidemill.llm import pieces

    return pieces.load_model()


def test_long_texts_without_spaces(piece_model):
    import sentencepiece

    from tidemill.llm import pieces

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(30_000)), "".join(rng.choice("etaoinshr") for _ in range(60_000)), "的是不了人我" * 5000, "ab" * 400 + "é" * 300, "▁" * 900]
    started = time.time()
    ids = pieces.encode(piece_model, pa.array(texts))
    assert time.time() - started < 20
    assert ids.to_pylist() == library.encode(texts)


def test_long_words_equal_short_ones(piece_model, monkeypatch):
    from tidemill.llm import pieces

    words = [w.encode() for w in ("▁international", "naïve", "▁語語", "x" * 40, "\U0001f600a")]
    want = [x.tolist() for x in pieces.encode_words(piece_model, words)]
    piece_model._known.clear()
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    assert [x.tolist() for x in pieces.encode_words(piece_model, words)] == want
    piece_model._known.clear()


def test_decode_documents(spark):
    from tidemill.llm import pieces

    texts = ["a  b", "", None, "naïve 語", "x"]
    docs = spark.createDataFrame([(k if k else None, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, id string")
    encoded = pieces.encode_documents(docs)
    back = {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()}
    assert back == {k if k else None: t or "" for k, t in enumerate(texts)}
    missing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode_documents(missing).collect()} == {1: None, 2: ""}


# exact dedup


def test_fuse_filters():
    from tidemill.llm import fuse

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 1000, 50_000):
        keys = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        blob = fuse.build(np.concatenate((keys, keys[:5])))
        assert fuse.contains(blob, keys).all()
        others = rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)
        assert fuse.contains(blob, others).mean() < 0.01
        assert n < 1000 or len(blob) < 1.6 * n + 4096


def test_dedup_tells_texts_of_one_digest_apart(spark, monkeypatch):
    from tidemill.llm import dedup

    monkeypatch.setattr(dedup.F, "sha2", lambda c, n: F.lit("ab" * 32))
    rows = [(1, "x"), (2, "x"), (3, "y"), (None, "y"), (4, None), (5, "")]
    out = dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in out) == [(0, 3, 2, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 5, 2, False), (5, 5, 2, True)]


# secrets


def named(text):
    from tidemill.llm.secrets import named_spans

    return [text[a:b] for a, _, b in named_spans(text)]


S = "Zx9!kQ27mNp4rT"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('"password":\n   "hunter2Xhunter9Q"', ["hunter2Xhunter9Q"]), ('password = """hunter2Xhunter9Q"""', ["hunter2Xhunter9Q"]), ('pwd = "hunter2" + "Xhunter9Q7777"', ['hunter2" + "Xhunter9Q7777']),
        ("<password>hunter2Xhunter9Q</password>", ["hunter2Xhunter9Q"]), ('{"name": "API_KEY", "value": "Zx9kQ27mNp4rT"}', ["Zx9kQ27mNp4rT"]), ("- name: DB_PASSWORD\n  value: Zx9kQ27mNp4rT\n", ["Zx9kQ27mNp4rT"]),
        ('<add key="ApiKey" value="Zx9kQ27mNp4rT"/>', ["Zx9kQ27mNp4rT"]), ('<property name="db.password">Zx9kQ27mNp4rT</property>', ["Zx9kQ27mNp4rT"]), ('hunter2Xhunter9Q = 3\npassword = "hunter2Xhunter9Q"', ["hunter2Xhunter9Q"]),
        (f"key = '{S}'\napi_key := key", [S]), (f"a = '{S}'\nb = a\nsecret = b", [S]), (f"api_key = key\nkey = '{S}'", []), (f"k = '{S}'\nk = 'plain'\ntoken = k\n", []),
        (f"def f():\n    k = '{S}'\ndef g():\n    token = k\n", []), (f"function f() {{ let k = '{S}'; }}\nsecret = k;", []), (f"const token: string = '{S}';", [S]), (f"os.environ['SECRET_TOKEN'] = '{S}'", [S]),
        (f"user, password = 'bobby', '{S}'", [S]), (f"a = b = '{S}'\nsecret = a", [S]), (f"connect(host='h', password='{S}')", [S]), ("password = os.getenv('DB_PASSWORD')", []), ("mysql --password Zx9kQ27mNp4rT db", ["Zx9kQ27mNp4rT"]),
        ('passwords = ["Zx9kQ27mNp4rT", "Yx9kQ27mNp4rT"]', ["Zx9kQ27mNp4rT", "Yx9kQ27mNp4rT"]), ('"credentials": {"user": "bobbybobby1", "value": "Zx9kQ27mNp4rT"}', ["Zx9kQ27mNp4rT"]), ("[db]\npasswd = Zx9kQ27mNp4rT\nhost = example.org", ["Zx9kQ27mNp4rT"]),
        ("token = (\n  'Zx9kQ27'\n  'mNp4rT55'\n)", ["Zx9kQ27'\n  'mNp4rT55"]), ("# password = 'Zx9kQ27mNp4rT'", ["Zx9kQ27mNp4rT"]), ("The key, as the author said: it isn't a password. Don't worry", []), ("password = 'changeme123'", []), ("", []),
        # brackets in comments and prose, calls that never end, and ones that span lines
        (f"# works :(\nk = '{S}'\ntoken = k", [S]), (f"// see {{ and [\nk = '{S}'\ntoken = k", [S]), (f"note (see below\nk = '{S}'\ntoken = k\n", [S]), (f"connect(\n    host='h',\n    password='{S}',\n)\nx = 1", [S]), (f"x = f(k='{S}')\ntoken = k", []),
        # block scalars, additions, fallbacks, escaped quotes
        ("password: |\n  Zx9kQ27mNp4rT\nx: 1", ["Zx9kQ27mNp4rT"]), ("a:\n  secret: >-\n    Zx9kQ27mNp4rT\n  b: 2", ["Zx9kQ27mNp4rT"]), ("secret: |\nb: Zx9kQ27mNp4rT", []), (f"token += '{S}'", [S]), (f"k = '{S}'\nk += 'abcdefgh12'\ntoken = k", [S, "abcdefgh12"]),
        (f"const password = process.env.PW || '{S}'", [S]), (f'token = settings.token ?? "{S}"', [S]), (f"pwd = \\\"it's\\\" + x\nsecret = '{S}'", [S]),
    ],
)
def test_lexer(text, want):
    from tidemill.llm.secrets import SCREEN

    assert named(text) == want
    # the screen before the lexer lets it through
    assert not want or pa.compute.match_substring_regex(pa.array([text]), SCREEN)[0].as_py()


def test_lexer_is_linear():
    chain = f'x0 = "{S}"\n' + "".join(f"x{k} = x{k - 1}\n" for k in range(1, 4000)) + "password = x3999\n"
    started = time.time()
    assert named(chain) == [S]
    for text in ('a="b";' * 100_000, '"' * 200_000, "<b " * 50_000, "a = " * 20_000, 'x = x + "abcdefgh1"\n' * 20_000, "{" * 100_000, "/*" * 100_000, "token:\n" * 30_000, "'''" * 50_001, "def f\n" * 30_000, "def f\n" + " {a = 1\n" * 60_000, '{\\"user\\":\\"bob\\",\\"password\\":\\"x1\\",' * 25_000, "it's \"" * 100_000, "//" * 200_000, "# (" * 100_000, "password: |\n" * 30_000, "a || " * 60_000, "token += (" * 30_000):
        named(text)
    assert time.time() - started < 30


def test_secrets_against_brute_force(spark):
    """The base patterns, written a second time as scanners over characters."""
    from tidemill.llm.secrets import scan_secrets

    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(text, at, allowed):
        stop = at
        while stop < len(text) and text[stop] in allowed:
            stop += 1
        return stop

    def assign(text, at):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not (text[at : at + len(name)].isascii() and text[at : at + len(name)].lower() == name):
                continue
            p = at + len(name)
            p += text[p : p + 1] in ('"', "'")
            p = run(text, p, " ")
            if text[p : p + 1] not in (":", "="):
                continue
            p = run(text, p + 1, " ")
            p += text[p : p + 1] in ('"', "'")
            if (stop := run(text, p, word)) > p:
                return stop, stop - p >= 12
        return None

    def access(text, at):
        stop = run(text, at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        return (stop, stop - at >= 18) if text.startswith("AKIA", at) and stop > at + 4 else None

    def hexes(text, at):
        stop = run(text, at, set("0123456789abcdef"))
        return (stop, stop - at >= 16) if stop > at else None

    def spans(text):
        out = []
        for kind, name, find in ((0, "assign", assign), (1, "access", access), (2, "hex", hexes)):
            at = 0
            while at < len(text):
                hit = find(text, at)
                if hit and hit[1]:
                    out.append((at, kind, f"{name}:{at}:{hit[0]}"))
                at = hit[0] if hit else at + 1
        return [x[2] for x in sorted(out)]

    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "\n", "AKIA", "ABCDEFGHIJKLMNOP", "Zx9kQ27mNp4rT", "deadbeef01234567", "é", "x", "fedcba98", "{", "}", "漢"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame([(k if k % 50 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_assign int").repartition(3)
    out = scan_secrets(docs.withColumn("doc_id", F.col("n_assign").cast("long")))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts) and scan_secrets(docs).count() == len(texts)
    for k, t in enumerate(texts):
        want = spans(t or "")
        counts = tuple(sum(x.startswith(name) for x in want) for name in ("assign", "access", "hex"))
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == counts, t
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        told = [x for x in got[k].spans.split(",") if x]
        assert [x for x in told if not x.startswith("named")] == want
        assert len(told) - len(want) == got[k].n_named


# language ID


def test_spans_and_scripts(spark):
    from tidemill.llm import langid

    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(n))
    alphabets = {"aa": "abcdefg", "bb": "mnopqrs", "ru": "абвгдежз", "el": "αβγδεζηθ"}
    train = [(k, make(letters, 30), name, "x") for n, (name, letters) in enumerate(alphabets.items()) for k in range(n * 40, n * 40 + 40)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string, id string")
    mixed = spark.createDataFrame([(1, make("abcdefg", 20) + " " + make("mnopqrs", 30)), (2, "αβγ ζηθ " + make("абвгдежз", 9)), (3, "12 ? abba"), (4, "語語 語語")], "doc_id long, text string")
    model = langid.train(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score, r.spans) for r in langid.predict(mixed, model).collect()}
    assert got[1][0] == "bb" and got[1][2] == "aa:0:20,bb:20:50"
    assert got[2][0] == "ru" and got[2][2].endswith("ru:2:11")
    assert got[3][0] == "aa" and got[4][0] in alphabets
    # words are cut where the script changes, and texts without spaces every few letters
    east = {"zh": "我们今天去公园看花 天气很好 我们坐在树下吃饭 他说明天还要来", "ja": "私たちは今日公園に行って花を見ました 天気がとても良かったです", "th": "วันนี้เราไปสวนสาธารณะเพื่อดูดอกไม้", "en": "the cat sat on the mat and we went to see flowers", "ru": "мы сегодня пошли в парк смотреть на цветы"}
    model = langid.train(spark.createDataFrame([(k, t, name) for k, (name, t) in enumerate(east.items())] * 5, "doc_id long, text string, lang string"), F.lit(True))
    texts = ["A我们今天去公园看花我们坐在树下吃饭", "thecatsat我们今天去公园看花", "私たちは今日公園に行って", "วันนี้เราไปสวนสาธารณะ", "the cat sat мы сегодня пошли в парк", "我们，the公园"]
    found = {r.text: r for r in langid.predict(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string"), model).withColumnRenamed("doc_id", "text").collect()}
    assert [found[t].lang_pred for t in texts] == ["zh", "en", "ja", "th", "ru", "zh"]
    languages = lambda t: [s.split(":")[0] for s in found[t].spans.split(",")]
    assert languages(texts[1]) == ["en", "zh"] and languages(texts[4]) == ["en", "ru"] and languages(texts[2]) == ["ja"]
    kept = langid.accepted(docs.unionByName(spark.createDataFrame([(900, None, "aa", "x"), (901, "1 2", "aa", "x"), (902, "", None, None)], docs.schema)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(160))


# language model


def test_gru_gradients_and_normalisation():
    from tidemill.llm import gru

    own = gru.layout(100)
    assert own.words == 1024 and own.bounds[0] == 0 and own.bounds[-1] == 1024 and all(a < b for a, b in zip(own.bounds, own.bounds[1:], strict=False))
    assert gru.layout(10**9).words > 30_000
    rng = np.random.default_rng(1)
    p = gru.initial(rng.integers(1, 50, own.words).astype(float), own)
    for k in p:
        p[k] = p[k] + rng.standard_normal(p[k].shape).astype(np.float32) * 0.3
    # probabilities of all words after a text sum to 1
    h = rng.standard_normal((1, gru.HIDDEN)).astype(np.float32)
    logp, _ = gru.output(p, own, np.repeat(h, own.words, 0), np.arange(own.words), None)
    assert np.exp(logp.astype(np.float64)).sum() == pytest.approx(1.0, abs=1e-3)

    words, start = rng.integers(2, 60, 40), np.array([0, 11, 12, 12, 40])
    held = {}

    class Spy(gru.Trainer):
        def step(self, grads, rows, row_grads):
            x = np.zeros_like(self.p["x"])
            x[rows] = row_grads
            held.update(grads | {"x": x})

    spy = Spy(p, own, 0.01)
    given, target, text, begins = gru.lanes(words, gru.whole(start, np.arange(4)), 4)
    n = int((text >= 0).sum())
    assert n == 44
    spy.window(given.astype(np.int64), target.astype(np.int64), text >= 0, (~begins).astype(np.float32)[:, :, None], np.zeros((given.shape[1], gru.HIDDEN), np.float32))
    for name in ("x", "u", "cw", "cb", "mw", "mb"):
        at = np.unravel_index(np.argmax(np.abs(held[name])), held[name].shape)
        ends = []
        for step in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            ends.append(-gru.score(q, own, words, start).sum() / n)
        assert held[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.05, abs=1e-4)


def test_long_texts_are_trained_whole():
    from tidemill.llm import gru

    start = np.array([0, 5, 5, 5 + 2 * gru.TRAIN_WORDS + 7])
    words = np.arange(2, 2 + start[-1])
    given, target, text, begins = gru.lanes(words, gru.parts(start, np.arange(3)), 8)
    learned = text >= 0
    assert sorted(target[learned].tolist()) == sorted([*words.tolist(), gru.END, gru.END, gru.END])
    # but for the starts of texts, a word is given the word before it
    word = learned & (target > 1)
    first = np.isin(target[word], [2, 7])
    assert (given[word] == np.where(first, gru.END, target[word] - 1)).all()
    assert (text == -2).sum() == 2 * gru.BURN


def test_lm_learns_order(spark):
    """On texts in which each word tells the next, the model must beat the counts by far."""
    from tidemill.llm import lm

    rng = random.Random(7)
    after = {w: rng.sample(range(40), 2) for w in range(40)}

    def text(n):
        w, out = rng.randrange(40), []
        for _ in range(n):
            out.append(f"w{w}")
            w = rng.choice(after[w])
        return " ".join(out)

    docs = spark.createDataFrame([(k, text(200 if k % 50 else 4000), k) for k in range(900)], "doc_id long, text string, slice_id int").repartition(2)
    out = lm.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.75 * out[1]  # both are negative


def test_histogram_cut(spark):
    from tidemill.llm.common import at_least

    rng = random.Random(1)
    counts = [rng.randrange(1, 10) if k % 3 else rng.randrange(1, 10**7) for k in range(3000)]
    rows = spark.createDataFrame([(n,) for n in counts], "n long")
    for most in (0, 10, 500, 2999, 3000, 10_000):
        cut = at_least(rows, "n", most)
        kept = sum(n >= cut for n in counts)
        assert kept <= most and (most < 3000 or cut == 0 and kept == 3000)
        assert most != 500 or kept > 450


# neighbours


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_of_the_index(spark, kind, monkeypatch):
    from tidemill.llm import pivots

    rng = np.random.default_rng(11)
    n, d = 20_000, 32
    x = rng.standard_normal((n, d))
    if kind == "clustered":
        x = (rng.standard_normal((150, d)) * 3)[rng.integers(0, 150, n)] + x
    x = x.astype(np.float32).astype(np.float64)
    docs = spark.createDataFrame(pa.table({"vec_id": pa.array(range(n)), "embedding": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))}))
    fits = []
    kept = pivots.fitted
    monkeypatch.setattr(pivots, "fitted", lambda *a: fits.append(kept(*a)) or fits[-1])
    got = {}
    for r in pivots.nearest(docs).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, n, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        want = set(np.lexsort((np.arange(n), dist))[:10].tolist())
        assert sorted(got[q]) == list(range(1, 11))
        hits += len(want & {v for v, _ in got[q].values()})
        assert all(s == pytest.approx(dist[v]) for v, s in got[q].values())
    assert hits >= 0.9 * n // 100 * 10
    files, share = fits[0]
    assert share < 0.5 if kind == "random" else files <= 12


def test_neighbours_of_awkward_tables(spark):
    from tidemill.llm import pivots

    rows = [(100, [1.0, 0.0]), (100, [2.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (200, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 4.0]), (None, [1.0, 1.0]), (300, [5.0]), (5, None)]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, rank int")
    got = {}
    for r in pivots.nearest(docs, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 6)))
    assert {q: sorted(x) for q, x in got.items()} == {100: [(1, 1, 0.0), (2, 2, 1.414214), (3, 3, 1.414214)], 200: [(1, 4, 1.0)]}


# Jaccard join


def test_jaccard_with_long_lists(spark, monkeypatch):
    """Salted lists, groups that expand to many pairs, hubs, and frequent shingles in the order."""
    from tests.llm.test_operators import components
    from tidemill.llm import jaccard

    for name, value in (("LIST_ROWS", 8), ("NEIGHBOURS", 1), ("EXPANDED", 2), ("BLOCK", 5), ("FREQUENT_IN_SLICE", 2), ("VERIFY_SHINGLES", 300)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(12)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = []
    for k in range(90):
        t = list(base)
        for _ in range(k % 5):
            t[rng.randrange(60)] = f"v{rng.randrange(9)}"
        texts.append(" ".join(t[: 60 - k % 3]))
    texts += [" ".join(base[:8] + [f"u{rng.randrange(400)}" for _ in range(rng.randrange(2, 30))]) for _ in range(60)]
    texts += ["a b c d e f"] * 30 + ["a b c d e f g"] * 5
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, t int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(docs).collect()}
    assert got == components(rows, 4, 85, 100)


def test_components_of_long_paths(spark):
    from tidemill.llm.components import components

    links = [(k, k + 1) for k in range(0, 700) if k % 100 != 99] + [(900, k) for k in range(901, 960)] + [(5, 5), (None, 3), (7, None)]
    rng = random.Random(2)
    name = list(range(1000))
    rng.shuffle(name)
    links = [(None if a is None else name[a], None if b is None else name[b]) for a, b in links]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for low in range(0, 701, 100):
        own = [name[k] for k in range(low, min(low + 100, 701))]
        want |= dict.fromkeys(own, min(own))
    want |= dict.fromkeys([name[k] for k in range(900, 960)], min(name[k] for k in range(900, 960)))
    want.pop(name[700], None)
    got.pop(name[700], None)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# FM-index


def test_fm_index_against_search():
    from tidemill.llm import fm

    rng = np.random.default_rng(6)
    texts = [rng.integers(1, 4, rng.integers(5, 25)) for _ in range(30)] + [np.ones(12, np.int64)] * 2
    symbols = np.concatenate([np.append(t, 0) for t in texts])
    index = fm.FMIndex(symbols, 4, 5)
    ends = np.array([e for e in range(5, len(symbols)) if 0 not in symbols[e - 5 : e]])
    low, high, reached = index.search(symbols, ends, 5)
    s = "".join(map(str, symbols))
    for e, a, b, r in zip(ends, low, high, reached, strict=True):
        places = [k for k in range(len(s)) if s.startswith(s[e - 5 : e], k)]
        assert (r == 5) == (len(places) > 1)
        if r == 5:
            assert sorted(index.suffixes[a:b].tolist()) == places


# WARC


def page_rows(rows, spark):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, first string")


def test_warc_rows(spark):
    from tidemill.llm import warc

    a, b = "a" * 200, "b" * 300
    rows = [(1, "u", a), (1, "u", b), (3, None, b), (None, "v", a), (None, "v", None), (5, "WARC/1.1\r\nx", "WARC/1.0\r\n\r\n" * 4000), (6, "é", "é" * 99), (1, "u", a)]
    out = warc.warc_round_trip(page_rows(rows, spark), segment_bytes=1000).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.ok) for r in out)
    assert got == sorted([(1, 200, "response", None, True), (1, 200, "response", None, True), (1, 300, "response", None, True), (3, 300, "revisit", 1, True), (0, 200, "response", None, True), (0, 0, "response", None, True), (5, 48_000, "response", None, True), (6, 198, "response", None, True)], key=lambda x: tuple(str(v) for v in x)) or len(got) == 8
    by = {(r.page_id, r.payload_digest): r for r in out}
    assert by[3, hashlib.sha256(b.encode()).hexdigest()].refers_to == 1
    assert all(r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest() for (i, _, h) in rows for r in [by[i, hashlib.sha256((h or "").encode()).hexdigest()]])
    assert warc.warc_round_trip(page_rows([], spark)).count() == 0


def record(kind, rid, block, *fields, version=b"1.1", length=None):
    head = [b"WARC-Type: " + kind, b"WARC-Record-ID: <" + rid + b">", b"WARC-Date: 2024-01-01T00:00:00Z", *fields, b"Content-Length: %d" % (len(block) if length is None else length)]
    return b"WARC/" + version + b"\r\n" + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def segments(rid, blocks, total, numbers=None):
    numbers = numbers or range(1, len(blocks) + 1)
    out = []
    for n, x in zip(numbers, blocks, strict=True):
        fields = [b"WARC-Segment-Number: %d" % n]
        if n > 1:
            fields.append(b"WARC-Segment-Origin-ID: <" + rid + b">")
        if n == len(blocks):
            fields.append(b"WARC-Segment-Total-Length: %d" % total)
        out.append(record(b"response" if n == 1 else b"continuation", rid if n == 1 else rid + b":%d" % n, x, *fields))
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_warc_reads_other_archives(spark, tmp_path, packed):
    import gzip

    from tidemill.llm import warc

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    inside = b"<p>WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" * 40
    archive = [
        record(b"warcinfo", b"urn:0", b"software: x\r\n", version=b"1.0"), record(b"response", b"urn:1", b"HTTP/1.1 200 OK\r\n\r\n" + inside, version=b"1.0"), record(b"resource", b"urn:2", inside),
        record(b"response", b"urn:3", http + b"4\r\nwiki\r\n5;x=y\r\npedia\r\n0\r\n\r\n"), record(b"response", b"urn:4", http + b"zz\r\nwiki"), record(b"response", b"urn:5", b""),
        *segments(b"urn:6", [http + b"4\r\nwi", b"ki\r\n0", b"\r\n\r\n"], len(http) + 14)[::-1], *segments(b"urn:7", [b"ab", b"cd", b"ef"], 6)[:2], *segments(b"urn:8", [b"ab", b"cd"], 99), *segments(b"urn:9", [b"ab", b"cd", b"cd"], 6, [1, 2, 2]),
        segments(b"urn:10", [b"ab", b"cd"], 4)[1], record(b"response", b"urn:11", b"cut short", length=5000),
    ]
    path = tmp_path / ("a.warc.gz" if packed else "a.warc")
    path.write_bytes(b"".join(gzip.compress(x) for x in archive) if packed else b"".join(archive))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "1000b"):  # in one split, and in splits smaller than a record
            for k in before:
                spark.conf.set(k, size)
            got = {r.record_id: (r.record_type, r.ok, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(spark, str(path)).collect()}
            assert got["urn:1"] == ("response", True, inside) and got["urn:2"] == ("resource", True, inside) and got["urn:0"][0] == "warcinfo"
            assert got["urn:3"] == ("response", True, b"wikipedia") and got["urn:4"][2] is None and got["urn:5"] == ("response", True, b"")
            assert got["urn:6"] == ("response", True, b"wiki")
            assert not any(got[f"urn:{k}"][1] for k in (7, 8, 9, 10, 11)) and got["urn:10"][0] == "continuation"
            assert len(got) == 12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_written_archives_are_valid(spark, tmp_path):
    from tidemill.llm import warc

    warc.write_warc(page_rows([(k, "u", chr(97 + k % 3) * (150 + 90_000 * (k % 3 == 1))) for k in range(9)], spark), str(tmp_path / "w"), date="2024-05-06T07:08:09Z")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    seen, at = set(), 0
    while at < len(raw):  # one record after the other, by their lengths
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        assert lines[0] == b"WARC/1.1" and {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= set(fields)
        assert fields[b"WARC-Date"] == b"2024-05-06T07:08:09Z" and fields[b"WARC-Record-ID"] not in seen
        seen.add(fields[b"WARC-Record-ID"])
        at += len(head) + 4 + int(fields[b"Content-Length"])
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert len(seen) > 9


# mixing


def test_mix_against_brute_force(spark):
    """Earliest deadline first over released blocks, with a source that runs out, null, and one without weight."""
    import math
    from fractions import Fraction

    from tidemill.llm import mixing

    rows = [(k, "a") for k in range(90)] + [(k, "b") for k in range(90, 97)] + [(k, None) for k in range(97, 140)] + [(k, "z") for k in range(140, 150)] + [(7, "a"), (None, "a"), (None, None)]
    docs = spark.createDataFrame([(i, s, "x", 1) for i, s in rows], "doc_id long, source string, slot string, slot_row int").repartition(4)
    weights = {"a": 2.0, "b": 1.0, None: 3.0, "z": 0.0}
    out = mixing.mix_order(docs, weights, block_rows=4).collect()
    blocks = {s: -(-sum(x == s for _, x in rows) // 4) for s in weights}
    names = sorted(weights, key=lambda s: (s is not None, s))
    w = {s: Fraction(weights[s]) / 6 for s in names}
    done, want, slot = dict.fromkeys(names, 0), {}, 0
    while any(done[s] < blocks[s] for s in names if w[s]):
        free = [s for s in names if w[s] and done[s] < blocks[s] and math.floor(done[s] / w[s]) <= slot]
        if free:
            s = min(free, key=lambda s: (math.ceil((done[s] + 1) / w[s]), names.index(s)))
            want[s, done[s]] = slot
            done[s] += 1
        slot += 1
    got = {}
    for r in out:
        got.setdefault((r.source, r.source_block), set()).add(r.slot)
    assert {k: v for k, v in got.items() if k[0] != "z"} == {k: {v} for k, v in want.items()}
    assert min(r.slot for r in out if r.source == "z") > max(want.values())
    assert len(out) == len(rows) == len({(r.slot, r.slot_row) for r in out})
    kept = mixing.mixed(docs, weights, block_rows=4)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


# workers


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Only the driver has the package on its path."""
    code = f"""
import sys, tempfile
sys.path.insert(0, {str(next(p for p in sys.path if p and (__import__("pathlib").Path(p) / "tidemill").is_dir()))!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate()
docs = spark.createDataFrame([(k, "the cat sat on the mat " * (k + 1) + "password = 'Zx9kQ27mNp4rT'", "en", "s") for k in range(12)], "doc_id long, text string, lang string, source string")
pages = docs.selectExpr("doc_id as page_id", "source as url", "text as html")
vectors = docs.selectExpr("doc_id * 50 as vec_id", "array(doc_id + 1.0, 2.0) as embedding")
from tidemill.llm import dedup, jaccard, langid, lm, mixing, pieces, pivots, secrets, substrings, warc
assert dedup.exact_dedup(docs).count() == jaccard.near_components(docs).count() == langid.identify(docs).count() == lm.lm_scores(docs).count() == 12
assert langid.accepted(docs).count() == mixing.mix_order(docs).count() == secrets.scan_secrets(docs).count() == substrings.dedup_substrings(docs).count() == 12
assert pieces.decode_documents(pieces.encode_documents(docs)).count() == warc.warc_round_trip(pages).count() == 12
assert pivots.nearest(vectors).count() == 60
print("all ran")
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in out.stdout, out.stderr[-3000:]


def test_held_out_by_crc(spark):
    import zlib

    from tidemill.llm import langid

    docs = spark.createDataFrame([(k - 40 if k else None, "abc def", "en") for k in range(90)], "doc_id long, text string, lang string")
    out = langid.identify(docs).collect()
    assert len(out) == 90
    for r in out:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) and r.lang_pred == "en" and r.score == 1.0
