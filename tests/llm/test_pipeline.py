"""The pipeline, and the queries that SQL can express."""

import pytest

from tests.oracle import same
from tidemill.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same(spark, SF, QUERIES[name], ORACLE[name])


def test_pipeline(spark):
    import corpus_pipeline

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    last = {}
    for i, t in rows.items():
        last[t] = max(i, last.get(t, -1))
    from tests.llm.test_operators import components

    kept = [(i, t) for i, t in rows.items() if last[t] == i]
    roots = components(kept, 5, 80, 100)
    want = {i for i, _ in kept if roots[i][1] == i}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= want
    # language ID rejects hardly any of these documents
    assert len(out) >= len(want) - 2 and all(r.round_trip for r in out)


def test_pipeline_keeps_the_mix(spark):
    import math
    from fractions import Fraction

    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source")))
    rows = {}
    for r in docs.select("source", "doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        rows.setdefault(r.source, []).append(r.doc_id)
    names = sorted(rows, key=lambda s: (s is not None, s))
    weights = [Fraction(math.sqrt(len(rows[s]))) for s in names]
    weights = [w / sum(weights) for w in weights]
    taken, want, slot = [0] * len(names), {}, 0
    while len(want) < sum(map(len, rows.values())):
        released = [k for k, s in enumerate(names) if taken[k] * 32 < len(rows[s]) and math.floor(taken[k] / weights[k]) <= slot]
        if released:
            k = min(released, key=lambda k: (math.ceil((taken[k] + 1) / weights[k]), k))
            want |= {i: (slot, n) for n, i in enumerate(rows[names[k]][taken[k] * 32 : taken[k] * 32 + 32])}
            taken[k] += 1
        slot += 1
    for _, stage in corpus_pipeline.STAGES[3:]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id: (r.slot, r.slot_row) for r in docs.collect()} == want


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline

    unlike = [" ".join(f"{w}{k}" for k in range(30)) for w in "abcdefg"]
    near = unlike[5] + " more"
    rows = [(None, unlike[0]), (1, unlike[0]), (None, unlike[1]), (None, unlike[2]), (2, unlike[3]), (3, unlike[3]), (2, unlike[4]), (4, unlike[5]), (5, near), (5, unlike[6]), (None, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.dedup_exact(spark, docs, SF)
    # null and 2 lose the copies of 1 and 3, and nothing else; of the texts of 5 and null the one with the id stays
    want = [x for x in rows if x not in ((None, unlike[0]), (2, unlike[3]), (None, near))]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t in want)
    # 5 loses the near copy of 4, not its other text
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.dedup_near(spark, kept, SF).collect()) == sorted((i or 0, t) for i, t in want if (i, t) != (5, near))
    # a near copy goes even where another row of its id stays
    twice = docs.where("doc_id = 4").unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 5").selectExpr("4 as doc_id", "text", "lang", "source", "n_chars"))
    assert corpus_pipeline.dedup_near(spark, twice, SF).count() == 2


def edf(rows, block=32):
    """Places of a mix by brute force; ``rows`` maps sources to ids in order."""
    import math
    from fractions import Fraction

    names = sorted(rows, key=lambda s: (s is not None, s))
    weights = [Fraction(math.sqrt(len(rows[s]))) for s in names]
    weights = [w / sum(weights) for w in weights]
    taken, out, slot = [0] * len(names), {}, 0
    while len(out) < sum(map(len, rows.values())):
        free = [k for k, s in enumerate(names) if taken[k] * block < len(rows[s]) and math.floor(taken[k] / weights[k]) <= slot]
        if free:
            k = min(free, key=lambda k: (math.ceil((taken[k] + 1) / weights[k]), k))
            out |= {i: (slot, n) for n, i in enumerate(rows[names[k]][taken[k] * block : taken[k] * block + block])}
            taken[k] += 1
        slot += 1
    return out


def test_pipeline_whole(spark):
    """Every row of the pipeline: which documents stay, their places in the mix, and their ids."""
    import corpus_pipeline
    import pyarrow as pa
    import sentencepiece
    from pyspark.sql import functions as F

    from tests.llm.test_operators import components
    from tidemill.llm import langid, pieces

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = docs.select("doc_id", "text", "source", F.xxhash64("doc_id").alias("h")).collect()
    names, score, _ = langid.labelled(langid.train(docs, F.lit(True)), pa.array([r.text for r in table], pa.string()), False)
    rows = [r for r, n, s in zip(table, names, score, strict=True) if n != "und" and s >= 0.5]
    last = {}
    for r in rows:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    rows = [r for r in rows if last[r.text or ""] == r.doc_id]
    roots = components([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    rows = sorted((r for r in rows if roots[r.doc_id][1] == r.doc_id), key=lambda r: (r.h, r.doc_id))
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r.doc_id)
    places = edf(by_source)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    want = {r.doc_id: (*places[r.doc_id], library.encode(r.text or "")) for r in rows}
    got = {r.doc_id: (r.slot, r.slot_row, r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_of_awkward_tables(spark):
    """Extra columns with the names that stages use themselves, nulls in all columns, repeated rows, and no rows at all."""
    import corpus_pipeline

    extra = ("id", "ids", "slot", "slot_row", "source_block", "weight_slots", "gid", "sha", "component_id", "lang_pred", "kept", "n")
    words = [" ".join(f"{w}{k}" for k in range(20)) for w in "abcdefgh"]
    rows = [(1, words[0], "en", "s", 1), (1, words[0], "en", "s", 1), (None, words[1], "en", None, None), (2, words[2], None, "s", 3), (3, None, "en", "s", 0), (4, "", "en", None, 0), (5, "12 34 !", "en", "t", 7), (6, words[0], "en", "t", 1), (7, words[3] + " more", "en", "t", 1), (8, words[3], "en", "u", 1), (None, None, None, None, None)]
    made = spark.createDataFrame([(*r, *[k] * len(extra)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in extra))
    docs = made
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == made.columns, name
        docs = spark.createDataFrame(docs.collect(), made.schema)
    # of equal texts the largest id stays, of near ones the smallest; texts without letters go
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(0, words[1]), (2, words[2]), (6, words[0]), (7, words[3] + " more")])
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert len(out) == 4 and len({(r.slot, r.slot_row) for r in out}) == 4 and all(r.round_trip and r.n_ids for r in out)
    docs = made.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
