"""The best of all candidates and the runner-up's score, without pairs of every probe and every candidate.

Features of a pair are of two sorts.  Rare ones (a tracking number, an order,
an amount) make pairs by equi-joins.  Common ones (a domain, a name, none at
all) are shared by too many; of candidates that share the same of them only
the distance in time still tells, and that by few steps.  So of those it is
enough to know, for each set of common features and each span around the
probe, how many there are and the smallest of them: a running count and
minimum, taken within days, and over days from sums of each day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DAY = 86_400_000_000


def amount_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows (value, b_value) whose amounts may be within 1 or half a percent: candidates, to be checked.

    Amounts meet in cells of a scale that is linear up to 200 and logarithmic
    beyond, on which that distance is about 1 everywhere.
    """
    scale = lambda x: F.when(F.abs(x) <= 200, x).otherwise(F.signum(x) * (200 + 200 * F.log(F.abs(x) / 200)))
    cell = lambda x: F.floor(scale(x) / 1.01).cast("long")
    right = b.withColumn("__cell", F.explode(F.array(*[cell(F.col("b_value")) + k for k in (-1, 0, 1)])))
    return a.withColumn("__cell", cell(F.col("value"))).join(right, [*keys, "__cell"]).drop("__cell")


def _common(kinds: dict[int, list[str]]) -> Column:
    """A row for each set of common features that a row has: the set's number and its key."""
    sets = [F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in keys]), F.struct(F.lit(mask).alias("mask"), F.concat_ws("\u001f", *[F.col(c).cast("string") for c in keys]).alias("key"))) for mask, keys in kinds.items()]
    return F.explode(F.array_compact(F.array(*sets)))


def _counted(rows: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """probe, part, n and first of the rows from a probe's place on (``forward``), or up to it, within its key.

    ``rows`` have the keys, at, n and first; ``probes`` the keys, at, probe,
    part and forward.
    """
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select(*keys, "at", "n", "first", none("long").alias("probe"), none("int").alias("part"), none("boolean").alias("forward")).unionByName(probes.select(*keys, "at", none("long").alias("n"), none("long").alias("first"), "probe", "part", "forward"))
    # rows at a probe's own place count, so they come first
    asked = F.col("probe").isNotNull().cast("int")
    up, down = (W.partitionBy(*keys).orderBy(o, asked).rowsBetween(W.unboundedPreceding, W.currentRow) for o in (F.col("at"), F.col("at").desc()))
    told = both.select("probe", "part", "forward", *[F.struct(F.sum("n").over(w).alias("n"), F.min("first").over(w).alias("first")).alias(name) for name, w in (("below", up), ("above", down))])
    side = F.when(F.col("forward"), F.col("above")).otherwise(F.col("below"))
    return told.where("probe is not null").select("probe", "part", side.alias("side")).select("probe", "part", "side.n", "side.first").where("n > 0")


def standing(probes: DataFrame, rows: DataFrame, kinds: dict[int, list[str]], spans: tuple[int, ...]) -> DataFrame:
    """probe, mask, band, n, first: how many rows share the common features of a set, and the smallest, within so many days of the probe.

    ``probes`` have probe, t and the features; ``rows`` have id, t and the
    features; t is in microseconds.  Bands are the spans in order, ends
    counted, and last the whole time.  A span is two parts of days, counted
    row by row within the day, and the days between, counted by day.
    """
    marked = rows.select("id", "t", _common(kinds).alias("c")).select("id", "t", "c.*")
    asking = probes.select("probe", "t", _common(kinds).alias("c")).select("probe", "t", "c.*").dropDuplicates(["probe", "mask", "key"])
    day = lambda t: F.floor(t / DAY).cast("long")
    in_day = marked.select("mask", "key", day(F.col("t")).alias("slot"), F.col("t").alias("at"), F.lit(1).cast("long").alias("n"), F.col("id").alias("first"))
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), (F.col("t") + sign * days * DAY).alias("at"), F.lit(sign < 0).alias("forward")) for k, days in enumerate(spans) for sign in (-1, 1)]))
    edges = asking.select("probe", "mask", "key", ends.alias("e")).select("probe", "mask", "key", "e.*").withColumn("slot", day(F.col("at")))
    number = lambda df: df.withColumn("part", F.col("part") + F.col("mask") * len(spans))
    near = _counted(in_day, number(edges), ["mask", "key", "slot"])
    # the days between, of which a span always has as many: the end of one stretch of that many days and the start of the next
    daily = in_day.groupBy("mask", "key", "slot").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    wide = [2 * days - 1 for days in spans]
    stretch = lambda at, width: F.floor(at / width).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("span"), stretch(F.col("slot"), w).alias("stretch")) for k, w in enumerate(wide)]))
    days = daily.select("mask", "key", F.col("slot").alias("at"), "n", "first", each.alias("s")).select("mask", "key", "at", "n", "first", "s.*")
    starts = []
    for k, w in enumerate(wide):
        first, last = day(F.col("t") - spans[k] * DAY) + 1, day(F.col("t") + spans[k] * DAY) - 1
        starts += [F.struct(F.lit(k).alias("span"), stretch(first, w).alias("stretch"), first.alias("at"), F.lit(True).alias("forward")), F.struct(F.lit(k).alias("span"), (stretch(first, w) + 1).alias("stretch"), last.alias("at"), F.lit(False).alias("forward"))]
    middles = asking.select("probe", "mask", "key", F.explode(F.array(*starts)).alias("e")).select("probe", "mask", "key", "e.*").withColumn("part", F.col("span"))
    # where the days begin a stretch, its end is the whole of them
    middles = middles.where(F.col("forward") | (stretch(F.col("at"), F.element_at(F.array(*[F.lit(w) for w in wide]), F.col("span") + 1)) == F.col("stretch")))
    far = _counted(days, number(middles), ["mask", "key", "span", "stretch"])
    spanned = near.unionByName(far).groupBy("probe", "part").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    spanned = spanned.select("probe", F.floor(F.col("part") / len(spans)).cast("int").alias("mask"), (F.col("part") % len(spans)).alias("band"), "n", "first")
    # the whole time: sums of the days
    ever = daily.groupBy("mask", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    ever = asking.join(ever, ["mask", "key"]).groupBy("probe", "mask").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return spanned.unionByName(ever.select("probe", "mask", F.lit(len(spans)).alias("band"), "n", "first"))


def best_of_all(probes: DataFrame, common: DataFrame, pairs: DataFrame, points: dict[int, int], time: tuple[int, ...]) -> DataFrame:
    """``probes`` with ``best`` (score, id, flags) and ``runner_up``, over all candidates of each.

    ``common`` is of ``standing``; ``pairs`` are all that share a rare feature:
    probe, id, score, mask and band (its common features and time) and flags.
    ``points`` are those of each set of common features, ``time`` those of
    each band.  A candidate counts by its true score: one with more features
    than its set's, or nearer than its band, is in a better one, so that only
    counts need the difference.  Without a candidate that scores, best is null.
    """
    cells = [(m, b) for m in points for b in range(len(time))]
    # as SQL text: the expressions are many, and a call to the JVM for each part of them takes longer than the query
    at = lambda m, b: f"mask = {m} and band = {b}"
    counts = common.groupBy("probe").agg(*[F.expr(f"sum(n) filter (where {at(m, b)}) as n_{m}_{b}") for m, b in cells], *[F.expr(f"min(first) filter (where {at(m, b)}) as first_{m}_{b}") for m, b in cells])
    # rare ones count in every set that they share and every band that they lie in
    rare = pairs.groupBy("probe").agg(F.min(F.struct((-F.col("score")).alias("less"), "id", "flags")).alias("rare"), *[F.expr(f"count_if(mask & {m} = {m} and band <= {b}) as rare_{m}_{b}") for m, b in cells])
    second = pairs.withColumn("place", F.row_number().over(W.partitionBy("probe").orderBy(F.col("score").desc(), "id"))).where("place = 2").select("probe", F.col("score").alias("rare_second"))
    t = probes.join(counts, "probe", "left").join(rare, "probe", "left").join(second, "probe", "left")
    # within the band and sharing the set at least
    left = {(m, b): f"(coalesce(n_{m}_{b}, 0) - coalesce(rare_{m}_{b}, 0))" for m, b in cells}

    def exact(m: int, b: int) -> str:
        more = [x for x in points if x & m == m]
        return " ".join(f"{'-' if bin(x ^ m).count('1') % 2 else '+'} ({left[x, b]}{f' - {left[x, b - 1]}' if b else ''})" for x in more)

    worth = {(m, b): points[m] + time[b] for m, b in cells if points[m] + time[b] > 0}
    offers = ", ".join(f"if(n_{m}_{b} > 0, named_struct('less', {-v}, 'id', first_{m}_{b}), null)" for (m, b), v in worth.items())
    numbered = t.withColumn("top", F.expr(f"array_min(filter(array({offers}, if(rare is not null, named_struct('less', rare.less, 'id', rare.id), null)), x -> x is not null))"))
    numbered = numbered.withColumns({f"e_{m}_{b}": F.expr(exact(m, b)) for m, b in worth})
    scored = ", ".join(f"if(e_{m}_{b} >= {k}, {v}, null)" for (m, b), v in worth.items() for k in (1, 2))
    runner_up = F.expr(f"coalesce(get(sort_array(filter(array({scored}, -rare.less, rare_second), x -> x is not null), false), 1), 0)")
    same = F.coalesce(F.col("rare.id") == F.col("top.id"), F.lit(False))
    found = F.when(F.col("top").isNotNull(), F.struct((-F.col("top.less")).alias("score"), F.col("top.id").alias("id"), F.when(same, F.col("rare.flags")).alias("flags")))
    return numbered.select(*probes.columns, found.alias("best"), runner_up.alias("runner_up"))


def alike_names(asked: DataFrame, held: DataFrame, least: int = 5, gram: int = 3) -> DataFrame:
    """name, alike: names of ``asked`` and of ``held`` (one column each, normalised) that are equal, or of which one holds the other and both have ``least`` letters.

    A name that another holds shares all its runs of three letters with it, so
    they meet by the one of them that fewest names have.
    """
    a, b = asked.toDF("name").where("name <> ''").distinct(), held.toDF("name").where("name <> ''").distinct()
    runs = lambda df: df.where(F.length("name") >= least).select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - (gram - 1)), lambda i: F.substring("name", i, F.lit(gram))))).alias("run"))

    def held_by(small: DataFrame, large: DataFrame) -> DataFrame:
        many = runs(large)
        few = runs(small).join(many.groupBy("run").agg(F.count(F.lit(1)).alias("times")), "run").groupBy("name").agg(F.min(F.struct("times", "run")).alias("rarest"))
        return few.select(F.col("name").alias("small"), F.col("rarest.run").alias("run")).join(many.withColumnRenamed("name", "large"), "run").where(F.col("large").contains(F.col("small"))).select("small", "large")

    inside, around = held_by(a, b).toDF("name", "alike"), held_by(b, a).toDF("alike", "name").select("name", "alike")
    return inside.unionByName(around).unionByName(a.join(b, "name").select("name", F.col("name").alias("alike"))).distinct()
