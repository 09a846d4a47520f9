"""Mixing sources to target weights with a Pfair schedule.

The rows of a source are dealt into blocks.  With target weights w_s of sum 1,
block i of source s (from 0) is released at slot floor(i/w_s) and is due
before slot ceil((i+1)/w_s).  Each slot goes to the released block with the
earliest deadline, which meets all deadlines.  That keeps every source within
less than one block of its target at every slot, however long the table.  A
source that runs out leaves its slots empty; the others keep their pace.

The schedule has one entry for each block.  The driver makes it, in exact
integers and in parts of PART_BLOCKS entries, and holds one part and a few
numbers for each source; larger tables want larger blocks, which is a
parameter.  All that has to do with rows is DataFrame operations, with no
Python on executors.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType
from pyspark.sql.window import Window as W

from .common import fresh_path, materialize

BLOCK_ROWS = 32
#: The slots that the column weight_slots counts by.
SLOTS = 1000
#: Rows of a source that one task numbers, and runs that are put end to end together.
RUN_ROWS, LOT_RUNS = 1_000, 1_024
#: Blocks of a part of the schedule.
PART_BLOCKS = 1 << 18
#: Slots from here on aren't used.
LAST_SLOT = 1 << 62


def target_weights(rows: list[tuple], weights: dict[str, float] | None) -> list[int]:
    """An integer for each (source, rows); they are in the proportion of the targets, exactly.

    Without ``weights`` a source weighs as the square root of its rows.
    Sources that ``weights`` doesn't name, or not with a positive number,
    weigh 0.  If all weigh 0, all weigh the same.
    """
    wished = [math.sqrt(n) if weights is None else float(weights.get(source) or 0) for source, n in rows]
    exact = [Fraction(w) if w > 0 else Fraction(0) for w in wished]
    if not any(exact):
        exact = [Fraction(1)] * len(rows)
    unit = reduce(math.lcm, (w.denominator for w in exact), 1)
    return [int(w * unit) for w in exact]


def schedule(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of each block, by slot.

    Blocks of sources of weight 0, and those due after LAST_SLOT, follow all
    others.
    """
    total = sum(weights)
    fits = [min(n, a * LAST_SLOT // total) if a else 0 for a, n in zip(weights, blocks, strict=True)]
    waiting = [(0, s) for s, n in enumerate(fits) if n]
    ready: list[tuple[int, int]] = []
    done = [0] * len(weights)
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s))
        s = heapq.heappop(ready)[1]
        yield s, done[s], slot
        done[s] += 1
        slot += 1
        if done[s] < fits[s]:
            heapq.heappush(waiting, (done[s] * total // weights[s], s))
    for s, n in enumerate(blocks):
        for block in range(done[s], n):
            yield s, block, slot
            slot += 1


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of the driver's values, made without Python workers."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows, default=str)), f"array<struct<{schema}>>")))


def slot_table(spark: SparkSession, weights: list[int], blocks: list[int]) -> DataFrame:
    """The schedule as a table: __ix, __block, __slot."""
    steps, path = schedule(weights, blocks), fresh_path(spark, "mix-slots")
    while True:
        slots: dict[int, tuple[int, list[int]]] = {}
        for s, block, slot in islice(steps, PART_BLOCKS):  # the blocks of a source come in order
            slots.setdefault(s, (block, []))[1].append(slot)
        part = _rows(spark, [{"__ix": s, "__first": first, "__slots": own} for s, (first, own) in slots.items()], "__ix: bigint, __first: bigint, __slots: array<bigint>")
        part.select("__ix", "__first", F.posexplode("__slots").alias("__n", "__slot")).select("__ix", (F.col("__first") + F.col("__n")).alias("__block"), "__slot").write.mode("append").parquet(path)
        if sum(len(own) for _, own in slots.values()) < PART_BLOCKS:
            return spark.read.schema("__ix long, __block long, __slot long").parquet(path)


def _placed(docs: DataFrame, weights: dict[str, float] | None, block_rows: int, slots: int, id_col: str, source_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of each row with __at, its number in the source, and __block, __weight, __slot and __slot_row."""
    spark = docs.sparkSession
    runs = max(1, docs.count() // RUN_ROWS)
    same = [F.col(c) for c in columns if isinstance(docs.schema[c].dataType, (StringType, NumericType))]
    keyed = docs.select(*[F.col(c) for c in columns]).withColumn("__h", F.xxhash64(F.col(id_col))).withColumn("__run", F.pmod(F.shiftright("__h", 20), F.lit(runs)))
    per_run = materialize(keyed.groupBy(F.col(source_col).alias("__source"), "__run").agg(F.count(F.lit(1)).alias("__rows")), "mix-runs")
    rows = [tuple(r) for r in per_run.groupBy("__source").agg(F.sum("__rows")).orderBy("__source").collect()]  # one for each source
    exact = target_weights(rows, weights)
    named = [{"__name": s, "__ix": k, "__weight": float(Fraction(slots * a, sum(exact)))} for k, ((s, _), a) in enumerate(zip(rows, exact, strict=True))]
    sources = _rows(spark, named, f"__name: {docs.schema[source_col].dataType.simpleString()}, __ix: bigint, __weight: double")
    at = slot_table(spark, exact, [-(-n // block_rows) for _, n in rows])

    # rows of a source before each run: lots of runs are put end to end, then the runs of each lot
    counted = per_run.join(sources, F.col("__source").eqNullSafe(F.col("__name"))).select("__ix", "__run", "__rows", F.floor(F.col("__run") / LOT_RUNS).alias("__lot"))
    earlier = lambda w: F.coalesce(F.sum("__rows").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lots = counted.groupBy("__ix", "__lot").agg(F.sum("__rows").alias("__rows")).select("__ix", "__lot", earlier(W.partitionBy("__ix").orderBy("__lot")).alias("__lot_before"))
    before = counted.withColumn("__in_lot", earlier(W.partitionBy("__ix", "__lot").orderBy("__run"))).join(lots, ["__ix", "__lot"])
    before = before.select("__ix", "__run", "__rows", (F.col("__lot_before") + F.col("__in_lot")).alias("__before"))
    # the slots of the blocks of each run, in order; its first block may have begun in the run before
    first, last = (F.floor(x / block_rows) for x in (F.col("__before"), F.col("__before") + F.col("__rows") - 1))
    held = before.withColumn("__block", F.explode(F.sequence(first, last))).join(at, ["__ix", "__block"])
    held = held.groupBy("__ix", "__run", "__before").agg(F.array_sort(F.collect_list(F.struct("__block", "__slot"))).alias("__slots"))

    # both sides of the join are dealt by __ix and __run, so rows are shuffled once
    keyed = keyed.join(sources, F.col(source_col).eqNullSafe(F.col("__name")))
    rank = F.row_number().over(W.partitionBy("__ix", "__run").orderBy("__h", F.col(id_col), *same))
    ranked = keyed.withColumn("__n", rank).join(held, ["__ix", "__run"])
    ranked = ranked.withColumn("__at", F.col("__before") + F.col("__n") - 1).withColumn("__block", F.floor(F.col("__at") / block_rows)).withColumn("__slot_row", (F.col("__at") % block_rows).cast("int"))
    slot = F.col("__slots")[(F.col("__block") - F.col("__slots")[0]["__block"]).cast("int")]["__slot"]
    return ranked.select(*columns, "__block", "__weight", slot.alias("__slot"), "__slot_row")


#: What `mix_order` adds.
ADDED = ("source_block", "weight_slots", "slot", "slot_row")


def mix_order(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, slots: int = SLOTS, id_col: str = "doc_id", source_col: str = "source", columns: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with its place in the mix.

    Adds source_block, weight_slots (the target of the source in ``slots``
    slots, not rounded), slot and slot_row to the id, the source and
    ``columns``; of ``columns`` those named like one of these are left out.
    (slot, slot_row) orders the mix and tells rows apart.  Every row stays,
    repeated ones too, and rows of a source are dealt in the order of a hash
    of the id, those of one id (or of none) by ``columns``.  Null is a source
    like others.  Sources of weight 0 follow all others; a source that has run
    out leaves its slots empty.  An empty table gives an empty result.

    A hot source is numbered in runs of about RUN_ROWS rows, by many tasks,
    and the runs are put end to end by their counts.
    """
    named = list(dict.fromkeys([id_col, source_col, *(c for c in columns or [] if c not in ADDED)]))
    placed = _placed(docs, weights, block_rows, slots, id_col, source_col, named)
    return placed.select(*named, *[F.col(c).alias(name) for c, name in zip(("__block", "__weight", "__slot", "__slot_row"), ADDED, strict=True)])


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs``, whatever they are called, sorted into the order of the mix.

    As in `mix_order`, null is a source, and no row is lost; an empty table
    gives an empty result.
    """
    return _placed(docs, weights, block_rows, SLOTS, id_col, source_col, docs.columns).orderBy("__slot", "__slot_row").select(*docs.columns)
