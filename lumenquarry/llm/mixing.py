"""Operator 4, mixing sources to target weights by a Pfair schedule.

A source's documents are cut into blocks of up to `block_rows`. Time is counted in slots of one block. With c of every
`period` slots as its weight, the source's block k has release time floor(k * period / c) and deadline
ceil((k + 1) * period / c); earliest-deadline-first among released blocks fills every slot, and a source never is a
whole block away from its share. The schedule repeats after `period` slots, so one period is simulated and any block's
slot follows from its number. When a source runs out, the others' weights are scaled up and a new phase begins: no row
is dropped or repeated.

Weights that aren't given follow the sources' sizes to the power `temperature`; either way those over 0 are rounded to
parts of the period, at least one part each. A source of weight 0 comes after all others have run out. Block numbers come from counts: a source is dealt by a hash into salts of about
`salt_rows` rows, which are numbered on their own, so a source with a third of all rows is spread like the others. The
driver sees a row for each source, and the phases' table, a row for each source and phase in which it has blocks, is made
there: with many sources of unlike lengths it grows with their number's square. It is broadcast while its counted size is
small.

Null source: a source of its own, listed as null. Null doc_id: numbered first, dealt by a hash of the row. Null, empty and very long texts: rows
like others. Ties and repeated rows: ordered by doc_id, then by a hash of the row; each is a row of the result. Empty
table: no rows. Extra columns are returned as they were, also where their names are those used here inside.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS, SALT_ROWS, TEMPERATURE, PERIOD = 32, 8192, 0.7, 512


def parts_of(weights: list[float], period: int) -> list[int]:
    """Whole parts of the period by largest remainder, at least 1 each."""
    whole = sum(weights)
    exact = [w / whole * period for w in weights]
    parts = [max(1, int(x)) for x in exact]
    order = sorted(range(len(parts)), key=lambda k: (parts[k] - exact[k], k))
    k = 0
    while sum(parts) < period:
        parts[order[k % len(order)]] += 1
        k += 1
    while sum(parts) > period:
        parts[max(range(len(parts)), key=lambda k: (parts[k], k))] -= 1
    return parts


def one_period(parts: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks within a period, by earliest deadline first among released blocks."""
    period = sum(parts)
    waiting = sorted((k * period // c, -(-(k + 1) * period // c), s) for s, c in enumerate(parts) for k in range(c))
    ready: list[tuple[int, int]] = []
    slots: list[list[int]] = [[] for _ in parts]
    at = 0
    for t in range(period):
        while at < len(waiting) and waiting[at][0] <= t:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        deadline, s = heapq.heappop(ready)
        assert t < deadline
        slots[s].append(t)
    return slots


def phases(blocks: list[int], weights: list[float], period: int) -> list[dict]:
    """A row for each source in each phase: its first block there, the phase's first slot and the slots of a period.

    Sources of weight 0 have no slot before all others have run out.
    """
    left, done, start, rows, phase = list(blocks), [0] * len(blocks), 0, [], 0
    while alive := [s for s in range(len(blocks)) if left[s] and weights[s] > 0] or [s for s in range(len(blocks)) if left[s]]:
        span = max(period, 4 * len(alive))
        parts = parts_of([weights[s] or 1.0 for s in alive], span)
        slots = one_period(parts)
        ends = [(left[s] - 1) // c * span + x[(left[s] - 1) % c] + 1 for s, c, x in zip(alive, parts, slots, strict=True)]
        end = min(ends)
        for s, c, x in zip(alive, parts, slots, strict=True):
            used = end // span * c + bisect_left(x, end % span)
            if used:
                rows.append({"source": s, "phase": phase, "first_block": done[s], "last_block": done[s] + used - 1, "first_slot": start, "period": span, "slots": x})
            done[s] += used
            left[s] -= used
        start += end
        phase += 1
    return rows


def numbered(docs: DataFrame, block_rows: int, salt_rows: int) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """docs with _block (in its source) and _place (in its block); each source's number of blocks."""
    spark = docs.sparkSession
    sizes = docs.groupBy("source").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("_salts"))
    sizes = common.cut(sizes)
    n_sources = sizes.count()
    salted = common.small_or_shuffled(docs, sizes.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left", n_sources, 64).drop("_source")
    salted = salted.withColumn("_salt", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id")), F.col("_salts")).cast("int")).drop("_salts")
    counts = common.cut(salted.groupBy("source", "_salt").agg(F.ceil(F.count("*") / block_rows).alias("_n")))
    offsets = counts.withColumn("_offset", F.sum("_n").over(Window.partitionBy("source").orderBy("_salt")) - F.col("_n"))
    n_salts = counts.count()
    each = F.row_number().over(Window.partitionBy("source", "_salt").orderBy("doc_id", F.xxhash64(*[c for c in docs.columns if not c.startswith("_")]))) - 1
    rows = salted.withColumn("_at", each)
    side = offsets.select(F.col("source").alias("_source"), F.col("_salt").alias("_in"), "_offset")
    rows = common.small_or_shuffled(rows, side, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_in")), "left", n_salts, 64)
    rows = rows.withColumns({"_block": F.col("_offset") + F.floor(F.col("_at") / block_rows), "_place": F.col("_at") % block_rows})
    totals = [(r[0], int(r[1])) for r in counts.groupBy("source").agg(F.sum("_n")).collect()]
    return rows.drop("_source", "_in", "_salt", "_at", "_offset"), sorted(totals, key=lambda x: (x[0] is not None, x[0]))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, salt_rows: int = SALT_ROWS, temperature: float = TEMPERATURE, period: int = PERIOD) -> DataFrame:
    """docs and, last, mix = (phase, block, slot, place, release, deadline); the order (slot, place) is the mixture's.

    Where docs has a column mix, the new one's name gets signs added. A source that weights doesn't name has weight 0.
    """
    spark = docs.sparkSession
    kept = docs.columns
    inner = docs.select("doc_id", "source", F.struct(*kept).alias("row"), *(["text"] if "text" in kept else []))
    rows, totals = numbered(inner, block_rows, salt_rows)
    given = [weights.get(s, 0.0) if weights else n**temperature for s, n in totals]
    table = phases([n for _, n in totals], given, period)
    schema = "_source string, phase int, first_block long, last_block long, first_slot long, period int, slots array<int>"
    data = [(totals[r["source"]][0], r["phase"], r["first_block"], r["last_block"], r["first_slot"], r["period"], r["slots"]) for r in table]
    plan = spark.createDataFrame(data, schema)
    on = F.col("source").eqNullSafe(F.col("_source")) & F.col("_block").between(F.col("first_block"), F.col("last_block"))
    out = common.small_or_shuffled(rows, plan, on, "inner", sum(4 * len(r["slots"]) + 64 for r in table), 1)

    k = F.col("_block") - F.col("first_block")
    c = F.size("slots")
    mixed = F.struct(
        F.col("phase"),
        F.col("_block").alias("block"),
        (F.col("first_slot") + F.floor(k / c) * F.col("period") + F.get("slots", (k % c).cast("int"))).alias("slot"),
        F.col("_place").alias("place"),
        (F.col("first_slot") + F.floor(k * F.col("period") / c)).alias("release"),
        (F.col("first_slot") + F.ceil((k + 1) * F.col("period") / c)).alias("deadline"),
    )
    return out.select("row.*", mixed.alias(common.free(docs, "mix")[0]))


def in_order(mixed: DataFrame) -> DataFrame:
    """mix's rows sorted into the mixture's order, without the schedule."""
    column = mixed.columns[-1]
    order: list[Column] = [F.col(f"{column}.slot"), F.col(f"{column}.place")]
    return mixed.orderBy(*order).drop(column)


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix.*")
