"""Work along an order that no single task could hold: ranks over ranges, and points joined to the spans that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.written import written_once

BIN = 1 << 16  # places that one task sweeps together


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with `place`, from 1, of each row within its group in the order of the columns. Rows that are equal in all of them get different places in no fixed order.

    The rows are sorted over ranges of (group, order) and written once, with their partition and their number in it. The sizes of the written partitions, a row each, give each partition's start; the least number of a group is where its ranks begin. No partition holds more than its range, however large a group is."""
    sorted_ = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    whole = written_once(sorted_.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_id", 33), "_own": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "ranked")
    sizes = whole.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))  # a row a partition
    numbered = whole.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.col("_own"))
    firsts = numbered.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first"))
    return numbered.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).withColumn("place", F.col("_at") - F.col("_first") + 1).drop("_part", "_own", "_start", "_at", "_group", "_first")


def within_spans(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, length: str, *carried: str) -> DataFrame:
    """points (key, at, ...) with the carried columns of the span of the same key that holds them: start <= at < start + length. Null where none does. The spans of a key don't overlap; empty ones hold nothing.

    Spans are dealt to the bins of BIN places that they reach into, with their start cut to the bin's; points and spans meet under (key, bin) and one sweep in the order of places carries the last span that began. The work is linear in points and spans, and a task has at most what one bin holds, so that a key of any length is dealt over many."""
    own = [c for c in points.columns if c not in (key, at)]
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    bin_of = lambda x: F.floor(x / BIN)
    end = F.col(start) + F.col(length)
    reach = spans.where(F.col(length) > 0).select(key, F.col(start).cast("long").alias("_start"), end.cast("long").alias("_end"), F.struct(*carried).alias("_span"), F.explode(F.sequence(bin_of(F.col(start)), bin_of(end - 1))).alias("_bin"))
    begun = reach.select(key, "_bin", F.greatest("_start", F.col("_bin") * BIN).alias("_at"), F.lit(0).alias("_kind"), F.struct("_end", "_span").alias("_open"), *(nothing(points, c) for c in own))
    asked = points.select(key, bin_of(F.col(at)).alias("_bin"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(begun.schema["_open"].dataType).alias("_open"), *own)
    sweep = Window.partitionBy(key, "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = begun.union(asked).withColumn("_last", F.last("_open", ignorenulls=True).over(sweep)).where("_kind = 1")
    held: Column = F.col("_last._end") > F.col("_at")
    return last.select(key, F.col("_at").alias(at), *own, *(F.when(held, F.col(f"_last._span.{c}")).alias(c) for c in carried))


def runs_within_spans(runs: DataFrame, spans: DataFrame, key: str, low: str, high: str, start: str, length: str, *carried: str) -> DataFrame:
    """All places of runs (key, low, high, both in it; one run a key) joined to the spans that hold them, as within_spans joins single points, with a row for each stretch of places that one span holds or none does: key, low, high and the carried columns, null where no span holds them. The spans of a key don't overlap; empty ones hold nothing.

    A run without spans is one stretch. The work is linear in spans, however many places they hold."""
    own = runs.where(F.col(low) <= F.col(high)).select(key, F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"))
    reach = spans.where(F.col(length) > 0).select(key, F.col(start).cast("long").alias("_start"), (F.col(start) + F.col(length) - 1).cast("long").alias("_end"), F.struct(*carried).alias("_span"))
    inside = reach.join(own, key).where("_start <= _high AND _end >= _low").select(key, F.greatest("_start", "_low").alias("_at"), F.least("_end", "_high").alias("_to"), "_span")
    ends = own.select(key, F.col("_low").alias("_at"), (F.col("_low") - 1).alias("_to"), F.lit(None).cast(inside.schema["_span"].dataType).alias("_span"), F.col("_high").alias("_high"))
    marks = inside.withColumn("_high", F.lit(None).cast("long")).union(ends)  # each key has one mark of no length, where its run begins
    order = Window.partitionBy(key).orderBy("_at", "_to")
    after = F.coalesce(F.lead("_at").over(order), F.first("_high", ignorenulls=True).over(order) + 1)
    stretches = F.array(F.struct(F.col("_at").alias("low"), F.col("_to").alias("high"), F.col("_span").alias("span")), F.struct((F.col("_to") + 1).alias("low"), (F.col("_next") - 1).alias("high"), F.lit(None).cast(inside.schema["_span"].dataType).alias("span")))
    each = marks.withColumn("_next", after).select(key, F.explode(stretches).alias("x")).where("x.low <= x.high")
    return each.select(key, F.col("x.low").alias(low), F.col("x.high").alias(high), *(F.col(f"x.span.{c}").alias(c) for c in carried))
