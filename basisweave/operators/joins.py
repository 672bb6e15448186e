"""As-of, tolerance and interval joins without range scans of whole groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _carried(rows: DataFrame, keys: list[str], last: dict[str, Column]) -> DataFrame:
    """``rows`` (keys, _chunk) with what each chunk of a key takes over from those before it, a column for each of ``last``, which gives
    the last value inside a chunk. What is ranked in one task is a row a chunk."""
    per = rows.groupBy(*keys, "_chunk").agg(*(c.alias(n) for n, c in last.items()))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    seams = per.select(*keys, "_chunk", *(F.last(n, ignorenulls=True).over(before).alias(n) for n in last))
    return rows.join(seams, [*keys, "_chunk"])


def asof(left: DataFrame, right: DataFrame, keys: Iterable[str], order: str, values: Iterable[str], tolerance: float | None = None, suffix: str = "_asof", chunk: float | None = None) -> DataFrame:
    """Each left row with the last right row at or before it, by key. One shuffle of the union, one sorted pass, no pairs.

    ``order`` is numeric; a match older than ``tolerance`` counts as none; of right rows at one time the one of greatest values
    counts. ``chunk`` cuts each key into ranges of that length, which are sorted apart, and carries the last right row over the
    seams: then neither a hot key nor a long history is one task.
    """
    keys, values = list(keys), list(values)
    struct = F.struct(F.col(order).alias("at"), *values)
    empty = right.select(struct.alias("r")).schema["r"].dataType
    l = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(empty)})  # noqa: E741
    r = right.select(*keys, order, F.lit(0).alias("_side"), struct.alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    if chunk is None:
        part, before = keys, F.lit(None).cast(empty)
    else:
        both = _carried(both.withColumn("_chunk", F.floor(F.col(order) / chunk)), keys, {"_before": F.max("_r")})
        part, before = [*keys, "_chunk"], F.col("_before")
    w = Window.partitionBy(*part).orderBy(order, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_r", F.coalesce(F.last("_r", ignorenulls=True).over(w), before)).where("_side = 1").drop("_side", "_chunk", "_before")
    fresh = F.lit(True) if tolerance is None else F.col(order) - F.col("_r.at") <= tolerance
    return found.withColumns({f"{v}{suffix}": F.when(fresh, F.col(f"_r.{v}")) for v in values}).withColumn(f"{order}{suffix}", F.when(fresh, F.col("_r.at"))).drop("_r")


def open_at(intervals: DataFrame, start: str, stop: str, step: int = 1, out: str = "bar") -> DataFrame:
    """A row per grid bar that lies in [start, stop): an equi-joinable form of the interval join; integers on the grid."""
    first = F.ceil(F.col(start) / step) * step
    return intervals.where(F.col(stop) > first).withColumn(out, F.explode(F.sequence(first, F.col(stop) - 1, F.lit(step).cast("long"))))


def pair_last_ticks(ticks: DataFrame, keys: Iterable[str], side: str, a: str, b: str, chunk: int = 86_400) -> DataFrame:
    """On each tick, the last price of both sides once both were seen. Keys are cut into ``chunk`` seconds, with both last prices
    carried over the seams."""
    keys = list(keys)
    tick = lambda v: F.when(F.col(side) == v, F.struct("ts", "event_id", "mid"))
    cut = ticks.where(F.col(side).isin(a, b)).withColumn("_chunk", F.floor(F.unix_timestamp("ts") / chunk))
    cut = _carried(cut, keys, {"_before_a": F.max(tick(a)), "_before_b": F.max(tick(b))})
    w = Window.partitionBy(*keys, "_chunk").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda v, before: F.coalesce(F.last(tick(v), ignorenulls=True).over(w), F.col(before))
    both = cut.withColumns({"_a": last(a, "_before_a"), "_b": last(b, "_before_b")}).where("_a is not null and _b is not null")
    return both.withColumns({"mid_a": F.col("_a.mid"), "mid_b": F.col("_b.mid"), "age_a": F.unix_timestamp("ts") - F.unix_timestamp("_a.ts"), "age_b": F.unix_timestamp("ts") - F.unix_timestamp("_b.ts")}).drop("_a", "_b", "_chunk", "_before_a", "_before_b")
