"""Keyed state with event-time timers: rows wait in state until the watermark passes them, then a rule takes them in order.

A rule sees each key's rows by event time whatever micro-batches, files or restarts brought them, so a replay gives the same
result as the live stream, and so does a batch job over the same rows. What stays in state is the rows the watermark has
not passed and the rule's own record. Timers wake a key for its earliest waiting row and for the rule's deadline: a
position times out and an order expires although nothing of its key comes any more.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from basisweave.sources.files import kept, landing

# The worker that sets up a stream has Spark's path alone: rules go to it whole, not by the name of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule:
    """What happens to a key's rows. ``row``: the waiting columns after the time in milliseconds; ``held``: the record's columns;
    ``out``: the result's columns after the key's."""

    row: str
    held: str
    out: str

    def advance(self, key: tuple, held: tuple | None, rows: list[tuple], now: int) -> tuple[tuple | None, list[tuple], int | None]:
        """Take ``rows`` in order, then the time ``now``; the new record, results, and the next deadline."""
        raise NotImplementedError


#: Rows that a rule takes at once.
_AT_ONCE = 20_000


def _packed(rows: pa.Table) -> tuple[int, bytes]:
    """The first time of the rows, and the rows as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return pc.min(rows["at_ms"]).as_py(), sink.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """Buffers rows by event time and feeds the rule. A batch of rows is one value of the state, not one a row."""

    def __init__(self, rule: Rule, keys: list[str], names: dict[str, bool], empty: dict[str, str]):
        self.rule, self.keys, self.names, self.empty = rule, keys, names, empty

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, rows binary")
        self.record = handle.getValueState("record", self.rule.held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, blocks = None, []
        for b in rows:
            if len(b):
                # A column of whole numbers with nulls comes as floats.
                table = pa.table({c: pa.array(b[c], pa.int64() if whole and b[c].dtype.kind != "f" else None, from_pandas=True) for c, whole in self.names.items()})
                blocks.append(_packed(table.cast(pa.schema([(f.name, pa.int64() if self.names[f.name] else f.type) for f in table.schema]))))
                first = blocks[-1][0] if first is None else min(first, blocks[-1][0])
        if first is not None:
            self.waiting.appendList(blocks)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        blocks = [tuple(b) for b in self.waiting.get()] if self.waiting.exists() else []
        due, later = [b for b in blocks if b[0] <= now], [b for b in blocks if b[0] > now]
        ready = None
        if due:
            rows = pa.concat_tables([pa.ipc.open_stream(b[1]).read_all() for b in due], promote_options="permissive")
            passed = pc.less_equal(rows["at_ms"], now)
            if (kept := rows.filter(pc.invert(passed))).num_rows:
                later.append(_packed(kept))
            ready = rows.filter(passed)
            ready = ready.take(pc.sort_indices(ready, [(c, "ascending") for c in self.names], null_placement="at_start"))
        held = tuple(self.record.get()) if self.record.exists() else None
        size = ready.num_rows if ready is not None else 0
        deadline = None
        for lo in range(0, max(size, 1), _AT_ONCE):
            part = list(zip(*(c.to_pylist() for c in ready[lo : lo + _AT_ONCE].columns))) if size else []
            # Up to the next row nothing else happens, so a deadline before it is met in this part.
            until = ready["at_ms"][lo + _AT_ONCE].as_py() - 1 if lo + _AT_ONCE < size else now
            held, found, deadline = self.rule.advance(key, held, part, until)
            if found:
                own = dict(zip(self.keys, key))
                values = dict(zip((c for c in self.empty if c not in own), zip(*found)))
                yield pd.DataFrame({c: pd.Series([own[c]] * len(found) if c in own else list(values[c]), dtype=t) for c, t in self.empty.items()})
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if held is not None:
            self.record.update(held)
        elif self.record.exists():
            self.record.clear()
        wake = min((t for t in (deadline, min((b[0] for b in later), default=None)) if t is not None), default=None)
        if wake is not None:
            self.handle.registerTimer(wake)

    def close(self) -> None:
        pass


def _pandas_type(kind: str) -> str:
    return {"bigint": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean"}.get(kind, "object")


def in_order(stream: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """``stream`` (keys, ``at`` with a watermark, ``at_ms`` and the rule's columns) through the rule, key by key."""
    names = {f.name: f.dataType.simpleString() in ("int", "bigint") for f in StructType.fromDDL(f"at_ms long, {rule.row}").fields}
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = StructType.fromDDL(f"{kinds}, {rule.out}")
    empty = {f.name: _pandas_type(f.dataType.simpleString()) for f in schema.fields}
    return stream.groupBy(*keys).transformWithStateInPandas(InOrder(rule, keys, names, empty), schema, "Append", "EventTime")


def replayed(rows: DataFrame, wave: Column, keys: list[str], rule: Rule, delay_ms: int, waves: int = 3, anew_after: int | None = None) -> DataFrame:
    """The rule's results for rows (keys, ``at_ms``, the rule's columns) that land in waves, with the query stopped after each wave and
    started anew from its checkpoint. Rows may land out of order by up to ``delay_ms``; rows within that of the last are still
    waiting in state at the end.

    ``anew_after`` waves the outputs are archived and the query begins again from zero, over all that has landed, with a sink and a
    checkpoint of its own: the result then has ``generation``, 0 for the archive. Nothing is overwritten, so a start that
    fails half-way leaves the archive as it was."""
    spark = rows.sparkSession
    landed, source, sink = kept(rows.withColumn("_wave", wave).withColumn("at", F.timestamp_millis("at_ms")), "rows"), landing(spark, "feed"), landing(spark, "ruled")
    generation = 0
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        for k in range(waves):
            generation += k == anew_after
            part = landed.where(F.col("_wave") == k).drop("_wave")
            part.write.mode("append").parquet(source)
            stream = spark.readStream.schema(part.schema).parquet(source).withWatermark("at", f"{delay_ms} milliseconds")
            out = in_order(stream, keys, rule)
            out.writeStream.outputMode("append").option("checkpointLocation", f"{sink}-state-{generation}").format("parquet").option("path", f"{sink}/generation={generation}").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    # Each generation by its own sink, whose log names the files of committed batches alone.
    each = [spark.read.schema(out.schema).parquet(f"{sink}/generation={g}").withColumn("generation", F.lit(g)) for g in range(generation + 1)]
    return each[0].drop("generation") if anew_after is None else each[0].unionByName(each[1])


@dataclass
class Trader(Rule):
    """The trading rule of one series, a row at a time.

    Step t is at ``zero_ms`` + t * ``step_ms``; z is the last spread against the last ``w``. From the ``warmup``-th row on, a flat trader enters against |z| >= ``entry`` where the
    deviation is ``min_std`` or more and ``cooldown`` steps have passed since it left; it leaves where z is within ``exit``, or
    ``max_hold`` steps after it entered, at the last spread by then, whether or not a row comes."""

    zero_ms: int
    step_ms: int
    w: int = 20
    min_periods: int = 6
    warmup: int = 10
    entry: float = 1.5
    exit: float = 0.5
    max_hold: int = 12
    cooldown: int = 2
    min_std: float = 0.0

    row = "t long, s double"
    held = "n long, recent array<double>, d int, t0 long, s0 double, free long"
    out = "entry long, exit long, direction int, entry_spread double, exit_spread double, reason string"

    def advance(self, key, held, rows, now):
        n, recent, d, t0, s0, free = (held[0], list(held[1]), *held[2:]) if held is not None else (0, [], 0, None, None, None)
        found: list[tuple] = []

        def leave(at: int, spread: float, why: str) -> None:
            nonlocal d, t0, s0, free
            found.append((t0, at, d, s0, spread, why))
            d, free, t0, s0 = 0, at + 1 + self.cooldown, None, None

        for _, t, s in rows:
            if s is None:
                continue
            if d and t > t0 + self.max_hold:
                leave(t0 + self.max_hold, recent[-1], "timeout")
            recent = [*recent, s][-self.w :]
            n += 1
            sd = float(np.std(recent, ddof=1)) if len(recent) >= max(2, self.min_periods) else 0.0
            z = (s - float(np.mean(recent))) / sd if sd > 0 else None
            known = z is not None and n >= self.warmup
            if d:
                if known and (z >= -self.exit if d == 1 else z <= self.exit):
                    leave(t, s, "signal")
                elif t == t0 + self.max_hold:
                    leave(t, s, "timeout")
            elif known and abs(z) >= self.entry and sd >= self.min_std and (free is None or t >= free):
                d, t0, s0 = (-1 if z > 0 else 1), t, s
        deadline = None
        if d:
            deadline = self.zero_ms + (t0 + self.max_hold) * self.step_ms
            if deadline <= now:
                leave(t0 + self.max_hold, recent[-1], "timeout")
                deadline = None
        return (n, recent, d, t0, s0, free), found, deadline


@dataclass
class Fills(Rule):
    """Resting orders of one side of one instrument, each filled by the first price after it that crosses, or given up after ``wait_ms``.

    The key's last part is the side, buy or sell. Rows: a price (no order id), or an order with its limit. A price takes no
    order placed at its own time."""

    wait_ms: int
    row = "order_id long, price double"
    held = "ids array<long>, placed array<long>, limits array<double>"
    out = "order_id long, placed_ms long, filled_ms long"

    def advance(self, key, held, rows, now):
        buy = key[-1] == "buy"
        open_ = {i: (p, x) for i, p, x in zip(*held)} if held is not None else {}
        found: list[tuple] = []
        for at, order, price in rows:  # at equal times prices, whose id is null, come first
            if order is not None:
                open_[order] = (at, price)
                continue
            for i in [i for i, (p, x) in open_.items() if p + self.wait_ms < at or (price <= x if buy else price >= x)]:
                placed, _ = open_.pop(i)
                found.append((i, placed, at if placed + self.wait_ms >= at else None))
        for i in [i for i, (p, _) in open_.items() if p + self.wait_ms <= now]:
            found.append((i, open_.pop(i)[0], None))
        deadline = min((p + self.wait_ms for p, _ in open_.values()), default=None)
        left = (list(open_), [p for p, _ in open_.values()], [x for _, x in open_.values()]) if open_ else None
        return left, found, deadline


@dataclass
class Pairing(Rule):
    """The last price of two feeds at every tick of either, with the age of the older one in seconds."""

    row = "us long, event_id long, second boolean, mid double"
    held = "mid_a double, at_a long, mid_b double, at_b long"
    out = "event_id long, mid_a double, mid_b double, age long"

    def advance(self, key, held, rows, now):
        a, ta, b, tb = held if held is not None else (None,) * 4
        found = []
        for at, _, event, second, mid in rows:
            if second:
                b, tb = mid, at
            else:
                a, ta = mid, at
            if a is not None and b is not None:
                found.append((event, a, b, at // 1000 - min(ta, tb) // 1000))
        return (a, ta, b, tb), found, None


@dataclass
class Stalls(Rule):
    """Silences of a feed: raised by a timer ``gap_ms`` after its last tick, before the tick that ends it is there."""

    gap_ms: int
    row = "n long"
    held = "last long, raised boolean"
    out = "last_ms long, raised_ms long"

    def advance(self, key, held, rows, now):
        last, raised = held if held is not None else (None, False)
        found = []
        for at, _ in rows:
            if last is not None and not raised and at - last > self.gap_ms:
                found.append((last, last + self.gap_ms))
            last, raised = at, False
        if last is not None and not raised and last + self.gap_ms < now:
            found.append((last, last + self.gap_ms))
            raised = True
        return (last, raised), found, None if last is None or raised else last + self.gap_ms + 1
