"""References to records that are missing, deleted or arrive later.

The operator keeps keyed state and takes one batch of changes at a time:

* new references probe the index of live parents as of their own time;
* arriving parents resolve references that wait for them;
* deletions of the last live parent reopen the references to it;
* counts of waiting references are snapshot at the end of each period.

State is three tables, never a blob per key, so that a key holding a third of
all references is rows of a table like any other, and it is only appended to:

``live``    (target, key, n)            changes of the number of live parents; a key's sum counts
``later``   (target, key, at, delta)    changes already announced for a later time
``refs``    (ref_table, row_id, target, key, at, orphan)   the references seen

Whether a reference waits follows from its key's sum, so a batch rewrites no
reference and writes a row for the keys it touches alone; the references of
keys whose liveness turned are looked up, not scanned into a new state.

Within a batch, liveness is a running sum of +1 (arrival) and -1 (deletion)
per key. A hot key isn't put into one window: the sum runs inside (key, day)
and the total of earlier days, from a table pre-aggregated to one row per key
and day, is added by a join on the same partitioning.

Defined cases: a null reference is no reference; a blank reference is one, to
the empty key; a null time of reference gives no case; a parent without start
is never live; a parent whose end isn't after its start is never live; rows
delivered twice count once in the results; empty tables give empty results;
further columns of the inputs are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..plans.shared import materialize

REFS = "ref_table string, row_id bigint, target string, key string, at timestamp"
#: A touched key's references are spread over so many join keys.
SALTS = 16


@dataclass
class Increment:
    """What one batch adds: its changes per key and moment, announcements still open, and its references with their flag."""

    now: DataFrame
    later: DataFrame
    found: DataFrame

    @property
    def touched(self) -> DataFrame:
        return self.now.groupBy("target", "key").agg(F.sum("delta").alias("delta"))

    def kept(self, tag: str = "orphans") -> "Increment":
        """The increment written to the shared folder: the next batch then starts from tables."""
        return Increment(*(materialize(d, f"{tag}-{n}") for n, d in (("now", self.now), ("later", self.later), ("refs", self.found))))


@dataclass
class OrphanState:
    live: DataFrame
    later: DataFrame
    refs: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "OrphanState":
        return OrphanState(
            spark.createDataFrame([], "target string, key string, n bigint"),
            spark.createDataFrame([], "target string, key string, at timestamp, delta bigint"),
            spark.createDataFrame([], REFS + ", orphan boolean"),
        )

    def plus(self, more: Increment) -> "OrphanState":
        return OrphanState(self.live.unionByName(more.touched.select("target", "key", F.col("delta").alias("n"))), more.later, self.refs.unionByName(more.found))

    def compacted(self, tag: str = "orphans") -> "OrphanState":
        """One row per key instead of one per batch and key; once in many batches."""
        return OrphanState(materialize(_counts(self.live).where("n <> 0"), f"{tag}-live"), self.later, self.refs)

    def waiting(self) -> DataFrame:
        """The references whose target isn't live now."""
        live = _counts(self.live).where("n > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return _salted(self.refs, F.col("row_id")).join(live, ["target", "key", "salt"], "left_anti").drop("salt")


def _counts(live: DataFrame) -> DataFrame:
    return live.groupBy("target", "key").agg(F.sum("n").alias("n"))


def references(df: DataFrame, ref_table: str, row_id: str, ref: str, at: str, target: str) -> DataFrame:
    """Rows of a referring table in the operator's form, each (row, key, time) once."""
    return (
        df.select(F.lit(ref_table).alias("ref_table"), F.col(row_id).cast("bigint").alias("row_id"), F.lit(target).alias("target"), clean_id(ref).alias("key"), F.col(at).cast("timestamp").alias("at"))
        .where("key is not null and at is not null")
        .distinct()
    )


def parents(df: DataFrame, target: str, key: str, start: str, end: str) -> DataFrame:
    """Lifetimes of a referred table: (target, key, live_from, live_until)."""
    return df.select(F.lit(target).alias("target"), clean_id(key).alias("key"), F.col(start).cast("timestamp").alias("live_from"), F.col(end).cast("timestamp").alias("live_until")).where(
        "key is not null and live_from is not null and (live_until is null or live_until > live_from)"
    )


def changes(lifetimes: DataFrame) -> DataFrame:
    """+1 at each arrival, -1 at each deletion, summed per moment and key."""
    both = F.array(
        F.struct(F.col("live_from").alias("at"), F.lit(1).cast("bigint").alias("delta")),
        F.struct(F.col("live_until").alias("at"), F.lit(-1).cast("bigint").alias("delta")),
    )
    return lifetimes.select("target", "key", F.inline(both)).where("at is not null").groupBy("target", "key", "at").agg(F.sum("delta").alias("delta"))


def probe(refs: DataFrame, deltas: DataFrame, carried: DataFrame) -> DataFrame:
    """``refs`` with ``orphan``: no parent of the key is live at the row's time."""
    day = F.date_trunc("day", "at")
    keys = ["target", "key", "day"]
    steps = deltas.withColumn("day", day)
    per_day = steps.groupBy(*keys).agg(F.sum("delta").alias("d"))
    per_day = per_day.unionByName(refs.select("target", "key", day.alias("day"), F.lit(0).cast("bigint").alias("d")))
    per_day = per_day.unionByName(carried.select("target", "key", F.lit(datetime(1, 1, 1)).cast("timestamp").alias("day"), F.col("n").alias("d")))
    before = Window.partitionBy("target", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_day.groupBy(*keys).agg(F.sum("d").alias("d")).withColumn("carry", F.coalesce(F.sum("d").over(before), F.lit(0))).drop("d")
    events = steps.select(*keys, "at", "delta", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("bigint").alias("row_id")).unionByName(
        refs.select("target", "key", day.alias("day"), "at", F.lit(0).cast("bigint").alias("delta"), "ref_table", "row_id")
    )
    until = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("run", F.sum("delta").over(until)).where("ref_table is not null")
    return seen.join(carry, keys, "left").select("ref_table", "row_id", "target", "key", "at", (F.coalesce("carry", F.lit(0)) + F.col("run") <= 0).alias("orphan"))


def _salted(df: DataFrame, by: Column) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.hash(by), F.lit(SALTS)))


def advance(state: OrphanState, new_refs: DataFrame, new_parents: DataFrame, before: datetime | None = None) -> tuple[Increment, DataFrame]:
    """One batch. Returns what it adds to the state (``state.plus``), with the batch's references and
    their ``orphan`` flag, and the older references that it resolves (``waiting`` false: a parent
    arrived) or reopens (true: the last one was deleted).

    A reference must come in the batch that covers its time; changes of parents that lie at or after
    ``before`` wait in the state. None takes everything.
    """
    every = state.later.unionByName(changes(new_parents)).groupBy("target", "key", "at").agg(F.sum("delta").alias("delta"))
    now = every if before is None else every.where(F.col("at") < F.lit(before))
    later = every.limit(0) if before is None else every.where(F.col("at") >= F.lit(before))
    touched = now.groupBy("target", "key").agg(F.sum("delta").alias("delta"))
    keys = touched.select("target", "key").union(new_refs.select("target", "key")).distinct()
    live = _counts(state.live.join(keys, ["target", "key"], "left_semi"))  # of the batch's keys alone
    found = probe(new_refs, now, live)
    n, after = F.coalesce("n", F.lit(0)), F.coalesce("n", F.lit(0)) + F.col("delta")
    turned = touched.join(live, ["target", "key"], "left").where((n <= 0) != (after <= 0)).select("target", "key", (after <= 0).alias("waiting"))
    spread = turned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    moved = _salted(state.refs, F.col("row_id")).join(spread, ["target", "key", "salt"]).select("ref_table", "row_id", "target", "key", "waiting")
    return Increment(now, later, found), moved


def batches(refs: DataFrame, lifetimes: DataFrame, unit: str = "year") -> Iterator[tuple[OrphanState, Increment, DataFrame, datetime]]:
    """Runs the operator over periods: (state before, increment, references moved, end of the period) of
    each period in which anything happens, in order. Inputs are cut by period once, so a batch reads its own part."""
    spark = refs.sparkSession
    start = lambda c: F.date_trunc(unit, c)
    r = materialize(refs.withColumn("_period", F.date_format(start("at"), "yyyy-MM-dd")), "references", "_period")
    p = materialize(lifetimes.withColumn("_period", F.date_format(start("live_from"), "yyyy-MM-dd")), "lifetimes", "_period")
    ends = p.where("live_until is not null").select(F.date_format(start("live_until"), "yyyy-MM-dd").alias("_period"))
    periods = sorted(x[0] for x in r.select("_period").union(p.select("_period")).union(ends).distinct().collect())  # one row per period
    state = OrphanState.empty(spark)
    step = {"year": "1 year", "quarter": "3 months", "month": "1 month"}[unit]
    for k in periods:
        end = spark.range(1).select((F.lit(k).cast("timestamp") + F.expr(f"interval {step}")).alias("t")).first()[0]
        more, moved = advance(state, r.where(F.col("_period") == k).drop("_period"), p.where(F.col("_period") == k).drop("_period"), end)
        more = more.kept()
        yield state, more, moved, end
        state = state.plus(more)


def waiting_counts(state: OrphanState, more: Increment, now: DataFrame, period: str = "month") -> DataFrame:
    """(ref_table, period, step): by how much the number of waiting references changes in each period of a
    batch. Keys that the batch doesn't touch can't change; the others start from the state."""
    keys = now.select("target", "key").union(more.found.select("target", "key")).distinct()
    live = _counts(state.live.join(keys, ["target", "key"], "left_semi")).select("target", "key", F.col("n").alias("delta"))
    held = state.refs.join(keys, ["target", "key"], "left_semi").groupBy("target", "key", "ref_table").agg(F.count(F.lit(1)).alias("n"))
    return steps(more.found, now, period, held, live)


def steps(refs: DataFrame, deltas: DataFrame, period: str, held: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """(ref_table, period, step): changes of the number of waiting references per period. ``held``
    (target, key, ref_table, n) and ``live`` (target, key, delta) are what the keys begin with.

    Each key contributes a row per period in which anything happened to it; its
    waiting count is carried on as a difference, so no key is filled up over
    quiet periods.
    """
    unit, zero = F.date_trunc(period, "at").alias("period"), F.lit(0).cast("bigint")
    first = F.lit(datetime(1, 1, 1)).cast("timestamp").alias("period")
    kinds = refs.select("target", "ref_table")
    kinds = (kinds if held is None else kinds.union(held.select("target", "ref_table"))).distinct()
    moves = refs.select("target", "key", "ref_table", unit, F.lit(1).cast("bigint").alias("n"), zero.alias("delta")).unionByName(
        deltas.join(F.broadcast(kinds), "target").select("target", "key", "ref_table", unit, zero.alias("n"), "delta")  # a row per pair of tables
    )
    if held is not None:
        moves = moves.unionByName(held.select("target", "key", "ref_table", first, "n", zero.alias("delta")))
        moves = moves.unionByName(live.join(F.broadcast(kinds), "target").select("target", "key", "ref_table", first, zero.alias("n"), "delta"))
    moves = moves.groupBy("target", "ref_table", "key", "period").agg(F.sum("n").alias("n"), F.sum("delta").alias("delta"))
    key = Window.partitionBy("target", "ref_table", "key").orderBy("period")
    run = key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_now = F.when(F.sum("delta").over(run) <= 0, F.sum("n").over(run)).otherwise(F.lit(0))
    step = moves.withColumn("open", open_now).withColumn("step", F.col("open") - F.coalesce(F.lag("open").over(key), F.lit(0)))
    return step.where(F.col("period") != first).groupBy("ref_table", "period").agg(F.sum("step").alias("step"))


def running(step: DataFrame) -> DataFrame:
    """(ref_table, period, waiting) of the steps: a row per table and period reaches the window."""
    total = Window.partitionBy("ref_table").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return step.select("ref_table", "period", F.sum("step").over(total).alias("waiting"))
