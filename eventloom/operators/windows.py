"""Selections of an event index: date windows, filters, picks, packing.

An index has ``id, t`` (title), ``s`` and ``e`` (first and last day, ``e`` null for one day), ``c`` (categories),
``h`` (time), ``f`` (free), ``x`` (unusual), ``v`` (venue), ``u`` (url); operators use the columns they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.dates import as_day

EVENING = "18:00"


def last_day() -> Column:
    return F.coalesce(F.col("e"), F.col("s"))


def in_window(start, end) -> Column:
    return (F.col("s") <= as_day(end)) & (last_day() >= as_day(start))


def covers_day(day) -> Column:
    return in_window(day, day)


def occurs_on(day) -> Column:
    """Like ``covers_day``, but a container happens on its sessions' days only."""
    on = F.exists("sessions", lambda x: x["date"] == as_day(day))
    return covers_day(day) & ((F.col("kind").eqNullSafe("container") & on) | ~F.col("kind").eqNullSafe("container"))


def listing_order(df: DataFrame) -> DataFrame:
    """By first day, then title as people sort it, then id."""
    return df.orderBy("s", F.collate("t", "UNICODE"), "id")


def upcoming(df: DataFrame, today) -> DataFrame:
    """Without events that are over."""
    return df.where(last_day() >= as_day(today))


def has_category(*categories: str) -> Column:
    return F.arrays_overlap("c", F.array(*map(F.lit, categories)))


def tonight(df: DataFrame, today) -> DataFrame:
    return df.where(covers_day(today) & (F.coalesce(F.col("h") >= EVENING, F.lit(False)) | has_category("nightlife", "music")))


def ahead(df: DataFrame, today, days: int) -> DataFrame:
    return df.where(in_window(today, F.date_add(as_day(today), days)))


def free(df: DataFrame, today, days: int = 30) -> DataFrame:
    return ahead(df, today, days).where(F.col("f").eqNullSafe(True))


def gems(df: DataFrame, today, days: int = 30) -> DataFrame:
    return ahead(df, today, days).where(F.col("x").eqNullSafe(True))


def of_category(df: DataFrame, category: str, today, days: int = 14) -> DataFrame:
    return ahead(df, today, days).where(F.array_contains("c", category))


def feed_filter(df: DataFrame, categories: list[str] | None = None, free_only: bool = False) -> DataFrame:
    if categories:
        df = df.where(has_category(*categories))
    return df.where(F.col("f").eqNullSafe(True)) if free_only else df


def weighted_pick(df: DataFrame, order: list, weight: Column, roll: float) -> DataFrame:
    """The first row whose running weight exceeds ``roll`` times the total; the last row if none does.

    Weights are summed for each value of the first order column before rows are ordered within one value,
    so only the days' sums, not all rows, pass through one task.
    """
    first, *rest = order
    rows = df.withColumn("_w", weight)
    groups = rows.groupBy(first).agg(F.sum("_w").alias("_g"))
    every = Window.partitionBy()
    before = groups.select(
        first,
        (F.sum("_g").over(Window.orderBy(first)) - F.col("_g")).alias("_before"),
        F.sum("_g").over(every).alias("_total"),
        F.max(first).over(every).alias("_last"),
        F.col("_g"),
    )
    target = F.lit(float(roll)) * F.col("_total")
    chosen = before.where(((F.col("_before") <= target) & (target < F.col("_before") + F.col("_g"))) | ((target >= F.col("_total")) & (F.col(first) == F.col("_last"))))
    within = Window.orderBy(*rest)
    # one group's rows: those of one day
    day = rows.join(F.broadcast(chosen.select(first, "_before", target.alias("_target"))), first)
    day = day.withColumn("_run", F.col("_before") + F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    hit = day.withColumn("_past", F.col("_run") > F.col("_target"))
    return hit.orderBy(F.desc("_past"), F.when(F.col("_past"), F.col("_run")).otherwise(-F.col("_run"))).limit(1).drop("_w", "_before", "_target", "_run", "_past")


def pack_prefix(df: DataFrame, keys: list[str], order: list, size: Column, most: int) -> DataFrame:
    """For each key, rows in order while the sizes, one more for each, sum to ``most`` or less."""
    run = F.sum(size + 1).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_run", run).where(F.col("_run") <= most).drop("_run")


def chunked(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """``chunk``: numbers of runs of ``size`` rows within each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("chunk", F.floor((at - 1) / size))


def first_of(df: DataFrame, keys: list[str], order: list, most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def split_lines(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters, cut at line ends; longer lines are cut hard."""
    hard = lambda line: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(line) / most).cast("int") - 1)), lambda i: F.substring(line, i * most + 1, F.lit(most))
    )
    pieces = F.flatten(F.transform(F.split(text, "\n"), hard))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, piece: Column) -> Column:
        empty = a["open"] == ""
        fits = F.length(a["open"]) + 1 + F.length(piece) <= most
        done = F.when(empty | fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        return F.struct(done.alias("done"), F.when(empty, piece).when(fits, F.concat(a["open"], F.lit("\n"), piece)).otherwise(piece).alias("open"))

    packed = F.aggregate(pieces, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)
