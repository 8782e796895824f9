"""Stateful operators in batch form: eviction by budget, binned recorders, telemetry, notifications and trackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_sum_before(rows: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """rows with before: the sum of value over all rows with a smaller order (a unique integer).

    Slices of order of a fixed width are summed apart and carried by one row per slice, and the slices likewise by one row
    per width slices, so no task sees all rows, nor all slices.
    """
    rows = rows.withColumn("slice_", F.expr(f"({order} - pmod({order}, {width})) div {width}"))
    per = rows.groupBy("slice_").agg(F.sum(value).alias("sum_")).withColumn("span_", F.expr(f"(slice_ - pmod(slice_, {width})) div {width}"))
    spans = per.groupBy("span_").agg(F.sum("sum_").alias("all_"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span_", F.coalesce(F.sum("all_").over(earlier(Window.orderBy("span_"))), F.lit(0)).alias("far_"))  # one row per span
    near = F.coalesce(F.sum("sum_").over(earlier(Window.partitionBy("span_").orderBy("slice_"))), F.lit(0))
    starts = per.withColumn("near_", near).join(spans, "span_").select("slice_", (F.col("far_") + F.col("near_")).alias("start_"))
    inside = Window.partitionBy("slice_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside_", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(starts, "slice_").withColumn("before", F.col("start_") + F.col("inside_")).drop("slice_", "start_", "inside_")


def evicted(cache: DataFrame, leave: int, width: int = 1000) -> DataFrame:
    """sha1, size, before of the victims: unpinned, by ascending acseq (volatile ones are negative), until leave is reached."""
    gauge = cache.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("gauge"))
    rows = with_sum_before(cache.filter("pinned = 0"), "acseq", "size", width)
    return rows.crossJoin(F.broadcast(gauge)).filter(F.col("gauge") - F.col("before") > leave).select("sha1", "size", "before")


def with_newest(rows: DataFrame, value: str, width: int) -> DataFrame:
    """rows with newest: the largest value of the user's rows up to each by event_id (a unique integer).

    A user's events are cut into slices of event_id of a fixed width, so no task sorts or holds all of them; a slice begins
    with the largest value of the earlier ones, from one row per slice.
    """
    rows = rows.withColumn("slice_", F.expr(f"(event_id - pmod(event_id, {width})) div {width}"))
    earlier = Window.partitionBy("user_id").orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("user_id", "slice_").agg(F.max(value).alias("most_")).withColumn("start_", F.max("most_").over(earlier)).select("user_id", "slice_", "start_")
    inside = Window.partitionBy("user_id", "slice_").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inside_", F.max(value).over(inside))
    user = F.col("rows_.user_id").eqNullSafe(F.col("starts_.user_id")) & (F.col("rows_.slice_") == F.col("starts_.slice_"))
    joined = rows.alias("rows_").join(starts.alias("starts_"), user)
    return joined.select("rows_.*", "start_").withColumn("newest", F.greatest("inside_", "start_")).drop("slice_", "inside_", "start_")


def recorded(ticks: DataFrame, resolution: int, capacity: int, width: int = 100_000) -> DataFrame:
    """user_id, bin, n: ticks in arrival order (event_id) in bins; one that is too late for the ring is dropped.

    The ring has the capacity rounded up to whole bins; the newest bin seen so far decides what is late.
    """
    bins = -(-capacity // resolution)
    rows = ticks.select("user_id", "event_id", F.expr(f"t div {resolution}").alias("bin"))
    return with_newest(rows, "bin", width).filter(F.col("newest") - F.col("bin") < bins).groupBy("user_id", "bin").agg(F.count("*").alias("n"))


def looked_back(ticks: DataFrame, recorders: list[tuple[int, int]], back: int, width: int = 100_000) -> DataFrame:
    """user_id, n: ticks within a look-back from each user's last tick, by the first recorder (resolution, capacity) that reaches so far, else the last.

    The newest tick of all is never late, so the last bin is that of all ticks.
    """
    resolution, capacity = next((r for r in recorders if r[1] >= back), recorders[-1])
    bins = recorded(ticks, resolution, capacity, width)
    newest = ticks.groupBy("user_id").agg(F.max(F.expr(f"t div {resolution}")).alias("newest"))
    return bins.join(newest, "user_id").filter(F.col("newest") - F.col("bin") < -(-back // resolution)).groupBy("user_id").agg(F.sum("n").alias("n"))


def rate(ticks: DataFrame, seconds: int) -> DataFrame:
    """event_id, n: ticks of the same user within the last seconds, itself included."""
    last = Window.partitionBy("user_id").orderBy("t").rangeBetween(1 - seconds, 0)
    return ticks.select("event_id", F.count("*").over(last).alias("n"))


def deltas(counters: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Each row with its change since the key's previous row; the first has its whole value."""
    earlier = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return counters.withColumn("delta", F.col(value) - F.coalesce(earlier, F.lit(0)))


def published(messages: DataFrame, key: str, order: str, message: str) -> DataFrame:
    """Messages that differ from their key's last one."""
    earlier = F.lag(message).over(Window.partitionBy(key).orderBy(order))
    return messages.withColumn("last_", earlier).filter(~F.col(message).eqNullSafe(F.col("last_"))).drop("last_")


def subscribed(messages: DataFrame, key: str, order: str, since: int) -> DataFrame:
    """What a subscriber that joins after since gets: each key's message of then, and all later ones."""
    now = messages.filter(F.col(order) <= since).groupBy(key).agg(F.max(order).alias(order))
    return messages.join(now, [key, order], "left_semi").unionByName(messages.filter(F.col(order) > since))


def rising(messages: DataFrame, key: str, order: str, revision: str) -> DataFrame:
    """Messages with a revision above all that their key saw before."""
    seen = F.max(revision).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("seen_", seen).filter(F.col("seen_").isNull() | (F.col(revision) > F.col("seen_"))).drop("seen_")


def throttled(calls: DataFrame, reset: int, first: int, most: int) -> DataFrame:
    """event_id, delay: the most that a call waits; it doubles while calls of a user follow within reset seconds."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(order) > reset).cast("int"), F.lit(1))
    runs = calls.withColumn("fresh_", fresh).withColumn("run_", F.sum("fresh_").over(order))
    place = F.row_number().over(Window.partitionBy("user_id", "run_").orderBy("t", "event_id"))
    return runs.select("event_id", F.least(F.lit(first) * F.pow(F.lit(2), F.least(place - 1, F.lit(40))), F.lit(most)).cast("long").alias("delay"))


def latest_used(accesses: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """The capacity keys that were used last: a top-k over one row per key."""
    last = accesses.groupBy(key).agg(F.max(order).alias("last"))
    return last.orderBy(F.desc("last"), key).limit(capacity)


def references(changes: DataFrame, key: str, change: str) -> DataFrame:
    """Keys with references left, and how many."""
    return changes.groupBy(key).agg(F.sum(change).alias("references")).filter("references > 0")


def flushes(opens: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Each opening and whether its content differs from that of the key's last opening, so that pages are dropped."""
    earlier = F.lag(content).over(Window.partitionBy(key).orderBy(order))
    return opens.withColumn("flush", F.coalesce(earlier != F.col(content), F.lit(False)))


def tiered(upper: DataFrame, lower: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, copied_up: the upper tier's value, else the lower's, which is copied up."""
    a, b = upper.select(key, F.col(value).alias("u_")), lower.select(key, F.col(value).alias("l_"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("u_", "l_").alias(value), F.col("u_").isNull().alias("copied_up"))


def layered(layers: DataFrame) -> DataFrame:
    """path, entry of stacked layers (layer, path, entry, whiteout): the last layer wins, a whiteout hides all below it.

    A whiteout of a path hides its own and all deeper entries of lower layers: an equi-join on ancestors.
    """
    from treelake.functions.paths import ancestors

    gone = layers.filter("whiteout").groupBy("path").agg(F.max("layer").alias("hides")).withColumnRenamed("path", "above")
    top = layers.filter("not whiteout").groupBy("path").agg(F.max_by("entry", "layer").alias("entry"), F.max("layer").alias("layer"))
    up = top.select("path", "layer", F.explode(ancestors(F.col("path"))).alias("above"))
    hidden = up.join(gone, "above").filter("hides > layer").select("path").distinct()
    return top.join(hidden, "path", "left_anti").select("path", "entry")


def chain_ids(layers: Column) -> Column:
    """Identity of a chain of layers: a digest folded over them in order."""
    return F.aggregate(layers, F.lit(""), lambda acc, x: F.sha2(F.concat(acc, F.lit(" "), x), 256))


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """key, batch, items: the rows of a key in batches of size, in order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = rows.withColumn("batch", F.floor(place / size).cast("long"))
    return rows.groupBy(key, "batch").agg(F.array_join(F.array_sort(F.collect_list(F.col(order).cast("string"))), " ").alias("items"))


def packed(objects: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Objects of each pack with their offset in its payload."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))
