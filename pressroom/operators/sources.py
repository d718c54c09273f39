"""Rules that turn a source's crawl history into its health and its next interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LEAST_MINUTES, MOST_MINUTES = 30, 1440
DEGRADED_AT, PAUSED_AT = 5, 15
LOW_AFTER, ARCHIVED_AFTER = 30, 90
#: Text that a restored source must serve.
PROBE_CHARS = 500
#: Shares of a day's articles, and of a weekday's, below which a crawl is not worth it.
QUIET_HOUR, QUIET_WEEKEND = 0.02, 0.3
#: Logs of a source that are folded in one row.
STRETCH = 10_000


def discovery_rate(new: Column, found: Column) -> Column:
    return F.when(found > 0, new / found).otherwise(0.0)


def next_interval(minutes: Column, rate: Column) -> Column:
    scaled = lambda by: (minutes.cast("double") * by).cast("int")
    return (
        F.when(rate > 0.5, F.greatest(F.lit(LEAST_MINUTES), scaled(0.7)))
        .when(rate > 0.1, minutes)
        .when(rate > 0, F.least(F.lit(MOST_MINUTES), scaled(1.5)))
        .otherwise(F.least(F.lit(MOST_MINUTES), minutes * 2))
        .cast("int")
    )


def next_crawl_at(base: Column, minutes: Column, errors: Column) -> Column:
    """base plus the interval, doubled for every error in a row, ten at most."""
    wait = minutes * F.pow(F.lit(2), F.least(errors, F.lit(10)))
    return (base + F.make_dt_interval(mins=wait.cast("int"))).cast("timestamp")


def _stretches(logs: DataFrame, *columns: str) -> DataFrame:
    """source_id, part, stretch, log: the logs of a source in order (started_at, id), STRETCH at most a row.

    Logs are range-partitioned, so a large source lies in many partitions; parts follow each other, and so do the stretches of a part.
    """
    order = ["source_id", "started_at", "id"]
    placed = logs.select(*order, *columns).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("source_id", "part").orderBy("started_at", "id"))
    stretches = placed.withColumn("stretch", F.floor((number - 1) / STRETCH)).groupBy("source_id", "part", "stretch")
    return stretches.agg(F.array_sort(F.collect_list(F.struct("started_at", "id", *columns))).alias("log"))


def _composed(logs: DataFrame, columns: tuple[str, ...], nothing: Column, step, after) -> DataFrame:
    """source_id, f: what all logs of a source together do to any state before them.

    `step` adds a log to such a function, `after(f, g)` is f followed by g, and `nothing` changes no state. Stretches are folded each by itself, then those of a
    part, then the parts of a source: three rounds for logs of any length, and a row holds what one partition, or one shuffle, has of stretches.
    """
    order = lambda place: F.array_sort(F.collect_list(F.struct(place, "f")))
    joined = lambda found: F.aggregate(found, nothing, lambda f, x: after(f, x["f"])).alias("f")
    each = _stretches(logs, *columns).select("source_id", "part", "stretch", F.aggregate("log", nothing, step).alias("f"))
    parts = each.groupBy("source_id", "part").agg(order("stretch").alias("found")).select("source_id", "part", joined("found"))
    return parts.groupBy("source_id").agg(order("part").alias("found")).select("source_id", joined("found"))


def _bound(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _health_nothing() -> Column:
    """What logs do to health, as columns of a struct.

    head: times of the first errors before any success, PAUSED_AT at most; leading: how many errors come before any success; good: whether there was one; tail: errors since the last one.
    degraded_at, paused_at: last time that errors after a success reached the limit; fresh: whether a crawl found something new; idle: crawls since then.
    """
    never = F.lit(None).cast("timestamp")
    return F.struct(
        F.array().cast("array<timestamp>").alias("head"), F.lit(0).alias("leading"), F.lit(False).alias("good"), F.lit(0).alias("tail"),
        never.alias("degraded_at"), never.alias("paused_at"), F.lit(False).alias("fresh"), F.lit(0).alias("idle"),
    )


def _health_step(f: Column, x: Column) -> Column:
    good = F.coalesce(x["status"] == "success", F.lit(False))
    first = ~good & ~f["good"]
    tail = F.when(good, 0).when(f["good"], f["tail"] + 1).otherwise(0)
    reached = lambda limit: ~good & f["good"] & (f["tail"] + 1 == limit)
    fresh = good & F.coalesce(x["articles_new"] > 0, F.lit(False))
    return F.struct(
        F.when(first & (F.size(f["head"]) < PAUSED_AT), F.array_append(f["head"], x["started_at"])).otherwise(f["head"]).alias("head"),
        (f["leading"] + first.cast("int")).alias("leading"),
        (f["good"] | good).alias("good"),
        tail.alias("tail"),
        F.when(reached(DEGRADED_AT), x["started_at"]).otherwise(f["degraded_at"]).alias("degraded_at"),
        F.when(reached(PAUSED_AT), x["started_at"]).otherwise(f["paused_at"]).alias("paused_at"),
        (f["fresh"] | fresh).alias("fresh"),
        F.when(fresh, 0).otherwise(f["idle"] + 1).alias("idle"),
    )


def _health_after(f: Column, g: Column) -> Column:
    # Errors at the head of g go on from those at the tail of f, if f knows where those began.
    reached = lambda limit: F.when(f["tail"] < limit, F.get(g["head"], limit - 1 - f["tail"]))
    when = lambda name, limit: F.coalesce(g[name], F.when(f["good"], reached(limit)), f[name]).alias(name)
    return F.struct(
        F.when(f["good"], f["head"]).otherwise(F.slice(F.concat(f["head"], g["head"]), 1, PAUSED_AT)).alias("head"),
        (f["leading"] + F.when(f["good"], 0).otherwise(g["leading"])).alias("leading"),
        (f["good"] | g["good"]).alias("good"),
        F.when(g["good"], g["tail"]).when(f["good"], f["tail"] + g["leading"]).otherwise(0).alias("tail"),
        when("degraded_at", DEGRADED_AT),
        when("paused_at", PAUSED_AT),
        (f["fresh"] | g["fresh"]).alias("fresh"),
        F.when(g["fresh"], g["idle"]).otherwise(f["idle"] + g["idle"]).alias("idle"),
    )


def health(logs: DataFrame) -> DataFrame:
    """source_id, status, consecutive_errors, days_without_new, degraded_at, paused_at after all logs; one success heals.

    days_without_new counts crawls without new articles, as the rules that read it do. Sources start active, without errors.
    """
    out = _composed(logs, ("status", "articles_new"), _health_nothing(), _health_step, _health_after)
    f = lambda name: F.col(f"f.{name}")
    errors = F.when(f("good"), f("tail")).otherwise(f("leading"))
    return out.select(
        "source_id",
        F.when(errors >= PAUSED_AT, "paused").when(errors >= DEGRADED_AT, "degraded").otherwise("active").alias("status"),
        errors.alias("consecutive_errors"),
        f("idle").alias("days_without_new"),
        F.coalesce(f("degraded_at"), F.get(f("head"), DEGRADED_AT - 1)).alias("degraded_at"),
        F.coalesce(f("paused_at"), F.get(f("head"), PAUSED_AT - 1)).alias("paused_at"),
    )


def _merged(values: Column, least: Column) -> Column:
    """An interval function as struct of its values, in order, and the least interval that leads to each; equal values are put together."""
    pairs = F.zip_with(values, least, lambda value, low: F.struct(value.alias("value"), low.alias("least")))
    first = _bound(pairs, lambda p: F.filter(p, lambda x, i: (i == 0) | (x["value"] != F.get(p, F.greatest(i - 1, F.lit(0)))["value"])))
    return _bound(first, lambda p: F.struct(F.transform(p, lambda x: x["value"]).alias("value"), F.transform(p, lambda x: x["least"]).alias("least")))


def _at(function: Column, minutes: Column) -> Column:
    """Value of an interval function."""
    return F.element_at(function["value"], F.size(F.filter(function["least"], lambda least: least <= minutes)))


def frequency(logs: DataFrame, first_interval: int = 240, alpha: float = 0.3) -> DataFrame:
    """source_id, interval_minutes, average_new, crawl_count after replaying successes in order; first_interval: from LEAST_MINUTES to MOST_MINUTES.

    An interval never falls when the one before rises, so what logs do to it is a rising step function over the minutes; few steps are left after some logs. The
    average is a * before + b; the first two crawls of a source set it, so `from_0` and `from_1` say what follows no crawl, or one.
    """
    if not LEAST_MINUTES <= first_interval <= MOST_MINUTES:
        raise ValueError(f"an interval lies from {LEAST_MINUTES} to {MOST_MINUTES} minutes")
    none = F.lit(None).cast("double")
    every = F.sequence(F.lit(LEAST_MINUTES), F.lit(MOST_MINUTES))
    nothing = F.struct(F.struct(every.alias("value"), every.alias("least")).alias("minutes"), F.lit(0).alias("count"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), none.alias("from_0"), none.alias("from_1"))

    def step(f: Column, x: Column) -> Column:
        new = x["articles_new"].cast("double")
        onward = lambda before: alpha * new + (1 - alpha) * before
        rate = discovery_rate(x["articles_new"], x["articles_found"])
        moved = _merged(F.transform(f["minutes"]["value"], lambda m: next_interval(m, rate)), f["minutes"]["least"])
        return F.struct(
            F.when((rate > 0.1) & (rate <= 0.5), f["minutes"]).otherwise(moved).alias("minutes"),
            (f["count"] + 1).alias("count"),
            ((1 - alpha) * f["a"]).alias("a"),
            onward(f["b"]).alias("b"),
            F.when(f["count"] <= 1, new).otherwise(onward(f["from_0"])).alias("from_0"),
            F.when(f["count"] == 0, new).otherwise(onward(f["from_1"])).alias("from_1"),
        )

    def after(f: Column, g: Column) -> Column:
        onward = lambda before: g["a"] * before + g["b"]
        moved = _merged(F.transform(f["minutes"]["value"], lambda m: _at(g["minutes"], m)), f["minutes"]["least"])
        return F.struct(
            F.when(f["count"] == 0, g["minutes"]).otherwise(moved).alias("minutes"),
            (f["count"] + g["count"]).alias("count"),
            (f["a"] * g["a"]).alias("a"),
            onward(f["b"]).alias("b"),
            F.when(f["count"] == 0, g["from_0"]).when(f["count"] == 1, g["from_1"]).otherwise(onward(f["from_0"])).alias("from_0"),
            F.when(f["count"] == 0, g["from_1"]).otherwise(onward(f["from_1"])).alias("from_1"),
        )

    out = _composed(logs.where("status = 'success'"), ("articles_new", "articles_found"), nothing, step, after)
    return out.select("source_id", _at(F.col("f.minutes"), F.lit(first_interval)).alias("interval_minutes"), F.col("f.from_0").alias("average_new"), F.col("f.count").alias("crawl_count"))


def daily_health_rules(sources: DataFrame, now: Column) -> DataFrame:
    """Sources after the daily rules, with archived_at and changed: low priority from LOW_AFTER idle crawls, archived from ARCHIVED_AFTER."""
    low = (F.col("status") == "active") & (F.col("days_without_new") >= LOW_AFTER)
    old = F.col("status").isin("active", "degraded") & (F.col("days_without_new") >= ARCHIVED_AFTER)
    changed = F.when(old, "archived").when(low, "priority_low")
    return sources.withColumns(
        {
            "priority": F.when(low, "low").otherwise(F.col("priority")),
            "status": F.when(old, "archived").otherwise(F.col("status")),
            "archived_at": F.when(old, now).otherwise(F.lit(None).cast("timestamp")),
            "changed": changed,
        }
    )


def restore_paused(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """Paused sources whose probe (source_id, http_status, content_chars) answers with enough text are active again, of medium priority."""
    alive = (F.col("http_status") == 200) & (F.col("content_chars") > PROBE_CHARS)
    good = probes.where(alive).select(F.col("source_id").alias("id"), F.lit(True).alias("_alive")).distinct()
    back = F.coalesce(F.col("_alive"), F.lit(False)) & (F.col("status") == "paused")
    out = sources.join(good, "id", "left").withColumn("_back", back)
    changes = {"status": "active", "consecutive_errors": 0, "priority": "medium"}
    return out.withColumns({c: F.when(F.col("_back"), F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}).select(sources.columns)


def should_crawl_now(hours: Column, weekdays: Column, hour: Column, weekday: Column) -> Column:
    """struct crawl, reason from articles by hour and by weekday (maps of counts, Monday 0)."""
    count = lambda by, k: F.coalesce(F.try_element_at(by, k), F.lit(0))
    size = lambda by: F.coalesce(F.size(by), F.lit(0))
    total = F.aggregate(F.map_values(hours), F.lit(0).cast("long"), lambda a, x: a + x)
    now = count(hours, hour)
    week = sum((count(weekdays, F.lit(d)) for d in range(5)), F.lit(0))
    end = count(weekdays, F.lit(5)) + count(weekdays, F.lit(6))
    quiet = (weekday >= 5) & (week > 0) & (F.try_divide(end, week * 2 / 5) < QUIET_WEEKEND)
    cases = [
        ((size(hours) <= 0) | (size(weekdays) <= 0), True, "no_pattern_data"),
        (total == 0, True, "no_articles"),
        (now == 0, False, "low_activity_hour"),
        (F.try_divide(now, total) < QUIET_HOUR, False, "very_low_activity_hour"),
        (quiet, False, "low_weekend_activity"),
    ]
    out = F
    for holds, crawl, reason in cases:
        out = out.when(holds, F.struct(F.lit(crawl).alias("crawl"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit(True).alias("crawl"), F.lit("normal_activity").alias("reason")))


def optimized_interval(base: Column, hours: Column, hour: Column) -> Column:
    """Half the interval in one of the three busiest hours (the earlier among equals), twice in a very quiet one."""
    ranked = F.array_sort(F.transform(F.map_entries(hours), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("h"))))
    busiest = F.transform(F.slice(ranked, 1, 3), lambda s: s["h"])
    total = F.aggregate(F.map_values(hours), F.lit(0).cast("long"), lambda a, x: a + x)
    now = F.coalesce(F.try_element_at(hours, hour), F.lit(0))
    return (
        F.when(F.coalesce(F.size(hours), F.lit(0)) <= 0, base)
        .when(F.array_contains(busiest, hour), F.greatest(F.lit(LEAST_MINUTES), (base * 0.5).cast("int")))
        .when((total > 0) & (F.try_divide(now, total) < QUIET_HOUR), F.least(F.lit(MOST_MINUTES), base * 2))
        .otherwise(base)
        .cast("int")
    )
