"""Change detection, staleness, priorities, plans and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import write_counted

HOUR, DAY = 3_600_000_000, 86_400_000_000
STATE = ("university", "url", "content_hash", "last_checked", "last_updated", "course_count", "notes")


def _with_url(rows: DataFrame) -> DataFrame:
    return rows if "url" in rows.columns else rows.withColumn("url", F.lit(None).cast("string"))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def age_days(now: str, then: Column) -> Column:
    """Whole days of 24 hours."""
    return F.floor((_micros(F.lit(now)) - _micros(then)) / F.lit(DAY)).cast("long")


def _age(now: str, then: Column) -> Column:
    return _micros(F.lit(now)) - _micros(then)


def check(current: DataFrame, snapshots: DataFrame, now: str, force: bool = False) -> DataFrame:
    """Current ``university, content_hash`` (and ``url``) against the snapshots: what changed and why, and the next state.

    A snapshot keeps the address it was first made with.
    """
    snapshots = _with_url(snapshots)
    old = snapshots.select("university", *[F.col(c).alias(f"old_{c}") for c in STATE[1:]], F.lit(True).alias("known"))
    rows = _with_url(current).join(old, "university", "left")
    state = (
        F.when(F.col("content_hash").isNull(), "failed").when(F.col("known").isNull(), "first")
        .when(F.lit(not force) & (_age(now, F.col("old_last_checked")) < HOUR), "recent").when(~F.col("content_hash").eqNullSafe(F.col("old_content_hash")), "changed").otherwise("same")
    )
    rows = rows.withColumn("action", state)
    a, stamp = F.col("action"), F.lit(now).cast("timestamp")
    # The reasons as users know them.
    reasons = {"failed": "Failed to fetch catalog", "first": "First snapshot - needs scraping", "recent": "Checked recently - skipping", "changed": "Catalog content changed", "same": "No changes detected"}
    reason = F.lit(None).cast("string")
    for k, v in reasons.items():
        reason = F.when(a == k, v).otherwise(reason)
    fresh = a.isin("first", "changed")
    return rows.select(
        "university", "action", fresh.alias("changed"), reason.alias("reason"), F.when(a.isin("failed", "first") & F.col("known").isNull(), F.col("url")).otherwise(F.col("old_url")).alias("url"),
        F.when(fresh, F.col("content_hash")).otherwise(F.col("old_content_hash")).alias("content_hash"),
        F.when(a.isin("first", "changed", "same"), stamp).otherwise(F.col("old_last_checked")).alias("last_checked"),
        F.when(fresh, stamp).otherwise(F.col("old_last_updated")).alias("last_updated"),
        F.when(a == "first", F.lit(0).cast("long")).otherwise(F.col("old_course_count")).alias("course_count"),
        F.when(a == "first", "Initial snapshot").when(a == "changed", "Catalog updated").otherwise(F.col("old_notes")).alias("notes"),
    )


def next_state(checked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshot table after a check; universities that were not checked stay."""
    touched = checked.where((F.col("action") != "failed") | F.col("last_checked").isNotNull()).select(*STATE)
    return _with_url(snapshots).select(*STATE).join(touched.select("university"), "university", "left_anti").unionByName(touched)


def update_counts(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Course counts and notes of ``runs(university, n, note)``; unknown universities are added."""
    both = _with_url(snapshots).join(runs, "university", "full")
    return both.select("university", "url", "content_hash", "last_checked", "last_updated", F.coalesce("n", "course_count").alias("course_count"), F.coalesce(F.when(F.col("note") != "", F.col("note")), F.col("notes")).alias("notes"))


def snapshot(snapshots: DataFrame, university: str) -> DataFrame:
    """The snapshot of one university, no row if there is none."""
    return snapshots.where(F.col("university") == university).limit(1)


def snapshots_listed(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("university")


def tasks(checked: DataFrame, force: bool = False) -> DataFrame:
    """What a refresh job works on: skipped if unchanged, unless forced."""
    return checked if force else checked.where("changed")


def run_duration(runs: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Add ``duration``: end less start as text, ``Unknown`` where either is no time."""
    gap = F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))
    whole = F.floor(F.abs(gap) / F.lit(1_000_000)).cast("long")
    parts = [F.floor(whole / 3600).cast("string"), F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"), F.lpad((whole % 60).cast("string"), 2, "0")]
    return runs.withColumn("duration", F.coalesce(F.concat(F.when(gap < 0, "-").otherwise(""), parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2]), F.lit("Unknown")))


def stale(snapshots: DataFrame, now: str, days: int = 7) -> DataFrame:
    return snapshots.where(_age(now, F.col("last_updated")) > days * DAY)


def should_refresh(current: DataFrame, snapshots: DataFrame, now: str) -> DataFrame:
    """Never scraped, older than 30 days, or what the change check says."""
    checked = check(current, snapshots, now).select("university", "changed", "reason")
    rows = checked.join(snapshots.select("university", "last_updated", F.lit(True).alias("known")), "university", "left")
    old = _age(now, F.col("last_updated")) > 30 * DAY
    reason = F.when(F.col("known").isNull(), "Never scraped before").when(old, F.concat(F.lit("Stale data (last updated "), age_days(now, F.col("last_updated")).cast("string"), F.lit(" days ago)"))).otherwise(F.col("reason"))
    return rows.select("university", F.when(F.col("known").isNull() | old, True).otherwise(F.col("changed")).alias("refresh"), reason.alias("reason"))


def priorities(snapshots: DataFrame, now: str) -> DataFrame:
    return snapshots.withColumn("priority", age_days(now, F.col("last_updated")))


def plan(snapshots: DataFrame, now: str, most: int = 5, order: str = "nseq") -> DataFrame:
    """The catalogues longest without an update, with their address where the snapshots have one."""
    return priorities(_with_url(snapshots), now).orderBy(F.desc("priority"), order).limit(most)


def rank_configs(configs: DataFrame, snapshots: DataFrame, now: str, most: int = 5, order: str = "nseq") -> DataFrame:
    """Enabled configurations by priority; one without a snapshot has priority 0."""
    on = configs.where(F.coalesce("enabled", F.lit(True)))
    ranked = on.join(priorities(snapshots, now).select("university", "priority"), "university", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    return ranked.orderBy(F.desc("priority"), order).limit(most)


def run_metrics(events: DataFrame) -> DataFrame:
    """Sums, peak memory and speed of ``events(university, ts, courses, pages, errors, memory_mb)``."""
    n = events.groupBy("university").agg(
        F.sum("courses").alias("courses"), F.sum("pages").alias("pages"), F.sum("errors").alias("errors"), F.max("memory_mb").alias("memory_peak_mb"),
        ((_micros(F.max("ts")) - _micros(F.min("ts"))) / F.lit(1e6)).alias("duration_s"),
    )
    speed = F.when(F.col("duration_s") > 0, F.bround(F.col("courses") / F.col("duration_s"), 2)).otherwise(0.0)
    return n.withColumns({"courses_per_second": speed, "duration_s": F.bround("duration_s", 2)})


def timing_summary(durations: DataFrame, seconds: str = "seconds") -> DataFrame:
    ms = F.col(seconds) * 1000.0
    return durations.agg(F.count("*").alias("iterations"), F.bround(F.avg(ms), 3).alias("avg_ms"), F.bround(F.min(ms), 3).alias("min_ms"), F.bround(F.max(ms), 3).alias("max_ms"))


def write_refreshed(checked: DataFrame, path: str) -> dict:
    """Write the checks of a run; successes, attempts and courses, counted while writing."""
    return write_counted(checked, path, F.count_if("changed").alias("successes"), F.count("*").alias("attempts"), F.coalesce(F.sum("course_count"), F.lit(0)).alias("courses"))
