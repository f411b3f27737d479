"""Grouped analytics over diagnostics, benchmark runs and usage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that an output of a category may have.
CAPS = {"diff": 900, "test": 700, "lint": 500}
#: Marks of an unavailable upstream in lower-cased test output.
UPSTREAM = ("upstream_unavailable", "connection refused", "connecterror", "readtimeout", "timed out", "not reachable")


def digest_by_rule(findings: DataFrame) -> DataFrame:
    """(rule_id, n, files, example, position) of ``findings(seq, rule_id, file, message)``, most frequent rule first."""
    grouped = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("file")).alias("fs"), F.min_by("message", "seq").alias("example"), F.min("seq").alias("first"))
    order = Window.orderBy(F.desc("n"), F.asc("first"))
    return grouped.select("rule_id", "n", F.array_join("fs", ",").alias("files"), "example", F.row_number().over(order).cast("long").alias("position"))


def summarise_models(cells: DataFrame, scores: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """One row a model: counts, percentiles by linear interpolation, stability, cap violations, quality, judge errors.

    Stability is the share of (category, fixture) groups whose outputs are all the same; a
    model without such groups has 0. A category without a cap is an error.
    """
    caps = CAPS if caps is None else caps
    ok = F.col("status") == "ok"
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("category"))
    over = F.when(cap.isNull(), F.raise_error(F.concat(F.lit("no cap for category "), F.col("category"))).cast("boolean")).otherwise(F.col("output_chars") > cap)
    base = cells.groupBy("model").agg(
        F.count_if(ok).alias("n_ok"),
        F.count_if(~ok).alias("n_fail"),
        F.median(F.when(ok, F.col("latency_seconds"))).alias("p50"),
        F.percentile(F.when(ok, F.col("latency_seconds")), F.lit(0.95)).alias("p95"),
        F.count_if(ok & over).alias("cap_violations"),
    )
    groups = cells.where(ok).groupBy("model", "category", "fixture").agg((F.count_distinct("output_text") == 1).cast("double").alias("same"))
    stability = groups.groupBy("model").agg(F.avg("same").alias("stability"))
    known = cells.select("model", "category", "fixture").distinct()
    mean = (F.col("faithfulness") + F.col("conciseness") + F.col("risk_callout")) / F.lit(3.0)
    quality = scores.where("error is null").join(known, ["model", "category", "fixture"]).groupBy("model").agg(F.avg(mean).alias("quality"))
    errors = scores.where("error is not null").groupBy("model").agg(F.count(F.lit(1)).alias("judge_errors"))
    out = base.join(stability, "model", "left").join(quality, "model", "left").join(errors, "model", "left")
    return out.fillna({"stability": 0.0, "judge_errors": 0})


def rank_models(summary: DataFrame) -> DataFrame:
    """Composite score, flags and rank of each row of ``summarise_models``.

    0.5 * quality (of 5; missing counts as half) + 0.3 * (1 - latency scaled between the
    models' extremes; missing counts as slowest) + 0.2 * stability; 0 where no model has a latency. One row a model, so the
    windows without a key are small.
    """
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, high = F.min("p95").over(everyone), F.max("p95").over(everyone)
    slow = F.coalesce((F.col("p95") - low) / F.greatest(high - low, F.lit(1e-6)), F.lit(1.0))
    known = F.max("p95").over(everyone).isNotNull()
    composite = 0.5 * (F.coalesce("quality", F.lit(2.5)) / 5.0) + 0.3 * (1 - slow) + 0.2 * F.col("stability")
    flags = F.concat_ws(
        ",",
        F.when(F.col("stability") < 1, "unstable"),
        F.when(F.col("cap_violations") > 1, "over_cap"),
        F.when(F.col("n_fail") > 0, "failures"),
        F.when(F.col("judge_errors") > 0, "judge_errors"),
    )
    scored = summary.withColumn("composite", F.when(known, composite).otherwise(0.0)).withColumn("flags", flags)
    return scored.withColumn("position", F.row_number().over(Window.orderBy(F.desc("composite"), "model")).cast("long"))


def recommended(ranked: DataFrame) -> DataFrame:
    """The best model by composite among those without failures and fully stable; no row if there is none."""
    return ranked.where("n_fail = 0 and stability >= 1").orderBy("position").limit(1)


def classify_outcome(nodeid: Column, outcome: Column, detail: Column) -> Column:
    """The triage class of a test outcome; the first rule that holds decides."""
    text = F.lower(F.concat(nodeid, F.lit("\n"), detail))
    has = lambda *marks: F.coalesce(*[F.when(text.contains(m), True) for m in marks], F.lit(False))
    skipped = outcome == "skipped"
    return (
        F.when(outcome == "passed", "passed")
        .when(skipped & has("smoke target disabled"), "target_disabled")
        .when(skipped & has("missing_env"), "missing_env")
        .when(skipped & has(*UPSTREAM), "upstream_unavailable")
        .when(skipped, "missing_env")
        .when(has("harness_bug"), "harness_bug")
        .when(has("missing_env"), "missing_env")
        .when(has(*UPSTREAM, "upstream provider"), "upstream_unavailable")
        .otherwise("product_failure")
    )


def cache_totals(usage: DataFrame) -> DataFrame:
    """(hit, miss, hit_percent) of ``usage(cache_read, cache_creation, cached)``; the second shape, which tells hits only, counts where both fields of the first are absent."""
    second = F.col("cache_read").isNull() & F.col("cache_creation").isNull()
    hit = F.when(second, F.coalesce("cached", F.lit(0))).otherwise(F.coalesce("cache_read", F.lit(0)))
    miss = F.coalesce("cache_creation", F.lit(0))
    return usage.agg(F.sum(hit).alias("hit"), F.sum(miss).alias("miss")).withColumn("hit_percent", F.round(F.try_divide(F.lit(100.0) * F.col("hit"), F.col("hit") + F.col("miss")), 6))


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of ``literal``."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def stream_totals(chunks: DataFrame, every: int = 20) -> DataFrame:
    """(stream_id, n_chunks, n_bytes, n_progress, outcome) of ``chunks(stream_id, chunk, failed)``; works on batch and streaming input."""
    return chunks.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.octet_length("chunk")).alias("n_bytes"),
        F.expr(f"count(1) div {every}").alias("n_progress"),
        F.when(F.bool_or("failed"), "error").otherwise("complete").alias("outcome"),
    )
