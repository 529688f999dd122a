"""Registered definitions, their locks, status logs and test results, as table audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# What a registration and a test result must satisfy.
MIN_RATIONALE, MIN_T, MIN_SAMPLE = 50, 3, 30
KEY_PATTERN = "^[a-z][a-z0-9_]{2,63}$"
DIRECTIONS = ("higher_is_better", "lower_is_better")
UNIVERSES = ("TWSE", "TPEx", "BOTH")
METHODS = ("purged_kfold_embargo", "walk_forward", "full_sample_descriptive")


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


REGISTRATION_RULES = {
    "factor_key": f"factor_key rlike '{KEY_PATTERN}'",
    "display_name": "length(trim(display_name)) > 0",
    "rationale": f"length(trim(rationale)) >= {MIN_RATIONALE}",
    "direction": f"direction in ({_quoted(DIRECTIONS)})",
    "period_start": "period_start is not null",
    "period_end": "period_end is not null",
    "period_order": "period_start is null or period_end is null or period_start < period_end",
    "threshold": f"t_threshold >= {MIN_T}",
    "universe": f"universe in ({_quoted(UNIVERSES)})",
    "registered_by": "length(trim(registered_by)) > 0",
    "definition": "size(definition) > 0",
}
TEST_RULES = {
    "factor_key": f"factor_key rlike '{KEY_PATTERN}'",
    "definition_hash": "definition_hash rlike '^[0-9a-f]{64}$'",
    "t_statistic": "t_statistic is not null and not isnan(t_statistic) and abs(t_statistic) < double('infinity')",
    "sample_size": f"sample_size >= {MIN_SAMPLE}",
    "direction": f"observed_direction in ({_quoted(DIRECTIONS)})",
    "method": f"method in ({_quoted(METHODS)})",
}


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, rule) for every broken rule of every row, in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), name) for name, sql in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def validate_registrations(registrations: DataFrame) -> DataFrame:
    return violations(registrations, "factor_key", REGISTRATION_RULES)


def validate_test_results(results: DataFrame, key: str = "result_id") -> DataFrame:
    return violations(results, key, TEST_RULES)


def definition_lock(local: DataFrame, registered: DataFrame, archived: DataFrame) -> DataFrame:
    """(factor_key, problem): unregistered, or else every mismatch with what was registered."""
    reg = registered.select("factor_key", *[F.col(c).alias(f"_{c}") for c in ("definition_hash", "direction", "t_threshold")])
    joined = local.join(reg, "factor_key", "left").join(
        archived.select("factor_key").distinct().withColumn("_archived", F.lit(True)), "factor_key", "left"
    )
    missing = F.col("_definition_hash").isNull()
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    problems = F.when(missing, F.array(F.lit("unregistered"))).otherwise(F.array_compact(F.array(
        F.when(differs("definition_hash"), "definition_hash"), F.when(differs("direction"), "direction"),
        F.when(differs("t_threshold"), "t_threshold"), F.when(F.col("_archived"), "archived"),
    )))
    return joined.select("factor_key", F.explode(problems).alias("problem"))


def recompute_passed(results: DataFrame, registered: DataFrame, archived: DataFrame) -> DataFrame:
    """Each test result's own verdict recomputed; ``state`` says why a row must be refused."""
    reg = registered.select("factor_key", F.col("definition_hash").alias("_hash"), F.col("direction").alias("_direction"), F.col("t_threshold").alias("_t"))
    joined = results.join(reg, "factor_key", "left").join(
        archived.select("factor_key").distinct().withColumn("_archived", F.lit(True)), "factor_key", "left"
    )
    passed = F.coalesce((F.col("t_statistic") >= F.col("_t")) & (F.col("observed_direction") == F.col("_direction")), F.lit(False))
    state = (
        F.when(F.col("_hash").isNull(), "unregistered").when(F.col("_hash") != F.col("definition_hash"), "hash_mismatch")
        .when(F.col("_archived"), "archived").when(passed != F.col("claimed_passed"), "claim_differs").otherwise("ok")
    )
    return joined.select("result_id", "factor_key", passed.alias("passed"), state.alias("state"))


def with_seed_status(registrations: DataFrame, events: DataFrame) -> DataFrame:
    """Status log including the ``registered`` event every registration implies."""
    seeds = registrations.select("factor_key", F.lit("registered").alias("status"), F.lit(0).cast("bigint").alias("seq"))
    return events.select("factor_key", "status", "seq").unionByName(seeds)


def status_after_archive(events: DataFrame) -> DataFrame:
    """Events that follow an archiving event of the same key. The first archiving is one number per
    key, so the log itself needs no ordering."""
    first = events.filter("status = 'archived'").groupBy("factor_key").agg(F.min("seq").alias("_first"))
    return events.join(first, "factor_key").filter("seq > _first").select("factor_key", "seq", "status")


def archived_keys(events: DataFrame) -> DataFrame:
    return events.filter("status = 'archived'").select("factor_key").distinct()


def trial_summary(registrations: DataFrame, results: DataFrame, events: DataFrame, probe: Column) -> DataFrame:
    """One row: how often anything was tried at all, probes apart."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    r = registrations.agg(F.count(F.lit(1)).alias("registrations"), F.count_if(probe).alias("probes"), F.count_if(~probe).alias("real_registrations"))
    t = results.agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("passed")).alias("passed"))
    a = archived_keys(events).agg(F.count(F.lit(1)).alias("archived"))
    return one(r).join(one(t), "_one").join(one(a), "_one").drop("_one")


def config_lock(active: DataFrame, registered: DataFrame, broken: DataFrame) -> DataFrame:
    """(version, problem) for configurations that are invalid, unregistered or changed."""
    reg = registered.select("version", F.col("config_hash").alias("_hash"))
    bad = broken.select("version").distinct().withColumn("_bad", F.lit(True))
    joined = active.join(reg, "version", "left").join(bad, "version", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("_bad"), "invalid"), F.when(F.col("_hash").isNull(), "unregistered"),
        F.when(F.col("_hash") != F.col("config_hash"), "hash"),
    ))
    return joined.select("version", F.explode(problems).alias("problem"))


def pending_registrations(local: DataFrame, registered: DataFrame) -> DataFrame:
    return local.join(registered.select("factor_key"), "factor_key", "left_anti").select("factor_key", "definition_hash")


def read_back(written: DataFrame, stored: DataFrame) -> DataFrame:
    """Registrations whose stored hash is not the one that was written."""
    s = stored.select("factor_key", F.col("definition_hash").alias("_stored"))
    return written.join(s, "factor_key", "left").filter(~F.col("definition_hash").eqNullSafe(F.col("_stored"))).select("factor_key")
