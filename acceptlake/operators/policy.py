"""Validation status, policy rules over metrics, and risk scoring; every operator takes and returns DataFrames keyed by run_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")
RULE_SCHEMA = "rule_id string, metric string, operator string, exp_num double, exp_str string, exp_bool boolean, exp_list array<string>, outcome string, evidence array<string>"
#: Rules are a policy document's; the table that is broadcast may hold so many.
MAX_RULES = 100_000


def severity_counts(findings: DataFrame, by: str = "run_id") -> DataFrame:
    """A row for each run with the count of every severity, zero where there is none."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy(by).agg(*counts)


def validation_counts(executions: DataFrame) -> DataFrame:
    """Passed, failed (timed out included) and all commands of a run."""
    return executions.groupBy("run_id").agg(
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status").isin("failed", "timed_out")).alias("failed"),
        F.count("*").alias("total"),
    )


#: Statuses from the strongest on.
STATUS_ORDER = ("timed_out", "failed", "unavailable", "passed")
MESSAGE_ORDER = ("passed", "failed", "skipped", "timed_out", "unavailable")


def validation_status(executions: DataFrame) -> DataFrame:
    """A run's overall status, and how often each status occurs as a text."""
    overall = F.lit("skipped")
    for s in reversed(STATUS_ORDER):
        overall = F.when(F.bool_or(F.col("status") == s), s).otherwise(overall)
    message = F.concat_ws(", ", *[F.when(F.count_if(F.col("status") == s) > 0, F.concat(F.lit(f"{s}: "), F.count_if(F.col("status") == s))) for s in MESSAGE_ORDER])
    return executions.groupBy("run_id").agg(overall.alias("overall"), message.alias("message"))


def validation_findings(executions: DataFrame) -> DataFrame:
    """Commands that didn't pass, as findings."""
    bad = executions.where(F.col("status") != "passed")
    severity = F.when(F.col("status").isin("failed", "timed_out"), "high").otherwise("medium")
    return bad.select("run_id", "execution_id", severity.alias("severity"), F.concat(F.lit("validation."), "status").alias("rule_id"), F.concat(F.lit("Command "), "command", F.lit(" is "), "status").alias("title"))


def metrics_table(findings: DataFrame, executions: DataFrame) -> DataFrame:
    """metrics(run_id, metric, value): findings by severity and validation counts under dotted names, zero-filled over all runs."""
    both = severity_counts(findings).join(validation_counts(executions), "run_id", "full")
    names = {f"findings.{s}": s for s in SEVERITIES} | {f"validation.{s}": s for s in ("passed", "failed", "total")}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(F.col(v), F.lit(0)).cast("double").alias("value")) for k, v in names.items()])
    return both.select("run_id", F.inline(pairs))


def compare(operator: Column, m: DataFrame | None = None) -> Column:
    """Whether a rule holds. Columns: present, value_num, value_str, value_bool (observed) and exp_num, exp_str, exp_bool, exp_list.

    A missing metric fails every operator but exists. Numbers and texts are ordered among themselves only, booleans never.
    in with a text looks for a substring, with a list for an element of the same type.
    """
    equal = F.coalesce((F.col("value_num") == F.col("exp_num")) | (F.col("value_str") == F.col("exp_str")) | (F.col("value_bool") == F.col("exp_bool")), F.lit(False))
    number = F.coalesce(F.col("value_num") == F.col("exp_bool").cast("double"), F.col("value_bool").cast("double") == F.col("exp_num"), F.lit(False))  # true counts as 1
    equal = equal | number

    def ordered(test) -> Column:
        return F.coalesce(test(F.col("value_num"), F.col("exp_num")), test(F.col("value_str"), F.col("exp_str")), F.lit(False))

    listed = F.coalesce(F.array_contains("exp_list", F.col("value_str")), F.exists("exp_list", lambda x: x.try_cast("double") == F.col("value_num")), F.lit(False))
    inside = F.when(F.col("exp_list").isNotNull(), listed).otherwise(F.coalesce(F.col("exp_str").contains(F.col("value_str")), F.lit(False)))
    can_hold = F.col("exp_list").isNotNull() | F.col("value_str").isNotNull()
    tests = {
        "eq": equal,
        "neq": ~equal,
        "gt": ordered(lambda a, b: a > b),
        "gte": ordered(lambda a, b: a >= b),
        "lt": ordered(lambda a, b: a < b),
        "lte": ordered(lambda a, b: a <= b),
        "in": inside,
        "not_in": can_hold & ~inside,
    }
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(operator == name, F.col("present") & test).otherwise(out)
    return F.when(operator == "exists", F.col("present") == F.coalesce(F.col("exp_bool"), F.lit(True))).otherwise(out)


def policy_compare(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule against the metric of its name, for every run that has any metric: run_id, rule_id, present, matched."""
    if (n := rules.count()) > MAX_RULES:
        raise ValueError(f"{n} rules; at most {MAX_RULES}")
    every = metrics.select("run_id").distinct().join(F.broadcast(rules))
    seen = metrics.withColumn("present", F.lit(True))
    joined = every.join(seen, ["run_id", "metric"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return joined.withColumn("matched", compare(F.col("operator")))


def policy_decisions(metrics: DataFrame, rules: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """A decision for each run and rule: matched, outcome (pass, or the rule's warn or fail), explanation, evidence references without repeats.

    evidence: metric, refs array<string> (references by metric) that are added to the rules' own.
    """
    made = policy_compare(metrics, rules)
    refs = F.coalesce("evidence", F.array().cast("array<string>"))
    if evidence is not None:
        made = made.join(evidence, "metric", "left")
        refs = F.concat(refs, F.coalesce("refs", F.array().cast("array<string>")))
    outcome = F.when(F.col("matched"), "pass").otherwise(F.col("outcome"))
    text = F.concat(F.lit("Rule '"), "rule_id", F.when(F.col("matched"), "' satisfied: metric '").otherwise("' violated: metric '"), "metric", F.lit("' expected operator '"), "operator", F.lit("'."))
    return made.select("run_id", "rule_id", "metric", "operator", "present", "matched", outcome.alias("outcome"), text.alias("explanation"), F.array_distinct(refs).alias("evidence"))


def policy_verdict(decisions: DataFrame) -> DataFrame:
    """fail if any rule fails, else warn if any warns, else pass; with the counts."""
    counts = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("pass", "warn", "fail")]
    verdict = F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("pass")
    return decisions.groupBy("run_id").agg(*counts).withColumn("verdict", verdict)


def policy_findings(decisions: DataFrame) -> DataFrame:
    """Decisions that don't pass, as findings."""
    bad = decisions.where(F.col("outcome") != "pass")
    severity = F.when(F.col("outcome") == "fail", "high").otherwise("medium")
    fingerprint = F.sha2(F.concat(F.lit("policy:"), "rule_id", F.lit(":"), "outcome"), 256)
    return bad.select("run_id", F.concat(F.lit("policy."), "rule_id").alias("rule_id"), severity.alias("severity"), F.concat(F.lit("Policy rule "), "outcome").alias("title"), fingerprint.alias("fingerprint"))


# Metrics that are counts.
COUNTS = ("changed_files", "additions", "deletions", "high_complexity_symbols", "high_fan_in_symbols", "breaking_api_changes", "database_migrations", "dependency_changes", "critical_findings", "high_findings", "medium_findings", "low_findings", "secrets_detected", "failed_validations", "config_drifts", "ci_files_changed")
RATIOS = ("test_evidence_score", "requirement_coverage")


def risk_factors(runs: DataFrame, *parts: DataFrame) -> DataFrame:
    """The 18 inputs of each run: parts (keyed by run_id, any of the inputs as columns) joined to the runs; missing counts are 0, missing ratios 1."""
    out = runs.select("run_id")
    for part in parts:
        out = out.join(part, "run_id", "left")
    have = set(out.columns)
    columns = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in have else F.lit(0).cast("long").alias(c) for c in COUNTS]
    columns += [F.coalesce(F.col(c), F.lit(1.0)).cast("double").alias(c) if c in have else F.lit(1.0).alias(c) for c in RATIOS]
    return out.select("run_id", *columns)


def risk_factor_errors(factors: DataFrame) -> DataFrame:
    """Inputs outside their range: negative counts, ratios outside 0 to 1 or not finite."""
    bad = [F.when(F.col(c) < 0, F.lit(c)) for c in COUNTS] + [F.when(~F.col(c).between(0, 1) | F.isnan(c), F.lit(c)) for c in RATIOS]
    return factors.select("run_id", F.explode(F.array_compact(F.array(*bad))).alias("field"))


#: The most that each component adds; 100 together.
WEIGHTS = {"change_surface": 10.0, "complexity_and_fan_in": 8.0, "api_compatibility": 10.0, "database": 7.0, "dependencies": 6.0, "security_findings": 20.0, "secrets": 12.0, "test_gap": 8.0, "requirement_gap": 6.0, "validation": 8.0, "configuration": 3.0, "ci_changes": 2.0}


def _components() -> dict[str, str]:
    """The components' scores before the cap, as SQL."""
    return {
        "change_surface": "least(5.0D, changed_files * 0.5D) + least(5.0D, (additions + deletions) / 200.0D)",
        "complexity_and_fan_in": "least(4.0D, CAST(high_complexity_symbols AS DOUBLE)) + least(4.0D, CAST(high_fan_in_symbols AS DOUBLE))",
        "api_compatibility": "breaking_api_changes * 5.0D",
        "database": "database_migrations * 3.5D",
        "dependencies": "dependency_changes * 1.5D",
        "security_findings": "critical_findings * 20.0D + high_findings * 7.0D + medium_findings * 2.5D + low_findings * 0.5D",
        "secrets": "secrets_detected * 12.0D",
        "test_gap": "(1.0D - test_evidence_score) * 8.0D",
        "requirement_gap": "(1.0D - requirement_coverage) * 6.0D",
        "validation": "failed_validations * 4.0D",
        "configuration": "config_drifts * 1.5D",
        "ci_changes": "ci_files_changed * 2.0D",
    }


def risk_components(factors: DataFrame) -> DataFrame:
    """A row for each run and component: score (0 to maximum) and maximum."""
    items = [F.struct(F.lit(k).alias("component"), F.greatest(F.lit(0.0), F.least(F.lit(WEIGHTS[k]), F.expr(e))).alias("score"), F.lit(WEIGHTS[k]).alias("maximum")) for k, e in _components().items()]
    return factors.select("run_id", F.inline(F.array(*items)))


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").when(score >= 15, "low").otherwise("minimal")


def risk_score(factors: DataFrame) -> DataFrame:
    """raw_score, score (rounded up, raised by the floors in order), floors applied, level."""
    capped = [F.greatest(F.lit(0.0), F.least(F.lit(WEIGHTS[k]), F.expr(e))) for k, e in _components().items()]
    raw = F.least(F.lit(100.0), sum(capped[1:], capped[0]))
    out = factors.withColumn("raw_score", raw).withColumn("score", F.ceil(F.round("raw_score", 9)))
    floors = []
    for test, floor in ((F.col("critical_findings") > 0, 90), (F.col("secrets_detected") > 0, 75), (F.col("high_findings") >= 3, 70)):
        raised = test & (F.col("score") < floor)
        out = out.withColumn(f"floor_{floor}", F.when(raised, F.lit(floor)))
        out = out.withColumn("score", F.when(raised, floor).otherwise(F.col("score")))
        floors.append(F.col(f"floor_{floor}"))
    return out.select("run_id", "raw_score", F.col("score").cast("long").alias("score"), F.array_compact(F.array(*floors)).alias("floors"), risk_level(F.col("score")).alias("level"))
