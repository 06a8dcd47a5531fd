"""Reporting over stored runs: pages, dashboards, summaries, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .policy import SEVERITIES


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of df in the given order (a top-k, so no full sort). The size is held to 1 to 100."""
    size = max(1, min(100, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def findings_page(findings: DataFrame, severity: str | None = None, category: str | None = None, status: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """Findings by severity (critical first), path, line and id; filters are exact. Sorted before the page is cut."""
    for name, value in (("severity", severity), ("category", category), ("status", status)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    return page(findings, [severity_rank(F.col("severity")), F.col("file_path"), F.col("start_line"), F.col("finding_id")], number, size)


def finding_triage(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings with the status that the last review gave, and old_status where it differs. changes: finding_id, status, at."""
    last = changes.groupBy("finding_id").agg(F.max_by("status", F.struct("at", "status")).alias("new_status"))
    out = findings.join(last, "finding_id", "left")
    now = F.coalesce("new_status", "status")
    return out.select("finding_id", now.alias("status"), F.when(~(now.eqNullSafe(F.col("status"))), F.col("status")).alias("old_status"))


def run_summary(runs: DataFrame, findings: DataFrame, files: DataFrame, mappings: DataFrame, executions: DataFrame) -> DataFrame:
    """Per run: findings, critical findings, changed files, mean requirement score (0 without any), share of passed commands (0 without any)."""
    f = findings.groupBy("run_id").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical_findings"))
    c = files.groupBy("run_id").agg(F.count("*").alias("changed_files"))
    m = mappings.groupBy("run_id").agg(F.avg("score").alias("coverage"))
    e = executions.groupBy("run_id").agg(F.avg((F.col("status") == "passed").cast("double")).alias("passed_share"))
    out = runs.select("run_id")
    for part in (f, c, m, e):
        out = out.join(part, "run_id", "left")
    zero = {"findings": 0, "critical_findings": 0, "changed_files": 0, "coverage": 0.0, "passed_share": 0.0}
    return out.na.fill(zero)


def in_scope(rows: DataFrame, key: str, scope: DataFrame, scope_key: str) -> DataFrame:
    """Rows whose key is in scope (tenancy)."""
    return rows.join(scope.select(F.col(scope_key).alias(key)).distinct(), key, "left_semi")


def dashboard_totals(projects: DataFrame, runs: DataFrame, findings: DataFrame, tenant: Column) -> DataFrame:
    """Projects, runs, and critical or high findings of one tenant. projects: project_id and what tenant tests."""
    own = projects.where(tenant)
    own_runs = in_scope(runs, "project_id", own, "project_id")
    severe = in_scope(findings.where(F.col("severity").isin("critical", "high")), "run_id", own_runs, "run_id")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(own, "projects").join(one(own_runs, "runs")).join(one(severe, "severe_findings"))


def zero_filled_counts(rows: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """How often each value of the domain occurs, zero included."""
    return domain.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").na.fill({"n": 0})


def newest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key)).limit(n)


def avg_run_duration(runs: DataFrame, n: int = 30) -> DataFrame:
    """Mean seconds of the newest n completed runs, none below zero; 0 without any. runs: run_id, started_at, completed_at."""
    done = newest(runs.where(F.col("completed_at").isNotNull() & F.col("started_at").isNotNull()), "completed_at", "run_id", n)
    seconds = F.greatest(F.lit(0.0), F.unix_micros(F.col("completed_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6)
    return done.agg(F.coalesce(F.avg(seconds), F.lit(0.0)).alias("seconds"))


def run_state_metrics(runs: DataFrame) -> DataFrame:
    """Gauges: all, running and failed."""
    return runs.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "failed").alias("failed"))


def run_progress(events: DataFrame) -> DataFrame:
    """Per run: current stage and the stages in order. events: run_id, event_id, stage, ts."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "stage")))
    return events.groupBy("run_id").agg(ordered.alias("e")).select("run_id", F.element_at("e", -1)["stage"].alias("current"), F.transform("e", lambda x: x["stage"]).alias("stages"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which one of the columns holds the text, without regard to case; % and _ in the text stand for themselves."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(f"%{safe}%"), F.lit(False))
    return rows.where(test)


def purge(children: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """What stays of each child table when the rows of some parents go."""
    return {name: df.join(keys.select(key).distinct(), key, "left_anti") for name, df in children.items()}


def summary_table(findings: DataFrame, n: int = 10) -> DataFrame:
    """Per run: counts of findings and severities, and the first n findings by severity and id."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(severity_rank(F.col("severity")), "finding_id"))
    top = findings.withColumn("p", place).where(F.col("p") <= n).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("p", "title"))).alias("t"))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy("run_id").agg(F.count("*").alias("findings"), *counts).join(top.select("run_id", F.transform("t", lambda x: x["title"]).alias("first")), "run_id")


def client_rollups(findings: DataFrame) -> DataFrame:
    """Several groupings of the findings in one aggregate: by severity, by status, by category, and over all."""
    sets = [["severity"], ["status"], ["category"], []]
    cols = ["severity", "status", "category"]
    return findings.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.grouping_id().cast("int").alias("level"))


def patch_rollup(lines: DataFrame, by: tuple[str, str]) -> DataFrame:
    """Additions and deletions on both levels of a key in one aggregate."""
    return lines.rollup(*by).agg(F.count_if(F.col("kind") == "added").alias("additions"), F.count_if(F.col("kind") == "removed").alias("deletions"))
