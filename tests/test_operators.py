"""Literal cases: diffs, redaction, policy comparison, risk floors, invariants."""

import pytest
from pyspark.sql import functions as F

from acceptlake.functions import text as X
from acceptlake.operators import graph as G
from acceptlake.operators import patches as PA
from acceptlake.operators import policy as P
from acceptlake.operators import security as S

DIFF = """diff --git a/src/app.py b/src/app.py
index 1..2 100644
--- a/src/app.py
+++ b/src/app.py
@@ -2,3 +2,4 @@ def run():
 one
-two
+TWO
+three
 four
diff --git "a/old name.py" "b/new name.py"
similarity index 90%
rename from old name.py
rename to new name.py
diff --git a/tests/test_app.py b/tests/test_app.py
new file mode 100644
--- /dev/null
+++ b/tests/test_app.py
@@ -0,0 +1,2 @@
+a
+b
diff --git a/logo.png b/logo.png
Binary files a/logo.png and b/logo.png differ
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
"""
BARE = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n--- a/y\n+++ b/y\n@@ -1 +1,2 @@\n c\n+d\n"


def test_diff(spark):
    lines = PA.parsed(spark.createDataFrame([("git", DIFF), ("bare", BARE)], "patch_id string, text string")).cache()
    files = {(r.patch_id, r.file): r for r in PA.patch_files(lines).collect()}
    assert [files["git", i].change_type for i in range(1, 6)] == ["modified", "renamed", "added", "modified", "deleted"]
    assert files["git", 2].old_path == "old name.py" and files["git", 2].new_path == "new name.py" and files["git", 2].similarity == 90
    assert files["git", 3].old_path is None and files["git", 4].is_binary and files["git", 5].new_path is None
    assert [files["bare", i].path for i in (1, 2)] == ["x", "y"]
    content = PA.patch_lines(lines).cache()
    stats = {(r.patch_id, r.file): (r.additions, r.deletions) for r in PA.patch_stats(content).collect()}
    assert stats["git", None] == (4, 2) and stats["bare", None] == (2, 1)
    assert [(r.old_line, r.new_line) for r in content.where("patch_id = 'git' AND file = 1").orderBy("pos").collect()] == [(2, 2), (3, None), (None, 3), (None, 4), (4, 5)]
    assert [(r.first_line, r.last_line) for r in PA.changed_ranges(content).where("patch_id = 'git' AND file = 1").collect()] == [(3, 4)]


@pytest.mark.parametrize(
    "operator, observed, expected, holds",
    [("eq", {"value_num": 1.0}, {"exp_num": 1.0}, True), ("eq", {"value_num": 1.0}, {"exp_str": "1"}, False), ("neq", {"value_str": "a"}, {"exp_str": "b"}, True), ("neq", None, {"exp_str": "b"}, False), ("gt", {"value_bool": True}, {"exp_num": 0.0}, False), ("in", {"value_str": "b"}, {"exp_str": "abc"}, True), ("not_in", None, {"exp_list": ["a"]}, False), ("exists", None, {"exp_bool": False}, True), ("lte", {"value_str": "a"}, {"exp_num": 2.0}, False)],
)
def test_compare(spark, operator, observed, expected, holds):
    schema = "run_id int, metric string, value_num double, value_str string, value_bool boolean"
    rows = [(1, "other", 0.0, None, None)] + ([(1, "m", *[observed.get(c) for c in ("value_num", "value_str", "value_bool")])] if observed else [])
    rule = [("r", "m", operator, *[expected.get(c) for c in ("exp_num", "exp_str", "exp_bool", "exp_list")], "fail", [])]
    out = P.policy_compare(spark.createDataFrame(rows, schema), spark.createDataFrame(rule, P.RULE_SCHEMA)).collect()
    assert [r.matched for r in out] == [holds]


def test_risk_floors(spark):
    runs = spark.range(5).withColumnRenamed("id", "run_id")
    parts = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 3)], "run_id long, critical_findings int, secrets_detected int, high_findings int")
    got = {r.run_id: (r.score, r.level) for r in P.risk_score(P.risk_factors(runs, parts)).collect()}
    assert got == {0: (0, "minimal"), 1: (90, "critical"), 2: (75, "high"), 3: (70, "high"), 4: (0, "minimal")}
    bad = spark.createDataFrame([(1, -1, 1.5)], "run_id long, additions int, requirement_coverage double")
    assert {r.field for r in P.risk_factor_errors(P.risk_factors(runs.where("run_id = 1"), bad)).collect()} == {"additions", "requirement_coverage"}


def test_redaction(spark):
    token = "gh" + "p_" + "A" * 30
    texts = [f"use {token} now", "Bearer abcdefgh12345", "password = 'hunter2 x'", "postgres://u:pw@host/db", "api_key: zzz, rest", "plain text"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.redact_text(F.col("t")).alias("t"), X.leaks(F.col("t")).alias("before"), X.leaks(X.redact_text(F.col("t"))).alias("after")).orderBy("i").collect()
    assert [r.before for r in rows] == [True] * 5 + [False] and not any(r.after for r in rows)
    assert token not in rows[0].t and rows[5].t == "plain text"
    nested = S.redact_nested(spark.createDataFrame([({"apiKey": "x", "n": "ok"}, ("tok", "me"))], "m map<string,string>, s struct<auth_token:string,name:string>")).first()
    assert nested.m == {"apiKey": "[REDACTED]", "n": "ok"} and tuple(nested.s) == ("[REDACTED]", "me")
    kind = "m map<string,array<string>>, mm map<string,map<string,string>>, token struct<a:string,n:int>, api_key array<string>, keys map<string,string>, note string"
    row = S.redact_nested(spark.createDataFrame([({"password": ["hunter2"], "n": ["ok"]}, {"token": {"a": "b"}}, ("x", 1), ["y"], {f"k {token}": "1", "k": "2"}, None)], kind)).first()
    assert row.m == {"password": ["[REDACTED]"], "n": ["ok"]} and row.mm == {"token": {"[REDACTED]": "[REDACTED]"}}
    assert tuple(row.token) == ("[REDACTED]", None) and row.api_key == ["[REDACTED]"] and row.note is None
    assert set(row["keys"].values()) == {"1", "2"} and not any(token in k for k in row["keys"])


def test_last_of_a_repeated_name_counts(spark):
    kind = "name string, signature string, behaviour array<string>, exported boolean, position int"
    before = spark.createDataFrame([("f", "(a)", [], True, 1), ("f", "(b)", [], False, 2), ("g", "()", [], True, 1)], kind)
    after = spark.createDataFrame([("f", "(b)", [], True, 2), ("f", "(c)", [], True, 1), ("g", "(x)", [], False, 1)], kind)
    assert [tuple(r) for r in G.symbol_diff(before, after).collect()] == [("g", "impact.python-signature-changed", "high")]
    assert G.symbol_diff(before, before).count() == 0


def test_secret_scan_masks_and_skips(spark):
    value = "".join(["q7", "Rt", "9x", "Lm", "2p"])
    files = spark.createDataFrame([("a.py", f'x = 1\ntoken = "{value}"\npassword = "changeme-please"\n')], "path string, text string")
    rows = S.secret_scan(files).collect()
    assert [(r.rule_id, r.line) for r in rows] == [("secret.assigned-credential", 2)] and value not in rows[0].masked
