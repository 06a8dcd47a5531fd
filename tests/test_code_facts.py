"""Code facts of literal sources, and of large and odd ones."""

import time

import pytest
from pyspark.sql import functions as F

from acceptlake.functions import pysource
from acceptlake.operators import codefacts as C
from acceptlake.plans import code_queries as Q

SMOKE_DIR = "/root/testdata/sf0.001"

SERVICE = '''
import importlib
from tools import *

class Parent:
    pass

class Service(Parent):
    @staticmethod
    async def calculate(value: int, flag: bool = False) -> int:
        if value and flag:
            return helper(value)
        return 0

def helper(value: int) -> int:
    importlib.import_module("plugins.demo")
    return value
'''
ROUTES = """
from fastapi import APIRouter, Depends
router = APIRouter(prefix="/v1")
@router.post("/items", response_model=ItemOut, status_code=201)
def create(item: ItemIn, user=Depends(auth)):
    return item
"""
SPREAD = '''def f(
    a,
    b=(1,
       2),
) -> int:
    """
def fake():
    """
    if a:
        return g(a)
'''


@pytest.fixture(scope="module")
def facts(spark):
    texts = [("app/service.py", SERVICE), ("module.py", "def outer():\n    def inner():\n        return 1\n    return inner()\n"), ("broken.py", "def broken(:\n"), ("api.py", ROUTES), ("pkg/__init__.py", SPREAD), ("none.py", None), (None, "x = f()"), ("empty.py", ""), ("nul.py", "x = 1\0")]
    return pysource.code_facts(spark.createDataFrame([(*t, 1) for t in texts], "path string, text string, line int")).cache()


def test_declarations(facts):
    d = {r.qualified_name: r for r in C.code_declarations(facts).collect()}
    method = d["app.service.Service.calculate"]
    assert (method.kind, method.owner, method.is_async, method.decorators, method.start_line, method.end_line) == ("method", "app.service.Service", True, ["staticmethod"], 10, 13)
    assert method.signature == "async calculate(value: int, flag: bool=False) -> int" and d["app.service.Service"].bases == ["Parent"]
    assert (d["module.outer.inner"].kind, d["module.outer.inner"].owner) == ("function", None)
    assert (d["pkg.f"].start_line, d["pkg.f"].end_line) == (1, 10) and "pkg.fake" not in d
    assert {r.qualified_name: r.complexity for r in C.code_complexity(facts).collect()}["app.service.Service.calculate"] == 3
    assert {r.qualified_name: r.return_shapes for r in C.code_behaviour(facts).collect()}["pkg.f"] == ["call:g"]


def test_calls_warnings_and_routes(facts):
    calls = {(r.caller, r.target, r.line) for r in C.code_calls(facts).collect()}
    assert {("app.service.Service.calculate", "helper", 12), ("pkg.f", "g", 10)} <= calls and not any(t == "f" for _, t, _ in calls)
    assert {(r.path, r.rule_id) for r in C.code_warnings(facts).collect()} == {("app/service.py", "python.wildcard-import"), ("app/service.py", "python.dynamic-import"), ("broken.py", "python.syntax-error"), ("nul.py", "python.syntax-error")}
    (r,) = C.web_routes(facts).collect()
    assert (r.route, r.method, r.handler, r.request_models, r.response_model, r.status, r.dependencies) == ("/v1/items", "POST", "create", ["ItemIn"], "ItemOut", 201, ["auth"])


def test_a_very_long_file(spark):
    body = "def f{0}(x):\n    for i in x:\n        if i and x:\n            return g{0}(i)\n\n"
    files = spark.createDataFrame([("long.py", "".join(body.format(i) for i in range(20_000)))], "path string, text string")
    facts = pysource.code_facts(files).cache()
    start = time.time()
    assert C.code_complexity(facts).groupBy("complexity").count().collect() == [(4, 20_000)]
    calls = C.code_calls(facts).where(F.col("caller") == F.regexp_replace("target", "^g", "long.f"))
    assert calls.count() == 20_000 and time.time() - start < 60


def test_deep_nesting_is_an_error_of_its_file(spark):
    files = spark.createDataFrame([("deep.py", "(" * 100_000), ("sum.py", "x = " + "1 + " * 20_000 + "1"), ("good.py", "def f(): pass")], "path string, text string")
    facts = pysource.code_facts(files)
    assert {r.path for r in C.code_declarations(facts).collect()} == {"good.py"}
    assert {"deep.py"} <= {r.path for r in C.code_warnings(facts).collect()}


def test_python_analyzers_fail_alone(spark):
    files = spark.createDataFrame([(1, "a", "x\ny"), (2, "b", "boom"), (3, "c", None), (4, "d", "odd"), (5, "a", "x\ny")], "seq long, path string, text string")

    def body(path, text):
        if text == "boom":
            raise KeyError(text)
        return [{"no": 1}] if text == "odd" else [{"rule_id": "lines", "line": text.count("\n") + 1}]

    rows = C.run_analyzers(files, [C.python_analyzer("mine", body)]).collect()
    assert sorted((r.first, r.seq, r.path, r.rule_id, r.line) for r in rows) == [(1, 5, "a", "lines", 2), (2, 2, "b", "analyzer.failed", None), (4, 4, "d", "analyzer.failed", None)]


def test_wanted_facts_are_those_of_all(spark, facts):
    """Kinds that are asked for are the same rows as among all facts; plain ones only lack their arguments and signatures."""
    texts = [("app/service.py", SERVICE), ("api.py", ROUTES), ("pkg/__init__.py", SPREAD), ("broken.py", "def broken(:\n")]
    for path, text in texts:
        whole = list(pysource.facts_of(path, text))
        for kind in pysource.KINDS:
            assert list(pysource.facts_of(path, text, [kind])) == [r for r in whole if r[1] == kind]
        bare = list(pysource.facts_of(path, text, pysource.KINDS, ["call", "declaration"]))
        assert [r[:9] + r[10:12] for r in bare] == [r[:9] + r[10:12] for r in whole] and all(r[12] is None for r in bare if r[1] in ("call", "declaration"))
    with pytest.raises(ValueError):
        pysource.code_facts(spark.createDataFrame([], "path string, text string"), ["calls"])


def test_one_file_of_parts_is_read_by_all_cores(spark):
    for df in (Q.files(spark, SMOKE_DIR), Q.code_calls(spark, SMOKE_DIR)):
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
