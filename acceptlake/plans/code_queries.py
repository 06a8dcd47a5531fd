"""Queries of code facts over Python texts put together from pieces by part key, and of the extension points.

A piece has variants, each with its lines and with the facts that a reader finds in them, written down beside them; the oracle adds the
lines that stand before. Some texts have an error and so no other fact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pysource import code_facts
from ..operators import codefacts as P
from ..operators import graph as G
from ..operators import textmatch as T
from ..operators.security import fingerprint
from ..sources.staging import staged
from .base import Registry, spread, table
from .security_queries import q
from .textmatch_queries import BASE_SQL, rounded

R = Registry()
_K = "CAST(p_partkey AS STRING)"
_BROKEN = "p_partkey % 11 = 10"
#: Of each kind of fact, its columns after the first, which is the line ({k}: the part key, {m}: the module).
#: decl: end, name, kind, async, owner, signature, bases, decorators, complexity, return shapes, raises. import: module, name, alias, dynamic. call: caller, target.
#: route: method, route, handler, models, response model, status, dependencies. danger: rule, severity.
PIECES = [
    [
        {"text": ["import os, sys as system", "from lib.core import (", "    a as b,", "    c,  # and d", ")"], "import": [(1, "os", None, None, False), (1, "sys", None, "system", False), (2, "lib.core", "a", "b", False), (2, "lib.core", "c", None, False)]},
        {"text": ["from ..pkg import *"], "import": [(1, "..pkg", "*", None, False)]},
        {"text": ['"""Code in a text:', "def fake():", "    import nothing", '"""', "from . import helper{k} as h"], "import": [(5, ".", "helper{k}", "h", False)]},
        {"text": ["import a.b.c", 'x = __import__("dyn{k}")'], "import": [(1, "a.b.c", None, None, False), (2, "dyn{k}", None, None, True)], "call": [(2, "{m}", "__import__")]},
        {"text": ["import importlib", "importlib.import_module(name)"], "import": [(1, "importlib", None, None, False), (2, "<dynamic>", None, None, True)], "call": [(2, "{m}", "importlib.import_module")]},
    ],
    [
        {
            "text": ["class Svc{k}(Base, mix.In[int]):", "    limit = 3", "", "    @property", "    @cached(ttl=5)", "    def run(", "        self,", "        x: int,", "        *rest,", "    ) -> dict:", "        # if comment and or", '        if x and self.y or "if and or":', "            raise ValueError(x)", '        return {"a": helper(x)}'],
            "decl": [(1, 14, "Svc{k}", "class", False, None, "class Svc{k}", "Base,mix.In", "", 4, None, None), (6, 14, "Svc{k}.run", "method", False, "{m}.Svc{k}", "run(self, x: int, *rest) -> dict", "", "property;cached(ttl=5)", 4, "mapping", "ValueError")],
            "call": [(5, "{m}.Svc{k}.run", "cached"), (13, "{m}.Svc{k}.run", "ValueError"), (14, "{m}.Svc{k}.run", "helper")],
        },
        {
            "text": ["class Outer{k}:", "\tclass _Inner:", "\t\tdef go(self): return [i for i in self if i]", "\tdef done(self):", "\t\treturn None"],
            "decl": [(1, 5, "Outer{k}", "class", False, None, "class Outer{k}", "", "", 2, None, None), (2, 3, "Outer{k}._Inner", "class", False, "{m}.Outer{k}", "class _Inner", "", "", 2, None, None), (3, 3, "Outer{k}._Inner.go", "method", False, "{m}.Outer{k}._Inner", "go(self)", "", "", 2, "listcomp", ""), (4, 5, "Outer{k}.done", "method", False, "{m}.Outer{k}", "done(self)", "", "", 1, "none", "")],
        },
        {
            "text": ["def outer{k}(a, b=(1, 2)):", "    def inner():", "        for i in a:", "            while i:", "                i = yield i", "        return", "    try:", "        return inner()", "    except (A, B):", "        raise", "    finally:", "        assert b"],
            "decl": [(1, 12, "outer{k}", "function", False, None, "outer{k}(a, b=(1, 2))", "", "", 5, "call:inner", "dynamic_exception"), (2, 6, "outer{k}.inner", "function", False, None, "inner()", "", "", 3, "none", "")],
            "call": [(8, "{m}.outer{k}", "inner")],
        },
    ],
    [
        {
            "text": ['router = APIRouter(prefix="/v{k}")', "", "", "@router.post(", "    '/items//{id}',", "    status_code=201,", "    response_model=list[Item],", "    dependencies=[Depends(auth), limit, Depends()],", ")", "async def create_{k}(item: ItemIn, q: str, req: Request, user: User = Depends(current), *, other: ItemIn = None):", "    return await save(item)"],
            "decl": [(10, 11, "create_{k}", "function", True, None, "async create_{k}(item: ItemIn, q: str, req: Request, user: User=Depends(current), *, other: ItemIn=None)", "", "router.post('/items//{id}', status_code=201, response_model=list[Item], dependencies=[Depends(auth), limit, Depends()])", 1, "await", "")],
            "call": [(1, "{m}", "APIRouter"), (4, "{m}.create_{k}", "router.post"), (8, "{m}.create_{k}", "Depends"), (8, "{m}.create_{k}", "Depends"), (10, "{m}.create_{k}", "Depends"), (11, "{m}.create_{k}", "save")],
            "route": [(10, "POST", "/v{k}/items/{id}", "create_{k}", "ItemIn", "list[Item]", 201, "current;auth;Depends")],
        },
        {
            "text": ["app = FastAPI()", '@app.GET("/a")', '@app.trace("b/{k}")', "def both_{k}(x: int = 1): return x"],
            "decl": [(4, 4, "both_{k}", "function", False, None, "both_{k}(x: int=1)", "", "app.GET('/a');app.trace('b/{k}')", 1, "name:x", "")],
            "call": [(1, "{m}", "FastAPI"), (2, "{m}.both_{k}", "app.GET"), (3, "{m}.both_{k}", "app.trace")],
            "route": [(4, "GET", "/a", "both_{k}", "", None, None, ""), (4, "TRACE", "/b/{k}", "both_{k}", "", None, None, "")],
        },
        {
            "text": ['__all__ = ["_hidden", "x"]', "def _hidden(): return -1", 'def shown_{k}(): return "s" if x else y'],
            "decl": [(2, 2, "_hidden", "function", False, None, "_hidden()", "", "", 1, "unaryop", ""), (3, 3, "shown_{k}", "function", False, None, "shown_{k}()", "", "", 2, "ifexp", "")],
        },
    ],
    [
        {"text": ["subprocess.run(", "    cmd,", "    shell=True,", ")"], "call": [(1, "{m}", "subprocess.run")], "danger": [(1, "python.subprocess-shell", "critical")]},
        {"text": ['text = "eval(x)"  # eval(y)', "yaml.load(f,", "          Loader=yaml.CSafeLoader)", "eval(text); literal_eval(text)"], "call": [(2, "{m}", "yaml.load"), (4, "{m}", "eval"), (4, "{m}", "literal_eval")], "danger": [(4, "python.eval", "high")]},
        {"text": ['jwt.decode(t, key, algorithms=["HS256"], options={"verify_signature": False})', "auth.jwt.decode(t)", 'jwt.decode(t, algorithms=["HS256"], options={"a": "verify_signature"})'], "call": [(1, "{m}", "jwt.decode"), (2, "{m}", "auth.jwt.decode"), (3, "{m}", "jwt.decode")], "danger": [(1, "python.jwt-validation-incomplete", "high"), (2, "python.jwt-validation-incomplete", "high")]},
        {"text": ["db.execute(", '    f"SELECT * FROM t WHERE id = {x}"', ")", 'db.execute("select 1", [x])', 'cur().executemany("insert into t values (%s)" % y)', 'db.execute("update t set a = {}".format(y))'], "call": [(1, "{m}", "db.execute"), (4, "{m}", "db.execute"), (5, "{m}", "cur().executemany"), (5, "{m}", "cur"), (6, "{m}", "db.execute"), (6, "{m}", "'update t set a = {}'.format")], "danger": [(1, "python.sql-string-concatenation", "high"), (5, "python.sql-string-concatenation", "high"), (6, "python.sql-string-concatenation", "high")]},
        {"text": ["requests.get(url, verify=False); hashlib.md5(data); hashlib.sha1(data)"], "call": [(1, "{m}", "requests.get"), (1, "{m}", "hashlib.md5"), (1, "{m}", "hashlib.sha1")], "danger": [(1, "python.tls-verification-disabled", "high"), (1, "python.weak-hash", "medium")]},
        {"text": ["with open(p) as f:", "    yaml.unsafe_load(f); pickle.loads(f.read())"], "call": [(1, "{m}", "open"), (2, "{m}", "yaml.unsafe_load"), (2, "{m}", "pickle.loads"), (2, "{m}", "f.read")], "danger": [(2, "python.unsafe-yaml-load", "high"), (2, "python.pickle-loads", "high")]},
        {"text": ["subprocess.run(cmd, shell=False, **more)"], "call": [(1, "{m}", "subprocess.run")]},
    ],
]


def _text() -> str:
    """SQL of Spark: the text of a part."""
    parts = [f"CASE p_partkey % {len(p)} {' '.join(f'WHEN {v} THEN {_quoted(chr(10).join(x["text"]))}' for v, x in enumerate(p))} END" for p in PIECES]
    return f"replace(concat_ws('\\n', {', '.join(parts)}, IF({_BROKEN}, 'def broken(:', NULL)), '{{k}}', {_K})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def parts(spark, d):
    """A part's row is small and its text is not: one file of parts is read by all cores."""
    return spread(table(spark, d, "part").select("p_partkey"))


def files(spark, d):
    return parts(spark, d).selectExpr(f"concat('app/m', {_K}, '.py') AS path", f"{_text()} AS text")


def facts(spark, d, *kinds, plain=()):
    """The facts that a query is made of; written down once where several sides of a join are."""
    out = code_facts(files(spark, d), kinds, plain)
    return staged(out, "facts") if len(kinds) > 1 else out


_PIECES_SQL = "pieces AS (" + " UNION ALL ".join(f"SELECT p_partkey AS k, {i} AS piece, p_partkey % {len(p)} AS variant, {' + '.join(['0', *[f'CASE p_partkey % {len(b)} ' + ' '.join(f'WHEN {v} THEN ' + str(len(x['text'])) for v, x in enumerate(b)) + ' END' for b in PIECES[:i]]])} AS before FROM part" for i, p in enumerate([*PIECES, [{}]])) + ")"


def _value(x) -> str:
    return "NULL" if x is None else q(x) if isinstance(x, str) else str(x).lower()


def _expected(kind: str, names: str) -> str:
    """SQL of the oracle: piece, variant and facts of a kind, placed in each text that has no error: path, k, line and the named columns."""
    rows = ", ".join(f"({i}, {v}, {', '.join(map(_value, f))})" for i, p in enumerate(PIECES) for v, x in enumerate(p) for f in x.get(kind, ()))
    return f"{_PIECES_SQL}, f AS (SELECT 'app/m' || k || '.py' AS path, k, CAST(before + rel AS INT) AS line, before, {names} FROM pieces JOIN (VALUES {rows}) AS x(piece, variant, rel, {names}) USING (piece, variant) WHERE k % 11 <> 10)"


def _put(c: str) -> str:
    return f"replace(replace({c}, '{{m}}', 'app.m' || k), '{{k}}', CAST(k AS VARCHAR))"


_DECL = _expected("decl", "stop, name, kind, is_async, owner, signature, bases, decorators, complexity, shapes, raised")
_NAME = f"'app.m' || k || '.' || {_put('name')} AS qualified_name"


@R.add("code_declarations", f"WITH {_DECL} SELECT path, {_NAME}, {_put('owner')} AS owner, kind, line AS start_line, CAST(before + stop AS INT) AS end_line, is_async, {_put('signature')} AS signature, bases, {_put('decorators')} AS decorators FROM f")
def code_declarations(spark, d):
    return P.code_declarations(facts(spark, d, "declaration", "decorator")).drop("number").withColumns({"bases": F.array_join("bases", ","), "decorators": F.array_join("decorators", ";")})


@R.add("code_imports", f"WITH {_expected('import', 'module, name, alias, dynamic')} SELECT path, line, {_put('module')} AS module, {_put('name')} AS name, alias, dynamic, coalesce(name = '*', false) AS wildcard FROM f")
def code_imports(spark, d):
    return P.code_imports(facts(spark, d, "import"))


@R.add("code_calls", f"WITH {_expected('call', 'caller, target')} SELECT path, {_put('caller')} AS caller, target, line FROM f")
def code_calls(spark, d):
    return P.code_calls(facts(spark, d, "call", plain=("call",)))


@R.add("code_complexity", f"WITH {_DECL} SELECT path, {_NAME}, CAST(complexity AS BIGINT) AS complexity FROM f")
def code_complexity(spark, d):
    return P.code_complexity(facts(spark, d, "declaration", "branch", plain=("declaration",))).drop("number")


@R.add("code_exports", f"WITH {_DECL} SELECT path, {_NAME}, CASE WHEN owner IS NULL AND k % 3 = 2 THEN list_contains(['_hidden', 'x'], n) ELSE n NOT LIKE '\\_%' ESCAPE '\\' END AS exported FROM (SELECT *, list_last(string_split(name, '.')) AS n FROM f)")
def code_exports(spark, d):
    return P.code_exports(facts(spark, d, "declaration", "export", plain=("declaration",))).drop("number")


@R.add("code_behaviour", f"WITH {_DECL} SELECT path, {_NAME}, shapes AS return_shapes, raised AS raises FROM f WHERE kind <> 'class'")
def code_behaviour(spark, d):
    return P.code_behaviour(facts(spark, d, "declaration", "return", "raise", plain=("declaration",))).drop("number").withColumns({c: F.array_join(c, ",") for c in ("return_shapes", "raises")})


@R.add(
    "code_warnings",
    f"""WITH {_expected('import', 'module, name, alias, dynamic')} SELECT path, line, 'python.wildcard-import' AS rule_id, 'medium' AS severity FROM f WHERE name = '*' UNION ALL SELECT path, line, 'python.dynamic-import', 'medium' FROM f WHERE dynamic
UNION ALL SELECT 'app/m' || k || '.py', CAST(before + 1 AS INT), 'python.syntax-error', 'medium' FROM pieces WHERE piece = {len(PIECES)} AND k % 11 = 10""",
)
def code_warnings(spark, d):
    return P.code_warnings(code_facts(files(spark, d), ("import", "error")))


_ROUTE_FACTS = ("declaration", "decorator", "assigned call")
_ROUTES = _expected("route", "method, route, handler, models, response_model, status, dependencies")


@R.add("web_routes", f"WITH {_ROUTES} SELECT path, method, {_put('route')} AS route, {_put('handler')} AS handler, models AS request_models, response_model, CAST(status AS INT) AS status, dependencies, line FROM f")
def web_routes(spark, d):
    return P.web_routes(facts(spark, d, *_ROUTE_FACTS)).withColumns({c: F.array_join(c, ";") for c in ("request_models", "dependencies")})


@R.add("danger_calls", f"WITH {_expected('danger', 'rule_id, severity')} SELECT path, rule_id, severity, line FROM f")
def danger_calls(spark, d):
    return P.danger_calls(facts(spark, d, "call"))


_CHANGES = "CASE WHEN k % 2 = 0 THEN 'response model changed' END, CASE WHEN k % 5 = 0 THEN 'status code changed' END, CASE WHEN k % 7 = 0 THEN 'dependencies changed' END"


@R.add("route_diff_of_sources", f"WITH {_ROUTES} SELECT {_put('route')} AS path, method, 'modified' AS change, k % 2 = 0 OR k % 5 = 0 AS breaking, concat_ws('; ', {_CHANGES}) AS explanation FROM f WHERE method = 'POST' AND (k % 2 = 0 OR k % 5 = 0 OR k % 7 = 0)")
def route_diff_of_sources(spark, d):
    """The routes of two versions of the sources, compared."""
    before = parts(spark, d).selectExpr("p_partkey", f"concat('app/m', {_K}, '.py') AS path", f"{_text()} AS text")
    after = before.selectExpr("path", "replace(replace(replace(text, IF(p_partkey % 2 = 0, 'list[Item]', '\\0'), 'New'), IF(p_partkey % 5 = 0, 'status_code=201', '\\0'), 'status_code=202'), IF(p_partkey % 7 = 0, 'Depends(auth)', '\\0'), 'Depends(other)') AS text")

    def routes(df):
        r = P.web_routes(staged(code_facts(df, _ROUTE_FACTS), "facts"))
        return r.where("route <> '/a'").select("method", F.col("route").alias("path"), F.array_join("request_models", ";").alias("request"), F.col("response_model").alias("response"), "status", F.array_join("dependencies", ";").alias("depends"), F.col("line").alias("position"))

    return G.route_diff(routes(before), routes(after))


@R.add("register_analyzer", "SELECT sha256('long:' || source) AS fingerprint, min(doc_id) AS first, max(doc_id) AS seq, 'long' AS rule_id FROM documents WHERE n_chars > 3000 GROUP BY source UNION ALL SELECT sha256('short:' || source), min(doc_id), max(doc_id), 'short' FROM documents WHERE n_chars < 500 GROUP BY source")
def register_analyzer(spark, d):
    def sized(rule, test):
        return lambda df: df.where(test).select(fingerprint(F.lit(rule), F.col("source")).alias("fingerprint"), F.col("doc_id").alias("seq"), F.lit(rule).alias("rule_id"))

    return P.run_analyzers(table(spark, d, "documents"), [sized("long", "n_chars > 3000"), sized("short", "n_chars < 500")])


def _long_words(path, text):
    """A user's function: the first word of over 11 letters; it fails on texts with a mail address."""
    if "@" in text:
        raise ValueError("mail")
    for n, line in enumerate(text.split("\n"), 1):
        for word in line.split(" "):
            if len(word) > 11 and word.isascii() and word.isalpha():
                yield {"rule_id": "long-word", "line": n, "message": word}
                return


@R.add(
    "register_python_analyzer",
    r"""WITH w AS (SELECT doc_id, n, word, p FROM (SELECT doc_id, n, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS p FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE NOT contains(text, '@'))) WHERE regexp_full_match(word, '[A-Za-z]{12,}'))
SELECT doc_id AS seq, 'long-word' AS rule_id, 'medium' AS severity, CAST(arg_min(n, (n, p)) AS INT) AS line, arg_min(word, (n, p)) AS message FROM w GROUP BY doc_id
UNION ALL SELECT doc_id, 'analyzer.failed', 'high', NULL, 'ValueError: mail' FROM documents WHERE contains(text, '@')""",
)
def register_python_analyzer(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("path"), "text")
    return P.run_analyzers(docs, [P.python_analyzer("words", _long_words)]).select("seq", "rule_id", "severity", "line", "message")


@R.add("register_requirement_scorer", f"WITH {BASE_SQL}, own AS (SELECT requirement_id, candidate_id, round(score, 9) * CASE WHEN kind = 'test' THEN 0.5 ELSE 1.0 END AS s FROM scores WHERE score > 0), k AS (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY s DESC, candidate_id) AS place FROM own) SELECT requirement_id, candidate_id, CAST(place AS INT) AS place, round(s, 4) AS score FROM k WHERE place <= 3 AND s >= 0.12")
def register_requirement_scorer(spark, d):
    own = P.rescored(rounded(spark, d), F.col("score") * F.when(F.col("kind") == "test", 0.5).otherwise(1.0))
    return T.requirement_topk(own, k=3).select("requirement_id", "candidate_id", "place", F.round("score", 4).alias("score"))


QUERIES, SQL = R.queries, R.sql
