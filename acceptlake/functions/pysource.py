"""Python sources as one table of facts: what is declared, imported, called, branched on, returned and raised, where, and inside of what.

The language's own parser reads each text in the task that holds it; everything behind it is a DataFrame operation on the facts.
"""

from __future__ import annotations

import ast
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: name: of a parameter or keyword (null: positional). form: class of the value's syntax node, or "element" and "entry" for the parts of a list or
#: dict behind the same keyword. text: the value. literal: a text constant. callee, first: where the value is a call, what it calls and with what first.
_ARG = "struct<name:string,form:string,text:string,literal:string,annotation:string,callee:string,first:string>"
FACTS = f"path string, fact string, number int, within array<int>, scope string, line int, end_line int, form string, name string, value string, alias string, weight int, args array<{_ARG}>"
_ARROW = pa.list_(pa.struct([(x, pa.string()) for x in ("name", "form", "text", "literal", "annotation", "callee", "first")]))
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int32(), _ARROW]
_NAMES = [c.split()[0] for c in FACTS.split(", ")]
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.Assert, ast.comprehension, ast.Match)
_DECLARED = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "async function"}
KINDS = ("declaration", "decorator", "import", "call", "branch", "return", "raise", "export", "assigned call", "error")
#: Nodes that some fact is read from, and nodes that neither are nor hold such ones.
_READ = (*_DECLARED, *_BRANCHES, ast.Import, ast.ImportFrom, ast.Call, ast.BoolOp, ast.Return, ast.Raise, ast.Assign, ast.AnnAssign)
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias, ast.Load, ast.Store, ast.Del, ast.TypeIgnore))
_LEAVES |= {k for of in (ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for k in of.__subclasses__()}
#: Facts of a record batch, or those of one longer text.
_BATCH_FACTS = 20_000


def _text(node: ast.AST | None) -> str | None:
    if node is None:
        return None
    try:
        return ast.unparse(node)
    except RecursionError:
        return "..."


def _dotted(node: ast.AST | None) -> tuple[str, str]:
    """a.b.c of a chain of attributes, subscripts left out; and the same without a head that isn't a name."""
    parts = []
    while isinstance(node, ast.Attribute | ast.Subscript):
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
        node = node.value
    parts.reverse()
    plain = isinstance(node, ast.Name)
    return ".".join([node.id if plain else _text(node) or "", *parts]).strip("."), ".".join([node.id, *parts] if plain else parts)


def _arg(name: str | None, value: ast.AST | None, form: str | None = None, annotation: str | None = None) -> dict:
    call = value if isinstance(value, ast.Call) else None
    literal = value.value if isinstance(value, ast.Constant) and isinstance(value.value, str) else None
    first = _text(call.args[0]) if call and call.args else None
    return {"name": name, "form": form or type(value).__name__, "text": _text(value), "literal": literal, "annotation": annotation, "callee": _text(call.func) if call else None, "first": first}


def _call_args(call: ast.Call) -> list[dict]:
    out = [_arg(None, a) for a in call.args]
    for k in call.keywords:
        out.append(_arg(k.arg or "**", k.value))
        if isinstance(k.value, ast.List | ast.Tuple):
            out += [_arg(k.arg, e, "element") for e in k.value.elts]
        if isinstance(k.value, ast.Dict):
            out += [_arg(k.arg, v, "entry") | {"first": _text(key)} for key, v in zip(k.value.keys, k.value.values, strict=True)]
    return out


def _parameters(a: ast.arguments) -> list[dict]:
    by_place = [*a.posonlyargs, *a.args]
    defaults = [*[None] * (len(by_place) - len(a.defaults)), *a.defaults, *a.kw_defaults]
    return [_arg(p.arg, d, annotation=_text(p.annotation)) for p, d in zip([*by_place, *a.kwonlyargs], defaults, strict=True)]


def _shape(value: ast.AST | None) -> str:
    match value:
        case None | ast.Constant(value=None):
            return "none"
        case ast.Constant():
            return f"constant:{type(value.value).__name__}"
        case ast.Name():
            return f"name:{value.id}"
        case ast.Call():
            return f"call:{_dotted(value.func)[0] or 'dynamic'}"
        case ast.Dict():
            return "mapping"
        case ast.List() | ast.Tuple() | ast.Set():
            return "sequence"
        case ast.Yield() | ast.YieldFrom():
            return "generator"
    return type(value).__name__.lower()


def module_of(path: str) -> str:
    return ".".join(p for p in path.replace("\\", "/").removesuffix(".py").split("/") if p not in ("", "__init__"))


def _children(node: ast.AST) -> list[ast.AST]:
    out = []
    for name in node._fields:
        x = getattr(node, name, None)
        if isinstance(x, list):
            out += [e for e in x if isinstance(e, ast.AST) and type(e) not in _LEAVES]
        elif isinstance(x, ast.AST) and type(x) not in _LEAVES:
            out.append(x)
    return out


def facts_of(path: str, text: str, kinds: Collection[str] = KINDS, plain: Collection[str] = ()) -> Iterator[tuple]:
    """Rows of FACTS of one text, in order, of the wanted kinds; those in plain without args and, for a declaration, signature (value). A text that
    can't be parsed gives one fact, error."""

    def row(fact, node, within=(), scope="", number=None, form=None, name=None, value=None, alias=None, weight=None, args=None):
        return path, fact, number, list(within), scope, getattr(node, "lineno", None), getattr(node, "end_lineno", None), form, name, value, alias, weight, args

    try:
        tree = ast.parse(text, type_comments=True)
    except SyntaxError as e:
        if "error" in kinds:
            yield row("error", None, value=e.msg, weight=e.lineno)
        return
    except (ValueError, RecursionError, MemoryError) as e:
        if "error" in kinds:
            yield row("error", None, value=type(e).__name__)
        return
    declared = 0
    # what is still to be visited: node, declarations around it, dotted scope, kinds of the declarations, the class around, depth
    todo: list[tuple] = [(tree, (), module_of(path), (), None, 0)]
    while todo:
        node, within, scope, around, owner, depth = todo.pop()
        if isinstance(node, _READ):
            here = {"within": within, "scope": scope}
            match node:
                case ast.ClassDef() | ast.FunctionDef() | ast.AsyncFunctionDef():
                    form, of, signature, args = _DECLARED[type(node)], owner, None, None
                    if form != "class":
                        of = owner if around and around[-1] == "class" else None
                    if "declaration" in kinds and "declaration" not in plain:
                        if form == "class":
                            signature, args = f"class {node.name}", [_arg(None, b) | {"name": _dotted(b)[0]} for b in node.bases]
                        else:
                            returns = "" if node.returns is None else f" -> {_text(node.returns)}"
                            signature, args = f"{'async ' if form != 'function' else ''}{node.name}({_text(node.args)}){returns}", _parameters(node.args)
                    if "declaration" in kinds:
                        yield row("declaration", node, **here, number=declared, form=form, name=node.name, value=signature, alias=of, args=args)
                    scope, around = f"{scope}.{node.name}".strip("."), (*around, form)
                    within, owner = (*within, declared), scope if form == "class" else owner
                    for k, d in enumerate(node.decorator_list if "decorator" in kinds else ()):
                        call = isinstance(d, ast.Call)
                        args = _call_args(d) if call and "decorator" not in plain else None
                        yield row("decorator", d, within, scope, declared, "call" if call else "name", _dotted(d)[0], _text(d.func) if call else None, weight=k, args=args)
                    declared += 1
                case ast.Import() if "import" in kinds:
                    for a in node.names:
                        yield row("import", node, **here, form="plain", name=a.name, alias=a.asname)
                case ast.ImportFrom() if "import" in kinds:
                    for a in node.names:
                        yield row("import", node, **here, form="from", name="." * node.level + (node.module or ""), value=a.name, alias=a.asname)
                case ast.Call() if "call" in kinds or "import" in kinds:
                    name, value = _dotted(node.func)
                    if "call" in kinds:
                        yield row("call", node, **here, name=name, value=value, args=None if "call" in plain else _call_args(node))
                    if name in ("importlib.import_module", "__import__") and "import" in kinds:
                        yield row("import", node, **here, form="dynamic", name=(node.args and _arg(None, node.args[0])["literal"]) or "<dynamic>")
                case ast.BoolOp() if "branch" in kinds:
                    yield row("branch", node, **here, weight=max(1, len(node.values) - 1))
                case ast.Return() if "return" in kinds:
                    yield row("return", node, **here, name=_shape(node.value))
                case ast.Raise() if "raise" in kinds:
                    yield row("raise", node, **here, name=_dotted(node.exc.func if isinstance(node.exc, ast.Call) else node.exc)[0] or "dynamic_exception")
                case ast.Assign() | ast.AnnAssign():
                    for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                        if isinstance(t, ast.Name) and t.id == "__all__" and depth == 1 and isinstance(node.value, ast.List | ast.Tuple | ast.Set) and "export" in kinds:
                            yield row("export", node, args=[_arg(None, e) for e in node.value.elts])
                        if isinstance(t, ast.Name) and isinstance(node.value, ast.Call) and "assigned call" in kinds:
                            yield row("assigned call", node, **here, name=t.id, value=_text(node.value.func), weight=depth, args=_call_args(node.value))
            if "branch" in kinds and isinstance(node, _BRANCHES):
                yield row("branch", node, **here, weight=1)
        todo += [(child, within, scope, around, owner, depth + 1) for child in reversed(_children(node))]


def code_facts(files: DataFrame, kinds: Collection[str] = KINDS, plain: Collection[str] = ()) -> DataFrame:
    """Facts (FACTS) of files (path, text): one reading, each text alone. A text without a path or a null text has none. kinds: the facts that are
    wanted, if not all; plain: those of them whose arguments and signatures, which cost most to write down, are not."""
    if odd := sorted({*kinds, *plain} - set(KINDS)):
        raise ValueError(f"unknown facts: {', '.join(odd)}")
    kinds, plain = frozenset(kinds), frozenset(plain)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                if path.is_valid and text.is_valid:
                    rows += facts_of(path.as_py(), text.as_py(), kinds, plain)
                if len(rows) >= _BATCH_FACTS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return files.select("path", "text").mapInArrow(scan, FACTS)
