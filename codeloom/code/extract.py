"""Python sources to rows: imports, exports, symbols with their call sites, and parse errors, by the standard parser."""

from __future__ import annotations

import ast
import io
import textwrap
import tokenize
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = "struct<expr:string,line:int,kind:string,control_ctx:string>"
IMPORT = "struct<module:string,name:string,alias:string,level:int,line:int,is_from:boolean>"
SYMBOL = (
    "struct<kind:string,qualname:string,name:string,parent_qualname:string,signature:string,decorators:array<string>,docstring:string,start_line:int,end_line:int,"
    f"raw_code:string,is_async:boolean,bases:array<string>,init_attrs:map<string,string>,param_types:map<string,string>,local_types:map<string,string>,call_sites:array<{SITE}>>"
)
PARSED = f"imports:array<{IMPORT}>,exports:array<string>,symbols:array<{SYMBOL}>,skeleton:string,main_guard:boolean,parse_error:string"
EXPR_CHARS = 200

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef)
_BLOCKS = {"If": "if", "For": "for", "AsyncFor": "for", "While": "while", "Try": "try", "TryStar": "try", "With": "with", "AsyncWith": "with", "ListComp": "comp", "SetComp": "comp", "DictComp": "comp", "GeneratorExp": "comp"}


def decode_source(raw: bytes) -> str:
    """By the encoding cookie or byte order mark; as UTF-8 with replacement characters if that fails."""
    try:
        return raw.decode(tokenize.detect_encoding(io.BytesIO(raw).readline)[0])
    except (SyntaxError, UnicodeError, LookupError):
        return raw.decode("utf-8", errors="replace")


def unwrap_optional(text: str) -> str:
    """unwrap_optional of functions.text for a Python string."""
    text = text.strip()
    head = text.partition("[")[0]
    if head in ("Optional", "typing.Optional") and text.endswith("]"):
        return text[len(head) + 1 : -1]
    return text.replace(" | None", "").replace("None | ", "").strip()


def _annotation(node: ast.expr) -> str:
    quoted = isinstance(node, ast.Constant) and isinstance(node.value, str)
    return unwrap_optional(node.value if quoted else ast.unparse(node))


def call_sites(nodes: list[ast.AST], context: tuple[str, ...] = ()) -> Iterator[dict]:
    """Calls of a scope in source order of the tree, with the control blocks around each; inner definitions own theirs."""
    for node in nodes:
        if isinstance(node, _SCOPES):
            continue
        if isinstance(node, ast.Call):
            yield {"expr": ast.unparse(node.func)[:EXPR_CHARS], "line": node.lineno, "kind": "call", "control_ctx": ">".join(context)}
        if isinstance(node, ast.IfExp):
            test = ast.unparse(node.test)[:EXPR_CHARS]
            yield from call_sites([node.test], context)
            yield from call_sites([node.body], (*context, f"if {test}"))
            yield from call_sites([node.orelse], (*context, f"if not ({test})"))
            continue
        block = _BLOCKS.get(type(node).__name__)
        yield from call_sites(list(ast.iter_child_nodes(node)), (*context, block) if block else context)


def own_statements(nodes: list[ast.AST]) -> Iterator[ast.AST]:
    """Nodes of a scope through its control blocks, without inner definitions."""
    for node in nodes:
        if not isinstance(node, (*_SCOPES, ast.Lambda)):
            yield node
            yield from own_statements(list(ast.iter_child_nodes(node)))


def _of_self(node: ast.AST) -> bool:
    return isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self"


def parameter_types(args: ast.arguments) -> dict[str, str]:
    every = [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]
    return {a.arg: _annotation(a.annotation) for a in every if a.annotation is not None and a.arg not in ("self", "cls")}


def attribute_types(init: ast.AST) -> dict[str, str]:
    """Type names of what __init__ assigns to attributes of self: what is called, a parameter's type, or an annotation."""
    known, found = parameter_types(init.args), {}
    for node in own_statements(init.body):
        if isinstance(node, ast.Assign):
            value = node.value
            name = ast.unparse(value.func) if isinstance(value, ast.Call) else known.get(value.id, "") if isinstance(value, ast.Name) else ""
            found.update((t.attr, name) for t in node.targets if _of_self(t))
        elif isinstance(node, ast.AnnAssign) and _of_self(node.target):
            found[node.target.attr] = _annotation(node.annotation)
    return found


def local_types(body: list[ast.stmt]) -> dict[str, str]:
    """Names that are assigned a call, with what is called."""
    found = {}
    for node in own_statements(body):
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(node.value, ast.Call):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            found.update((t.id, ast.unparse(node.value.func)) for t in targets if isinstance(t, ast.Name))
    return found


def _signature(node: ast.AST) -> str:
    back = f" -> {node.returns.value if isinstance(node.returns, ast.Constant) and isinstance(node.returns.value, str) else ast.unparse(node.returns)}" if node.returns else ""
    return ("async " if isinstance(node, ast.AsyncFunctionDef) else "") + ast.unparse(node.args) + back


def _symbols(body: list[ast.stmt], lines: list[str], scope: tuple[ast.AST, ...] = ()) -> Iterator[dict]:
    """Definitions of a scope, each before what it holds; control blocks open no scope."""
    for node in body:
        if not isinstance(node, _SCOPES):
            inner = [c for c in ast.iter_child_nodes(node) if isinstance(c, ast.stmt)]
            inner += [s for c in ast.iter_child_nodes(node) if isinstance(c, (ast.ExceptHandler, ast.match_case)) for s in c.body]
            yield from _symbols(inner, lines, scope)
            continue
        is_class = isinstance(node, ast.ClassDef)
        names = [x.name for x in scope]
        start = min([node.lineno, *(d.lineno for d in node.decorator_list[:1])])
        decorators = [{"expr": ast.unparse(d.func if isinstance(d, ast.Call) else d)[:EXPR_CHARS], "line": d.lineno, "kind": "decorator", "control_ctx": ""} for d in node.decorator_list]
        init = node if node.name == "__init__" and not is_class else next((s for s in node.body if isinstance(s, _FUNCTIONS) and s.name == "__init__"), None) if is_class else None
        yield {
            "kind": "class" if is_class else "function" if not scope else "method" if isinstance(scope[-1], ast.ClassDef) else "nested",
            "qualname": ".".join([*names, node.name]),
            "name": node.name,
            "parent_qualname": ".".join(names) or None,
            "signature": "" if is_class else _signature(node),
            "decorators": [ast.unparse(d) for d in node.decorator_list],
            "docstring": ast.get_docstring(node),
            "start_line": start,
            "end_line": node.end_lineno,
            "raw_code": "\n".join(lines[start - 1 : node.end_lineno]),
            "is_async": isinstance(node, ast.AsyncFunctionDef),
            "bases": [ast.unparse(b) for b in node.bases] if is_class else [],
            "init_attrs": attribute_types(init) if init is not None else {},
            "param_types": {} if is_class else parameter_types(node.args),
            "local_types": {} if is_class else local_types(node.body),
            "call_sites": [*decorators, *call_sites(node.body)],
        }
        yield from _symbols(node.body, lines, (*scope, node))


def _module_symbol(tree: ast.Module, lines: list[str], stem: str) -> Iterator[dict]:
    """The module's own statements as a symbol, if they call anything."""
    own = [s for s in tree.body if not isinstance(s, (*_SCOPES, ast.Import, ast.ImportFrom))]
    if any(isinstance(n, ast.Call) for s in own for n in ast.walk(s)):
        code = "\n".join("\n".join(lines[s.lineno - 1 : s.end_lineno]) for s in own)
        base = dict(kind="module", qualname=f"{stem}::<module>", name="<module>", parent_qualname=None, signature="", decorators=[], docstring=None, is_async=False, bases=[])
        yield base | dict(start_line=min(s.lineno for s in own), end_line=max(s.end_lineno for s in own), raw_code=code, init_attrs={}, param_types={}, local_types={}, call_sites=list(call_sites(own)))


def skeleton(symbols: list[dict]) -> str:
    """A line for each symbol: a class with its bases, a function with its signature, a module's marker."""
    out = []
    for s in symbols:
        args, arrow, back = s["signature"].removeprefix("async ").partition(" -> ")
        if s["kind"] == "class":
            out.append(f"class {s['qualname']}({', '.join(s['bases'])}):")
        elif s["kind"] == "module":
            out.append(f"# module {s['qualname']}")
        else:
            out.append(f"{'async ' * s['is_async']}def {s['qualname']}({args}){arrow}{back}:")
    return "\n".join(out)


def is_main_guard(tree: ast.AST) -> bool:
    """Somewhere, __name__ is compared to "__main__"."""
    for n in ast.walk(tree):
        if isinstance(n, ast.Compare) and isinstance(n.left, ast.Name) and n.left.id == "__name__" and [type(o) for o in n.ops] == [ast.Eq]:
            if isinstance(n.comparators[0], ast.Constant) and n.comparators[0].value == "__main__":
                return True
    return False


def parse_python(path: str, source: str) -> dict:
    """One file as a row of PARSED. A file that can't be parsed has its error and nothing else."""
    empty = {"imports": [], "exports": [], "symbols": [], "skeleton": "", "main_guard": False, "parse_error": None}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return empty | {"parse_error": str(e) or type(e).__name__}
    lines, name = source.splitlines(), path.rpartition("/")[2]
    imports = []
    for n in own_statements(tree.body):
        if isinstance(n, ast.Import):
            imports += [{"module": a.name, "name": None, "alias": a.asname, "level": 0, "line": n.lineno, "is_from": False} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports += [{"module": n.module or "", "name": a.name, "alias": a.asname, "level": n.level, "line": n.lineno, "is_from": True} for a in n.names]
    exports: list[str] = []
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets):
            try:
                value = ast.literal_eval(n.value)
            except ValueError:
                continue
            exports = [str(x) for x in value] if isinstance(value, (list, tuple)) else exports
    if name == "__init__.py":
        shown = [i["alias"] or (i["name"] if i["is_from"] else i["module"].partition(".")[0]) for i in imports]
        exports = list(dict.fromkeys([*exports, *(x for x in shown if not x.startswith("_"))]))
    symbols = [*_symbols(tree.body, lines), *_module_symbol(tree, lines, name.rpartition(".")[0])]
    return empty | {"imports": imports, "exports": exports, "symbols": symbols, "skeleton": skeleton(symbols), "main_guard": any(is_main_guard(s) for s in tree.body if not isinstance(s, _SCOPES))}


#: Parsers by language: (path, source) to a row of PARSED. More may be registered before a job starts.
ADAPTERS: dict[str, Callable[[str, str], dict]] = {"python": parse_python}


#: Files of a task at least, and at most unless every core has four tasks by then; files that become rows at a time.
FILES_LEAST, FILES_MOST, FILES_AT_ONCE = 50, 5000, 200


def spread(files: DataFrame) -> DataFrame:
    """files dealt by path to as many tasks as their number asks for: a table of few bytes is one task's as it is read,
    however many files it stands for."""
    n = files.count()
    most = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_MOST))
    return files.repartition(max(1, min(-(-n // FILES_LEAST), most)), "path")


def parse_files(files: DataFrame) -> DataFrame:
    """files (path, language, source and more) with the columns of PARSED and parse_status: parsed, failed, or unsupported
    for a language without an adapter. A table function over spread files: one Python call a file, Arrow batches; what a
    task holds is FILES_AT_ONCE parsed files."""
    known = dict(ADAPTERS)
    keep = [f for f in files.schema if f.name not in ("source",)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{c}` {t}" for c, t in (x.split(":", 1) for x in _fields(PARSED))] + ["parse_status string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + FILES_AT_ONCE] for b in batches for at in range(0, len(b), FILES_AT_ONCE)):
            rows = []
            for path, language, source in zip(batch["path"], batch["language"], batch["source"]):
                parse = known.get(language)
                row = parse(path, source or "") if parse else parse_python(path, "")
                rows.append(row | {"parse_status": "unsupported" if parse is None else "failed" if row["parse_error"] else "parsed"})
            yield pd.concat([batch[[f.name for f in keep]].reset_index(drop=True), pd.DataFrame(rows, columns=[*(x.split(":", 1)[0] for x in _fields(PARSED)), "parse_status"])], axis=1)

    return spread(files).mapInPandas(run, schema)


def _fields(spec: str) -> list[str]:
    """The top-level fields of a schema string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(spec):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(spec[start:i])
            start = i + 1
    return [*out, spec[start:]]


def symbol_table(parsed: DataFrame) -> DataFrame:
    """One row a symbol: id, file_path, the fields of SYMBOL, parent_id, code_hash. Names that a file defines more than
    once get their line behind the id, all of them."""
    from pyspark.sql import Window

    rows = parsed.select(F.col("path").alias("file_path"), F.explode("symbols").alias("s")).select("file_path", "s.*")
    twins = F.count("*").over(Window.partitionBy("file_path", "qualname")) > 1
    base = F.concat_ws("::", "file_path", "qualname")
    rows = rows.withColumn("id", F.when(twins, F.concat(base, F.lit("@"), F.col("start_line"))).otherwise(base))
    first = rows.groupBy("file_path", F.col("qualname").alias("parent_qualname")).agg(F.min_by("id", "start_line").alias("parent_id"))
    return rows.join(first, ["file_path", "parent_qualname"], "left").withColumn("code_hash", F.sha2("raw_code", 256))


def _body(code: str) -> tuple[ast.AST | None, list[ast.stmt]]:
    try:
        node = ast.parse(textwrap.dedent(code)).body[0]
    except (SyntaxError, IndexError):
        return None, []
    body = getattr(node, "body", [])
    return node, body[ast.get_docstring(node) is not None :] if isinstance(node, _SCOPES) else body


def is_trivial(kind: str, name: str, code: str) -> bool:
    """A symbol whose code needs no model: nothing but a pass, a stub, one attribute set or given back, or a call passed on."""
    if kind == "module" or name in ("__repr__", "__str__"):
        return True
    node, body = _body(code)
    if all(isinstance(s, ast.Pass) for s in body):
        return True
    if len(body) > 1:
        return False
    match body[0]:
        case ast.Raise(exc=ast.Name(id="NotImplementedError") | ast.Call(func=ast.Name(id="NotImplementedError"))):
            return True
        case ast.Assign(targets=[target]):
            return _of_self(target)
        case ast.Return(value=value) if value is not None and _of_self(value):
            return True
        case ast.Return(value=ast.Call(args=args, keywords=words)) if isinstance(node, _FUNCTIONS):
            given = [*args, *(k.value for k in words)]
            own = [p.arg for p in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if p.arg != "self"]
            return all(isinstance(a, ast.Name) for a in given) and [a.id for a in given] == own
    return False


def trivial(symbols: DataFrame, min_lines: int = 0, skip_tests: bool = False) -> DataFrame:
    """symbols with is_trivial; those under min_lines are trivial too, and those of test paths if skip_tests."""
    from codeloom.functions.text import has_test_part

    @F.pandas_udf("boolean")
    def by_code(kind: pd.Series, name: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([is_trivial(*x) for x in zip(kind, name, code)])

    short = F.col("end_line") - F.col("start_line") + 1 < min_lines
    of_test: Column = has_test_part(F.col("file_path")) if skip_tests else F.lit(False)
    return symbols.withColumn("is_trivial", F.when(short | of_test, True).otherwise(by_code("kind", "name", "raw_code")))


def statement_spans(code: str) -> list[tuple[int, int]]:
    """First and last line of each statement of a function's body, or of the code itself if it is no function."""
    try:
        body = ast.parse(textwrap.dedent(code)).body
    except (SyntaxError, ValueError, RecursionError):
        return []
    if body and isinstance(body[0], _FUNCTIONS):
        body = body[0].body
    return [(s.lineno, s.end_lineno) for s in body]


def split_symbol(code: str, start: int, limit: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of chunks of whole statements within `limit` tokens; the head is repeated in each.

    A statement over the limit raises BudgetExceeded, as does code without statements.
    """
    from codeloom.operators.budget import BudgetExceeded, estimate

    lines = code.splitlines(keepends=True)
    if estimate(code) <= limit:
        return [(start, start + len(lines) - 1, code)]
    spans = statement_spans(code)
    if not spans:
        raise BudgetExceeded("no statements to split at")
    first = spans[0][0] - 1
    head, ends = "".join(lines[:first]), [e for _, e in spans[:-1]] + [len(lines)]
    out, opened, last = [], first, first
    for end in ends:
        if estimate(head + "".join(lines[last:end])) > limit:
            raise BudgetExceeded(f"the statement at line {start + last} is over the limit")
        if last > opened and estimate(head + "".join(lines[opened:end])) > limit:
            out.append((start + opened, start + last - 1, head + "".join(lines[opened:last])))
            opened = last
        last = end
    return [*out, (start + opened, start + last - 1, head + "".join(lines[opened:last]))]


def split_symbols(symbols: DataFrame, limit: int) -> DataFrame:
    """id, chunk, start_line, end_line, text of each symbol (id, raw_code, start_line), by split_symbol."""
    kind = "array<struct<start_line:int,end_line:int,text:string>>"

    @F.pandas_udf(kind)
    def cut(code: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([[{"start_line": a, "end_line": b, "text": t} for a, b, t in split_symbol(c, s, limit)] for c, s in zip(code, start)])

    return symbols.select("id", F.posexplode(cut("raw_code", "start_line")).alias("chunk", "c")).select("id", "chunk", "c.*")


def decoded(files: DataFrame, column: str = "content") -> DataFrame:
    """files with text, the decoded source. What is UTF-8 and names no encoding is decoded in the JVM."""

    @F.pandas_udf("string")
    def by_cookie(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else decode_source(x))

    head = F.decode(F.substring(column, 1, 400), "ISO-8859-1")
    plain = F.is_valid_utf8(F.col(column).cast("string")) & ~F.contains(head, F.lit("coding")) & ~F.startswith(head, F.lit("ï»¿"))
    return files.withColumn("text", F.when(plain, F.col(column).cast("string")).otherwise(by_cookie(column)))
