"""Call resolution as joins: each rung of the ladder looks sites up by a key, the first rung with a candidate wins.

All candidates of that rung are kept; more than one make the edges ambiguous. Chases (re-exports, base classes) are
bounded loops over small tables: one row an alias, a class or a base, never a row a call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.shared import kept

# Names too common to resolve by name alone.
COMMON_NAMES = [
    "get", "set", "items", "keys", "values", "append", "extend", "pop", "update", "add", "remove", "join", "split", "strip", "format", "read", "write", "close", "open",
    "copy", "sort", "count", "index", "lower", "upper", "encode", "decode", "replace", "find", "startswith", "endswith",
    "__init__", "__repr__", "__str__", "__len__", "__iter__", "__next__", "__enter__", "__exit__", "__eq__", "__hash__",
]
# Rungs in order with their confidence.
CONFIDENCE = {"import": 0.95, "local": 0.9, "super": 0.9, "self": 0.9, "ctor": 0.9, "typed": 0.8, "name-unique": 0.75}
AMBIGUOUS = 0.4
# Decorators that mark an entry point, by the end of their name.
ENTRY_DECORATORS = [".route", ".get", ".post", ".put", ".delete", ".patch", ".command", ".task", ".callback"]
CHASE = 8


def module_index(files: DataFrame) -> DataFrame:
    """key, target: every name under which a file (path) can be imported, with dots; with and without src."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    keys = F.array(stem, F.when(F.col("path").rlike(r".+/__init__\.py$"), F.regexp_replace("path", r"/__init__\.py$", "")))
    rows = files.select(F.col("path").alias("target"), F.explode(keys).alias("k")).filter("k IS NOT NULL")
    both = rows.unionByName(rows.filter(F.col("k").startswith("src/")).select("target", F.substring("k", 5, 10_000).alias("k")))
    return both.select(F.replace("k", F.lit("/"), F.lit(".")).alias("key"), "target").groupBy("key").agg(F.max("target").alias("target"))


def import_map(parsed: DataFrame) -> DataFrame:
    """file_path, alias, target, exported, prefix: what each imported name of a file stands for; the last import wins.

    exported is null for a module; prefix is what must follow the name first (`import a.b` binds a, which stands for a.b).
    """
    index = module_index(parsed.select("path"))
    rows = parsed.select(F.col("path").alias("file_path"), F.posexplode("imports").alias("at", "i")).select("file_path", "at", "i.*")
    folders = F.split("file_path", "/")
    package = F.array_join(F.slice(folders, 1, F.greatest(F.size(folders) - F.col("level"), F.lit(0))), ".")
    absolute = F.col("level") == 0
    module = F.when(absolute, F.col("module")).otherwise(F.concat_ws(".", F.when(package != "", package), F.when(F.col("module") != "", F.col("module"))))
    rows = rows.withColumn("m", module).withColumn("sub", F.when(F.col("is_from"), F.concat_ws(".", F.when(F.col("m") != "", F.col("m")), "name")))
    own = index.select(F.col("key").alias("m"), F.col("target").alias("module_file"))
    inner = index.select(F.col("key").alias("sub"), F.col("target").alias("sub_file"))
    met = rows.join(own, "m", "left").join(inner, "sub", "left")
    first = F.element_at(F.split("module", r"\."), 1)
    alias = F.coalesce("alias", F.when(F.col("is_from"), F.col("name")).otherwise(first))
    prefix = F.when(~F.col("is_from") & F.col("alias").isNull(), F.expr("substring(module, length(split(module, '[.]')[0]) + 2)")).otherwise("")
    found = met.select("file_path", "at", alias.alias("alias"), F.coalesce("sub_file", "module_file").alias("target"), F.when(F.col("is_from") & F.col("sub_file").isNull(), F.col("name")).alias("exported"), prefix.alias("prefix")).filter("target IS NOT NULL")
    return found.groupBy("file_path", "alias").agg(F.max_by(F.struct("target", "exported", "prefix"), "at").alias("b")).select("file_path", "alias", "b.*")


def _through(rows: DataFrame, imports: DataFrame) -> DataFrame:
    """rows (file, name and more) where the name's head is imported in the file: file and name become what it stands for."""
    i = imports.select(F.col("file_path").alias("file"), F.col("alias").alias("head"), "target", "exported", "prefix")
    rest = F.expr("substring(name, length(head) + 2)")
    met = rows.withColumn("head", F.element_at(F.split("name", r"\."), 1)).join(i, ["file", "head"]).withColumn("rest", rest)
    whole = F.when(F.col("exported").isNotNull(), F.concat_ws(".", "exported", F.when(F.col("rest") != "", F.col("rest")))).when(F.col("prefix") == "", F.col("rest")).when(F.startswith("rest", F.concat("prefix", F.lit("."))), F.expr("substring(rest, length(prefix) + 2)"))
    return met.withColumn("file", F.col("target")).withColumn("name", whole).filter("name IS NOT NULL AND name <> ''").select(*rows.columns)


def defined(rows: DataFrame, symbols: DataFrame, imports: DataFrame, depth: int = CHASE) -> DataFrame:
    """rows (key, file, name) with the symbols of that name in that file, or else where its imports lead: key, target.

    A name that a file defines isn't chased further; chains of re-exports beyond `depth` are given up.
    """
    own = symbols.select(F.col("file_path").alias("file"), F.col("qualname").alias("name"), F.col("id").alias("target"))
    found, open_rows = [], rows.select("key", "file", "name").distinct()
    for _ in range(depth):
        met = kept(open_rows.join(own, ["file", "name"], "left"))
        found.append(met.filter("target IS NOT NULL").select("key", "target"))
        open_rows = kept(_through(met.filter("target IS NULL").select("key", "file", "name"), imports).distinct())
        if open_rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def by_name(symbols: DataFrame) -> DataFrame:
    """name, target: the project-wide index, without dunders and common names."""
    return symbols.filter(~F.col("name").startswith("__") & ~F.col("name").isin(COMMON_NAMES)).select("name", F.col("id").alias("target"))


def classes_of(rows: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """key, class_id of type names (key, file, name): as the file knows the name, or else by name anywhere."""
    kinds = symbols.filter("kind = 'class'").select(F.col("id").alias("target"))
    here = defined(rows, symbols, imports)
    rest = rows.select("key", "name").join(here.select("key").distinct(), "key", "left_anti").join(by_name(symbols.filter("kind = 'class'")), "name").select("key", "target")
    return here.unionByName(rest).distinct().join(kinds, "target").select("key", F.col("target").alias("class_id"))


def class_bases(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """class_id, place, base: base classes in order."""
    rows = symbols.filter("kind = 'class'").select("id", "file_path", F.posexplode("bases").alias("at", "name"))
    rows = rows.select(F.struct("id", "at").alias("key"), F.col("file_path").alias("file"), "name")
    met = classes_of(rows, symbols, imports)
    return met.select(F.col("key.id").alias("class_id"), F.col("class_id").alias("base"), "key.at").groupBy("class_id", "base").agg(F.min("at").alias("at")).select("class_id", F.row_number().over(Window.partitionBy("class_id").orderBy("at", "base")).alias("place"), "base")


def ancestors(symbols: DataFrame, bases: DataFrame, depth: int = CHASE) -> DataFrame:
    """class_id, ancestor, way: all classes above each and itself; ways sort depth first in base order."""
    level = symbols.filter("kind = 'class'").select(F.col("id").alias("class_id"), F.col("id").alias("ancestor"), F.array().cast("array<int>").alias("way"), F.array("id").alias("seen"))
    levels = [level]
    for _ in range(depth):
        up = levels[-1].join(bases.select(F.col("class_id").alias("ancestor"), "place", F.col("base").alias("next")), "ancestor").filter(~F.array_contains("seen", F.col("next")))
        levels.append(kept(up.select("class_id", F.col("next").alias("ancestor"), F.concat("way", F.array("place")).alias("way"), F.concat("seen", F.array("next")).alias("seen"))))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, levels).groupBy("class_id", "ancestor").agg(F.min("way").alias("way"))


def methods(symbols: DataFrame, above: DataFrame) -> DataFrame:
    """class_id, method, target: what a method name means for each class, by the first ancestor that defines it."""
    own = symbols.filter("kind <> 'class' AND parent_id IS NOT NULL").select(F.col("parent_id").alias("ancestor"), F.col("name").alias("method"), F.col("id").alias("target"))
    met = above.join(own, "ancestor")
    first = F.rank().over(Window.partitionBy("class_id", "method").orderBy("way"))
    return met.withColumn("n", first).filter("n = 1").select("class_id", "method", "target")


def call_table(symbols: DataFrame) -> DataFrame:
    """site, caller, file, qualname, class_id (innermost around), expr, line, kind, control_ctx, and parts of expr."""
    rows = symbols.select("id", "file_path", "qualname", F.posexplode("call_sites").alias("at", "c"))
    rows = rows.select(F.struct("id", "at").alias("site"), F.col("id").alias("caller"), F.col("file_path").alias("file"), "qualname", "c.*")
    parts = F.split("expr", r"\.")
    rows = rows.withColumns({"head": parts[0], "method": F.element_at(parts, -1), "dots": F.size(parts) - 1})
    return rows.join(enclosing_classes(symbols), "caller", "left")


def enclosing_classes(symbols: DataFrame, depth: int = CHASE) -> DataFrame:
    """caller, class_id: the innermost class that a symbol is or lies in."""
    up = symbols.select(F.col("id").alias("at"), "kind", "parent_id")
    here, found = symbols.select(F.col("id").alias("caller"), F.col("id").alias("at")), []
    for _ in range(depth):
        met = here.join(up, "at")
        found.append(met.filter("kind = 'class'").select("caller", F.col("at").alias("class_id")))
        here = kept(met.filter("kind <> 'class' AND parent_id IS NOT NULL").select("caller", F.col("parent_id").alias("at")))
        if here.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _attribute_types(symbols: DataFrame, above: DataFrame) -> DataFrame:
    """class_id, attr, name: type names of an attribute, by the nearest class, level by level, whose __init__ sets one."""
    own = symbols.filter("name = '__init__' AND parent_id IS NOT NULL").select(F.col("parent_id").alias("ancestor"), F.explode("init_attrs").alias("attr", "name")).filter("name <> ''")
    near = F.rank().over(Window.partitionBy("class_id", "attr").orderBy(F.size("way"), "way"))
    return above.join(own, "ancestor").withColumn("n", near).filter("n = 1").select("class_id", "attr", "name").distinct()


def candidates(parsed: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sites, candidates (site, rung, target), methods): what the first rung that has any finds for each site; symbols as
    symbol_table gives them. A rung that looks a name up in the whole project is asked only for sites that are still open,
    so that a name of very many symbols doesn't meet sites that are settled."""
    imports = kept(import_map(parsed))
    bases = kept(class_bases(symbols, imports))
    above = kept(ancestors(symbols, bases))
    meaning = kept(methods(symbols, above))
    sites = kept(call_table(symbols))
    one = F.col("dots") == 1
    on_super = F.col("expr").startswith("super().") & one
    on_self = F.col("head").isin("self", "cls") & one
    found: dict[str, DataFrame] = {}

    def left(rows: DataFrame, *rungs: str) -> DataFrame:
        return rows.join(reduce(DataFrame.unionByName, (found[k].select("site") for k in rungs)).distinct(), "site", "left_anti")

    asked = _through(sites.select(F.col("site").alias("key"), "file", F.col("expr").alias("name")), imports)
    found["import"] = kept(defined(asked, symbols, imports).select(F.col("key").alias("site"), "target"))
    still = left(sites, "import")

    scope = F.split("qualname", r"\.")
    names = F.transform(F.sequence(F.lit(0), F.size(scope)), lambda d: F.struct(d.alias("depth"), F.concat_ws(".", F.slice(scope, 1, d), F.col("head")).alias("name")))
    own = symbols.select(F.col("file_path").alias("file"), F.col("qualname").alias("name"), F.col("id").alias("target"))
    scoped = still.filter("dots = 0").select("site", "file", F.explode(names).alias("n")).select("site", "file", "n.*").join(own, ["file", "name"])
    found["local"] = kept(scoped.withColumn("r", F.rank().over(Window.partitionBy("site").orderBy(F.desc("depth")))).filter("r = 1").select("site", "target"))

    of_base = bases.select("class_id", F.col("base")).join(meaning.select(F.col("class_id").alias("base"), "method", "target"), "base")
    found["super"] = kept(still.filter(on_super).join(of_base, ["class_id", "method"]).select("site", "target"))
    found["self"] = kept(still.filter(on_self).join(meaning, ["class_id", "method"]).select("site", "target"))
    still = kept(left(still, "local", "super", "self"))

    named = by_name(symbols)
    classes = symbols.filter("kind = 'class'").select(F.col("id").alias("target"))
    plain = still.filter("dots = 0")
    found["ctor"] = kept(plain.join(named.join(classes, "target"), plain["head"] == named["name"]).select("site", "target"))

    typed = symbols.select(F.col("id").alias("caller"), "local_types", "param_types")
    variable = still.filter(one & ~on_super & ~on_self).join(typed, "caller").select("site", "file", "method", F.coalesce(F.col("local_types")[F.col("head")], F.col("param_types")[F.col("head")]).alias("name"))
    attributes = still.filter(F.col("head").isin("self", "cls") & (F.col("dots") == 2)).withColumn("attr", F.element_at(F.split("expr", r"\."), 2))
    attributes = attributes.join(_attribute_types(symbols, above), ["class_id", "attr"]).select("site", "file", "method", "name")
    wanted = variable.filter("name IS NOT NULL AND name <> ''").unionByName(attributes)
    keyed = wanted.withColumn("key", F.struct("site", "file", "name", "method"))
    of_type = classes_of(keyed, symbols, imports).select("key.site", "key.method", "class_id")
    found["typed"] = kept(of_type.join(meaning, ["class_id", "method"]).select("site", "target"))

    still = left(still, "ctor", "typed").filter(~on_super & ~on_self)
    found["name-unique"] = still.join(named, still["method"] == named["name"]).select("site", "target")
    rungs = [df.select("site", F.lit(k).alias("rung"), "target") for k, df in enumerate(found.values())]
    return sites, kept(reduce(DataFrame.unionByName, rungs).distinct()), meaning


def call_edges(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """caller, callee, callee_expr, line, kind, resolution, source, confidence, control_ctx of every call site.

    A class as target adds an edge to what __init__ means for it, unless the site is a decorator. Equal (callee, kind) of
    a site are one edge; a site that nothing resolves has one edge without a callee.
    """
    sites, found, meaning = candidates(parsed, symbols)
    many = F.count("*").over(Window.partitionBy("site")) > 1
    names, sure = F.array(*map(F.lit, CONFIDENCE)), F.array(*map(F.lit, CONFIDENCE.values()))
    at = F.col("rung") + 1
    picked = found.withColumn("resolution", F.when(many, "ambiguous").otherwise(F.element_at(names, at))).withColumn("confidence", F.when(many, AMBIGUOUS).otherwise(F.element_at(sure, at)))
    picked = picked.join(symbols.select(F.col("id").alias("target"), F.col("kind").alias("target_kind")), "target")
    out = sites.select("site", "caller", F.col("expr").alias("callee_expr"), "line", "kind", "control_ctx").join(picked.drop("rung"), "site", "left")
    makes = (F.col("target_kind") == "class") & (F.col("kind") != "decorator")
    direct = out.withColumn("kind", F.when(makes, "constructor").otherwise(F.col("kind")))
    init = meaning.filter("method = '__init__'").select(F.col("class_id").alias("target"), F.col("target").alias("init"))
    made = out.filter(makes).join(init, "target")
    inits = F.count("*").over(Window.partitionBy("site", "target")) > 1
    made = made.withColumn("confidence", F.when(inits, AMBIGUOUS).otherwise(F.col("confidence"))).withColumn("resolution", F.when(inits, "ambiguous").otherwise(F.col("resolution")))
    made = made.withColumn("target", F.col("init")).withColumn("kind", F.lit("constructor")).drop("init")
    every = direct.unionByName(made).dropDuplicates(["site", "target", "kind"])
    return every.select("caller", F.col("target").alias("callee"), "callee_expr", "line", "kind", F.coalesce("resolution", F.lit("external")).alias("resolution"), F.lit("ast").alias("source"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "control_ctx")


def entry_points(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, entry_kind of symbols where a program starts: main, a main guard, __main__.py, a route, command or task by its
    decorator, or an exported name; what a package re-exports counts where it is defined."""
    files = parsed.select(F.col("path").alias("file_path"), "exports", "main_guard")
    rows = symbols.join(files, "file_path")

    def marks(d: Column) -> Column:
        name = F.element_at(F.split(d, r"\("), 1)
        return reduce(lambda a, b: a | b, [F.endswith(name, F.lit(x)) for x in ENTRY_DECORATORS])

    mark = F.element_at(F.filter("decorators", marks), 1)
    by_mark = F.when(F.size(F.filter("decorators", marks)) == 0, None).when(F.contains(mark, F.lit(".command")), "cli").when(F.contains(mark, F.lit(".task")) | F.contains(mark, F.lit(".callback")), "task").otherwise("route")
    kind = (
        F.when((F.col("name") == "main") & (F.col("kind") == "function"), "main")
        .when((F.col("kind") == "module") & F.col("main_guard"), "main_guard")
        .when(F.col("file_path").rlike(r"(^|/)__main__\.py$"), "main_module")
        .when(by_mark.isNotNull(), by_mark)
        .when(F.array_contains("exports", F.col("qualname")), "exported")
    )
    own = rows.select("id", kind.alias("entry_kind")).filter("entry_kind IS NOT NULL")
    shown = parsed.select(F.col("path").alias("file"), F.explode("exports").alias("name")).withColumn("key", F.struct("file", "name"))
    shown = defined(shown, symbols, import_map(parsed)).select(F.col("target").alias("id")).distinct().join(own, "id", "left_anti")
    return own.unionByName(shown.withColumn("entry_kind", F.lit("exported")))


def strict_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref, outcome, id of dotted references: a path and a name at any split, an id, then the full name, the name or its
    end; more than one at the first rung that has any is ambiguous, and nothing is matched in part."""
    parts = F.split("ref", r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit(".py::"), F.array_join(F.slice(parts, k + 1, F.size(parts)), ".")))
    name = F.when(F.contains("ref", F.lit("::")), F.element_at(F.split("ref", "::"), -1)).otherwise(F.col("ref"))
    rung = lambda k, key: F.struct(k.cast("int").alias("rung"), key.alias("key"))
    split = F.when(F.size(parts) > 1, F.transform(cuts, lambda c, i: rung(F.size(cuts) - i, c))).otherwise(F.array().cast("array<struct<rung:int,key:string>>"))
    asked = F.concat(split, F.array(rung(F.lit(100), F.col("ref")), *(rung(F.lit(k), F.concat(F.lit(f"{k}:"), name)) for k in (101, 102, 103))))
    own = F.split("qualname", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(own), F.lit(2))), lambda i: F.concat(F.lit("103:"), F.array_join(F.slice(own, i, F.size(own)), ".")))
    keys = F.array_distinct(F.concat(F.array(F.col("id"), F.concat(F.lit("101:"), "qualname"), F.concat(F.lit("102:"), "name")), ends))
    counts = symbols.select("id", F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    met = refs.select("ref").distinct().select("ref", F.explode(asked).alias("a")).select("ref", "a.*").join(counts, "key")
    best = met.groupBy("ref").agg(F.min_by(F.struct("n", "id"), "rung").alias("b"))
    out = refs.select("ref").distinct().join(best, "ref", "left")
    return out.select("ref", F.when(F.col("b.n").isNull(), "not found").when(F.col("b.n") > 1, "ambiguous").otherwise("found").alias("outcome"), F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"))
