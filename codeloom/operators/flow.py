"""Call trees of entry points: bounded traces, collapsing, diagrams and step tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import escape_label
from codeloom.sources.shared import kept

AGAIN = " ↻"
# The lines that a diagram may have.
DIAGRAM_HEADS = r"^((flowchart|graph) (TD|TB|LR|RL|BT)|sequenceDiagram)$"
FLOW_NODE, FLOW_ARROW = r'^(n\w+)\["[^"\[\]]+"\]$', r"^(n\w+)\s*(?:-->|-\.->|==>)(?:\|[^|]+\|)?\s*(n\w+)$"
SEQUENCE_NODE, SEQUENCE_ARROW = r"^participant (n\w+) as .+$", r"^(n\w+)(?:->>|-->>)(n\w+): .+$"
_NODE = ["seed", "depth", "id", "place", "recursive", "caller", "line", "callee_expr", "confidence", "source", "control_ctx", "kind", "omitted", "count"]


def trace_tree(seeds: DataFrame, edges: DataFrame, depth: int = 4, least: float = 0.6, max_nodes: int = 4000) -> DataFrame:
    """seed, position, parent (its position), depth, id, kind, recursive, omitted, count and the call site, in pre-order.

    Edges go in source order; external ones stay whatever their confidence. A vertex on the way already is a leaf marked
    recursive. At the last level, omitted counts the calls that are not followed. A tree ends at max_nodes - 1 nodes: a
    node with calls beyond that gets one of kind collapsed, with their count. No level keeps more nodes of a tree than the
    bound, as none behind it could be among the first.
    """
    if not 0 <= depth <= 64 or max_nodes < 2:
        raise ValueError("depth must be 0 to 64, max_nodes 2 at least")
    order = Window.partitionBy("caller").orderBy("line", "callee_expr", F.coalesce("callee", F.lit("")), F.desc("confidence"), "source")
    out = edges.filter((F.col("callee").isNull()) | (F.col("confidence") >= least)).withColumn("at", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("caller")).cast("int"))
    first = F.row_number().over(Window.partitionBy("caller", "line", "callee", "callee_expr").orderBy("at"))
    out = kept(out.withColumn("n", first).filter("n = 1").drop("n"))
    calls = out.groupBy(F.col("caller").alias("id")).agg(F.max("total").alias("calls"))
    none = F.lit(None)
    level = seeds.select(F.col("id").alias("seed"), F.lit(0).alias("depth"), "id", F.array().cast("array<int>").alias("place"), F.array("id").alias("way"), F.lit(False).alias("recursive"), none.cast("string").alias("caller"), none.cast("int").alias("line"), none.cast("string").alias("callee_expr"), none.cast("double").alias("confidence"), none.cast("string").alias("source"), none.cast("string").alias("control_ctx"), F.lit("symbol").alias("kind"))
    levels = [level]
    for k in range(1, depth + 1):
        up = levels[-1].filter("NOT recursive AND kind = 'symbol'").select("seed", F.col("id").alias("caller"), "place", "way")
        target = F.coalesce("callee", F.concat_ws(":", F.lit("external"), "caller", "line", "callee_expr"))
        step = up.join(out, "caller").select("seed", F.lit(k).alias("depth"), target.alias("id"), F.concat("place", F.array("at")).alias("place"), F.concat("way", F.array(target)).alias("way"), F.array_contains("way", target).alias("recursive"), "caller", "line", "callee_expr", "confidence", "source", "control_ctx", F.when(F.col("callee").isNull(), "external").otherwise("symbol").alias("kind"))
        near = F.row_number().over(Window.partitionBy("seed").orderBy("place"))
        levels.append(step.withColumn("n", near).filter(F.col("n") <= max_nodes).drop("n"))
    nodes = reduce(DataFrame.unionByName, levels).drop("way").join(calls, "id", "left")
    last = (F.col("depth") == depth) & ~F.col("recursive") & (F.col("kind") == "symbol")
    nodes = nodes.withColumn("omitted", F.when(last, F.coalesce("calls", F.lit(0))).otherwise(0)).withColumn("count", F.lit(0))
    ranked = kept(nodes).withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("place")))
    up = F.slice("place", 1, F.greatest(F.size("place") - 1, F.lit(0)))
    cut = ranked.filter(F.col("n") >= max_nodes).withColumn("up", up).groupBy("seed", "up").agg(F.min(F.element_at("place", -1)).alias("at"))
    held = ranked.filter(F.col("n") < max_nodes)
    more = cut.join(held.select("seed", F.col("place").alias("up"), F.col("id").alias("owner"), F.col("depth").alias("owner_depth"), F.col("calls")), ["seed", "up"])
    more = more.select("seed", (F.col("owner_depth") + 1).alias("depth"), F.concat("owner", F.lit("::cap")).alias("id"), F.concat("up", F.array("at")).alias("place"), F.lit("collapsed").alias("kind"), (F.col("calls") - F.col("at") + 1).alias("count"))
    every = held.select(*_NODE).unionByName(more, allowMissingColumns=True).fillna({"recursive": False, "omitted": 0})
    return kept(_numbered(kept(every)))


def _numbered(nodes: DataFrame) -> DataFrame:
    """Adds position (pre-order, from 1) and parent (position) to nodes with seed and place."""
    out = nodes.withColumn("position", F.row_number().over(Window.partitionBy("seed").orderBy("place")))
    up = F.slice("place", 1, F.greatest(F.size("place") - 1, F.lit(0)))
    above = out.select("seed", F.col("place").alias("up"), F.col("position").alias("parent"))
    return out.withColumn("up", F.when(F.size("place") > 0, up)).join(above, ["seed", "up"], "left").drop("up")


def labels(tree: DataFrame, symbols: DataFrame) -> DataFrame:
    """tree with label: the qualified name, what is called, or how many calls are left out."""
    named = tree.join(symbols.select("id", "qualname"), "id", "left")
    return named.withColumn("label", F.when(F.col("kind") == "collapsed", F.concat(F.lit("..."), F.col("count"), F.lit(" more calls"))).otherwise(F.coalesce("qualname", "callee_expr", "id")))


def collapse(tree: DataFrame, max_nodes: int = 40, depth: int = 4) -> DataFrame:
    """seed, node, position, depth, parent, label, omitted of each tree (labels()) cut to a budget: a node whose calls don't
    all fit ends in one node `...N more`, N counting all below; without room for even that, N is its omitted count.

    A tree is at most trace_tree's max_nodes rows, so one task walks it.
    """
    if max_nodes < 2 or depth < 0:
        raise ValueError("max_nodes must be 2 at least, depth 0")

    def run(key, rows):
        rows = rows.sort_values("position")
        below: dict[int, list] = {}
        for r in rows.itertuples():
            below.setdefault(-1 if pd.isna(r.parent) else int(r.parent), []).append(r)
        sizes = dict.fromkeys(rows["position"], 1)
        for r in reversed(list(rows.itertuples())):
            if not pd.isna(r.parent):
                sizes[int(r.parent)] += sizes[r.position]
        out: list[list] = []
        left = max_nodes - 1

        def visit(node, parent, level):
            nonlocal left
            out.append([key[0], node.id, len(out) + 1, level, parent, node.label, int(node.omitted)])
            own, children = out[-1], below.get(int(node.position), [])
            for i, child in enumerate(children):
                if level >= depth or left <= 1:
                    more = sum(sizes[c.position] for c in children[i:])
                    if left > 0:
                        out.append([key[0], f"{node.id}::collapsed", len(out) + 1, level + 1, own[2], f"...{more} more", 0])
                        left -= 1
                    else:
                        own[6] = more
                    return
                left -= 1
                visit(child, own[2], level + 1)

        for root in below.get(-1, []):
            visit(root, 0, 0)
        return pd.DataFrame(out, columns=["seed", "node", "position", "depth", "parent", "label", "omitted"])

    return tree.select("seed", "id", "position", "parent", "label", "omitted").groupBy("seed").applyInPandas(run, "seed string, node string, position int, depth int, parent int, label string, omitted int")


def flowchart(tree: DataFrame) -> DataFrame:
    """seed, diagram: a flowchart of each tree (labels()); a node line for each, then the arrow that leads to it."""
    label = F.concat("label", F.when(F.col("recursive"), AGAIN).otherwise(""), F.when(F.col("omitted") > 0, F.concat(F.lit(" (..."), "omitted", F.lit(" more)"))).otherwise(""))
    own = F.concat(F.lit("n"), F.col("position") - 1)
    condition = F.when(F.coalesce("control_ctx", F.lit("")) != "", F.concat(F.lit("|"), escape_label(F.col("control_ctx")), F.lit("|"))).otherwise("")
    node = F.concat(F.lit("  "), own, F.lit('["'), escape_label(label), F.lit('"]'))
    arrow = F.when(F.col("parent").isNotNull(), F.concat(F.lit("\n  n"), F.col("parent") - 1, F.lit(" -->"), condition, F.lit(" "), own)).otherwise("")
    lines = tree.select("seed", "position", F.concat(node, arrow).alias("line"))
    return _text(lines, "flowchart TD")


def sequence(tree: DataFrame) -> DataFrame:
    """seed, diagram: a sequence diagram; each id takes part once, named at its first place, calls follow in order."""
    first = tree.groupBy("seed", "id").agg(F.min("position").alias("position"))
    people = first.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("position")) - 1)
    lines = people.select("seed", F.struct(F.lit(0).alias("part"), "position").alias("position"), F.concat(F.lit("  participant n"), "n", F.lit(" as "), escape_label(F.col("id"))).alias("line"))
    a = people.select("seed", F.col("id").alias("from_id"), F.col("n").alias("a"))
    b = people.select("seed", "id", F.col("n").alias("b"))
    said = F.coalesce(F.when(F.col("control_ctx") != "", F.col("control_ctx")), "label")
    calls = tree.join(tree.select("seed", F.col("position").alias("parent"), F.col("id").alias("from_id")), ["seed", "parent"]).join(a, ["seed", "from_id"]).join(b, ["seed", "id"])
    calls = calls.select("seed", F.struct(F.lit(1).alias("part"), "position").alias("position"), F.concat(F.lit("  n"), "a", F.lit("->>n"), "b", F.lit(": "), escape_label(said)).alias("line"))
    return _text(lines.unionByName(calls), "sequenceDiagram")


def _text(lines: DataFrame, head: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"])
    return lines.groupBy("seed").agg(F.concat(F.lit(head + "\n"), F.array_join(ordered, "\n")).alias("diagram"))


def diagram_errors(rows: DataFrame) -> DataFrame:
    """rows with errors, an array: what in diagram lies outside the subset that flowchart() and sequence() write."""
    node = lambda x: F.when(F.col("__seq"), F.regexp_extract(x, SEQUENCE_NODE, 1)).otherwise(F.regexp_extract(x, FLOW_NODE, 1))
    ends = lambda x, k: F.when(F.col("__seq"), F.regexp_extract(x, SEQUENCE_ARROW, k)).otherwise(F.regexp_extract(x, FLOW_ARROW, k))
    stripped = F.filter(F.transform(F.split("diagram", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = rows.withColumn("__lines", stripped).withColumn("__head", F.coalesce(F.get("__lines", F.lit(0)), F.lit("")))
    out = out.withColumn("__seq", F.col("__head") == "sequenceDiagram").withColumn("__rest", F.slice("__lines", 2, F.greatest(F.size("__lines") - 1, F.lit(0))))
    out = out.withColumn("p", F.transform("__rest", lambda x: F.struct(node(x).alias("node"), ends(x, 1).alias("a"), ends(x, 2).alias("b"), F.substring(x, 1, 100).alias("line"))))
    out = out.withColumn("__seen", F.filter(F.transform("p", lambda x: x["node"]), lambda x: x != ""))
    wrong = F.transform(F.filter("p", lambda x: (x["node"] == "") & (x["a"] == "")), lambda x: F.concat(F.lit("Invalid line: "), x["line"]))
    again = F.transform(F.filter("__seen", lambda x, i: F.array_contains(F.slice("__seen", 1, i), x)), lambda x: F.concat(F.lit("Duplicate node: "), x))
    loose = F.transform(F.filter("p", lambda x: (x["a"] != "") & (~F.array_contains("__seen", x["a"]) | ~F.array_contains("__seen", x["b"]))), lambda x: F.lit("Undefined arrow end"))
    known = F.col("__head").rlike(DIAGRAM_HEADS)
    return out.withColumn("errors", F.when(known, F.concat(wrong, again, loose)).otherwise(F.array(F.lit("Unknown header")))).select(*rows.columns, "errors")


def step_table(tree: DataFrame, symbols: DataFrame) -> DataFrame:
    """seed, position, row: a table row of each node with its call site, label, control blocks, source and confidence."""
    where = symbols.select(F.col("id").alias("caller"), F.col("file_path").alias("call_file"))
    own = symbols.select("id", "file_path", "start_line")
    rows = tree.join(where, "caller", "left").join(own, "id", "left")
    place = F.concat(F.coalesce("call_file", "file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("line"), F.col("start_line")).cast("string"))
    sure = F.concat(F.coalesce("source", F.lit("root")), F.lit(" / "), F.coalesce(F.col("confidence").cast("string"), F.lit("")))
    cells = [F.coalesce(place, F.lit("")), F.concat("label", F.when(F.col("recursive"), AGAIN).otherwise("")), F.coalesce("control_ctx", F.lit("")), sure]
    plain = [F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in cells]
    return rows.select("seed", "position", F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |")).alias("row"))


def step_evidence(tree: DataFrame, symbols: DataFrame) -> DataFrame:
    """seed, position, cite, snippet: what stands behind each step: the root's definition, or the line of the call."""
    caller = symbols.select(F.col("id").alias("caller"), F.col("file_path").alias("c_file"), F.col("start_line").alias("c_start"), F.col("raw_code").alias("c_code"))
    own = symbols.select("id", "file_path", "start_line", "end_line", "raw_code")
    rows = tree.filter("kind <> 'collapsed'").join(caller, "caller", "left").join(own, "id", "left")
    lines, at = F.split("c_code", "\n"), F.col("line") - F.col("c_start")
    there = F.when((at >= 0) & (at < F.size(lines)), F.element_at(lines, at + 1)).otherwise(F.col("callee_expr"))
    root = F.col("parent").isNull()
    cite = F.when(root, F.concat(F.lit("["), "file_path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit("]"))).otherwise(F.concat(F.lit("["), "c_file", F.lit(":"), "line", F.lit("-"), "line", F.lit("]")))
    return rows.select("seed", "position", cite.alias("cite"), F.when(root, F.col("raw_code")).otherwise(there).alias("snippet"))
