"""Graph operators over an edge table (caller, callee, confidence) and a vertex table (id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import walks
from codeloom.operators.order import numbered
from codeloom.sources.shared import kept


def weighted(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """One edge for each pair, with its largest confidence, from those at or over the threshold; no null callee."""
    return edges.filter((F.col("confidence") >= least) & F.col("callee").isNotNull()).groupBy("caller", "callee").agg(F.max("confidence").alias("weight"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"), *(c for c in edges.columns if c not in ("caller", "callee")))


def reached(seeds: DataFrame, edges: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """seed, node, min_depth, n_paths of the vertices on the bounded simple paths from each seed (column id, an integer).

    A null callee is an end. A path never comes back to one of its vertices, except that a self-call of the seed is
    followed once. Paths are made where a block of seeds has the lists that it needs, and never shuffled.
    """
    rows = walks.reached(seeds, edges.filter(F.col("confidence") >= least).select("caller", "callee"), max(depth, 1))
    return rows if depth > 0 else rows.limit(0)


def shortest_paths(pairs: DataFrame, edges: DataFrame, depth: int = 8, least: float = 0.0) -> DataFrame:
    """pairs (source, target, integers): adds hops (null if unreachable, 0 if the same) and path (ids with >, least of the
    shortest).

    Paths grow by turns from the sources and back from the targets and meet at a vertex, so each side goes half the way;
    a pair stops growing once it has met. All shortest walks are simple paths. Pairs are searched by blocks, each with the
    lists that it needs.
    """
    best = walks.shortest(pairs, weighted(edges, least).select("caller", "callee"), depth).withColumnRenamed("path", "b")
    joined = pairs.join(best.hint("merge"), ["source", "target"], "left")
    same = F.col("source") == F.col("target")
    return joined.select("source", "target", F.when(same, F.lit(0)).otherwise(F.when(F.col("b").isNotNull(), F.size("b") - 1)).alias("hops"), F.when(same, F.lit("")).otherwise(F.array_join(F.col("b").cast("array<string>"), ">")).alias("path"))


def impact(seeds: DataFrame, edges: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """seed, node, min_depth of all that leads to a seed: breadth first, each vertex once, the seed left out."""
    back = weighted(edges, least).select(F.col("callee").alias("at"), F.col("caller").alias("node"))
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("min_depth"))
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.select("seed", F.col("node").alias("at")).join(back, "at").select("seed", "node").distinct()
        frontier = step.join(seen, ["seed", "node"], "left_anti").withColumn("min_depth", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen.filter("min_depth > 0")


def impact_groups(seeds: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 2, least: float = 0.0) -> DataFrame:
    """seed, min_depth, file, members, first_member: impact counted by depth and file (files: id, file), a block of seeds
    at a time; ids are integers."""
    rows = walks.impact(seeds, reversed_edges(weighted(edges, least).select("caller", "callee")), files, depth)
    return rows.withColumn("file", F.col("file").cast(files.schema["file"].dataType))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """id, rank after a fixed number of rounds; weights out-normalised, dangling mass dealt evenly. Each round joins and
    sums by key; rank vectors are cut from their lineage every few rounds."""
    w = weighted(edges)
    out = w.join(w.groupBy("caller").agg(F.sum("weight").alias("total")), "caller").select("caller", "callee", (F.col("weight") / F.col("total")).alias("share")).cache()
    ids = vertices.select("id").join(out.select(F.col("caller").alias("id")).distinct().withColumn("calls", F.lit(True)), "id", "left").cache()
    n = ids.count()
    ranks = ids.select("id", "calls", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        dangling = ranks.filter("calls IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d")).first()["d"]
        got = ranks.join(out, ranks["id"] == out["caller"]).groupBy(F.col("callee").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
        base = (1 - damping) / n + damping * dangling / n if n else 0.0
        ranks = ids.join(got, ids["id"] == got["to"], "left").select("id", "calls", (F.lit(base) + damping * F.coalesce("s", F.lit(0.0))).alias("rank")).cache()
    return ranks.select("id", "rank")


def fans(edges: DataFrame, least: float) -> DataFrame:
    """id, fan_in, fan_out: distinct neighbours at the threshold."""
    w = weighted(edges, least)
    one = w.select(F.col("callee").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(w.select(F.col("caller").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return one.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def hubs(vertices: DataFrame, edges: DataFrame, n: int = 10, least: float = 0.6, rounds: int = 10) -> DataFrame:
    edges = kept(edges)  # the graph is made once for the ranks and the fans
    top = pagerank(vertices, edges, rounds).select("id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(n)
    return top.join(fans(edges, least), "id", "left").select("id", "rank", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def dead(vertices: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """Vertices (id and more) that no edge at the threshold calls; a self-call counts as a call."""
    return vertices.join(weighted(edges, least).select(F.col("callee").alias("id")).distinct(), "id", "left_anti")


def descendants(roots: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id of all vertices that roots (id) lead to, roots left out unless they are led to."""
    w = weighted(edges).select("caller", "callee")
    seen = roots.join(w, roots["id"] == w["caller"]).select(F.col("callee").alias("id")).distinct().checkpoint()
    frontier = seen
    for _ in range(rounds):
        frontier = frontier.join(w, frontier["id"] == w["caller"]).select(F.col("callee").alias("id")).distinct().join(seen, "id", "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier).checkpoint()
    raise RuntimeError("descendants: the bound on rounds was met")


def _trimmed(left: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(vertices, edges, what was taken off): vertices that nothing leads to, or that lead to nothing, are on no cycle."""
    gone = []
    while True:
        cyclic = edges.select(F.col("caller").alias("id")).distinct().join(edges.select(F.col("callee").alias("id")).distinct(), "id", "left_semi")
        off = kept(left.join(cyclic, "id", "left_anti"))
        if off.isEmpty():
            return left, edges, gone
        gone.append(off)
        left = kept(left.join(off, "id", "left_anti"))
        edges = kept(edges.join(off.select(F.col("id").alias("caller")), "caller", "left_anti").join(off.select(F.col("id").alias("callee")), "callee", "left_anti"))


def components_strong(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (least id of the strongly connected component), by forward and backward colouring.

    Vertices on no cycle are taken off. Every other takes the largest id that leads to it as its colour; what leads back to
    a colour's own vertex within the colour is that vertex's component. Components are taken off and the rest goes on. Each
    step is a join and a sum over edges, so nothing grows with the square of the vertices.
    """
    left = kept(vertices.select("id").distinct())
    e = kept(weighted(edges).filter("caller <> callee").select("caller", "callee"))
    e = kept(e.join(left.select(F.col("id").alias("caller")), "caller", "left_semi").join(left.select(F.col("id").alias("callee")), "callee", "left_semi"))
    found = []
    while True:
        left, e, off = _trimmed(left, e)
        found += [x.select("id", F.col("id").alias("component")) for x in off]
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found) if found else vertices.select("id", F.col("id").alias("component"))
        colour = left.select("id", F.col("id").alias("c"))
        while True:
            came = e.join(colour.withColumnRenamed("id", "caller"), "caller").groupBy(F.col("callee").alias("id")).agg(F.max("c").alias("m"))
            new = kept(colour.join(came, "id", "left").select("id", F.greatest("c", "m").alias("c"), (F.col("m") > F.col("c")).alias("up")))
            colour = new.select("id", "c")
            if new.filter("up").isEmpty():
                break
        inner = e.join(colour.select(F.col("id").alias("caller"), F.col("c").alias("a")), "caller").join(colour.select(F.col("id").alias("callee"), F.col("c").alias("b")), "callee")
        inner = kept(inner.filter("a = b").select("caller", "callee", F.col("a").alias("c")))
        marked = frontier = kept(colour.filter("id = c"))
        while True:
            step = inner.join(frontier.select(F.col("id").alias("callee")), "callee").select(F.col("caller").alias("id"), "c").distinct()
            frontier = kept(step.join(marked, "id", "left_anti"))
            if frontier.isEmpty():
                break
            marked = kept(marked.unionByName(frontier))
        found.append(marked.join(marked.groupBy("c").agg(F.min("id").alias("component")), "c").select("id", "component"))
        left = kept(left.join(marked, "id", "left_anti"))
        e = kept(e.join(marked.select(F.col("id").alias("caller")), "caller", "left_anti").join(marked.select(F.col("id").alias("callee")), "callee", "left_anti"))


def layers(vertices: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """id, component, layer: longest way from the component to a sink of the condensation (0 there)."""
    c = components_strong(vertices, edges).checkpoint()
    w = weighted(edges).select("caller", "callee")
    up = w.join(c.select(F.col("id").alias("caller"), F.col("component").alias("a")), "caller").join(c.select(F.col("id").alias("callee"), F.col("component").alias("b")), "callee").filter("a <> b").select("a", "b").distinct().checkpoint()
    level = c.select(F.col("component").alias("a"), F.lit(0).alias("layer")).distinct()
    for _ in range(most):
        raised = up.join(level.select(F.col("a").alias("b"), "layer"), "b").groupBy("a").agg((F.max("layer") + 1).alias("up"))
        new = level.join(raised, "a", "left").select("a", F.coalesce("up", F.lit(0)).alias("layer")).checkpoint()
        changed = new.exceptAll(level).count()
        level = new
        if not changed:
            return c.join(level.withColumnRenamed("a", "component"), "component").select("id", "component", "layer")
    raise RuntimeError("layers: the bound on rounds was met")


def trace(seeds: DataFrame, edges: DataFrame, depth: int, least: float) -> DataFrame:
    """Pre-order rows of each seed's call tree: seed, position (from 1), depth, node, recursive.

    Edges come with a line and a callee; a vertex that is on the way already is shown as recursive and not followed. Ids are
    integers. Trees are made by blocks of seeds and never shuffled; a seed's own tree is sorted in memory.
    """
    return walks.traced(seeds, edges.filter(F.col("confidence") >= least).select("caller", "callee", "line"), depth)


def dead_symbols(symbols: DataFrame, edges: DataFrame, entries: DataFrame, above: DataFrame, parsed: DataFrame, least: float = 0.6, include_tests: bool = False) -> DataFrame:
    """id, label of symbols that no edge at the threshold calls, as candidates for removal.

    Left out are modules, entry points (id), dunders, names that their file exports, methods that override one of a class
    above (ancestors: class_id, ancestor), and, unless asked for, symbols of test paths.
    """
    from codeloom.functions.text import is_test_path

    found = dead(symbols.select("id", "file_path", "kind", "name", "qualname", "parent_id"), edges, least).filter("kind <> 'module' AND NOT name RLIKE '^__.*__$'")
    if not include_tests:
        found = found.filter(~is_test_path(F.col("file_path")))
    shown = parsed.select(F.col("path").alias("file_path"), F.explode("exports").alias("qualname")).distinct()
    found = found.join(entries.select("id"), "id", "left_anti").join(shown, ["file_path", "qualname"], "left_anti")
    own = symbols.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("ancestor"), "name")
    overridden = above.filter("class_id <> ancestor").join(own, "ancestor").select(F.col("class_id").alias("parent_id"), "name").distinct()
    return found.join(overridden, ["parent_id", "name"], "left_anti").select("id", F.lit("candidate").alias("label"))


def digraph(edges: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(vertices (id), edges with their largest weight) at the threshold; a caller stays even if all it calls is external."""
    strong = edges.filter(F.col("confidence") >= least)
    ends = strong.select(F.explode(F.array("caller", "callee")).alias("id")).filter("id IS NOT NULL").distinct()
    return ends, weighted(edges, least)


def order_graph(symbols: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """caller, callee of all that must be known first: calls at the threshold, a class's methods, and for a module's own
    code the classes and functions at the top of its file."""
    calls = weighted(edges, least).select("caller", "callee")
    inner = symbols.filter("kind = 'method' AND parent_id IS NOT NULL").select(F.col("parent_id").alias("caller"), F.col("id").alias("callee"))
    top = symbols.filter("kind IN ('class', 'function') AND parent_id IS NULL").select("file_path", F.col("id").alias("callee"))
    modules = symbols.filter("kind = 'module'").select("file_path", F.col("id").alias("caller")).join(top, "file_path").select("caller", "callee")
    return calls.unionByName(inner).unionByName(modules).distinct()


def flagged(symbols: DataFrame, entries: DataFrame) -> DataFrame:
    """symbols (id and more) with is_entrypoint and entry_kind as entries (id, entry_kind) say; old flags are gone."""
    bare = symbols.drop("is_entrypoint", "entry_kind")
    met = bare.join(entries.select("id", "entry_kind"), "id", "left")
    return met.withColumn("is_entrypoint", F.col("entry_kind").isNotNull())


def located(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """rows (caller, callee, line) with both names and the call's location; an external callee has no name."""
    a = symbols.select(F.col("id").alias("caller"), F.col("qualname").alias("caller_qualname"), F.col("file_path").alias("__file"))
    b = symbols.select(F.col("id").alias("callee"), F.col("qualname").alias("callee_qualname"))
    return rows.join(a, "caller").join(b, "callee", "left").withColumn("location", F.concat_ws(":", "__file", "line")).drop("__file")


def processing_order(vertices: DataFrame, edges: DataFrame, files: DataFrame, roots: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """position, scc_id, component, layer, reachable, members of each component, callees first.

    Within a layer, what the roots (id) lead to comes first, then the component whose file has the highest rank, then the
    least file and the id. Components are numbered by their least member.
    """
    c = kept(layers(vertices, edges))
    ranks = pagerank(vertices, edges, rounds).select("id", F.round("rank", 9).alias("rank"))
    by_file = files.join(ranks, "id", "left").groupBy("file").agg(F.max(F.coalesce("rank", F.lit(0.0))).alias("file_rank"))
    met = c.join(files, "id").join(by_file, "file")
    if roots is not None:
        near = descendants(roots, edges).unionByName(roots.select("id")).distinct().withColumn("near", F.lit(True))
        met = met.join(near, "id", "left")
    else:
        met = met.withColumn("near", F.lit(None).cast("boolean"))
    rows = met.groupBy("component", "layer").agg(F.max(F.coalesce("near", F.lit(False))).alias("reachable"), F.max("file_rank").alias("file_rank"), F.min("file").alias("path"), F.count("*").alias("members"))
    named = numbered(rows, ["component"], "__k").withColumn("scc_id", F.concat(F.lit("scc-"), F.col("__k") - 1)).drop("__k")
    return numbered(named, ["layer", F.desc("reachable"), F.desc("file_rank"), "path", "scc_id"], "position")


def with_metrics(symbols: DataFrame, ranks: DataFrame, components: DataFrame, order: DataFrame) -> DataFrame:
    """symbols (id) with pagerank (0 outside the graph), scc_id and layer."""
    of = components.join(order.select("component", "scc_id", "layer"), "component").select("id", "scc_id", "layer")
    out = symbols.select("id").join(ranks.select("id", F.round("rank", 9).alias("pagerank")), "id", "left").join(of, "id", "left")
    return out.select("id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), "scc_id", "layer")


def communities(vertices: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community by label propagation over the undirected weighted graph: in each round a vertex takes the label with
    the largest weight around it, the least one of equals. A vertex without neighbours is its own community. Labels are
    summed by (vertex, label) before one is chosen, so a hub's neighbours are never gathered."""
    w = weighted(edges).filter("caller <> callee")
    both = w.select(F.col("caller").alias("a"), F.col("callee").alias("b"), "weight").unionByName(w.select(F.col("callee").alias("a"), F.col("caller").alias("b"), "weight"))
    both = kept(both.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    label = vertices.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a", "community").agg(F.round(F.sum("weight"), 6).alias("weight"))
        best = near.groupBy("a").agg(F.min(F.struct(-F.col("weight"), "community")).alias("m")).select(F.col("a").alias("id"), F.col("m.community").alias("new"))
        label = kept(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
    return label


def reach_ids(seeds: DataFrame, edges: DataFrame, depth: int, least: float = 0.6) -> DataFrame:
    """seed, node: what each seed (id) leads to within so many steps, each once, the seed itself left out."""
    w = weighted(edges, least).select(F.col("caller").alias("at"), F.col("callee").alias("node"))
    seen = frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    for _ in range(depth):
        step = frontier.select("seed", F.col("node").alias("at")).join(w, "at").select("seed", "node").distinct()
        frontier = step.join(seen, ["seed", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen.filter("seed <> node")
