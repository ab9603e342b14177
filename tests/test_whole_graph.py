"""The whole call graph's queries on a small fixture with up to five callees a part, against brute force."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from codeloom.plans import whole_graph

N = 12
ORDERS = {1: [1, 2, 3, 1, 4, 6], 2: [1, 5, 2, 4], 3: [2, 1, 2, 6, 7], 4: [4, 4, 8, 9, 10], 5: [4, 11, 2, 12, 1], 6: [6, 3, 4, 2, 9], 7: [1, 2, 5], 8: [10, 1, 8, 2]}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("graph")
    lines = [(o, k, p, 1) for o, ps in ORDERS.items() for k, p in enumerate(ps, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(i, f"b{i % 3}") for i in range(1, N + 1)], "p_partkey long, p_brand string").write.parquet(f"{at}/part.parquet")
    return str(at)


@pytest.fixture(scope="module")
def calls():
    """caller -> [(callee, confidence)], most frequent first."""
    n = Counter(pair for ps in ORDERS.values() for pair in zip(ps[:-1], ps[1:]))
    out = defaultdict(list)
    for (a, b), _ in sorted(n.items(), key=lambda x: (-x[1], x[0][1])):
        out[a].append((b, 0.9 if not out[a] else 0.7 if a % 2 == 0 else 0.4))
    assert max(map(len, out.values())) > 2
    return out


def strong(calls):
    return {a: [b for b, c in bs if c >= 0.6] for a, bs in calls.items()}


def turned(near):
    out = defaultdict(list)
    for a, bs in near.items():
        for b in bs:
            out[b].append(a)
    return out


def reached(near, depth):
    out = Counter()
    first = {}

    def walk(seed, path, d):
        for b in near.get(path[-1], ()):
            if d > 1 and b in path:
                continue
            out[seed, b] += 1
            first[seed, b] = min(d, first.get((seed, b), d))
            if d < depth:
                walk(seed, [*path, b], d + 1)

    for s in range(1, N + 1):
        walk(s, [s], 1)
    return {(s, b, first[s, b], k) for (s, b), k in out.items()}


def got(spark, sf, name, *cols):
    rows = [tuple(r[c] for c in cols) for r in entry.queries()[name](spark, sf).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_edges_and_dead(spark, sf, calls):
    want = {(a, b, c) for a, bs in calls.items() for b, c in bs if c >= 0.6}
    assert got(spark, sf, "whole_graph_edges", "caller", "callee", "weight") == want
    assert got(spark, sf, "whole_dead_candidates", "id", "file") == {(i, f"b{i % 3}") for i in range(1, N + 1)} - {(b, f"b{b % 3}") for _, b, _ in want}


def test_reached(spark, sf, calls):
    near = strong(calls)
    assert got(spark, sf, "whole_callees_depth3", "seed", "node", "min_depth", "n_paths") == reached(near, 3)
    assert got(spark, sf, "whole_callers_depth2", "seed", "node", "min_depth", "n_paths") == reached(turned(near), 2)


def test_shortest_path(spark, sf, calls):
    want = set()
    for s in range(1, N + 1):
        ways = [[s]]
        for _ in range(5):
            ways = [[*w, b] for w in ways for b, _ in calls.get(w[-1], ()) if b not in w]
            if best := min((w for w in ways if w[-1] == s + 1), default=None):
                break
        want.add((s, s + 1, len(best) - 1 if best else None, ">".join(map(str, best)) if best else None))
    assert got(spark, sf, "whole_shortest_path", "source", "target", "hops", "path") == want


def test_impact_groups(spark, sf, calls):
    near, groups = turned(strong(calls)), defaultdict(list)
    for s in range(1, N + 1):
        one = set(near[s]) - {s}
        two = {a for b in one for a in near[b]} - one - {s}
        for d, nodes in ((1, one), (2, two)):
            for i in nodes:
                groups[s, d, f"b{i % 3}"].append(i)
    assert got(spark, sf, "whole_impact_groups", "seed", "min_depth", "file", "members", "first_member") == {(*k, len(v), min(v)) for k, v in groups.items()}


def test_hubs(spark, sf, calls):
    rank = {i: 1 / N for i in range(1, N + 1)}
    for _ in range(8):
        base = 0.15 / N + 0.85 * sum(r for i, r in rank.items() if i not in calls) / N
        new = dict.fromkeys(rank, base)
        for a, bs in calls.items():
            for b, c in bs:
                new[b] += 0.85 * rank[a] * c / sum(x for _, x in bs)
        rank = new
    near = strong(calls)
    top = sorted(rank, key=lambda i: (-round(rank[i], 9), i))[:10]
    assert got(spark, sf, "whole_hubs", "id", "fan_in", "fan_out") == {(i, len(turned(near)[i]), len(near.get(i, ()))) for i in top}


def test_trace(spark, sf, calls):
    want = set()

    def walk(seed, way, recursive):
        nonlocal place
        place += 1
        want.add((seed, place, len(way) - 1, way[-1], recursive))
        if len(way) <= 3 and not recursive:
            for b, c in calls.get(way[-1], ()):
                if c >= 0.6:
                    walk(seed, [*way, b], b in way)

    for s in range(1, N + 1):
        place = 0
        walk(s, [s], False)
    assert got(spark, sf, "whole_trace_preorder", "seed", "position", "depth", "node", "recursive") == want
