"""Lexical, trigram and dense retrieval, rank fusion, ranked lookup and name resolution."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.walks import pieces
from codeloom.sources.shared import kept


def ranked(df: DataFrame, key: str, score, *ties: str, k: int | None = None, name: str = "rank") -> DataFrame:
    """Adds the place of each row within its key; at most k rows of each."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(score, *ties)))
    return out.filter(F.col(name) <= k) if k else out


def postings(units: DataFrame, text: str, terms: DataFrame | None = None) -> DataFrame:
    """id, term, tf of each unit (id, text); with terms (term, each once), of those only, so other words are never shuffled."""
    words = units.select("id", F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    if terms is not None:
        words = words.join(small(terms), "term", "left_semi")
    return words.groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))


#: A table may be broadcast if it has been counted to have at most so many (short) rows.
SMALL_ROWS = 200_000
#: Ways that the postings of a term are dealt, so that a common term isn't one task's.
TERM_PARTS = 16


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A hint to broadcast df if it is counted to be small; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def once_each(queries: DataFrame, text: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What search gives for queries (query_id and a text): equal texts are asked once, and each query gets its text's rows."""
    asked = kept(queries.groupBy(text).agg(F.min("query_id").alias("__asked")))
    found = search(asked.select(F.col("__asked").alias("query_id"), text)).withColumnRenamed("query_id", "__asked")
    own = queries.select("query_id", text).join(asked.hint("merge"), text).select("query_id", "__asked")
    return own.join(found.hint("merge"), "__asked").select("query_id", *(c for c in found.columns if c != "__asked"))


def lexical_topk(queries: DataFrame, units: DataFrame | None, k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank. queries: query_id (each once), text. An OR search: each term of the query adds its weight
    in the unit, over the number of terms. Postings come from a stored index (id, term, tf), or are made from units.

    Queries of one block are sent to where the units lie, and nothing of a unit is shuffled but its place among the best.
    For more queries, or for an index, a term's postings are dealt by unit, with the query's row in each part; scores are
    summed by pair before the ranking.
    """
    return once_each(queries, "text", lambda q: _lexical(q, units, k, index))


def _lexical(queries: DataFrame, units: DataFrame | None, k: int, index: DataFrame | None) -> DataFrame:
    terms = kept(queries.select("query_id", T.query_terms(F.col("text")).alias("terms")).select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term")))
    whole = ("bigint", "int")
    if index is None and queries.schema["query_id"].dataType.simpleString() in whole and units.schema["id"].dataType.simpleString() in whole:
        few = terms.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS and queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
        n = units.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).first() if few else None
        if n and n["rows"] == n["ids"]:
            return ranked(_lexical_block(terms, units, k), "query_id", F.desc("score"), "id", k=k)
    held = index if index is not None else postings(units, "text", terms.select("term").distinct())
    dealt = held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(TERM_PARTS)).cast("int"))
    asked = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1))))
    # merged: an exploded table is far larger than its estimate, by which it would be broadcast
    hits = asked.hint("merge").join(dealt, ["term", "part"]).withColumn("w", T.term_weight(F.col("tf")))
    scores = hits.groupBy("query_id", "id").agg(F.round(F.sum("w") / F.max("n"), 6).alias("score"))
    return ranked(scores, "query_id", F.desc("score"), "id", k=k)


#: Pairs of a query and a unit, or of a term's query and a unit's term, that a task scores at a time.
PAIRS = 2_000_000


def _lexical_block(terms: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """query_id, id, score of each task's k best units (id, text; ids once each) for queries whose terms fit the driver."""
    rows = terms.collect()  # at most SMALL_ROWS
    ids = np.array(sorted({r["query_id"] for r in rows}), np.int64)
    place = {q: i for i, q in enumerate(ids.tolist())}
    names = sorted({r["term"] for r in rows})
    at = {t: i for i, t in enumerate(names)}
    size = np.ones(len(ids))
    for r in rows:
        size[place[r["query_id"]]] = r["n"]
    pairs = np.array(sorted((at[r["term"]], place[r["query_id"]]) for r in rows), np.int64).reshape(-1, 2)
    of_term = np.searchsorted(pairs[:, 0], np.arange(len(names) + 1))  # the queries of a term, one after the other
    query = pairs[:, 1]

    def score(batches):
        import pyarrow.compute as pc

        known = pa.array(names, pa.string())
        best, own, held = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64), np.zeros(len(ids), np.int64)
        weight = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 1001) ** 2)])
        for batch in batches:
            words = batch.column("words")
            found = pc.index_in(words.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            unit = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
            key, tf = np.unique((unit * len(names) + found)[found >= 0], return_counts=True)
            if not len(key):
                continue
            if tf.max() >= len(weight):
                weight = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, tf.max() + 1.0) ** 2)])
            unit, term, w = key // len(names), key % len(names), weight[tf] * 0.1 / 1.64493
            many = of_term[term + 1] - of_term[term]
            cost = np.maximum(np.bincount(unit, many, batch.num_rows), len(ids))
            unit_ids = batch.column("id").to_numpy()
            for s in pieces(cost, PAIRS):
                rows = slice(*np.searchsorted(unit, [s.start, s.stop]))
                n = many[rows]
                step = np.repeat(np.arange(rows.start, rows.stop), n)
                q = query[np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n) + of_term[term[step]]]
                total = np.bincount((unit[step] - s.start) * len(ids) + q, w[step], (s.stop - s.start) * len(ids)).reshape(-1, len(ids))
                points = -np.floor(total / size * 1e6 + 0.5) / 1e6
                last = np.where(held == k, best[:, -1], np.inf)
                row, col = np.nonzero((total > 0) & (points <= last))
                if len(row):
                    _merge(best, own, held, col, points[row, col], unit_ids[s][row])
        q, col = np.nonzero(np.arange(k) < held[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[q, col]), pa.array(-best[q, col])], names=["query_id", "id", "score"])

    split = units.select(F.col("id").cast("long").alias("id"), F.regexp_extract_all(F.lower(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    got = split.mapInArrow(score, "query_id long, id long, score double")
    return got.select(F.col("query_id").cast(terms.schema["query_id"].dataType), F.col("id").cast(units.schema["id"].dataType), "score")


def trigram_topk(queries: DataFrame, units: DataFrame, k: int = 20, least: float = 0.3) -> DataFrame:
    """query_id, id, score, rank by Jaccard similarity of trigram sets, at least `least`; query_id (each once), name. Only
    pairs that share a gram and whose numbers of grams allow that similarity meet; a gram's units are dealt in parts; shared
    grams are summed by pair. Equal names are asked once."""
    return once_each(queries, "name", lambda q: _trigrams(q, units, k, least))


def _trigrams(queries: DataFrame, units: DataFrame, k: int, least: float) -> DataFrame:
    grams = lambda df, key: df.select(key, T.trigrams(F.col("name")).alias("g")).select(key, F.size("g").alias(f"n_{key}"), F.explode("g").alias("gram"))
    asked = grams(queries, "query_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1))))
    dealt = grams(units, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(TERM_PARTS)).cast("int"))
    near = (F.col("n_id") >= F.col("n_query_id") * (least - 1e-6)) & (F.col("n_query_id") >= F.col("n_id") * (least - 1e-6))
    shared = asked.hint("merge").join(dealt, ["gram", "part"]).filter(near).groupBy("query_id", "id").agg(F.count("*").alias("s"), F.max("n_query_id").alias("a"), F.max("n_id").alias("b"))
    scored = shared.select("query_id", "id", F.round(F.col("s") / (F.col("a") + F.col("b") - F.col("s")), 6).alias("score")).filter(F.col("score") >= least)
    return ranked(scored, "query_id", F.desc("score"), "id", k=k)


def fused(*lists: DataFrame, constant: int = 0, k: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the sum of 1 / (constant + rank) over ranked lists (query_id, id, rank)."""
    every = reduce(DataFrame.unionByName, (x.select("query_id", "id", "rank") for x in lists))
    scores = every.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + constant)), 6).alias("score"))
    return ranked(scores, "query_id", F.desc("score"), "id", k=k)


#: Queries, and units, of a block; and those compared at a time, so that a task holds no more distances than a tile has.
QUERY_BLOCK, UNIT_BLOCK = 4096, 16_384
QUERY_TILE, UNIT_TILE = 256, 4096
_NEAR = "query_id long, id long, distance double"


def _merge(best: np.ndarray, own: np.ndarray, held: np.ndarray, row: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
    """Puts (value, id) of each row into its k best, the least value and then the least id first; held is how many it has."""
    k = best.shape[1]
    old_row, old_col = np.nonzero(np.arange(k) < held[:, None])
    rows, values, names = np.concatenate([old_row, row]), np.concatenate([best[old_row, old_col], value]), np.concatenate([own[old_row, old_col], ids])
    order = np.lexsort((names, values, rows))
    rows, values, names = rows[order], values[order], names[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    best[rows[keep], place[keep]], own[rows[keep], place[keep]] = values[keep], names[keep]
    held[:] = np.minimum(np.bincount(rows, minlength=len(held)), k)


class _Best:
    """The k nearest of all units shown so far for each row of mat, by distance (6 places) and then by id.

    Distances come by tiles, as matrix products. Only what lies within the k-th so far, with a margin for rounding, is
    looked at further. For l2 the product is only a bound, with a margin for its error; what is within is computed by
    difference. A distance that isn't a number is the last.
    """

    def __init__(self, mat: np.ndarray, k: int, metric: str):
        self.mat, self.k, self.l2, self.size = mat, k, metric == "l2", (mat * mat).sum(1)
        self.near, self.own, self.held = np.full((len(mat), k), np.inf), np.zeros((len(mat), k), np.int64), np.zeros(len(mat), np.int64)

    def show(self, own: np.ndarray, v: np.ndarray) -> None:
        for u in range(0, len(v), UNIT_TILE):
            part = np.asarray(v[u : u + UNIT_TILE], np.float64)
            size = (part * part).sum(1)
            for q in range(0, len(self.mat), QUERY_TILE):
                self._tile(slice(q, q + QUERY_TILE), own[u : u + UNIT_TILE], part, size)

    def _tile(self, at: slice, own: np.ndarray, v: np.ndarray, size: np.ndarray) -> None:
        mat, near, ids, held, k = self.mat[at], self.near[at], self.own[at], self.held[at], self.k
        with np.errstate(invalid="ignore", divide="ignore"):
            d, margin = mat @ v.T, 0.0
            if self.l2:
                both = self.size[at][:, None] + size[None, :]
                d, margin = np.maximum(both - 2 * d, 0), 1e-9 * np.nan_to_num(both, posinf=0.0).max() + 1e-12
            else:
                d = 1 - d / (np.sqrt(self.size[at])[:, None] * np.sqrt(size)[None, :])
            d[np.isnan(d)] = np.inf
            last = np.where(held == k, near[:, -1], np.inf)
            if (held < k).any() and k <= d.shape[1]:
                bound = np.partition(d, k - 1, axis=1)[:, k - 1]
                last = np.minimum(last, np.sqrt(bound + margin) if self.l2 else bound)
            last = last + 2e-6
            row, col = np.nonzero(d <= (last * last + margin if self.l2 else last)[:, None])
            got = d[row, col]
            if self.l2:  # so many at a time, as a large group of equal vectors may be within the bound
                for i in range(0, len(row), 65_536):
                    got[i : i + 65_536] = np.sqrt(((v[col[i : i + 65_536]] - mat[row[i : i + 65_536]]) ** 2).sum(1))
                got[np.isnan(got)] = np.inf
        _merge(near, ids, held, row, np.round(got, 6), own[col])

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(np.arange(self.k) < self.held[:, None])
        d = self.near[row, col]
        return query_ids[row], self.own[row, col], np.where(np.isinf(d), np.nan, d)


def _nearest(ids: np.ndarray, mat: np.ndarray, own: np.ndarray, v: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, unit ids, distances) of the k nearest rows of v for each row of mat; ties go to the smaller id."""
    best = _Best(mat, k, metric)
    best.show(own, v)
    return best.rows(ids)


def dense_topk(queries: DataFrame, units: DataFrame, k: int = 5, metric: str = "cosine", query_block: int = QUERY_BLOCK, unit_block: int = UNIT_BLOCK) -> DataFrame:
    """query_id, id, distance (6 places), rank of the k nearest units (id, vector) of each query (query_id, vector).

    Exact, as matrix products of tiles of blocks. Queries that fit one block are sent to where the units lie. More are dealt
    to blocks as units are, and each pair of blocks is a task's: nothing but their number reaches the driver. Each task
    keeps its k best for a query, which are ranked again. Distances are rounded before they are ranked.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(metric)
    units = units.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    n = queries.limit(query_block + 1).count()
    if n == 0:
        return ranked(queries.join(units, F.lit(False)).select("query_id", "id", F.lit(0.0).alias("distance")), "query_id", "distance", "id")
    flat = lambda batch: np.array(batch.column("vector").combine_chunks().flatten().to_numpy() if isinstance(batch, pa.Table) else batch.column("vector").flatten().to_numpy()).reshape(batch.num_rows, -1)
    if n <= query_block:
        rows = queries.select("query_id", "vector").collect()  # at most one block
        ids, mat = np.array([r["query_id"] for r in rows]), np.array([r["vector"] for r in rows], np.float64)

        def near(batches):
            best = _Best(mat, k, metric)
            for batch in batches:
                if batch.num_rows:
                    best.show(batch.column("id").to_numpy(), flat(batch))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows(ids)], names=["query_id", "id", "distance"])

        return ranked(units.mapInArrow(near, _NEAR), "query_id", "distance", "id", k=k)
    q_blocks, u_blocks = -(-queries.count() // query_block), max(1, -(-units.count() // unit_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("q"), every(u_blocks).alias("u"))
    right = units.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(u_blocks)).cast("int").alias("u"), every(q_blocks).alias("q"))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        found = _nearest(a["query_id"].to_numpy(), flat(a).astype(np.float64), b["id"].to_numpy(), flat(b), k, metric)
        return pa.table(dict(zip(("query_id", "id", "distance"), found)))

    return ranked(left.groupBy("q", "u").cogroup(right.groupBy("q", "u")).applyInArrow(pair, _NEAR), "query_id", "distance", "id", k=k)


def name_lookup(queries: DataFrame, symbols: DataFrame, k: int = 100) -> DataFrame:
    """query, id, rung, rank: names that contain the query, case aside; symbols: id, qualname, name.

    Rungs: 0 the id itself, 1 the qualified name, 2 the name, 3 the last part of the qualified name, 4 elsewhere. A query
    of three characters or more meets the names that hold its last trigram, a shorter one those that hold it as a gram.
    """
    q = queries.select("query", F.lower("query").alias("q")).filter("q IS NOT NULL").distinct()
    s = symbols.withColumn("low", F.lower("qualname"))
    grams = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("low") - (n - 1), F.lit(1))), lambda i: F.substr(F.col("low"), i, F.lit(n))))

    def met(n: int) -> DataFrame:
        own = q.filter(F.char_length("q") >= 3 if n == 3 else F.char_length("q") == n)
        held = s.withColumn("gram", F.explode(grams(n)) if n else F.lit(""))
        return own.withColumn("gram", F.substring("q", -3, 3)).join(held, "gram").filter(F.contains("low", F.col("q")))

    hit = reduce(DataFrame.unionByName, map(met, range(4)))
    rung = F.when(F.col("id").cast("string") == F.col("query"), 0).when(F.col("qualname") == F.col("query"), 1).when(F.col("name") == F.col("query"), 2).when(F.endswith("qualname", F.concat(F.lit("."), F.col("query"))), 3).otherwise(4)
    return ranked(hit.select("query", "id", rung.alias("rung")).distinct(), "query", "rung", "id", k=k)


def resolve(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """query, rung, matches, outcome: the first rung with candidates decides; more than one there is ambiguous. A name
    that is only a part of another never wins."""
    own = F.split("qualname", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(own)), lambda i: F.array_join(F.slice(own, i, F.size(own)), "."))
    key = lambda rung, name: F.struct(F.lit(rung).alias("rung"), name.alias("query"))
    names = F.array(key(0, F.col("id").cast("string")), key(1, F.col("qualname")), key(2, F.col("name")))
    parts = F.when(F.size(own) > 1, F.transform(tails, lambda t: key(3, t)))
    every = symbols.select("id", F.explode(F.concat(names, F.coalesce(parts, F.array().cast("array<struct<rung:int,query:string>>")))).alias("k"))
    # counted before queries are met, so a name of very many symbols is one row there
    counts = every.select("k.rung", "k.query", "id").distinct().groupBy("query", "rung").agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    best = counts.join(queries.select("query").distinct(), "query")
    first = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("rung"))).filter("n = 1")
    out = queries.select("query").distinct().join(first, "query", "left")
    return out.select("query", "rung", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("id")).alias("id"), F.when(F.col("matches").isNull(), "not found").when(F.col("matches") > 1, "ambiguous").otherwise("found").alias("outcome"))
