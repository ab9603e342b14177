"""SimHash near-duplicates: exact tiled comparison with exclusive-or and bit counts.

Equal fingerprints are one node. Two fingerprints that differ in at most RADIUS bits agree in at least one of
RADIUS + 1 blocks of bits, so nodes are dealt by (block, its value); every link lies in some bucket and none is lost.
A bucket with more nodes than TILE is cut into tiles by hash, and each pair of tiles is a task's group of its own, so
a large group of near copies spreads. Within a group, rows are sorted by population count and compared tile by tile;
pairs of tiles whose population counts differ by more than the radius are skipped. A tile pair sends a spanning forest
of its links, not all of them. Components come from alternating large-star and small-star rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import drop_path, map_arrow, new_path, one_row, text_hash, whole_text, written

BITS, RADIUS, WORDS = 64, 3, 3
SEED = 42
TILE, SUBTILE = 4096, 1024
MOST_ROUNDS = 60


def fingerprint(text: str, words: int = WORDS) -> int:
    """Of a text's lower-cased words; bytes.lower() and bytes.split() know ASCII letters and white space only."""
    w = text.encode().lower().split()
    if not w:
        return 0
    if len(w) < words:
        found = [b" ".join(w)]
    else:
        found = map(b" ".join, zip(*(w[k:] for k in range(words))))
    h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in found], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) of each row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                got = [fingerprint(x, words) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), _signed(got)], names=["doc_id", "text_hash", "fp"])

    return map_arrow(docs.select("doc_id", text_hash().alias("text_hash"), "text"), run, "doc_id long, text_hash long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between two tiles, thinned: each node to the first that it meets, then those firsts to one another."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if not near.any():
        return
    # labels of a's rows go through b's columns until nothing changes: components of the tile pair
    rows, cols = np.nonzero(near.any(1))[0], np.nonzero(near.any(0))[0]
    near = near[np.ix_(rows, cols)]
    label = np.arange(len(rows))
    most = len(rows)
    while True:
        over = np.where(near, label[:, None], most).min(0)
        new = np.minimum(label, np.where(near, over[None, :], most).min(1))
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(rows))
    yield a[rows[moved]], a[rows[label[moved]]]
    yield b[cols], a[rows[over]]


def tile_links(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links that connect exactly the components of distinct values (unsigned) under `radius`; shape (n, 2)."""
    counts = np.bitwise_count(values)
    order = np.argsort(counts, kind="stable")
    values, counts = values[order], counts[order].astype(np.int64)
    found = []
    for i in range(0, len(values), SUBTILE):
        for j in range(i, len(values), SUBTILE):
            if counts[j] - counts[min(i + SUBTILE, len(values)) - 1] > radius:
                break  # sorted: all later tiles are farther
            for x, y in _forest(values[i : i + SUBTILE], values[j : j + SUBTILE], radius):
                keep = x != y
                found.append(np.stack([x[keep], y[keep]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links that connect the fingerprints (column fp, distinct) that differ in at most `radius` bits."""
    n = radius + 1
    width = BITS // n
    cut = F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << width) - 1 if k < n - 1 else (1 << (BITS - width * k)) - 1).alias("value")) for k in range(n)))
    dealt = nodes.select("fp", F.explode(cut).alias("c")).select("fp", "c.block", "c.value")
    full = dealt.groupBy("block", "value").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    sized = dealt.join(full, ["block", "value"])
    tiles = F.ceil(F.col("size") / tile).cast("int")
    sized = sized.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = sized.select("fp", "block", "value", "own", other).select("fp", "block", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    key = ["block", "value", "i", "j"]
    spread = pairs.repartition(*key).sortWithinPartitions(*key)

    def compared(group: list[np.ndarray]):
        links = tile_links(np.concatenate(group).view(np.uint64), radius) if sum(map(len, group)) > 1 else []
        return links.view(np.int64) if len(links) else None

    def run(batches):
        held, held_key, found = [], None, []
        for batch in batches:
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in key]
            fp = batch.column("fp").to_numpy()
            if not len(fp):
                continue
            change = np.zeros(len(fp) - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(fp)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                now = tuple(int(c[a]) for c in columns)
                if now != held_key:
                    if held and (links := compared(held)) is not None:
                        found.append(links)
                    held, held_key = [], now
                held.append(fp[a:b])
            if sum(map(len, found)) > 10_000:
                yield _pairs(found)
                found = []
        if held and (links := compared(held)) is not None:
            found.append(links)
        if found:
            yield _pairs(found)

    def _pairs(found):
        both = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return map_arrow(spread.select("fp", *key), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes in links (a, b); large-star and small-star in turns."""
    spark = links.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "links")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    # u > v always
    edges, path = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, large_path = kept(large)
        drop_path(spark, path)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges, path = kept(small)
        drop_path(spark, large_path)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("v", F.col("u"))
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id (smallest doc_id that links reach, itself included) of each row of docs.

    Null and empty texts have fingerprint zero and are linked like others. Rows with a null doc_id belong to their
    component but never name it, unless it has no other. Repeated rows count each, an empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    prints = written(fingerprints(rows, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    member = components(fingerprint_links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    named = nodes.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = named.select("fp", "component").join(names, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: of each component, those with its smallest doc_id, one of each text."""
    return one_row(docs, near_components(docs, words, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    got = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
