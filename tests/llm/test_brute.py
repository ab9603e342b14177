"""Each operator against plain Python on rows with every awkward case, and on an empty table."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, exact_dedup, line_dedup, packing, simhash, suffix_dedup, token_counts, token_output
from tests.llm import brute


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_exact_dedup(docs, nothing, rows):
    got = exact_dedup.exact_groups(docs)
    assert bag(got, "doc_id", "keep_id", "group_size") == Counter(brute.exact(rows))
    assert {(r["doc_id"], r["digest"]) for r in got.collect()} == {(i, brute.sha(t or "")) for i, t in rows}
    stay = exact_dedup.exact_dedup(docs)
    assert stay.columns == docs.columns
    assert bag(stay, "doc_id", "text").keys() == {(i, t) for (i, t), (_, k, _) in zip(rows, brute.exact(rows)) if i == k}
    assert exact_dedup.exact_groups(nothing).count() == exact_dedup.exact_dedup(nothing).count() == 0


def test_line_dedup(docs, nothing, rows):
    got = line_dedup.line_dedup(docs).withColumn("sha", F.sha2("kept_text", 256))
    assert bag(got, "doc_id", "n_lines", "n_dropped", "sha") == Counter(brute.lines(rows))
    assert line_dedup.line_dedup(nothing).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_CONTEXTS, 2])
def test_suffix_dedup(docs, rows, hot):
    """With hot=2, strings of nearly all anchors are counted as rows."""
    got = suffix_dedup.suffix_dedup(docs, hot_contexts=hot).withColumn("sha", F.sha2("kept", 256))
    want = brute.suffix(rows)
    assert sum(w[2] > 0 for w in want) > 10
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == Counter(want)


def test_suffix_dedup_of_nothing(nothing):
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_simhash(docs, nothing, rows):
    got = simhash.near_components(docs).withColumn("f", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    want = brute.near(rows)
    assert bag(got, "doc_id", "f", "component_id") == Counter(want)
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns
    assert bag(stay, "doc_id", "text").keys() == {r for r, (i, _, c) in zip(rows, want) if i == c}
    assert simhash.near_components(nothing).count() == 0


def test_simhash_tiles_of_one_bucket(spark):
    """Buckets far over the tile size give the components that comparing all gives."""
    import random

    import numpy as np

    rng = random.Random(5)
    values = {rng.getrandbits(10) | rng.choice([0, 1 << 40, 3 << 50]) for _ in range(900)} | {rng.getrandbits(64) for _ in range(200)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=64)
    got = {r["node"]: r["component"] for r in simhash.components(links).collect()}
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {v: got.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_decontaminate(spark, docs, nothing, rows, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items += [(None, rows[-1][1]), (501, None), (502, ""), (503, "two words"), (504, "two words"), (504, "two words"), (505, rows[-3][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("size", "window", "w")})
    got = decontaminate.decontaminate(docs, table).withColumn("sha", F.sha2("items", 256))
    want = brute.contaminated(rows, items)
    assert sum(w[-1] for w in want) > 5
    assert bag(got, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == Counter(want)
    stay = decontaminate.clean_documents(docs, table)
    assert stay.columns == docs.columns and bag(stay, "doc_id", "text") == Counter(r for r, w in zip(rows, want) if not w[-1])
    assert decontaminate.decontaminate(nothing, table).count() == 0
    assert decontaminate.decontaminate(docs, table.limit(0)).filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def test_token_counts(docs, nothing, rows):
    want = Counter((i, len((t or "").encode()), n := len(brute.ids(t, "byte_bpe_50k.json")), n > 1024) for i, t in rows)
    assert bag(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(nothing).count() == 0


def test_packing(docs, nothing, rows):
    got = packing.best_fit_packing(docs).collect()
    want, lengths = Counter(), []
    for i, t in rows:
        ids = [*brute.ids(t), 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            piece = ids[s : s + 4096]
            want[i, k, s, len(piece), brute.crc(piece)] += 1
            lengths.append(len(piece))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    bins: list[int] = []  # first fit, longest first
    for x in sorted(lengths, reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= x), None)
        if k is None:
            bins.append(4096 - x)
        else:
            bins[k] -= x
    assert -(-sum(lengths) // 4096) <= len(sequences) <= len(bins)
    assert packing.best_fit_packing(nothing).count() == 0


def test_token_files(spark, docs, nothing, rows, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write_segments(docs, path, segment_ids=5000)
    got = token_output.read_segments(spark, path).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x := [*brute.ids(t), 1]), brute.crc(x)) for i, t in rows)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [brute.order(r["doc_id"]) for r in got]
    assert order == sorted(order)
    token_output.write_segments(nothing, f"{path}-none")
    assert token_output.read_segments(spark, f"{path}-none").count() == 0
