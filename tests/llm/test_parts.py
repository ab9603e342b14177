"""The parts that run within one task."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import packing, simhash, suffix_dedup
from codeloom.llm.exact_dedup import CuckooIndex
from codeloom.llm.token_counts import merger
from codeloom.llm.token_output import Segment, encode_segment
from codeloom.llm.word_ids import WordEncoder
from tests.llm import brute


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_cuckoo_index_is_a_dictionary(steps):
    index, live = CuckooIndex(capacity=4), {}
    for add, k in steps:
        text = str(k)
        digest = bytes.fromhex(brute.sha(text))
        if add and k not in live:
            index.insert(digest, text, [k, 1])
            live[k] = text
        elif not add:
            assert index.delete(digest) == (live.pop(k, None) is not None)
        assert all(index.find(bytes.fromhex(brute.sha(t)), t)[2] == j for j, t in live.items())
    assert index.live == len(live) and sorted(e[2] for e in index.drain()) == sorted(live) and index.live == index.live_bytes == 0


def test_cuckoo_index_resizes_from_its_keys():
    index = CuckooIndex(capacity=4)
    keys = [str(k) for k in range(5000)]
    for k in keys:
        index.insert(bytes.fromhex(brute.sha(k)), k, [0, 1])
    assert all(index.find(bytes.fromhex(brute.sha(k)), k) for k in keys) and (index.mask + 1) * 4 >= 5000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=9), min_size=1, max_size=6))
def test_loser_tree_sorts_and_knows_common_prefixes(runs):
    coded, n = [], 0
    for r in runs:
        coded.append(suffix_dedup.front_code([(s, n + k) for k, s in enumerate(r)]))
        n += len(r)
    flat = [s for r in runs for s in r]
    out = list(suffix_dedup.LoserTree(coded))
    texts = [flat[m] for _, _, m in out]
    assert texts == sorted(flat) and sorted(m for _, _, m in out) == list(range(n))
    for (_, length, m), s in zip(out, texts):
        assert length == len(s)
    for a, b, (k, _, _) in zip([b"", *texts], texts, out):
        assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])


def least_bins(sizes, capacity):
    """Exact, by subsets: the fewest bins and the least load of the last."""
    n = len(sizes)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (1, 0)
    for mask in range(1 << n):
        bins, load = best[mask]
        for k in range(n):
            if not mask >> k & 1:
                to = (bins, load + sizes[k]) if load + sizes[k] <= capacity else (bins + 1, sizes[k])
                best[mask | 1 << k] = min(best[mask | 1 << k], to)
    return best[-1][0] if n else 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_dominance_reduction_loses_nothing(sizes):
    fixed, left = packing.reduce_dominated(dict(Counter(sizes)), 20)
    rest = [k for k, v in left.items() for _ in range(v)]
    assert sum(n for _, n in fixed) + least_bins(rest, 20) == least_bins(sizes, 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=25))
def test_plan_places_every_piece_once(counts):
    patterns = packing.plan(counts, 50)
    assert all(sum(x * c for x, c in p) <= 50 for p, _ in patterns)
    placed = Counter()
    for p, n in patterns:
        for x, c in p:
            placed[x] += c * n
    assert placed == Counter(counts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40), max_size=12))
def test_any_token_of_a_segment_is_at_hand(docs):
    flat = [x for d in docs for x in d]
    s = Segment(encode_segment(np.arange(len(docs)), np.ones(len(docs), bool), np.array([len(d) for d in docs], np.int64), np.array(flat, np.uint64)))
    assert [s.token(i) for i in range(len(flat))] == flat
    for k, d in enumerate(docs):
        assert s.tokens(int(s.starts[k]), int(s.starts[k + 1])).tolist() == d


TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.sStTrReE0é日Σ́")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_are_the_library_s(text):
    assert merger().count(text) == len(brute.ids(text, "byte_bpe_50k.json"))


_words = WordEncoder("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_word_ids_are_the_library_s(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in _words.encode(texts)] == [brute.ids(t) for t in texts]


def test_links_of_tiles_span_the_components():
    rng = random.Random(2)
    values = np.array(sorted({rng.getrandbits(12) << rng.choice([0, 30]) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)}), np.uint64)
    links = simhash.tile_links(values)

    def classes(pairs):
        root = {int(v): int(v) for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(int(a)), find(int(b))))
            root[y] = x
        return {v: find(v) for v in root}

    assert classes(links) == classes((a, b) for a, b in combinations(values.tolist(), 2) if (a ^ b).bit_count() <= 3)
