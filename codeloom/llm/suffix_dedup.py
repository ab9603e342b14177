"""Repeated-passage removal over suffixes: front-coded sorted runs, exchanged and merged by loser trees.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. Sorting every suffix of the corpus
isn't needed for that: of the 201 pieces of 200 bytes in a string of 400, the one with the least rolling hash is chosen
by content alone, so equal strings share that *anchor* at the same offset.

1. Each document's anchors, about one in a hundred bytes, with a hash of the anchor and of its whole context (200 bytes
   before, 400 from its start; clipped at the text's ends).
2. Counts by (anchor, context), summed before the shuffle. A context that occurs twice settles every string around the
   anchor. An anchor that occurs once settles them too. Only anchors with several contexts are left: the ends of matches.
3. One copy of each such context is read from the text. Its suffix (from the anchor on) and reversed prefix are sorted
   in the task, front-coded as a run, dealt by anchor, and merged by a loser tree in which a comparison starts behind
   the prefix known to be common. From the common-prefix lengths of neighbours follow the classes of strings that agree
   on `x` bytes before and 400 - x after; a class of two or more is a repeated string.
4. An anchor with very many contexts isn't gathered: its strings are hashed (128 bits) and counted, as rows.
5. The covered spans are joined to the texts, merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import map_arrow, whole_text, written

LENGTH, ANCHOR = 400, 200
BEFORE = LENGTH - ANCHOR
BUFFER = 1 << 20
#: Contexts that one task merges at a time, about; and of one anchor from which on strings are counted as rows.
BUCKET_ROWS, HOT_CONTEXTS = 20_000, 4_000
_KEY = 8

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def window_anchors(raw: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions chosen by the windows (LENGTH bytes from each valid start) of a buffer of at most 2^24 bytes."""
    n, w = len(raw), BEFORE + 1
    if n < LENGTH or not valid.any():
        return np.zeros(0, np.int64)
    up, down = _power_tables(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[:n], dtype=np.uint64)])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    pad = np.concatenate([h, np.full(-len(h) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(valid)
    least = np.minimum(behind[starts], ahead[starts + w - 1]) & np.uint64((1 << 24) - 1)
    return np.unique(least.astype(np.int64))


def text_anchors(texts: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """(number of the text, anchor positions), for the texts that have any."""
    at = 0
    while at < len(texts):
        group, size = [at], len(texts[at])
        while group[-1] + 1 < len(texts) and size + len(texts[group[-1] + 1]) <= BUFFER:
            group.append(group[-1] + 1)
            size += len(texts[group[-1]])
        at = group[-1] + 1
        if len(group) == 1 and size > BUFFER:  # a long text: blocks of window starts
            text, found = texts[group[0]], set()
            for s in range(0, size - LENGTH + 1, BUFFER):
                block = np.frombuffer(text[s : s + BUFFER + LENGTH - 1], np.uint8)
                valid = np.arange(len(block)) <= min(BUFFER - 1, len(block) - LENGTH)
                found.update((window_anchors(block, valid) + s).tolist())
            yield group[0], sorted(found)
            continue
        ends = np.cumsum([len(texts[i]) for i in group])
        raw = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        owner = np.repeat(np.arange(len(group)), [len(texts[i]) for i in group])
        places = window_anchors(raw, np.arange(len(raw)) + LENGTH <= ends[owner] if len(raw) else np.zeros(0, bool))
        whose = owner[places]
        cuts = np.searchsorted(whose, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            if cuts[k] < cuts[k + 1]:
                yield i, (places[cuts[k] : cuts[k + 1]] - (ends[k] - len(texts[i]))).tolist()


def _anchors(batches):
    h64 = xxhash.xxh3_64_intdigest
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [x.encode() for x in part.column("text").to_pylist()]
            rows, places, keys, contexts = [], [], [], []
            for i, found in text_anchors(texts):
                view, n = memoryview(texts[i]), len(texts[i])
                rows += [i] * len(found)
                places += found
                keys += [h64(view[p : p + ANCHOR], 1) for p in found]
                contexts += [h64(view[max(0, p - BEFORE) : p + LENGTH], min(p, BEFORE) * 1024 + min(n - p, LENGTH)) for p in found]
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(places, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(contexts, np.uint64).view(np.int64))], names=["doc_id", "text_hash", "at", "anchor", "context"])


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 32
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:  # the difference lies within `step` bytes
        step = (step + 1) // 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


def front_code(items: list[tuple[bytes, int]]) -> tuple[list[int], list[bytes], list[int]]:
    """Sorted (suffix, member): prefix shared with the one before, the rest, the member."""
    items.sort()
    shared, rest, last = [], [], b""
    for s, _ in items:
        k = _common(last, s, 0)
        shared.append(k)
        rest.append(s[k:])
        last = s
    return shared, rest, [m for _, m in items]


class LoserTree:
    """Merges front-coded runs. A run's head knows its common prefix with the last winner: of two heads with unequal
    such prefixes the longer comes first without a look, and equal ones are compared behind it only."""

    def __init__(self, runs: list[tuple[list[int], list[bytes], list[int]]]):
        self.runs, self.at = runs, [0] * len(runs)
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        # head: its suffix, or None at the end of the run; shared: with the last winner
        self.head: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (size - len(runs))
        self.shared = [0] * size
        self.losers = [0] * size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes the one with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        i, j = self.shared[a], self.shared[b]
        if i > j:
            return a, b
        if j > i:
            return b, a
        k = _common(x, y, i)
        if x[k : k + 1] <= y[k : k + 1]:
            self.shared[b] = k
            return a, b
        self.shared[a] = k
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(common prefix with the one before, length, member) in sorted order."""
        while (text := self.head[w := self.winner]) is not None:
            shared, rest, members = self.runs[w]
            k = self.at[w]
            yield self.shared[w], len(text), members[k]
            self.at[w] = k = k + 1
            if k < len(rest):
                self.head[w], self.shared[w] = text[: shared[k]] + rest[k], shared[k]
            else:
                self.head[w] = None
            node = (w + self.size) // 2
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


def repeated_offsets(after: list[tuple[int, int, int]], before: list[tuple[int, int, int]], members: int) -> np.ndarray:
    """[x, member]: the string that starts x bytes before the member's anchor is that of another member too.

    after and before: merged suffixes and reversed prefixes (common prefix, length, member), each led by _KEY bytes of
    the anchor's hash, which all members of an anchor share.
    """
    order_a, common_a = np.array([m for _, _, m in after]), np.array([k - _KEY for k, _, _ in after])
    order_b, common_b = np.array([m for _, _, m in before]), np.array([k - _KEY for k, _, _ in before])
    found = np.zeros((BEFORE + 1, members), bool)
    class_a, class_b = np.empty(members, np.int64), np.empty(members, np.int64)
    for x in range(BEFORE + 1):
        class_a[order_a] = np.cumsum(common_a < LENGTH - x)
        class_b[order_b] = np.cumsum(common_b < x)
        _, which, count = np.unique(class_a * (members + 1) + class_b, return_inverse=True, return_counts=True)
        found[x] = count[which] > 1
    return found


def _spans(found: np.ndarray, places: list[int]) -> Iterator[tuple[int, int, int]]:
    """(member, start, end) for each run of offsets."""
    edge = np.diff(np.concatenate([np.zeros((1, found.shape[1]), np.int8), found.astype(np.int8), np.zeros((1, found.shape[1]), np.int8)]), axis=0)
    m_from, x_from = np.nonzero(edge.T == 1)
    _, x_to = np.nonzero(edge.T == -1)
    for m, a, b in zip(m_from.tolist(), x_from.tolist(), x_to.tolist()):
        yield m, places[m] - (b - 1), places[m] - a + LENGTH


_CONTEXT = "anchor long, doc_id long, text_hash long, at int, n long, hot boolean, bucket long, pre binary, post binary"


def _read_contexts(batches):
    """Contexts of one document a row, from its text."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py().encode()
            got = batch.column("ends")[i].as_py()
            k = len(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g["anchor"] for g in got], pa.int64()), pa.array([batch.column("doc_id")[i].as_py()] * k, pa.int64()), pa.array([batch.column("text_hash")[i].as_py()] * k, pa.int64()), pa.array([g["at"] for g in got], pa.int32()), pa.array([g["n"] for g in got], pa.int64()), pa.array([g["hot"] for g in got], pa.bool_()), pa.array([g["bucket"] for g in got], pa.int64()), pa.array([text[max(0, g["at"] - BEFORE) : g["at"]] for g in got], pa.binary()), pa.array([text[g["at"] : g["at"] + LENGTH] for g in got], pa.binary())],
                names=["anchor", "doc_id", "text_hash", "at", "n", "hot", "bucket", "pre", "post"],
            )


_RUN = "bucket long, doc_ids array<long>, text_hashes array<long>, places array<int>, counts array<long>, shared_a array<int>, rest_a array<binary>, order_a array<int>, shared_b array<int>, rest_b array<binary>, order_b array<int>"


def _make_runs(batches):
    """One front-coded run of suffixes and one of reversed prefixes for each bucket that a task meets."""
    held: dict[int, list[tuple]] = {}
    size = 0

    def flush():
        nonlocal size
        for bucket, rows in held.items():
            after = front_code([(r[0].to_bytes(_KEY, "big", signed=True) + r[6], i) for i, r in enumerate(rows)])
            before = front_code([(r[0].to_bytes(_KEY, "big", signed=True) + r[5][::-1], i) for i, r in enumerate(rows)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int64())]
                + [pa.array([[r[c] for r in rows]], pa.list_(t)) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int64()))]
                + [pa.array([x], pa.list_(t)) for run in (after, before) for x, t in zip(run, (pa.int32(), pa.binary(), pa.int32()))],
                names=[c.split()[0] for c in _RUN.split(", ")],
            )
        held.clear()
        size = 0

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_hash", "at", "n", "pre", "post", "bucket"))):
            held.setdefault(row[7], []).append(row[:7])
            size += 1
            if size >= 2 * BUCKET_ROWS:
                yield from flush()
    yield from flush()


_SPAN = "doc_id long, text_hash long, start int, end int"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int32())], names=["doc_id", "text_hash", "start", "end"])


def _merge_bucket(runs: list[dict]) -> Iterator[pa.RecordBatch]:
    doc_ids, hashes, places, counts, after, before = [], [], [], [], [], []
    for r in runs:
        first = len(places)
        doc_ids += r["doc_ids"]
        hashes += r["text_hashes"]
        places += r["places"]
        counts += r["counts"]
        for side, out in (("a", after), ("b", before)):
            out.append((r[f"shared_{side}"], r[f"rest_{side}"], [first + m for m in r[f"order_{side}"]]))
    found = repeated_offsets(list(LoserTree(after)), list(LoserTree(before)), len(places))
    rows = [(doc_ids[m], hashes[m], start, end) for m, start, end in _spans(found, places) if counts[m] == 1]
    if rows:
        yield _span_batch(rows)


def _merge(batches):
    runs, current = [], None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["bucket"] != current:
                if runs:
                    yield from _merge_bucket(runs)
                runs, current = [], row["bucket"]
            runs.append(row)
    if runs:
        yield from _merge_bucket(runs)


def _strings(batches):
    """Each string of a hot anchor's contexts by its 128-bit hash. x tells places of one periodic text apart."""
    h128 = xxhash.xxh3_128_digest
    for batch in batches:
        for anchor, doc_id, text_hash, at, n, pre, post in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_hash", "at", "n", "pre", "post"))):
            whole, p = memoryview(pre + post), len(pre)
            xs = [x for x in range(BEFORE + 1) if x <= p and p - x + LENGTH <= len(whole)]
            if xs:
                k = len(xs)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * k, pa.int64()), pa.array(xs, pa.int32()), pa.array([h128(whole[p - x : p - x + LENGTH]) for x in xs], pa.binary()), pa.array([doc_id] * k, pa.int64()), pa.array([text_hash] * k, pa.int64()), pa.array([at - x for x in xs], pa.int32()), pa.array([n] * k, pa.int64())], names=["anchor", "x", "string", "doc_id", "text_hash", "start", "n"])


def repeated_spans(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, text_hash, start, end: spans of documents (doc_id, text) covered by repeated strings; they may overlap."""
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    anchors = written(map_arrow(rows, _anchors, "doc_id long, text_hash long, at int, anchor long, context long"), "anchors")
    by_context = anchors.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "at")).alias("one"))
    contexts = by_context.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("n").alias("total"))
    contexts = contexts.filter("total > 1")
    marked = written(by_context.join(contexts, "anchor").select("anchor", "context", "n", "one.*", "contexts"), "repeated-anchors")
    settled = anchors.join(marked.filter("n > 1").select("anchor", "context"), ["anchor", "context"]).select("doc_id", "text_hash", F.greatest(F.col("at") - BEFORE, F.lit(0)).alias("start"), (F.col("at") + LENGTH).alias("end"))
    ends = marked.filter("contexts > 1")
    buckets = max(1, -(-ends.count() // BUCKET_ROWS))
    ends = ends.withColumn("hot", F.col("contexts") > hot_contexts).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    per_text = ends.groupBy(F.col("doc_id").alias("e_id"), F.col("text_hash").alias("e_hash")).agg(F.collect_list(F.struct("anchor", "at", "n", "hot", "bucket")).alias("ends"))
    texts = rows.join(per_text, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("text_hash") == F.col("e_hash"))).select("doc_id", "text_hash", "text", "ends")
    read = written(map_arrow(texts, _read_contexts, _CONTEXT), "contexts")
    runs = map_arrow(read.filter("not hot").select("anchor", "doc_id", "text_hash", "at", "n", "pre", "post", "bucket"), _make_runs, _RUN)
    merged = map_arrow(runs.repartition("bucket").sortWithinPartitions("bucket"), _merge, _SPAN)
    strings = map_arrow(read.filter("hot").select("anchor", "doc_id", "text_hash", "at", "n", "pre", "post"), _strings, "anchor long, x int, string binary, doc_id long, text_hash long, start int, n long")
    often = strings.groupBy("anchor", "x", "string").agg(F.count("*").alias("k")).filter("k > 1").select("anchor", "x", "string")
    counted = strings.filter("n = 1").join(often, ["anchor", "x", "string"]).select("doc_id", "text_hash", "start", (F.col("start") + LENGTH).alias("end"))
    return settled.unionByName(merged).unionByName(counted)


def _cut(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part, out = batch.slice(at, 200), []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                raw = text.encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], min(s["end"], len(raw))) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, last = [], 0
                for a, b in merged:
                    kept.append(raw[last:a])
                    last = b
                kept.append(raw[last:])
                out.append((len(raw), sum(b - a for a, b in merged), len(merged), b"".join(kept)))
            a, b, c, d = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes) of each row of docs.

    Null text is empty, texts under 400 bytes keep all. Repeated rows count each, so two equal rows of 400 bytes or more
    lose everything. Null ids pass through, an empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    spans = repeated_spans(rows, hot_contexts).groupBy(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left")
    return map_arrow(joined.select("doc_id", "text", "spans"), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
