"""Best-fit packing of token sequences after a dominance reduction.

Only the histogram of piece lengths (at most `capacity` numbers, whatever the corpus) reaches the driver. There,
pairs and single pieces that provably dominate every other set with the same longest piece are fixed (Martello and
Toth's criterion), the instance shrinks, and the rest is packed best fit, longest first, whole groups of equal bins at
a time. The outcome is a table of slots: for each length, which ranks go to which run of sequences. Its size depends
on the capacity alone. Pieces get their rank within their length from counts by (length, bucket of doc_id), so a very
frequent length is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._shared import map_arrow, whole_text, written
from codeloom.llm.word_ids import END_ID, WORD_VOCABULARY, encoder, slices

CAPACITY = 4096
RANK_BUCKETS = 256

Pattern = tuple[tuple[int, int], ...]  # (length, copies), in the order in which they lie in the sequence


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets fixed for good with their multiplicity, and what is left.

    For the longest piece x, let y be the largest other piece that fits beside it. {x} is fixed if nothing fits;
    {x, y} if they fill the sequence, if no third piece ever fits beside x, or if every two pieces that fit beside x
    together are no longer than y and no three fit: then each set with x can be exchanged for {x, y} without loss.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for x in sorted(left, reverse=True):
            while left.get(x, 0):
                room, have = capacity - x, sorted(left)
                at = bisect_right(have, room) - 1
                if at >= 0 and have[at] == x and left[x] < 2:
                    at -= 1
                if at < 0:
                    fixed.append((((x, 1),), left.pop(x)))
                    changed = True
                    break
                y = have[at]
                if y != room and not _pair_dominates(have, left, x, y, room):
                    break
                m = left[x] // 2 if x == y else min(left[x], left[y])
                fixed.append((((x, 2),) if x == y else ((x, 1), (y, 1)), m))
                changed = True
                for k, used in ((x, 2 * m),) if x == y else ((x, m), (y, m)):
                    left[k] -= used
                    if not left[k]:
                        del left[k]
    return fixed, left


def _pair_dominates(have: list[int], left: dict[int, int], x: int, y: int, room: int) -> bool:
    small: list[int] = []
    for k in have:
        small += [k] * min(3 - len(small), left[k] - (k == x))
        if len(small) == 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return True
    if len(small) == 3 and sum(small) <= room:
        return False
    fit = have[: bisect_right(have, room)]
    i, j, best = 0, len(fit) - 1, 0
    while i <= j:
        total = fit[i] + fit[j]
        if total > room:
            j -= 1
        else:
            if i != j or left[fit[i]] - (fit[i] == x) > 1:
                best = max(best, total)
            i += 1
    return best <= y


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, over a histogram: bins with the same contents are one entry with a number."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, number]
    rooms: list[int] = []
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            rooms = sorted(r for r, v in open_bins.items() if v)
            at = bisect_right(rooms, x - 1)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                pattern, bins = open_bins[room].pop()
            else:
                pattern, bins = (), -(-n // (capacity // x))
            each = room // x
            if bins * each > n:  # the last bin may get fewer, others none
                full, rest = divmod(n, each)
                if full:
                    open_bins[room - each * x].append([(*pattern, (x, each)), full])
                if rest:
                    open_bins[room - rest * x].append([(*pattern, (x, rest)), 1])
                if (spare := bins - full - bool(rest)) and pattern:
                    open_bins[room].append([pattern, spare])
                n = 0
            else:
                open_bins[room - each * x].append([(*pattern, (x, each)), bins])
                n -= bins * each
    return [(tuple(p), n) for v in open_bins.values() for p, n in v]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have each."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slot_table(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset of the first copy), sorted."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, number in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, rank[length], sequence, copies, offset))
            rank[length] += number * copies
            offset += length * copies
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, vocab: str = WORD_VOCABULARY, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: ids of the whole text with the end id, cut only if longer than capacity."""

    def run(batches):
        enc, end = encoder(vocab), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part, texts in slices(batch):
                rows = []
                for i, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((i, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and more, at least one token each).

    Every piece lies whole in one sequence of at most `capacity`, offsets are gapless from 0. Null ids and repeated rows
    are pieces like any other (equal rows may change places); an empty table gives no rows.
    """
    bucketed = written(pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int")), "pieces")
    groups = bucketed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    counts = {r[0]: r[1] for r in bucketed.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(k > capacity or k < 1 for k in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    slots = slot_table(plan(counts, capacity))
    keys = slots[:, 0] * (1 << 48) + slots[:, 1] if len(slots) else np.zeros(0, np.int64)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = bucketed.withColumn("__row", F.row_number().over(within) - 1).join(firsts, ["length", "__bucket"]).withColumn("__rank", F.col("__first") + F.col("__row")).drop("__first", "__row", "__bucket")
    columns = [c for c in pieces.columns]
    schema = pieces.select(columns).schema.add("sequence_id", "long").add("offset", "long")
    ranked = ranked.select(*columns, "__rank")

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            row = slots[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            which = rank - row[:, 1]
            sequence, offset = row[:, 2] + which // np.maximum(row[:, 3], 1), row[:, 4] + which % np.maximum(row[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, vocab: str = WORD_VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents (null text: the end id alone) into sequences of at most `capacity` tokens."""
    return pack(token_pieces(docs, vocab, capacity), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
