"""Exact deduplication by a cuckoo-filter index over digests, verified against bucketed content.

1. Each scan task runs its rows through an index: a filter hit is looked up in the content bucket of the digest and
   compared as text. A task sends one row for each distinct text, so a group of copies shrinks before the shuffle.
2. Those rows are dealt and sorted by a digest bucket. A task holds the live digests of one bucket; when the bucket
   ends, its groups are sent out and its digests deleted from the index, so memory follows a bucket, not a partition.
3. Every document finds its group by digest in an equi-join that adaptive execution can split where one digest is hot.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import map_arrow, one_row, text_hash, whole_text

SLOTS, MOST_KICKS = 4, 200
#: A task's index is emptied (its groups sent on) when it holds so many bytes of text.
LIVE_BYTES = 48_000_000
BUCKET_HEX = 5


class CuckooIndex:
    """Live digests in a cuckoo filter of 16-bit fingerprints; the keys and contents themselves lie in buckets beside it."""

    def __init__(self, capacity: int = 1024):
        self.live = self.live_bytes = 0
        self.content: dict[int, list[list]] = {}
        self._size(capacity)

    def _size(self, capacity: int) -> None:
        n = 1
        while n * SLOTS * 0.9 < capacity:
            n *= 2
        self.mask, self.slots = n - 1, array("H", bytes(2 * SLOTS * n))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[a * SLOTS : a * SLOTS + SLOTS] or mark in self.slots[b * SLOTS : b * SLOTS + SLOTS]

    def _bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:14], "little")

    def find(self, digest: bytes, text: str) -> list | None:
        """The live entry of this very text; a filter hit alone is never believed."""
        if self.maybe(digest):
            for entry in self.content.get(self._bucket(digest), ()):
                if entry[0] == digest:
                    if entry[1] != text:
                        raise ValueError(f"two texts share the digest {digest.hex()}")
                    return entry
        return None

    def insert(self, digest: bytes, text: str, value: list) -> list:
        entry = [digest, text, *value]
        self.content.setdefault(self._bucket(digest), []).append(entry)
        self.live += 1
        self.live_bytes += len(text) + 200
        if not self._place(digest):
            self.resize()
        return entry

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        slots = self.slots
        for place in (a, b):
            for k in range(place * SLOTS, place * SLOTS + SLOTS):
                if not slots[k]:
                    slots[k] = mark
                    return True
        place = a
        for kick in range(MOST_KICKS):
            k = place * SLOTS + kick % SLOTS
            mark, slots[k] = slots[k], mark
            place = self._other(place, mark)
            for k in range(place * SLOTS, place * SLOTS + SLOTS):
                if not slots[k]:
                    slots[k] = mark
                    return True
        return False

    def resize(self) -> None:
        """Twice the room, filled again from the stored keys; a kicked-out mark is so never lost."""
        room = (self.mask + 1) * SLOTS
        while True:
            room *= 2
            self._size(room)
            if all(self._place(e[0]) for bucket in self.content.values() for e in bucket):
                return

    def delete(self, digest: bytes) -> bool:
        """Forgets a live digest; False if it isn't live."""
        bucket = self.content.get(self._bucket(digest), [])
        entry = next((e for e in bucket if e[0] == digest), None)
        if entry is None:
            return False
        bucket.remove(entry)
        if not bucket:
            del self.content[self._bucket(digest)]
        self.live -= 1
        self.live_bytes -= len(entry[1]) + 200
        mark, a, b = self._places(digest)
        for place in (a, b):
            for k in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.slots[k] == mark:
                    self.slots[k] = 0
                    return True
        return True

    def drain(self) -> list[list]:
        entries = [e for bucket in self.content.values() for e in bucket]
        for e in entries:
            self.delete(e[0])
        return entries


_GROUP = pa.schema([("digest", pa.string()), ("text", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _sent(entries: list[list], texts: bool) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(entries), 2000):
        part = entries[at : at + 2000]
        yield pa.RecordBatch.from_arrays([pa.array([e[0].hex() for e in part]), pa.array([e[1] if texts else None for e in part], pa.string()), pa.array([e[2] for e in part], pa.int64()), pa.array([e[3] for e in part], pa.int64())], schema=_GROUP)


def _take(index: CuckooIndex, digest: bytes, text: str, keep, n: int) -> None:
    entry = index.find(digest, text)
    if entry is None:
        index.insert(digest, text, [keep, n])
    else:
        entry[2] = keep if entry[2] is None else entry[2] if keep is None else max(entry[2], keep)
        entry[3] += n


def _within_task(batches):
    index = CuckooIndex()
    for batch in batches:
        for digest, text, keep, n in zip(*(c.to_pylist() for c in batch.columns)):
            _take(index, bytes.fromhex(digest), text, keep, n)
            if index.live_bytes > LIVE_BYTES:
                yield from _sent(index.drain(), True)
    yield from _sent(index.drain(), True)


def _within_bucket(batches):
    index, current, done = CuckooIndex(), None, []
    for batch in batches:
        for digest, text, keep, n in zip(*(c.to_pylist() for c in batch.columns)):
            if digest[:BUCKET_HEX] != current:
                done += [[e[0], None, *e[2:]] for e in index.drain()]
                current = digest[:BUCKET_HEX]
                if len(done) >= 2000:
                    yield from _sent(done, False)
                    done = []
            _take(index, bytes.fromhex(digest), text, keep, n)
    yield from _sent(done + index.drain(), False)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, digest (SHA-256, hex), keep_id (largest id of the equal texts), group_size.

    Null text counts as the empty text. A null id is kept in its group and never stays while another id exists. Rows
    that repeat with one id count each. An empty table gives no rows. Other columns are not read.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("digest", F.sha2("text", 256))
    schema = "digest string, text string, keep_id long, n long"
    local = map_arrow(keyed.select("digest", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")), _within_task, schema)
    dealt = local.repartition(F.substring("digest", 1, BUCKET_HEX)).sortWithinPartitions(F.substring("digest", 1, BUCKET_HEX))
    groups = map_arrow(dealt, _within_bucket, schema).select("digest", "keep_id", F.col("n").alias("group_size"))
    return keyed.select("doc_id", text_hash().alias("text_hash"), "digest").join(groups, "digest")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of equal texts, one with the largest doc_id."""
    return one_row(docs, exact_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
