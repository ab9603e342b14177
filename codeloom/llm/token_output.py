"""Token ids in directly addressable codes: 8-bit chunk levels, continuation bitmaps and rank directories.

Level 0 holds the low chunk of every id; a set bit in its bitmap says that the id goes on in the next level, where its
chunk lies at the rank of that bit. A directory keeps the rank before each block of 512 bits, so any token is read with
one chunk and one rank a level, and no block is decoded. A segment is one binary value with its own document directory.

Documents are dealt by ranges of doc_id and sorted; each task writes segments in order, each with the number of ids
before it in the task. Only one total for each task reaches the driver, for the ids before each task's range.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import map_arrow, new_path, shuffle_partitions, whole_text
from codeloom.llm.word_ids import END_ID, WORD_VOCABULARY, encoder, slices

MAGIC, BLOCK = b"DAC1", 512
SEGMENT_IDS = 1_000_000
_HEAD = "<4sIQQ"  # magic, levels, documents, ids
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def encode_segment(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """known: False where a document has no doc_id. ids: unsigned 32-bit, of all documents, one after another."""
    levels, values = [], ids.astype(np.uint32)
    while True:
        more = values > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_ONES[bits].reshape(-1, BLOCK // 8).sum(1))]).astype("<u4")
        levels.append(((values & 255).astype(np.uint8), bits, ranks))
        if not more.any():
            break
        values = values[more] >> 8
    parts = [struct.pack(_HEAD, MAGIC, len(levels), len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    for chunks, bits, ranks in levels:
        parts += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class Segment:
    """Random access to a segment's documents and tokens."""

    def __init__(self, raw: bytes):
        magic, n_levels, n_docs, self.n_ids = struct.unpack_from(_HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known, self.starts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            sizes = take("<u8", 3)
            self.levels.append((take("u1", int(sizes[0])), take("u1", int(sizes[1])), take("<u4", int(sizes[2]))))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        first = i // BLOCK * (BLOCK // 8)
        n = int(ranks[i // BLOCK]) + int(_ONES[bits[first : i // 8]].sum())
        return n + int(_ONES[bits[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else n

    def token(self, i: int) -> int:
        """Id number i; touches one chunk and one directory block a level."""
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; each level is entered at a rank, nothing before is read."""
        out, where = np.zeros(stop - start, "<u4"), None
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if stop <= start:
                break
            part = chunks[start:stop].astype(np.uint32) << (8 * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            where = np.flatnonzero(more) if where is None else where[more]
            start = self._rank(bits, ranks, start)
            stop = start + len(where)
        return out


def write_segments(docs: DataFrame, path: str, vocab: str = WORD_VOCABULARY, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents in ascending doc_id order (null first), each with the end id appended.

    Rows: part (range of doc_id), segment (within the part), base (ids before it in the part), n_ids, payload (a segment).
    """

    def run(batches):
        enc, end, part = encoder(vocab), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId()
        keys, ids, segment, base, n = [], [], 0, 0, 0

        def flush():
            nonlocal keys, ids, segment, base, n
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            payload = encode_segment(np.array([k or 0 for k in keys], np.int64), np.array([k is not None for k in keys]), lengths, np.frombuffer(b"".join(ids), "<u4"))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([base], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], names=["part", "segment", "base", "n_ids", "payload"])
            keys, ids, segment, base, n = [], [], segment + 1, base + n, 0
            return out

        for batch in batches:
            for rows, texts in slices(batch):
                for key, got in zip(rows.column("doc_id").to_pylist(), enc.encode(texts)):
                    keys.append(key)
                    ids.append(got + end)
                    n += len(got) // 4 + 1
                    if n >= segment_ids:
                        yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    map_arrow(dealt, run, "part int, segment int, base long, n_ids long, payload binary").write.option("compression", "zstd").parquet(path)


def read_segments(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the written segments."""
    files = spark.read.parquet(path)
    totals = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_ids")).collect())  # one row for each range
    firsts, total = {}, 0
    for part, n in totals:
        firsts[part], total = total, total + n

    def run(batches):
        for batch in batches:
            for part, base, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "payload"))):
                s, first = Segment(raw), firsts[part] + base
                ids = memoryview(s.tokens(0, s.n_ids)).cast("B")
                cuts = (s.starts * 4).tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=s.known == 0), pa.array(first + s.starts[:-1]), pa.array(np.diff(s.starts)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(files.select("part", "base", "payload"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts have the end id alone; rows with one doc_id lie side by side; an empty table gives no rows."""
    path = new_path(spark, "token-segments")
    write_segments(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_segments(spark, path)
