"""Token counts by byte-pair merging with a heap over a linked list; no ids are made.

A piece of text starts as its bytes. The heap gives the lowest-ranked adjacent pair, leftmost first; it is merged and
its new neighbours enter the heap. The count is the number of initial symbols less the number of merges. Counts of
short pieces are kept in a bounded memo for each worker.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import map_arrow, vocabulary, whole_text
from codeloom.llm.word_ids import slices

BYTE_VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
MEMO_PIECES, LONG_PIECE = 700_000, 48
#: The byte-level pre-tokenizer's pattern, with white space as Unicode's property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class PairMerger:
    def __init__(self, name: str = BYTE_VOCABULARY):
        with open(vocabulary(name), encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError(f"{name} isn't a plain byte-level vocabulary")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.pieces = regex.compile(PIECES).findall
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.memo: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece."""
        sym = [self.symbols[b] for b in piece.encode()]
        n = len(sym)
        rank = self.rank.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            both, sym[j], merges = a + b, "", merges + 1
            sym[i], right[i] = both, (k := right[j])
            if k < n:
                left[k] = i
                if (r := rank((both, sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, both, sym[k]))
            if (h := left[i]) >= 0 and (r := rank((sym[h], both))) is not None:
                heapq.heappush(heap, (r, h, sym[h], both))
        return n - merges

    def _plain(self, text: str) -> int:
        found = self.pieces(text)
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, found))
        except KeyError:
            pass
        total = 0
        for x in found:
            n = memo.get(x)
            if n is None:
                n = self.merged(x)
                if len(x) <= LONG_PIECE:
                    memo[x] = n
            total += n
        if len(memo) > MEMO_PIECES:
            memo.clear()
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special string within it is one token, as the library has it by default."""
        if self.special is None or not any(x in text for x in self.marks):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_mergers: dict[str, PairMerger] = {}


def merger(name: str = BYTE_VOCABULARY) -> PairMerger:
    if name not in _mergers:
        _mergers[name] = PairMerger(name)
    return _mergers[name]


def token_counts(docs: DataFrame, vocab: str = BYTE_VOCABULARY, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 tokens. Null ids pass through, repeated rows count each, an empty table gives no rows;
    other columns are not read. No shuffle; a text of any length is counted whole.
    """
    path = vocab

    def run(batches):
        m = merger(path)
        for batch in batches:
            for part, texts in slices(batch):
                sizes = [len(x.encode()) for x in texts]
                counts = [m.count(x) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
