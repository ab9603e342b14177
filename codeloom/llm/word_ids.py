"""Ids of whole texts by a public tokenizer file, with the distinct words of a worker encoded once.

The word tokenizer drops white space and never joins symbols across it, so a text's ids are the ids of its
white-space-separated chunks, one after another. Chunks repeat, so their ids are kept in a bounded memo; a text
for which that split is not proven (special strings, text that is not NFC, a capital sigma) goes to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from codeloom.llm._shared import vocabulary

WORD_VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: A memo that is larger than this keeps its short chunks, the frequent ones, only.
MEMO_CHUNKS, SHORT_CHUNK = 1_100_000, 7
LONG_CHUNK = 64

_encoders: dict[str, WordEncoder] = {}
#: Marks that end a word without joining it; control characters that str.split() takes for white space and the tokenizer doesn't.
_MARKS, _NOT_BLANK = frozenset(".,;:!?"), ("\x1c", "\x1d", "\x1e", "\x1f")


class WordEncoder:
    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would spin
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(max(vocab.values()), *[x["id"] for x in spec["added_tokens"]], 0) + 1, bool)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_chunk = bool(suffix) and kinds == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"]
        for token, i in vocab.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.memo: dict[str, bytes] = {}
        self.mark_ids: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that the memo lacks. Letters only: one piece a chunk, so the ids part after each end-of-word id.
        Letters and one mark: the ids of both."""
        got: dict[str, bytes] = {}
        marked = {x for x in chunks if x[-1] in _MARKS and x[:-1].isalpha()}
        words = {x[:-1] for x in marked}
        words.update(x for x in chunks if x.isalpha())
        known = self.memo
        plain = [x for x in words if x not in known]
        for at in range(0, len(plain), 50_000):
            part = plain[at : at + 50_000]
            ids = np.array(self.whole.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, b = ids.tobytes(), (cuts * 4).tolist()
                got.update(zip(part, (raw[i:j] for i, j in zip([0, *b], b))))
        rest = [x for x in (*plain, *chunks) if x not in got and x not in marked]
        got.update(zip(rest, self._library(rest)))
        for x in marked:
            mark = self.mark_ids.get(x[-1]) or self.mark_ids.setdefault(x[-1], self._library([x[-1]])[0])
            got[x] = (got[x[:-1]] if x[:-1] in got else known[x[:-1]]) + mark
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_chunk:
            return self._library(texts)
        out: list[bytes] = [b""] * len(texts)
        chunked: list[tuple[int, list[str]]] = []
        odd: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if "Σ" in text or any(x in text for x in (*self.special, *_NOT_BLANK)) or not unicodedata.is_normalized("NFC", text):
                odd.append(i)
            else:
                chunked.append((i, text.lower().split()))
        for i, ids in zip(odd, self._library([texts[i] for i in odd])):
            out[i] = ids
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            short = {k: v for k, v in memo.items() if len(k) <= SHORT_CHUNK}
            memo.clear()
            if len(short) <= MEMO_CHUNKS // 2:
                memo.update(short)
        missing = set().union(*(chunks for _, chunks in chunked)).difference(memo)
        local = self._learn(list(missing)) if missing else {}
        long = {k: local.pop(k) for k in [k for k in local if len(k) > LONG_CHUNK]}
        memo.update(local)
        for i, chunks in chunked:
            out[i] = b"".join([memo[x] if x in memo else long[x] for x in chunks] if long else map(memo.__getitem__, chunks))
        return out


def encoder(name: str = WORD_VOCABULARY) -> WordEncoder:
    """One encoder a worker and file."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def slices(batch, most_rows: int = 500):
    """(ids column, texts) of parts of a record batch, so that few texts are Python strings at once."""
    for at in range(0, batch.num_rows, most_rows):
        part = batch.slice(at, most_rows)
        yield part, [x or "" for x in part.column("text").to_pylist()]
