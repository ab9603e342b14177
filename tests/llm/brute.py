"""Plain Python statements of the contracts, over rows (doc_id, text); a row's result stands at its own place."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

BLANK = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(i):
    return -(1 << 63) if i is None else i


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return [(i, max(groups[t or ""], key=order), len(groups[t or ""])) for i, t in rows]


def lines(rows, least_chars=20, least_docs=3):
    key = lambda s: s.strip(BLANK).translate(LOWER)
    where = defaultdict(list)
    for i, t in rows:
        for k in {key(s) for s in (t or "").split("\n")}:
            where[k].append(i)
    gone = {k: max(v, key=order) for k, v in where.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [s for s in ls if key(s) not in gone or gone[key(s)] == i]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def suffix(rows, n=400):
    raw = [(t or "").encode() for _, t in rows]
    h = lambda b, s: xxhash.xxh3_128_intdigest(b[s : s + n])
    seen = Counter(h(b, s) for b in raw for s in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        cover = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - n + 1):
            if seen[h(b, s)] > 1:
                cover[s] += 1
                if s + n < len(cover):
                    cover[s + n] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def near(rows, words=3, radius=3):
    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        grams = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    members = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        members[find(k)].append(i)
    name = {r: min((i for i in v if i is not None), default=None) for r, v in members.items()}
    return [(i, f"{prints[k]:016x}", name[find(k)]) for k, (i, _) in enumerate(rows)]


def contaminated(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    of = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            of[tuple(w[s : s + n])].add(item)
    sizes = {len(k) for k in of}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (got := of.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


_libraries: dict[str, Tokenizer] = {}


def library(name):
    if name not in _libraries:
        _libraries[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _libraries[name]


def ids(text, name="word_bpe_49k.json"):
    return library(name).encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())
