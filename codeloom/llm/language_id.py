"""Language identification by a byte convolutional network in numpy.

One-hot bytes, filters of several widths, the maximum over each window's positions, a rectifier and a softmax. Learned on
a bounded sample of labelled rows (a documented parameter); applied to the whole of every text in fixed-length windows,
many windows at a time. A text's prediction is the mean log-probability of its windows, weighted by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._shared import map_arrow, matching, text_hash

WIDTHS, FILTERS, SPAN = (2, 3, 4), 16, 256
#: The sample: so many rows of each language (those with the smallest hash of doc_id), and so many characters of each.
ROWS_PER_LANGUAGE, SAMPLE_CHARS = 400, 4000
#: Rows that are ranked for each row of the sample, about, and the hash values that doc_id is dealt to.
SPARE, HASHES = 4, 1 << 40
STEPS, BATCH, RATE, SEED = 700, 128, 0.01, 7
UNKNOWN = "und"
#: The pipeline keeps what is predicted with at least this score.
LEAST_SCORE = 0.3


class ByteNet:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def pooled(self, windows: np.ndarray, places: bool = False):
        """Largest response of each filter over each window (uint8, n x SPAN), before the rectifier."""
        best, where = [], []
        for table, bias in zip(self.tables, self.bias):
            w = len(table)
            n = SPAN - w + 1
            got = np.take(table[0], windows[:, :n], axis=0)
            for j in range(1, w):
                got += np.take(table[j], windows[:, j : j + n], axis=0)
            if places:
                at = got.argmax(1)
                where.append(at)
                best.append(np.take_along_axis(got, at[:, None, :], 1)[:, 0] + bias)
            else:
                best.append(got.max(1) + bias)
        return (np.concatenate(best, 1), where) if places else np.concatenate(best, 1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(windows), 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        share = 1 / np.bincount(labels, minlength=len(self.languages))[labels]
        share /= share.sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(windows), BATCH, p=share)
            x, y = windows[pick], labels[pick]
            best, where = self.pooled(x, places=True)
            hidden = np.maximum(best, 0)
            z = hidden @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(BATCH), y] -= 1
            z /= BATCH
            back = (z @ self.out.T) * (best > 0)
            grads, rows, f = [], np.arange(BATCH)[:, None], np.arange(FILTERS)[None, :]
            for k, (table, at) in enumerate(zip(self.tables, where)):
                g, part = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(table)):
                    np.add.at(g[j], (x[rows, at + j], np.broadcast_to(f, at.shape)), part)
                grads.append(g)
            grads += [back.sum(0).reshape(self.bias.shape), hidden.T @ z, z.sum(0)]
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (padded with byte 0), the text of each window, bytes of each window."""
    sizes = np.array([len(x) for x in texts], np.int64)
    n = np.maximum(-(-sizes // SPAN), 1)
    raw = np.frombuffer(b"".join(x.ljust(int(k) * SPAN, b"\0") for x, k in zip(texts, n)), np.uint8).reshape(-1, SPAN)
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return raw, owner, np.clip(sizes[owner] - nth * SPAN, 1, SPAN)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4: rows with 2 are held out of learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> ByteNet | None:
    """A network from labelled rows that are not held out; None if there are none. At most rows x languages short strings
    are collected, wherever in the table the rows lie. Counts by language set a bound on the hash of doc_id under which
    about SPARE x rows of each language lie, so the ranking reads as many rows however large the table is."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id")) != 2))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return None
    bound = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(HASHES, SPARE * rows * HASHES // n))))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    hashed = usable.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))).filter(F.col("h") < bound[F.col("lang")])
    short = hashed.select("lang", "h", F.substring(F.col("text"), start, F.lit(chars)).alias("part"))
    first = short.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).filter(F.col("n") <= rows)
    sample = sorted((r["lang"], r["h"], r["part"]) for r in first.select("lang", "h", "part").collect())
    if not sample:
        return None
    net = ByteNet(sorted({r[0] for r in sample}))
    windows, owner, _ = cut([r[2].encode() for r in sample])
    net.train(windows, np.array([net.languages.index(r[0]) for r in sample])[owner])
    return net


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, text_hash, lang_pred, score of each row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lettered = part.column("lettered").to_pylist()
                texts = [t.encode() if ok else b"" for t, ok in zip(part.column("text").to_pylist(), lettered)]
                total = np.zeros((len(texts), len(net.languages) if net else 1))
                if net:
                    windows, owner, weight = cut(texts)
                    for k in range(0, len(windows), 256):
                        np.add.at(total, owner[k : k + 256], net.log_probabilities(windows[k : k + 256]) * weight[k : k + 256, None])
                    total /= np.bincount(owner, weight, len(texts))[:, None]
                total = np.exp(total - total.max(1, keepdims=True))
                total /= total.sum(1, keepdims=True)
                best = total.argmax(1)
                known = [ok and net is not None for ok in lettered]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([net.languages[b] if k else UNKNOWN for b, k in zip(best, known)]), pa.array([float(t[b]) if k else 0.0 for t, b, k in zip(total, best, known)])], names=["doc_id", "text_hash", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text", lettered), run, "doc_id long, text_hash long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, held_out, lang_pred, score of each row of docs (doc_id, text, lang).

    Null texts and texts without a letter get `und` with score 0, and so does everything if no row can be learned from.
    A null doc_id is neither held out nor learned from; repeated rows count each, an empty table gives no rows.
    """
    got = predict(docs, learn(docs))
    return got.select("doc_id", "text_hash", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is predicted with at least that score."""
    return matching(docs, language_id(docs).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)), "left_semi")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
