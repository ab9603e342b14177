"""The language predictions against the network written out in plain loops, on awkward texts."""

import math
import random

import pytest
import regex

from codeloom.llm import language_id as L


def plain_log_probabilities(net, window: bytes) -> list[float]:
    hidden = []
    for table, bias in zip(net.tables, net.bias):
        for f in range(L.FILTERS):
            answers = [sum(float(table[j][window[i + j]][f]) for j in range(len(table))) for i in range(L.SPAN - len(table) + 1)]
            hidden.append(max(0.0, max(answers) + float(bias[f])))
    z = [sum(h * float(w) for h, w in zip(hidden, net.out[:, k])) + float(net.out_bias[k]) for k in range(len(net.languages))]
    top = max(z)
    total = math.log(sum(math.exp(x - top) for x in z)) + top
    return [x - total for x in z]


def plain(net, text):
    if text is None or not regex.search(r"\p{L}", text):
        return "und", 0.0
    raw = text.encode()
    sums, weight = [0.0] * len(net.languages), 0
    for at in range(0, len(raw), L.SPAN):
        part = raw[at : at + L.SPAN]
        for k, x in enumerate(plain_log_probabilities(net, part.ljust(L.SPAN, b"\0"))):
            sums[k] += x * len(part)
        weight += len(part)
    means = [x / weight for x in sums]
    top = max(means)
    odds = [math.exp(x - top) for x in means]
    best = max(range(len(odds)), key=odds.__getitem__)
    return net.languages[best], odds[best] / sum(odds)


@pytest.fixture(scope="module")
def net(spark, small):
    return L.learn(spark.read.parquet(f"{small}/documents.parquet"))


def test_predictions_are_those_of_plain_loops(spark, small, net):
    rng = random.Random(3)
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(25).collect() if len(r["text"]) < 1500]
    odd = [None, "", "  \n\t", "123 456", "é", "x", "ab" * 128, "ab" * 128 + "c", "日本語", "\0a\0", "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(700))]
    given += [(-k, t) for k, t in enumerate(odd, 1)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(spark.createDataFrame(given, "doc_id long, text string"), net).collect()}
    assert len(got) == len(given) > 20
    for key, text in given:
        language, score = plain(net, text)
        assert got[key][0] == language and got[key][1] == pytest.approx(score, abs=1e-4), (key, text)
