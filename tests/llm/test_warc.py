import gzip
from datetime import datetime

import pytest

from codeloom.llm import warc

NM = warc.NOT_MODIFIED


def day(n, second=0):
    return datetime(2024, 1, n, 0, 0, second)


def row(rid, kind, url, date, status, headers, payload=b"", profile=None):
    return (rid, kind, url, date, profile or (NM if kind == "revisit" else None), status, headers, payload)


def brute(rows):
    """record id -> (state, target), by looking at every response for every revisit."""
    canon = lambda u: u.split("#")[0].split("://")[1].rstrip("/").lower()
    out = {}
    for rid, kind, url, date, _, status, headers, _ in rows:
        if kind == "response":
            out[rid] = ("full" if status == 200 else "other", None)
            continue
        full = [(r[3], r[0], r[6]) for r in rows if r[1] == "response" and r[5] == 200 and canon(r[2]) == canon(url) and r[3] < date]
        if not full:
            out[rid] = ("no_earlier", None)
            continue
        _, target, h = max(full, key=lambda f: f[:2])
        strip = lambda v: v.removeprefix("W/")
        state = next((("resolved" if strip(headers[k]) == strip(h[k]) else "mismatch") for k in ("etag", "last-modified") if k in headers and k in h), "unchecked")
        out[rid] = (state, target)
    return out


def test_revisits_against_brute_force_with_a_hot_url(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(3000):
        url = "http://Hot.example/x#f" if i % 3 == 0 else f"https://h{rng.randrange(40)}.example/p/{rng.randrange(5)}/"
        kind = "response" if rng.random() < 0.2 else "revisit"
        headers = {}
        if rng.random() < 0.8:
            headers["etag"] = rng.choice(['"a"', 'W/"a"', '"b"'])
        if rng.random() < 0.5:
            headers["last-modified"] = rng.choice(["x", "y"])
        rows.append(row(f"<{i}>", kind, url, datetime(2024, 1, 1 + rng.randrange(20), rng.randrange(24), rng.randrange(3)), rng.choice([200, 200, 200, 206]) if kind == "response" else 304, headers, b"%d" % i))
    df = spark.createDataFrame(rows, warc.CAPTURE).repartition(7)
    from pyspark.sql import functions as F

    got = warc.resolve_revisits(df.withColumn("part", F.lit("clash")).withColumn("full", F.lit(1)))
    assert {r["record_id"]: (r["state"], r["target_id"]) for r in got.collect()} == brute(rows)


def test_merged_headers_status_and_payload(spark):
    rows = [
        row("<1>", "response", "http://www.a.example:80/x/?b=2&a=1", day(1), 200, {"etag": '"e"', "content-type": "text/html", "cache-control": "old", "content-length": "2"}, b"hi"),
        row("<2>", "revisit", "https://a.example/x?a=1&b=2#z", day(2), 304, {"etag": 'W/"e"', "cache-control": "new", "content-type": "text/plain", "x-own": "1", "expires": "soon"}),
    ]
    import hashlib

    r = {x["record_id"]: x for x in warc.resolve_revisits(spark.createDataFrame(rows, warc.CAPTURE)).collect()}["<2>"]
    assert (r["state"], r["target_id"], r["status"], r["canonical"]) == ("resolved", "<1>", 200, "a.example/x?a=1&b=2")
    assert r["headers"] == {"etag": 'W/"e"', "content-type": "text/html", "cache-control": "new", "content-length": "2", "expires": "soon"}
    assert r["payload_sha256"] == hashlib.sha256(b"hi").hexdigest()


def test_nulls_ties_repeats_and_other_kinds(spark):
    rows = [
        row("<1>", "response", "http://a.example/", day(1), 200, {"etag": '"e"'}, b"1"),
        row("<3>", "response", "http://a.example/", day(1), 200, {"etag": '"e"'}, b"3"),
        row("<3>", "response", "http://a.example/", day(1), 200, {"etag": '"e"'}, b"3"),
        row(None, "response", "http://a.example/", day(2), 200, {"etag": '"e"'}, b"n"),
        row("<4>", "revisit", "http://a.example", day(3), 304, {"etag": '"e"'}),
        row("<4>", "revisit", "http://a.example", day(3), 304, {"etag": '"e"'}),
        row("<5>", "revisit", "http://a.example", day(1), 304, {"etag": '"e"'}),
        row("<6>", "revisit", None, day(3), 304, {"etag": '"e"'}),
        row("<7>", "revisit", "http://a.example", None, 304, {"etag": '"e"'}),
        row("<8>", "revisit", "http://a.example", day(4), 304, None, None, "identical-payload-digest"),
        row("<9>", "revisit", "http://a.example", day(4), None, None, None),
        (None,) * 8,
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, warc.CAPTURE)).collect()
    assert len(got) == len(rows)
    found = {(r["record_id"], r["state"], r["target_id"]) for r in got}
    assert found == {("<1>", "full", None), ("<3>", "full", None), (None, "other", None), ("<4>", "resolved", "<3>"), ("<5>", "no_earlier", None), ("<6>", "no_earlier", None), ("<7>", "no_earlier", None), ("<8>", "other", None), ("<9>", "unchecked", "<3>")}
    assert warc.resolve_revisits(spark.createDataFrame([], warc.CAPTURE)).count() == 0


def test_files_round_trip(spark, tmp_path):
    hard = [b"", b"\x00\xff\xfe\r\n\r\nbytes", b"a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"x" * 3_000_000, "é\n".encode()]
    rows = [row(f"<{i}>", "response", f"http://e.example/{i}", day(1 + i), 200, {"etag": f'"{i}"', "x": ""}, p) for i, p in enumerate(hard)]
    rows.append(row("<r>", "revisit", None, None, 304, None, None))
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, warc.CAPTURE), path)
    got = {r["record_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r[0]]
        assert (g["kind"], g["url"], g["date"], g["profile"], g["status"], g["headers"], bytes(g["payload"])) == (r[1], r[2], r[3], r[4], r[5], r[6] or {}, r[7] or b"")


def test_a_cut_off_record_is_an_error_and_an_empty_file_isnt(spark, tmp_path):
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path / "a.warc.gz")).collect()
    (tmp_path / "b.warc").write_bytes(b"")
    assert warc.read_warc(spark, str(tmp_path / "b.warc")).count() == 0


@pytest.mark.parametrize("url, want", [("HTTP://User@WWW.A.example:443/P//?z=1&a=2#f", "a.example/P?a=2&z=1"), ("https://a.example", "a.example"), (" no scheme#x ", "no scheme"), (None, None), ("", "")])
def test_canonical_url(spark, url, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want
