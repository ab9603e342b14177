"""WARC files and the resolution of not-modified revisits by an as-of join.

Records are written as text lines with the record's own separators and read by splitting at the start of a version line,
which all versions share, so Spark's readers and writers do the input and output; a payload that holds one is put together
again by its Content-Length.

A revisit with the server-not-modified profile stands for the latest earlier full response of its canonical URL. Metadata
(never payloads) is dealt by ranges of (canonical URL, date, record id) and sorted, so one URL with a third of all rows
spreads over many tasks. Each task carries the last full response forward; what reaches into a task from those before it
is one row for each task. The target's validators and headers are then joined by record id, an equi-join that adaptive
execution splits where one response answers very many revisits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from codeloom.llm._shared import map_arrow, new_path, shuffle_partitions, written

VERSION = "WARC/1.1"
#: What files are split at when they are read: the start of the version lines of 1.0 and 1.1.
SPLIT = "WARC/1."
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers that a 304 answer may renew in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
CAPTURE = "record_id string, kind string, url string, date timestamp, profile string, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, www, default port, fragment and last slashes; query parameters sorted.

    A text without scheme and host stays as it is, but for blanks around it and the fragment.
    """
    whole = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(whole, scheme + r"([^/?]*)", 1))
    for gone in (r"^.*@", r":(80|443)?$", r"^www[0-9]*\."):
        host = F.regexp_replace(host, gone, "")
    path = F.regexp_replace(F.regexp_extract(whole, scheme + r"[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(whole, r"(?s)\?(.*)$", 1), "&")), "&")
    return F.when(whole.rlike(scheme), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))).otherwise(whole)


# ---- files


def write_warc(captures: DataFrame, path: str) -> None:
    """Writes captures (columns CAPTURE) as compressed WARC files. Null fields are left out, a null payload is empty."""
    raw = lambda c: F.encode(c, "UTF-8")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 "), F.coalesce(F.col("status"), F.lit(0)).cast("string"), F.lit(" -\r\n"))
    fields = F.array_join(F.transform(F.map_entries(F.coalesce("headers", F.expr("map()").cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\r\n"))), "")
    block = F.concat(raw(F.concat(http, fields, F.lit("\r\n"))), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    date = F.date_format(F.to_utc_timestamp("date", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = F.concat(F.lit(VERSION + "\r\n"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Target-URI", F.col("url")), line("WARC-Date", date), line("WARC-Profile", F.col("profile")))
    with_block = captures.select(head.alias("head"), block.alias("block"))
    record = F.concat(raw(F.concat("head", F.lit("Content-Type: application/http\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))), F.col("block"))
    with_block.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.partition(b":")
        if colon:
            key, text = name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()
            out[key] = f"{out[key]}, {text}" if key in out else text
    return out


def _parsed(head: dict[str, str], block: bytes) -> tuple:
    """A row of CAPTURE; the date stays text here. Blocks that aren't HTTP messages have no status and no headers."""
    status, headers, payload = None, {}, block
    if block.startswith(b"HTTP/"):
        top, _, payload = block.partition(b"\r\n\r\n")
        first, *rest = top.split(b"\r\n")
        code = first.split(b" ")[1:2]
        status = int(code[0]) if code and code[0].isdigit() and code[0] != b"0" else None
        headers = _fields(rest)
    return head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-profile"), status, list(headers.items()), payload


_ROW = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("day", pa.string()), ("profile", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _taken(pending: bytes) -> tuple[tuple | None, int, bytes | None]:
    """The first record of pending (which starts behind SPLIT), its length and what is left behind it, None if nothing is;
    no record if it isn't whole yet."""
    top, gap, block = pending.partition(b"\r\n\r\n")
    if not gap:
        return None, 0, pending
    version, *lines = top.split(b"\r\n")
    if not version.isdigit():
        raise ValueError("a record without a version line")
    head = _fields(lines)
    length = int(head.get("content-length", "-1"))
    if length < 0:
        raise ValueError("a record without Content-Length")
    if len(block) < length:
        return None, 0, pending
    if block[length:].strip(b"\r\n"):
        raise ValueError("bytes behind a record that are neither a separator nor a record")
    return _parsed(head, block[:length]), length, None


def _records(batches):
    split, rows, size, pending = SPLIT.encode(), [], 0, None
    for batch in batches:
        for value in batch.column("value"):
            raw = value.as_py()
            if pending is None and not raw.strip():
                continue  # before the first record of a file
            pending = raw if pending is None else pending + split + raw  # the split stood within a payload
            row, length, pending = _taken(pending)
            if row is None:
                continue
            rows.append(row)
            size += length
            if size > 8_000_000 or len(rows) >= 2000:
                yield _rows(rows)
                rows, size = [], 0
    if pending is not None:
        raise ValueError("the last record of a file, or of a part of one, is cut off")
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (columns CAPTURE) of versions 1.0 and 1.1, also mixed, compressed or not; uncompressed
    files are read in parts.

    Header names are lower case, repeated ones joined by commas. A record that is cut off or without Content-Length, and
    bytes that belong to no record, are an error; a file without records gives no rows.
    """
    lines = spark.read.option("lineSep", SPLIT).text(path).select(F.col("value").cast("binary").alias("value"))
    got = map_arrow(lines, _records, "record_id string, kind string, url string, day string, profile string, status int, headers map<string,string>, payload binary")
    return got.select("record_id", "kind", "url", F.try_to_timestamp("day").alias("date"), "profile", "status", "headers", "payload")


# ---- revisits


def _carry(batches):
    """Adds part, place, last: the last full response of the same URL up to and with each row, as far as the task knows,
    and before: the one up to the row before."""
    part, key, last, place = TaskContext.get().partitionId(), None, None, 0
    for batch in batches:
        keys, ids, full = (batch.column(c).to_pylist() for c in ("canonical", "record_id", "full"))
        befores, lasts = [], []
        for k, i, f in zip(keys, ids, full):
            if k != key:
                key, last = k, None
            befores.append(last)
            if f:
                last = i
            lasts.append(last)
        n = batch.num_rows
        places = pa.array(range(place, place + n), pa.int64())
        place += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), places, pa.array(befores, pa.string()), pa.array(lasts, pa.string())], names=[*batch.schema.names, "part", "place", "before", "last"])


def _same(mine: Column, other: Column) -> Column:
    """Weak comparison of validators; null where one is missing."""
    strong = lambda c: F.regexp_replace(c, r"^\s*W/", "")
    return strong(mine) == strong(other)


def resolve_revisits(captures: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row for each capture: record_id, kind, url, canonical, date, state, target_id, status, headers, payload_sha256.

    state: full (a response with status 200), resolved (a not-modified revisit with a target whose validators agree: it
    gets the target's status, payload digest and headers, of which the permitted ones are renewed), mismatch (ETag, or
    else Last-Modified, differs), unchecked (no validator in common), no_earlier (no earlier full response) or other.
    Earlier is strict; of responses of one instant the largest record id counts. Rows without URL, date or record id are
    never targets, and revisits without URL or date find none. Repeated rows count each; of unlike responses with one
    record id the least (headers, digest) is the target. captures has CAPTURE's columns, or payload_sha256 for payload;
    others are not read. An empty table gives no rows.
    """
    spark = captures.sparkSession
    digest = F.col("payload_sha256") if "payload_sha256" in captures.columns else F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), 256)
    rows = captures.select("record_id", "kind", "url", canonical_url(F.col("url")).alias("canonical"), "date", "profile", "status", "headers", digest.alias("payload_sha256"))
    usable = F.col("canonical").isNotNull() & F.col("date").isNotNull()
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False))
    # ranges are found by a first pass over the rows, so they are written once: records aren't parsed and hashed twice
    rows = written(rows.withColumn("full", full & usable & F.col("record_id").isNotNull()), "metadata")
    order = ["canonical", "date", "full", "record_id"]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    schema = rows.schema.add("part", IntegerType()).add("place", LongType()).add("before", StringType()).add("last", StringType())
    carried = written(dealt.mapInArrow(_carry, schema), "captures")

    # the last row of each task: at most one for each shuffle partition
    ends = carried.groupBy("part").agg(F.max(F.struct("place", "canonical", "last")).alias("e")).select("part", "e.canonical", "e.last").orderBy("part").collect()
    into, held = [], None
    for part, key, last in ends:
        if held:
            into.append((part, *held))
        held = (key, last) if last is not None else held if held and held[0] == key else None
    if into:
        known = F.broadcast(spark.createDataFrame(into, "part int, canonical string, from_before string"))
        carried = carried.join(known, ["part", "canonical"], "left").withColumn("before", F.coalesce("before", "from_before")).drop("from_before")

    revisit = F.coalesce((F.col("kind") == "revisit") & F.col("profile").contains("server-not-modified"), F.lit(False))
    target = carried.filter("full").groupBy("record_id").agg(F.min(F.struct(F.array_sort(F.map_entries(F.coalesce("headers", F.expr("map()").cast("map<string,string>")))).alias("h"), "payload_sha256")).alias("t"))
    target = target.select(F.col("record_id").alias("key"), F.lit(True).alias("wants"), F.map_from_entries("t.h").alias("t_headers"), F.col("t.payload_sha256").alias("t_sha256"))
    wanted = carried.withColumn("target_id", F.when(revisit & usable, F.col("before")))
    # rows without a target are dealt by their own id: as nulls they would all meet in one task
    wants = F.col("target_id").isNotNull()
    both = wanted.withColumn("key", F.when(wants, F.col("target_id")).otherwise(F.col("record_id"))).withColumn("wants", wants).join(target, ["key", "wants"], "left")
    same = F.coalesce(_same(F.col("headers")["etag"], F.col("t_headers")["etag"]), _same(F.col("headers")["last-modified"], F.col("t_headers")["last-modified"]))
    state = F.when(F.col("full"), "full").when(~revisit, "other").when(F.col("target_id").isNull(), "no_earlier").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    both = both.withColumn("state", state)
    renewed = F.map_filter("headers", lambda k, v: k.isin(*permitted))
    kept = F.map_filter("t_headers", lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    done = F.col("state") == "resolved"
    return both.select(
        "record_id", "kind", "url", "canonical", "date", "state", "target_id",
        F.when(done, F.lit(200)).otherwise(F.col("status")).alias("status"),
        F.when(done, F.map_concat(kept, renewed)).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("t_sha256")).otherwise(F.col("payload_sha256")).alias("payload_sha256"),
    )


# ---- the query

DAY = 86_400
FIRST = 1_704_067_200  # 2024-01-01 UTC


def page_captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page: its response, a later revisit that is still valid and asks by another form of the URL,
    one whose ETag is new, and one from the day before the response."""
    hashed = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16), F.lit('"'))
    pages, etag = pages.select("page_id", "url", "html", hashed.alias("page_etag")), F.col("page_etag")
    at = F.lit(FIRST) + F.col("page_id") * 60
    day = lambda n: F.timestamp_seconds(at + n * DAY)
    rid = lambda name: F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(f":{name}>"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    own = F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), size, F.lit("content-type"), F.lit("text/html; charset=utf-8"), F.lit("etag"), etag)

    def revisit(name: str, url: Column, n: int, tag: Column) -> Column:
        headers = F.create_map(F.lit("cache-control"), F.lit("max-age=3600"), F.lit("content-length"), F.lit("0"), F.lit("content-type"), F.lit("text/plain"), F.lit("date"), F.date_format(day(n), "yyyy-MM-dd"), F.lit("etag"), tag)
        return F.struct(rid(name).alias("record_id"), F.lit("revisit").alias("kind"), url.alias("url"), day(n).alias("date"), F.lit(NOT_MODIFIED).alias("profile"), F.lit(304).alias("status"), headers.alias("headers"), F.lit(None).cast("binary").alias("payload"))

    first = F.struct(rid("response").alias("record_id"), F.lit("response").alias("kind"), F.col("url"), day(0).alias("date"), F.lit(None).cast("string").alias("profile"), F.lit(200).alias("status"), own.alias("headers"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    other = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    every = F.array(first, revisit("valid", other, 1, F.concat(F.lit("W/"), etag)), revisit("changed", F.col("url"), 2, F.lit('"changed"')), revisit("early", F.col("url"), -1, etag))
    return pages.select(F.explode(every).alias("c")).select("c.*")


def op6_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Pages go to WARC files as captures, the files are read back, and the revisits in them are resolved."""
    path = new_path(spark, "warc")
    write_warc(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    captures = read_warc(spark, path).withColumn("payload_sha256", F.sha2("payload", 256)).drop("payload")
    got = resolve_revisits(captures)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return got.select("record_id", F.col("canonical").alias("canonical_url"), "state", "target_id", F.sha2(text, 256).alias("headers_sha256"), "payload_sha256")


SQL = r"""
WITH p AS (
  SELECT page_id, url, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS etag, sha256(coalesce(html, '')) AS body, CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) AS size, 1704067200 + page_id * 60 AS t,
         regexp_replace(trim(url), '#.*$', '') AS w FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www[0-9]*\.', '') AS host,
             regexp_replace(regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
             array_to_string(list_sort(string_split(regexp_extract(w, '\?(.*)$', 1), '&')), '&') AS query FROM p),
u AS (SELECT *, CASE WHEN regexp_matches(w, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE w END AS canonical FROM q),
c AS (SELECT page_id, 'response' AS name, t, etag AS tag, * EXCLUDE (page_id, t) FROM u
      UNION ALL SELECT page_id, 'valid', t + 86400, etag, * EXCLUDE (page_id, t) FROM u
      UNION ALL SELECT page_id, 'changed', t + 172800, '"changed"', * EXCLUDE (page_id, t) FROM u
      UNION ALL SELECT page_id, 'early', t - 86400, etag, * EXCLUDE (page_id, t) FROM u),
r AS (SELECT *, '<urn:page:' || CAST(page_id AS VARCHAR) || ':' || name || '>' AS record_id FROM c),
a AS (SELECT r.record_id, max(f.t) AS ft FROM r JOIN r f ON f.canonical = r.canonical AND f.name = 'response' AND f.t < r.t WHERE r.name <> 'response' GROUP BY 1),
b AS (SELECT r.*, x.record_id AS found, x.etag AS f_etag, x.body AS f_body, x.size AS f_size,
             row_number() OVER (PARTITION BY r.record_id ORDER BY x.record_id DESC) AS n
      FROM r LEFT JOIN a ON a.record_id = r.record_id LEFT JOIN r x ON x.canonical = r.canonical AND x.name = 'response' AND x.t = a.ft),
s AS (SELECT *, CASE WHEN name = 'response' THEN 'full' WHEN found IS NULL THEN 'no_earlier' WHEN tag = f_etag THEN 'resolved' ELSE 'mismatch' END AS state FROM b WHERE n = 1)
SELECT record_id, canonical AS canonical_url, state, found AS target_id,
  sha256(CASE state WHEN 'full' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'etag: ' || etag
         ELSE 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || CASE state WHEN 'resolved' THEN f_size ELSE '0' END || chr(10)
           || 'content-type: ' || CASE state WHEN 'resolved' THEN 'text/html; charset=utf-8' ELSE 'text/plain' END || chr(10)
           || 'date: ' || strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d') || chr(10) || 'etag: ' || CASE WHEN name = 'valid' THEN 'W/' ELSE '' END || tag END) AS headers_sha256,
  CASE state WHEN 'full' THEN body WHEN 'resolved' THEN f_body ELSE sha256('') END AS payload_sha256
FROM s
"""
