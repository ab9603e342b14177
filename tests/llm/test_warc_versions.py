"""WARC/1.0 files, and files that mix both versions."""

import gzip

import pytest

from codeloom.llm import warc


def record(version, rid, payload, length=None):
    return b"WARC/%s\r\nWARC-Type: resource\r\nWARC-Record-ID: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (version, rid, len(payload) if length is None else length, payload)


PAYLOADS = [b"one", b"", b"WARC/1.0 and WARC/1.1\r\nin a text\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n", b"WARC/1.", b"\r\n\r\n", b"last"]


@pytest.mark.parametrize("versions", [[b"1.0"], [b"1.1"], [b"1.1", b"1.0"], [b"1.0", b"1.1", b"1.1"]])
@pytest.mark.parametrize("compressed", [True, False])
def test_every_record_is_read(spark, tmp_path, versions, compressed):
    data = b"".join(record(versions[k % len(versions)], b"<%d>" % k, p) for k, p in enumerate(PAYLOADS))
    path = tmp_path / ("a.warc.gz" if compressed else "a.warc")
    path.write_bytes(gzip.compress(data) if compressed else data)
    got = {(r["record_id"], bytes(r["payload"])) for r in warc.read_warc(spark, str(path)).collect()}
    assert got == {(f"<{k}>", p) for k, p in enumerate(PAYLOADS)}


def test_bytes_behind_a_record_are_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"1.0", b"<1>", b"longer than it says", 6) + record(b"1.0", b"<2>", b"x"))
    with pytest.raises(Exception, match="behind a record"):
        warc.read_warc(spark, str(tmp_path / "a.warc")).collect()
