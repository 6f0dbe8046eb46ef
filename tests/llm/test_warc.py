"""Packages are read back exactly, by this reader and by the standard library's."""

import gzip
import hashlib
import io
import zipfile

import pytest

pytest.importorskip("lantern.llm")
from lantern.llm import warc_zip as W  # noqa: E402


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_of_own_package(zip64):
    out = io.BytesIO()
    z = W.ZipWriter(out, zip64)
    for name, data in (("a/é.bin", b"123"), ("empty", b""), (W.INDEX, b"x" * 70000)):
        z.begin(name)
        assert z.write(data) == 0
        z.end()
    z.close()
    raw = out.getvalue()
    read_at = lambda o, n: raw[o : o + n]
    got = {k: read_at(W.data_start(read_at, o), n) for k, (o, n, m) in W.directory(read_at, len(raw)).items()}
    assert got == {"a/é.bin": b"123", "empty": b"", W.INDEX: b"x" * 70000}
    std = zipfile.ZipFile(io.BytesIO(raw))
    assert std.testzip() is None and {n: std.read(n) for n in std.namelist()} == got


def test_directory_of_foreign_package():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", b"abc")
        z.comment = b"said " * 40
    raw = out.getvalue()
    read_at = lambda o, n: raw[o : o + n]
    (o, n, m) = W.directory(read_at, len(raw))["x"]
    assert m == 0 and read_at(W.data_start(read_at, o), n) == b"abc"
    with pytest.raises(ValueError):
        W.directory(lambda o, n: b"no zip"[o : o + n], 6)


def test_round_trip(spark, tmp_path):
    big, other = "é" * 600, "b" * 999
    rows = [(1, "http://a/%0A\nx", big), (2, None, big), (7, "u", big), (3, "u", other), (4, "u", other), (5, "u", None), (6, "u", ""), (8, "u", "<p>x\r\n\r\ny"), (8, "u", "<p>x\r\n\r\ny"), (None, "n", "z" * 5000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = W.round_trip(df, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.payload_bytes): r for r in got}
    for i, url, html in rows:
        raw = (html or "").encode()
        r = by[(i, len(raw))]
        assert r.payload_digest == hashlib.sha1(raw).hexdigest() and r.url == url
        if html == big and i != 7:
            assert r.record_type == "revisit" and r.refers_to == 7 and r.payload is None
        else:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == raw
    files = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".zip"]
    assert sum(gzip.decompress(zipfile.ZipFile(f).read(W.ARCHIVE)).count(b"WARC/1.1\r\n") for f in files) == len(rows)
    assert W.round_trip(df.limit(0), f"file://{tmp_path}/e").collect() == []


def test_packages_roll(spark, tmp_path):
    df = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat(md5(cast(id as string)), 50) as html").coalesce(1)
    packages = W.write_packages(W.mark_revisits(df), f"file://{tmp_path}/w", roll=6000, zip64=True)
    assert packages.count() > 3
    assert {r.page_id for r in W.read_packages(packages).collect()} == set(range(200))
