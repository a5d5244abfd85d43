"""Archives that other readers can read, splits of any size, members that hold members, repeated payloads."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lograft.llm import warc

PAGES = "page_id long, url string, html string, payload_digest string, split long"
SMALL = "spark.sql.files.maxPartitionBytes"


def noise(seed, n):
    r = random.Random(seed)
    return "".join(chr(r.randint(32, 0x2FF)) for _ in range(n))


ROWS = [
    (1, "http://a/", "x" * 1000), (2, "http://a/\r\nWARC-Type: fake", "x" * 1000), (3, None, "x" * 1000), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
    (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "é" * 499 + "e"), (None, "u", "é" * 500), (None, "u", "n" * 2000), (None, "v", "n" * 2000), (11, "same", "s" * 1500), (11, "same", "s" * 1500),
    (12, "u", noise(1, 200_000)), (13, "u", "\x1f\x08\x00" * 400), (14, "u", "z" * (17 << 20)), (15, "u", "z" * (17 << 20)), (16, "u", "WARC/1.1\r\n\r\n"), *[(100 + k, "u", noise(k, 700 + k)) for k in range(150)],
]


def table(spark, rows):
    return spark.createDataFrame([(*x, "clash", 3) for x in rows], PAGES).repartition(5)


def wanted(rows):
    best = {}
    for page, _, html in rows:
        body = (html or "").encode()
        best[body] = max(best.get(body, (-1, 0)), (-1 if page is None else page, 0))
    out, responses = [], set()
    for page, _, html in rows:
        body = (html or "").encode()
        top = best[body][0]
        first = len(body) < 1000 or ((-1 if page is None else page) == top and body not in responses)
        if len(body) >= 1000 and first:
            responses.add(body)
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if first else "revisit", None if first or top < 0 else top))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    warc.write(table(spark, ROWS), path)
    return path


def test_query(spark, tmp_path):
    table(spark, ROWS).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted((tuple(x) for x in warc.op12_warc(spark, str(tmp_path)).collect()), key=repr) == wanted(ROWS)


def test_any_gzip_reader_reads_them(spark, archive):
    data = b"".join(gzip.open(os.path.join(archive, n)).read() for n in sorted(os.listdir(archive)) if n.startswith("part"))
    assert data.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)  # the fake type in a url stays in its line, the page that holds a version has no type
    assert data.count(b"WARC-Refers-To: <urn:page:") == sum(x[3] == "revisit" for x in wanted(ROWS))


@pytest.mark.parametrize("size", [2000, 100_000])
def test_splits_of_any_size(spark, archive, size):
    before = spark.conf.get(SMALL)
    spark.conf.set(SMALL, str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = warc.read(spark, archive)
        number = F.substring("record_id", 10, 20).try_cast("long").alias("page_id")
        rows = found.select(number, "payload_bytes", "payload_digest", "record_type", F.substring("refers_to", 10, 20).try_cast("long").alias("refers_to"))
        assert sorted((tuple(x) for x in rows.collect()), key=repr) == wanted(ROWS)
        bad = found.where("record_type = 'response' and (not digest_ok or sha1(payload) <> payload_digest or length(payload) <> payload_bytes)")
        assert bad.count() == 0
    finally:
        spark.conf.set(SMALL, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_members_inside_members(spark, tmp_path):
    """Payloads of stored bytes that hold whole archives: nothing inside them is a record, wherever splits fall."""
    inner = b"".join(gzip.compress(warc.record(900 + k, "u", b"inner" * 50, b"0" * 20), 6) for k in range(30))
    r = random.Random(5)
    outer, want = b"", []
    for k in range(25):
        body = r.randbytes(r.randint(0, 3000)) + inner * (k % 3) + r.randbytes(10) + warc.MAGIC * (k % 4)
        want.append((f"urn:page:{k}", hashlib.sha1(body).hexdigest()))
        outer += gzip.compress(warc.record(k, "u", body, hashlib.sha1(body).digest()), k % 2 * 6)  # level 0 stores the bytes as they are
        outer += b"\0" * (k % 2)
    (tmp_path / "nested.warc").write_bytes(outer)
    before = spark.conf.get(SMALL)
    try:
        for size in (3000, 20_000, 1 << 27):
            spark.conf.set(SMALL, str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = warc.read(spark, str(tmp_path / "nested.warc"))
            assert sorted((x.record_id, x.payload_digest) for x in found.collect()) == sorted(want), size
    finally:
        spark.conf.set(SMALL, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_and_torn(spark, tmp_path):
    warc.write(table(spark, []), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    whole = gzip.compress(warc.record(1, "u", b"p" * 5000, b"0" * 20))
    (tmp_path / "torn.warc").write_bytes(whole + whole[:-30])
    with pytest.raises(Exception, match="does not end"):
        warc.read(spark, str(tmp_path / "torn.warc")).count()
