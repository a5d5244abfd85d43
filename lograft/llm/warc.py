"""WARC archives: written with revisit records by Spark's text writer, read in splits by gzip's magic bytes.

Every record is a gzip member of its own. Spark's text source moves the bytes in both directions, so archives may stand in
any store that Spark reaches, and failed or repeated tasks leave no half-written files. Writing: a member ends with the
length of its content as four bytes, the last of which is zero below 16 MiB (longer records are followed by an empty member);
that zero byte is what the writer puts after each row. Reading: the magic bytes are the row separator, so tasks scan byte ranges for
them and own what begins inside. Each candidate is validated by decoding the head of its content; a member counts as
ended when its stream has ended, and bytes that merely look like magic belong to the member that they stand in.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, scratch, settings, ship, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads of so many bytes and more are written once.
REVISIT_BYTES = 1000
#: A page's record id; the number is its page_id.
ID = "urn:page:"
#: Members of such a length end with another byte than zero.
LONG = 1 << 24
#: Decoded bytes of a candidate that tell whether a record begins there.
HEAD = 5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(content: bytes) -> bytes:
    """A gzip member whose last byte is zero, without that byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(content) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += pack.compress(b"") + pack.flush()
    return out[:-1]


def _field(value) -> str:
    """A value that cannot break out of its header line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", str(value)).strip()


def record(page_id, url, payload: bytes, sha1: bytes, of=None, revisit: bool = False) -> bytes:
    """One WARC record: a response, or a revisit of the page of, which holds the headers of its HTTP answer only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(sha1).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_field(url)}"] * (url is not None) + [f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{'' if of is None else of}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _members(batches):
    for batch in batches:
        out = []
        for page, url, html, of, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "of", "revisit")), strict=True):
            payload = (html.as_py() or "").encode()
            out.append(member(record(page.as_py(), url.as_py(), payload, hashlib.sha1(payload).digest(), of.as_py(), revisit.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """A record per row of pages (page_id, url, html) in archives under path, one for each task.

    Of rows with equal payloads of at least so many bytes, one with the largest page_id is the response (null ids are the smallest;
    of several such rows any one), and the others revisit it; shorter payloads are always written. Null payloads are empty; null
    ids and urls are left out of the record; repeated rows get a record each; other columns are not looked at; an empty table
    gives no records. A payload of any length stands in one record.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # Written once, so that the number of a row is the same for its group and for itself.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("same", F.when(F.octet_length("html") >= least, F.sha2("html", 256))), "pages")
    groups = rows.where("same is not null").groupBy("same").agg(F.max(F.struct("page_id", "row")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    found = rows.join(groups.select("same", "kept"), "same", "left")
    revisit = F.col("kept").isNotNull() & (F.col("kept.row") != F.col("row"))
    found = found.select("page_id", "url", "html", F.when(revisit, F.col("kept.page_id")).alias("of"), F.coalesce(revisit, F.lit(False)).alias("revisit"))
    found.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


RECORDS = (
    "file string, split long, nth long, open boolean, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"
)
FIELDS = [c.split()[0] for c in RECORDS.split(", ")]
ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
SCHEMA = pa.schema([(n, ARROW[t]) for n, t in (c.split() for c in RECORDS.split(", "))])


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields at the front, names in lower case, and what follows them."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}, rest


def _sha1(field: str) -> str | None:
    """A labelled digest as hexadecimal digits, whichever way it is written."""
    kind, _, value = field.partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def parsed(content: bytes, payload: bool) -> dict:
    """The fields of a record's decoded content. A revisit's length is the one that its HTTP answer had."""
    named, rest = _headers(content)
    size = int(named["content-length"])
    if len(rest) < size:
        raise ValueError(f"record {named.get('warc-record-id')}: {size} bytes announced, {len(rest)} found")
    block, kind = rest[:size], named.get("warc-type", "")
    length, body = None, block
    if named.get("content-type", "").startswith("application/http"):
        http, body = _headers(block)
        length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    given, own = _sha1(named.get("warc-payload-digest", "")), None
    if kind != "revisit":
        length, own = len(body), hashlib.sha1(body).hexdigest()
    bare = lambda name: named[name].strip("<>") if name in named else None
    return {
        "record_type": kind, "record_id": bare("warc-record-id"), "refers_to": bare("warc-refers-to"), "target_uri": bare("warc-target-uri"), "payload_bytes": length,
        "payload_digest": own or given, "digest_ok": None if own is None or given is None else own == given, "payload": body if payload and kind != "revisit" else None,
    }


def begins(piece: bytes) -> bool:
    """Whether the bytes after a magic are the front of a member whose content begins like a record."""
    if len(piece) < 7 or piece[0] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(MAGIC + piece[: 1 << 16], HEAD) == b"WARC/"
    except zlib.error:
        return False


class Member:
    """A member that is being read; pieces are the bytes between magics."""

    def __init__(self):
        self.inflate, self.content, self.broken = zlib.decompressobj(31), [], None

    def add(self, data: bytes) -> None:
        if not self.inflate.eof and self.broken is None:
            try:
                self.content.append(self.inflate.decompress(data))
            except zlib.error as e:
                self.broken = e


def _records(payload: bool, chained: bool):
    """Records of pieces (file, split, value) in their order. chained: pieces of whole files, so that members pass from one split to the next; otherwise each
    split is read for itself, and a row that is open stands for a split that ends inside a member or begins inside one."""

    def run(batches):
        held, place, nth, out = None, None, 0, []

        def row(**more):
            nonlocal nth
            nth += 1
            out.append(dict.fromkeys(FIELDS) | {"file": place[0], "split": place[1], "nth": nth, "open": False} | more)

        def close(end: bool = True):
            nonlocal held
            if held is None:
                return
            if held.inflate.eof:
                row(**parsed(b"".join(held.content), payload))
            elif chained:
                raise ValueError(f"{place[0]}: a member does not end" + (f" ({held.broken})" if held.broken else ""))
            else:
                row(open=True)
            held = None

        for batch in batches:
            for file, split, value in zip(*(batch.column(c) for c in ("file", "split", "value")), strict=True):
                here, piece = (file.as_py(), split.as_py()), value.as_buffer().to_pybytes()
                if place is None or here[: 1 if chained else 2] != place[: 1 if chained else 2]:
                    close()
                place = here
                if held is not None and held.inflate.eof:
                    close()
                if held is not None:  # a magic inside a member
                    held.add(MAGIC + piece)
                elif begins(piece):
                    held = Member()
                    held.add(MAGIC + piece)
                elif piece.strip(b"\0") and not _idle(piece):
                    if chained:
                        raise ValueError(f"{place[0]}: bytes between members")
                    row(open=True)
            if out:
                yield pa.RecordBatch.from_pylist(out, SCHEMA)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return run


def _idle(piece: bytes) -> bool:
    """An empty member, which may stand anywhere between records."""
    try:
        inflate = zlib.decompressobj(31)
        return inflate.decompress(MAGIC + piece, 1) == b"" and inflate.eof
    except zlib.error:
        return False


def pieces(spark, path: str) -> DataFrame:
    """(file, split, at, value) of archives: the bytes between magics, each with the byte range that owns it."""
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    meta = F.col("_metadata")
    return text.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))


def read(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of archives under path, members of gzip each: record_type, record_id, refers_to, target_uri, payload_bytes, payload_digest (SHA-1, lowercase hex), digest_ok, payload.

    Splits are read side by side. Where a split ends inside a member that goes on behind another magic (a chance of one in 16 million a
    byte), the splits of that file are read again as one, in order. The payload of a revisit is null; its length and digest are those that it states. A
    member is held decoded while it is read. Names may not end in .gz, which Spark would decompress whole. An empty folder gives no rows.
    """
    ship(spark)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="256"):
        found = written(pieces(spark, path).drop("at").mapInArrow(_records(payload, False), RECORDS), "records")
    torn = found.where("open").select("file").distinct()
    names = ["record_type", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest", "digest_ok", "payload"]
    if torn.isEmpty():
        return found.select(*names)
    again = pieces(spark, path).join(torn, "file", "left_semi").repartition("file").sortWithinPartitions("file", "split", "at")
    again = written(again.select("file", "split", "value").mapInArrow(_records(payload, True), RECORDS), "records")
    return found.join(torn, "file", "left_anti").select(*names).unionByName(again.select(*names))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(load(spark, sf_dir, "pages"), path)
    number = lambda c: F.substring(F.col(c), len(ID) + 1, 20).try_cast("long")
    return read(spark, path, payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND k > 1 THEN top END AS refers_to FROM w"""
