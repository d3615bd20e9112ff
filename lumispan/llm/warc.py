"""WARC files of pages, written index first and read back by coalesced byte ranges.

A record is a gzip member of its own. Writing gives an index row per record (file, offset, length, URL, digest);
reading takes any selection of index rows, joins neighbouring ranges of a file into reads of bounded size, and checks
each record against its digest.

Of records with equal payloads of at least ``min_bytes``, those with the smallest page_id are responses and the others
revisits of it; smaller payloads are all responses. Null html is an empty payload, a null URL leaves the header out,
and rows that repeat a page_id with the same payload are all written as the first is. Rows without page_id compare as
the largest. An empty table gives no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumispan.llm.common import filesystem, make_dir, materialize, scratch

INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
TASK_BYTES = 8 << 20  # compressed bytes that a task reads
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, mark: str, refers_to: int | None, date: str) -> bytes:
    """An uncompressed WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:{f'uuid:{uuid.uuid4()}' if page_id is None else f'page:{page_id}'}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{mark}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of an uncompressed record; ValueError if it is not whole."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError("broken record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under ``folder`` and return their index (INDEX)."""
    folder = make_dir(folder or scratch(pages.sparkSession, "warc"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html")
    marks = rows.where(size >= min_bytes).select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("mark"))
    first = marks.groupBy("mark").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("page_id").alias("ids"), F.count("*").alias("n"))
    shared = first.where((F.col("first") != F.col("last")) | (F.col("ids") < F.col("n")) & F.col("first").isNotNull()).select("mark", "first")
    # only the ids of revisits travel; a mark held by a third of all rows is one row of `shared`, and the other side can be split
    revisits = marks.join(shared, "mark").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))).select(F.col("page_id").alias("id"), "mark", "first").distinct()
    named = rows.withColumn("mark", F.sha1(F.encode("html", "UTF-8")))
    full = named.join(revisits, named.page_id.eqNullSafe(revisits.id) & (named.mark == revisits.mark), "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))

    def run(batches):
        f = None
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        at, out, held = 0, None, None
        for batch in batches:
            found = []
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    f, path = filesystem(f"{folder}/{name}")
                    out = f.open_output_stream(path, compression=None)  # records are compressed one by one
                payload = html.encode()
                mark = digest(payload)
                raw = gzip.compress(record(page_id, url, payload, mark, refers_to, date), level, mtime=0)
                out.write(raw)
                found.append((page_id, url, mark, len(payload), "response" if refers_to is None else "revisit", refers_to, f"{folder}/{name}", at, len(raw)))
                at += len(raw)
            if found:
                if held is not None:
                    yield held
                held = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.close()  # before the last index rows go out: they name only what is on disk
            yield held

    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return materialize(full.mapInArrow(run, INDEX), "warc-index")


def plan_reads(index: DataFrame, gap: int = 64 << 10, span: int = 4 << 20) -> DataFrame:
    """Join index rows of a file whose ranges lie at most ``gap`` bytes apart into reads of about ``span`` bytes.

    Returns file, start, stop and the sorted offsets and lengths of the records. A file holds the rows of one task, so
    the window over a file is bounded; ``span`` bounds what a read and its list hold, but for a single larger record.
    """
    by_file = W.partitionBy("file", "cell").orderBy("offset")
    rows = index.select("file", "offset", "length").withColumn("cell", F.floor(F.col("offset") / span))
    end = F.lag(F.col("offset") + F.col("length")).over(by_file)
    opened = rows.withColumn("new", F.when(end.isNull() | (F.col("offset") - end > gap), 1).otherwise(0))
    runs = opened.withColumn("run", F.sum("new").over(by_file))
    return runs.groupBy("file", "cell", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).drop("cell", "run")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the selected index rows, from the files; revisits have no payload of their own."""

    def page(x: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
        return int(m[1]) if m else None

    def run(batches):
        opened, src = None, None
        for batch in batches:
            for uri, start, stop, records in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "records")), strict=True):
                if uri != opened:
                    if src:
                        src.close()
                    f, path = filesystem(uri)
                    opened, src = uri, f.open_input_file(path)
                raw, found = src.read_at(stop - start, start), []
                for r in records:
                    at = r["offset"] - start
                    fields, http, body = parse(gzip.decompress(raw[at : at + r["length"]]))
                    mark = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and digest(body) != mark:
                        raise ValueError(f"{uri}: payload of {fields['WARC-Record-ID']} differs from its digest")
                    found.append((page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(http["Content-Length"]), mark, fields["WARC-Type"], page(fields.get("WARC-Refers-To")), body if payload and fields["WARC-Type"] == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        if src:
            src.close()

    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    # the plan is small and what it reads is not: as many tasks as the bytes ask for
    total = index.agg(F.sum("length")).first()[0] or 0
    plan = plan_reads(index).repartition(max(1, -(-total // TASK_BYTES)), "file", "start").sortWithinPartitions("file", "start")
    return plan.mapInArrow(run, RECORD)
