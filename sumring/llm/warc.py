"""WARC archives with an index first.

Writing: each task writes its rows as records of one archive (a gzip member per record) and returns the index: file, offset, length,
URL, digest, type. Pages are not shuffled; only the ids of repeated payloads are looked up. Reading: selected index rows, sorted by
file and offset, are coalesced into byte ranges, so a file is read forwards in few large reads.

Records are WARC/1.1: ``response`` holds an HTTP head and the payload, ``revisit`` (identical payload digest) the HTTP head only,
whose Content-Length still tells the payload's size.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize
from .store import Ranges, Writer, coalesced

#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 1000
#: Revisit decisions (24 bytes each) up to which they are broadcast; beyond it pages are joined by shuffle.
BROADCAST_REVISITS = 2_000_000
#: Coalescing: bytes between neighbours that are read along, and bytes of a range at most.
GAP, RANGE = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "uri string, offset long, length long, url string, digest string, record_type string, page_id long"


#: Bytes of archives that a task reads, beyond as many tasks as there are cores.
TASK = 128 << 20


def _urn(page_id, digest: str, revisit: bool = False) -> str:
    """A record's id: page, digest and type tell all records apart but those of rows that are equal throughout."""
    return f"<urn:x-page:{page_id}:{digest}{':revisit' if revisit else ''}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not compressed. ``refers_to``: the id of the response that a revisit stands for, or None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest, refers_to is not None)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to, digest)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields, HTTP fields and the payload of one record (no payload for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-content-length"] = next(x.partition(b": ")[2].decode() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return fields | {"payload": payload}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another: of equal payloads of ``MIN_BYTES`` or more, that of the largest
    page_id is the response. Pages with a null id never revisit; rows that repeat the largest id are all responses."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    slim = pages.select("page_id", F.octet_length(body).alias("n"), F.sha1(body).alias("digest")).where(F.col("n") >= MIN_BYTES).select("page_id", "digest")
    slim = materialize(slim, "warcdig")
    most = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").drop("k")
    return slim.join(most, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``; returns the index, itself a table in the shared folder."""
    again = materialize(revisits(pages), "warcrev").withColumnsRenamed({"page_id": "_id", "digest": "_digest"})
    few = again.count() <= BROADCAST_REVISITS
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html")).withColumn("digest", F.sha1("html"))
    rows = rows.join(F.broadcast(again) if few else again, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")

    def run(it):
        out = None
        for pdf in it:
            if out is None and len(pdf):
                out = Writer(folder, ".warc.gz")
                info = b"software: archive writer\r\nformat: WARC File Format 1.1\r\n"
                out.write(_gzip(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-info:0>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (DATE.encode(), len(info), info)))
            found = []
            for page_id, url, html, digest, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["digest"], pdf["refers_to"], strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                data = _gzip(record(page_id, url, bytes(html), digest, refers_to))
                found.append((out.uri, out.write(data), len(data), url, digest, "response" if refers_to is None else "revisit", page_id))
            frame = pd.DataFrame(found, columns=[x.split()[0] for x in INDEX.split(", ")])
            yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    ids = rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})  # exact in pandas, nulls included
    return materialize(ids.mapInPandas(run, INDEX), "warcidx")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, html) of the selected index rows, from the archives; without
    ``payloads`` the last two are read and checked, but not returned.

    A response's size and digest are computed from its payload and checked against its header; a revisit's come from its header."""

    def run(it):
        ranges = Ranges()

        def rows():
            for pdf in it:
                yield from pdf[["uri", "offset", "length"]].itertuples(index=False, name=None)

        found = []
        for uri, begin, length, held in coalesced(rows(), GAP, RANGE):
            data = ranges.read(uri, begin, length)
            for _, offset, n in held:
                r = parse(zlib.decompress(data[offset - begin : offset - begin + n], 31))
                page, ref = r["warc-record-id"].split(":")[2], r.get("warc-refers-to", "::").split(":")[2]
                digest, size = r["warc-payload-digest"][5:], int(r["http-content-length"])
                if r["warc-type"] == "response" and (hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != size):
                    raise ValueError(f"damaged record at {uri} {offset}")
                found.append((page, size, digest, r["warc-type"], ref, *((r.get("warc-target-uri"), r["payload"].decode() if r["warc-type"] == "response" else None) if payloads else ())))
                if len(found) >= 500:
                    yield pd.DataFrame(found, columns=names)
                    found = []
        ranges.close()
        yield pd.DataFrame(found, columns=names)

    names = ["page", "payload_bytes", "payload_digest", "record_type", "ref", *(["url", "html"] if payloads else [])]
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, size // TASK + 1)  # the index itself is too small to tell
    picked = index.select("uri", "offset", "length").repartitionByRange(tasks, "uri", "offset").sortWithinPartitions("uri", "offset")
    out = picked.mapInPandas(run, ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'string'}" for c in names))
    number = lambda c: F.when(F.col(c).rlike("^-?[0-9]+$"), F.col(c)).cast("long")
    return out.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("ref").alias("refers_to"), *names[5:])


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write_archives(pages, fresh_path(spark, "warc"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN m.last > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.last > p.page_id THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.payload_bytes >= 1000 AND p.payload_digest = m.payload_digest
"""
