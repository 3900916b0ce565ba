"""Line dedup by site-relative frequency.

Within each host, the share of pages that contain a line tells boilerplate (menus, licences, footers) from content. Exact
copies of a page count as one page, so that a copied page does not make its own lines boilerplate.

Scale: lines travel as 64-bit hashes, pre-aggregated per (host, line) before the shuffle; a hot host only adds to map-side
combining. At most ``lines per page / ratio`` lines of a host can exceed the ratio, so the flagged table is small; it is
broadcast only when its counted size is under ``BROADCAST_LINES``, else joined by shuffle, page by page (texts travel only then).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted, unused

#: A line is boilerplate if more than this share of its host's pages holds it ...
RATIO = 0.1
#: ... and at least so many pages.
MIN_PAGES = 5
#: Flagged lines (16 bytes each) up to which the flagged table is broadcast.
BROADCAST_LINES = 1_000_000


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a leading ``www.``; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]*)", 1)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_keys(text: Column) -> Column:
    """Hashes of the distinct lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, n_pages, host_pages) of the lines that exceed ``ratio``. Blank lines never count."""
    page = pages.select(F.coalesce(host, F.lit("")).alias("host"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("page"), line_keys(text).alias("keys"))
    page = page.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    per_line = page.select("host", F.explode("keys").alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("n_pages"))
    total = page.groupBy("host").agg(F.count("*").alias("host_pages"))
    return per_line.where(F.col("n_pages") >= min_pages).join(total, "host").where(F.col("n_pages") > ratio * F.col("host_pages"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``; adds ``n_lines`` and ``n_dropped`` (replacing columns of those names).

    Null text stays null with no lines; a null host counts as the empty host; rows are never dropped; repeated rows are each
    cleaned. A page all of whose lines are boilerplate becomes empty (blank lines stay).
    """
    flagged = materialize(boilerplate(pages, F.col(quoted(host)), F.col(quoted(text)), ratio, min_pages), "lines")
    own = {k: unused(pages, k) for k in ("host", "page", "keys", "keep")}  # like no column of the input
    body, at = F.col(quoted(text)), F.coalesce(F.col(quoted(host)), F.lit(""))
    rows = pages.withColumn(own["host"], at)
    if flagged.count() <= BROADCAST_LINES:
        bad = flagged.groupBy(F.col("host").alias(own["host"])).agg(F.collect_set("line_hash").alias(own["keys"]))
        rows = rows.join(F.broadcast(bad), own["host"], "left")
    else:  # pages meet the flagged lines that they have, dealt by page, so that a hot host is spread
        lines = pages.select(at.alias("host"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("page"), F.explode(line_keys(body)).alias("line_hash"))
        bad = lines.join(flagged.select("host", "line_hash"), ["host", "line_hash"], "left_semi").groupBy(F.col("host").alias(own["host"]), F.col("page").alias(own["page"])).agg(F.collect_set("line_hash").alias(own["keys"]))
        rows = rows.withColumn(own["page"], F.xxhash64(F.coalesce(body, F.lit("")))).join(bad, [own["host"], own["page"]], "left")
    keep = F.when(F.col(own["keys"]).isNull(), _lines(body)).otherwise(F.filter(_lines(body), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(own["keys"]), _key(x))))
    rows = rows.withColumn(own["keep"], keep)
    n = F.when(body.isNull(), 0).otherwise(F.size(_lines(body))).cast("long")
    dropped = F.when(body.isNull(), 0).otherwise(F.size(_lines(body)) - F.size(own["keep"])).cast("long")
    cleaned = F.when(body.isNotNull(), F.array_join(own["keep"], "\n"))
    passed = [cleaned.alias(c) if c == text else F.col(quoted(c)) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*passed, n.alias("n_lines"), dropped.alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    """Boilerplate lines of ``documents`` cut, the source taken as host."""
    out = drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, host, md5(coalesce(text, '')) AS page, u.line, u.pos FROM d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) AS pos) u),
total AS (SELECT host, count(DISTINCT md5(coalesce(text, ''))) AS host_pages FROM d GROUP BY host),
bad AS (SELECT l.host, trim(l.line, ' ') AS line FROM lines l JOIN total t ON l.host = t.host WHERE trim(l.line, ' ') <> ''
  GROUP BY l.host, trim(l.line, ' '), t.host_pages HAVING count(DISTINCT l.page) >= 5 AND count(DISTINCT l.page) > 0.1 * t.host_pages),
marked AS (SELECT l.rid, l.line, l.pos, b.line IS NULL AS keep FROM lines l LEFT JOIN bad b ON l.host = b.host AND trim(l.line, ' ') = b.line),
kept AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '') AS cut FROM marked GROUP BY rid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS n_lines, CASE WHEN d.text IS NULL THEN 0 ELSE n_dropped END AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN length(cut) END AS kept_chars, CASE WHEN d.text IS NOT NULL THEN md5(cut) END AS kept_md5
FROM d JOIN kept USING (rid)
"""
