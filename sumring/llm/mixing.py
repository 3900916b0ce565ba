"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree is domain - language - source. A token budget flows from the root by integer weights. A node that cannot use its share
(its capacity is ``max_epochs`` times its tokens) hands the rest to its siblings by weight; only what all siblings together
cannot use moves up. Each leaf then takes the longest prefix, within its budget, of its documents in seeded order, epoch after
epoch.

Scale: documents are aggregated to (leaf, epoch, bucket) token sums, with map-side combining, so a hot leaf is never sorted in one
task; only the ids and lengths of the one bucket of a leaf where its budget ends are put in order (about 1 in 2**``BUCKET_BITS`` of the leaf). Texts are not
shuffled: the per-leaf cut is joined by broadcast while the tree has at most ``BROADCAST_LEAVES`` leaves, else by shuffle.
All arithmetic is on integers, so any engine gives the same budgets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, unused

#: Leaves (64 bytes each) up to which the per-leaf cut is broadcast.
BROADCAST_LEAVES = 200_000
#: Bits of the bucket within a leaf's seeded order.
BUCKET_BITS = 12
#: Production weights of the query and the pipeline; what is not listed weighs 1 among its siblings.
DOMAIN_WEIGHTS = {"web": 2, "curated": 3}
LANG_WEIGHTS = {"en": 12, "de": 3, "fr": 3, "es": 2}
MAX_EPOCHS = 2
#: The budget as a share (numerator, denominator) of all tokens there are.
BUDGET_SHARE = (9, 10)
SEED = 20_240_601


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("long")


def domain_of(source: Column) -> Column:
    """The largest site is the web crawl, all others are curated."""
    return F.when(source == "src0", "web").otherwise("curated")


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _share(w: DataFrame, on: list[str], name: str) -> DataFrame:
    """Split ``budget`` among the children of each parent: w has ``on``, ``name``, w, cap and the parent's budget. A child is full if
    its capacity is within the level that the smaller ones (by cap / w) leave; the rest is split by weight, rounded down."""
    d = lambda c: F.col(c).cast("decimal(38,0)")
    whole = Window.partitionBy(*on)
    prior = whole.orderBy((F.col("cap").cast("decimal(38,12)") / F.col("w")).asc(), F.col(name).asc()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"w_all": F.sum("w").over(whole), "w_prior": F.coalesce(F.sum("w").over(prior), F.lit(0)), "c_prior": F.coalesce(F.sum("cap").over(prior), F.lit(0))})
    w = w.withColumn("full", d("cap") * (d("w_all") - d("w_prior")) + d("c_prior") * d("w") <= d("budget") * d("w"))
    w = w.withColumns({"w_full": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(whole), "c_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)})
    part = F.expr("cast((cast(w as decimal(18,0)) * cast(budget - c_full as decimal(19,0))) div greatest(w_all - w_full, 1) as bigint)")
    return w.select(*on, name, F.when(F.col("full"), F.col("cap")).otherwise(part).alias("budget"))


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, budget) from leaves (domain, lang, source, tokens, w_domain, w_lang, w_source) and the root's budget."""
    leaf = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("w"))
    domain = leaf.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("w"), F.lit(budget).cast("long").alias("budget"), F.lit(0).alias("root"))
    by_domain = _share(domain, ["root"], "domain").drop("root")
    by_lang = _share(lang.join(by_domain, "domain"), ["domain"], "lang")
    return _share(leaf.withColumn("w", F.col("w_source")).join(by_lang, ["domain", "lang"]), ["domain", "lang"], "source")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Seeded order of a document in an epoch: the first 60 bits of an md5, as a number."""
    said = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(said, "UTF-8")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS, share: tuple[int, int] = BUDGET_SHARE, domain=domain_of,
        domain_weights: dict[str, int] | None = None, lang_weights: dict[str, int] | None = None, source_weights: dict[str, int] | None = None) -> DataFrame:
    """The chosen rows of ``docs`` (doc_id, text, lang, source, ...), once per epoch they are in, plus ``mix_epoch``, ``mix_tokens``,
    ``mix_domain`` (replacing columns of those names; all others pass untouched).

    Null lang or source forms a category of its own (''). A document of no words costs nothing and is in every epoch that its leaf
    reaches. Documents of equal order (repeated rows) are taken together or not at all. A document longer than what is left of its
    leaf's budget ends the leaf's prefix. An empty table gives an empty result.
    """
    added = ["mix_epoch", "mix_tokens", "mix_domain"]
    docs = docs.drop(*added)
    own = {k: unused(docs, k) for k in ("lang", "source", "key", "epochs", "end")}  # like no column of the input
    rows = docs.withColumns({own["source"]: F.coalesce(F.col("source"), F.lit("")), own["lang"]: F.coalesce(F.col("lang"), F.lit(""))})
    rows = rows.withColumn("mix_domain", domain(F.col(own["source"])))
    leaf = [F.col("mix_domain").alias("domain"), F.col(own["lang"]).alias("lang"), F.col(own["source"]).alias("source")]
    on = ["domain", "lang", "source"]
    # One pass over the texts: tokens by (leaf, epoch, bucket), from which leaves, budgets and cuts all follow.
    epochs = F.sequence(F.lit(1), F.lit(max_epochs))
    bucket = lambda key: F.shiftright(key, 60 - BUCKET_BITS)
    slim = rows.select(*leaf, "doc_id", n_words(F.col("text")).alias("tokens")).withColumn("epoch", F.explode(epochs)).withColumn("bucket", bucket(order_key(F.col("doc_id"), F.col("epoch"), seed)))
    sums = materialize(slim.groupBy(*on, "epoch", "bucket").agg(F.sum("tokens").alias("tokens")), "mix")
    leaves = sums.where("epoch = 1").groupBy(*on).agg(F.sum("tokens").alias("tokens"))
    leaves = leaves.withColumns({"w_domain": weight_of(F.col("domain"), domain_weights or DOMAIN_WEIGHTS), "w_lang": weight_of(F.col("lang"), lang_weights or LANG_WEIGHTS), "w_source": weight_of(F.col("source"), source_weights or {})})
    total = sums.where("epoch = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * share[0] // share[1]
    budget = leaf_budgets(leaves, total, max_epochs)
    run = Window.partitionBy(*on).orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("tokens").over(run)).join(budget, on).where("upto > budget")
    cut = ends.groupBy(*on).agg(F.min(F.struct("epoch", "bucket", (F.col("budget") - F.col("upto") + F.col("tokens")).alias("room"))).alias("end"))
    cut = materialize(budget.join(cut, on, "left").select(*on, F.coalesce("end.epoch", F.lit(max_epochs + 1)).alias("epoch"), F.coalesce("end.bucket", F.lit(0)).alias("bucket"), F.coalesce("end.room", F.lit(0)).alias("room")), "mixcut")
    discard(sums)
    few = cut.count() <= BROADCAST_LEAVES
    # Where a leaf's budget ends: only ids and lengths of that bucket are put in order.
    last = rows.select(*leaf, "doc_id", "text").join(F.broadcast(cut) if few else cut, on).withColumn("key", order_key(F.col("doc_id"), F.col("epoch"), seed)).where(bucket(F.col("key")) == F.col("bucket"))
    last = last.select(*on, "key", "doc_id", "room", n_words(F.col("text")).alias("tokens")).withColumn("upto", F.sum("tokens").over(Window.partitionBy(*on).orderBy("key", "doc_id")))
    last = last.where("upto <= room").groupBy(*on).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    marks = materialize(cut.join(last, on, "left").select(*on, F.struct("epoch", "bucket", "last").alias("end")), "mixend").toDF("mix_domain", own["lang"], own["source"], own["end"])
    discard(cut)
    end, key, epoch = F.col(own["end"]), F.col(own["key"]), F.col("mix_epoch")
    out = rows.join(F.broadcast(marks) if few else marks, ["mix_domain", own["lang"], own["source"]])
    out = out.withColumn("mix_epoch", F.explode(F.filter(epochs, lambda e: e <= end["epoch"]))).withColumn(own["key"], order_key(F.col("doc_id"), epoch, seed))
    within = end["last"].isNotNull() & (F.struct(key.alias("key"), F.col("doc_id").alias("doc_id")) <= end["last"])
    out = out.where((epoch < end["epoch"]) | (bucket(key) < end["bucket"]) | ((bucket(key) == end["bucket"]) & within))
    return out.withColumn("mix_tokens", n_words(F.col("text"))).select(*docs.columns, *added)


def query(spark, sf_dir: str) -> DataFrame:
    """The mixture of ``documents`` by the production tree: a row per chosen document and epoch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "mix_domain", "lang", "source", "mix_epoch", "mix_tokens")


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, CASE WHEN source = 'src0' THEN 'web' ELSE 'curated' END AS dm,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
leaf AS (SELECT dm, l, s, sum(tokens)::BIGINT * {MAX_EPOCHS} AS cap, CASE dm WHEN 'web' THEN 2 WHEN 'curated' THEN 3 ELSE 1 END AS wd,
  CASE l WHEN 'en' THEN 12 WHEN 'de' THEN 3 WHEN 'fr' THEN 3 WHEN 'es' THEN 2 ELSE 1 END AS wl FROM d GROUP BY dm, l, s),
root AS (SELECT (sum(cap)::HUGEINT // {MAX_EPOCHS} * {BUDGET_SHARE[0]}) // {BUDGET_SHARE[1]} AS b FROM leaf),
n1 AS (SELECT dm, max(wd)::HUGEINT AS w, sum(cap)::HUGEINT AS cap, (SELECT b FROM root) AS b FROM leaf GROUP BY dm),
o1 AS (SELECT *, sum(w) OVER () AS wa, coalesce(sum(w) OVER p, 0) AS wp, coalesce(sum(cap) OVER p, 0) AS cp FROM n1 WINDOW p AS (ORDER BY cap::DECIMAL(38,12) / w, dm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f1 AS (SELECT *, cap * (wa - wp) + cp * w <= b * w AS f FROM o1),
b1 AS (SELECT dm, CASE WHEN f THEN cap ELSE (w * (b - coalesce(sum(cap) FILTER (WHERE f) OVER (), 0))) // greatest(wa - coalesce(sum(w) FILTER (WHERE f) OVER (), 0), 1) END AS b FROM f1),
n2 AS (SELECT leaf.dm, l, max(wl)::HUGEINT AS w, sum(cap)::HUGEINT AS cap, max(b1.b) AS b FROM leaf JOIN b1 ON leaf.dm = b1.dm GROUP BY leaf.dm, l),
o2 AS (SELECT *, sum(w) OVER (PARTITION BY dm) AS wa, coalesce(sum(w) OVER p, 0) AS wp, coalesce(sum(cap) OVER p, 0) AS cp FROM n2 WINDOW p AS (PARTITION BY dm ORDER BY cap::DECIMAL(38,12) / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (SELECT *, cap * (wa - wp) + cp * w <= b * w AS f FROM o2),
b2 AS (SELECT dm, l, CASE WHEN f THEN cap ELSE (w * (b - coalesce(sum(cap) FILTER (WHERE f) OVER (PARTITION BY dm), 0))) // greatest(wa - coalesce(sum(w) FILTER (WHERE f) OVER (PARTITION BY dm), 0), 1) END AS b FROM f2),
n3 AS (SELECT leaf.dm, leaf.l, s, 1::HUGEINT AS w, cap::HUGEINT AS cap, b2.b FROM leaf JOIN b2 ON leaf.dm = b2.dm AND leaf.l = b2.l),
o3 AS (SELECT *, sum(w) OVER (PARTITION BY dm, l) AS wa, coalesce(sum(w) OVER p, 0) AS wp, coalesce(sum(cap) OVER p, 0) AS cp FROM n3 WINDOW p AS (PARTITION BY dm, l ORDER BY cap::DECIMAL(38,12) / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT *, cap * (wa - wp) + cp * w <= b * w AS f FROM o3),
b3 AS (SELECT dm, l, s, CASE WHEN f THEN cap ELSE (w * (b - coalesce(sum(cap) FILTER (WHERE f) OVER (PARTITION BY dm, l), 0))) // greatest(wa - coalesce(sum(w) FILTER (WHERE f) OVER (PARTITION BY dm, l), 0), 1) END AS b FROM f3),
e AS (SELECT d.*, ep, substr(md5('{SEED}:' || ep || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS k FROM d, range(1, {MAX_EPOCHS} + 1) r(ep)),
r AS (SELECT e.*, sum(tokens) OVER (PARTITION BY dm, l, s ORDER BY ep, k, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
SELECT r.doc_id, r.dm AS mix_domain, r.lang, r.source, r.ep::INTEGER AS mix_epoch, r.tokens AS mix_tokens FROM r JOIN b3 ON r.dm = b3.dm AND r.l = b3.l AND r.s = b3.s WHERE r.upto <= b3.b
"""
