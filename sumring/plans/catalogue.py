"""The library's operators as queries on the driver's tables, each with the DuckDB SQL of the same result.

Continuous features are whole numbers (floor of the price, hundredths of rates), so that sums are exact in any order. ``NULLS`` are the
injected masks, the same text in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ring
from ..operators import cofactor as co
from ..operators import factorized as fz
from ..operators import features as ft
from ..operators import impute as im
from ..operators import models as ml
from ..operators.comparator import ml_mice
from ..operators.lineage import Parts
from ..session import ship_package
from ..streaming.running import into_memory, running_sums

FEATURES = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS q, CAST(floor(l_extendedprice) AS DOUBLE) AS p, CAST(round(l_discount * 100) AS DOUBLE) AS d, CAST(round(l_tax * 100) AS DOUBLE) AS t, l_returnflag AS rf, l_linestatus AS ls, l_shipdate"
NULLS = {
    "q": "(l_orderkey*31+l_partkey*17+l_suppkey*13+l_linenumber*7)%10 < 2",
    "p": "(l_orderkey*7+l_partkey*3+l_linenumber*11)%10 IN (1,4)",
    "d": "(l_orderkey*5+l_suppkey*19+l_linenumber*23)%11 < 2",
    "rf": "(l_orderkey*13+l_partkey*29)%7 = 3",
}
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
K = ", ".join(KEYS)
LI = f"li AS (SELECT {FEATURES} FROM lineitem)"
NL = LI + f", nl AS (SELECT {K}, t, ls, " + ", ".join(f"CASE WHEN {m} THEN NULL ELSE {c} END AS {c}" for c, m in NULLS.items()) + " FROM li)"

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(Tables(spark, sf_dir))

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def li(self) -> DataFrame:
        return self.lineitem.selectExpr(*_split(FEATURES))

    @property
    def nl(self) -> DataFrame:
        return self.li.selectExpr(*KEYS, "t", "ls", *(f"CASE WHEN {m} THEN NULL ELSE {c} END AS {c}" for c, m in NULLS.items()))

    def one(self, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def _split(text: str) -> list[str]:
    """Cut a select list at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


SUMS2 = "count(*) AS n, sum({a}) AS s_0, sum({b}) AS s_1, sum({a}*{a}) AS q_0_0, sum({a}*{b}) AS q_0_1, sum({b}*{b}) AS q_1_1"
QP = SUMS2.format(a="q", b="p")

# --- counting over joins -------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem")
def sum1_scan(t):
    return t.lineitem.agg(F.count("*").alias("n"))


JOIN = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT count(*) AS n FROM {JOIN}")
def sum1_join(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM {JOIN}")
def sum1_factorized_right(t):
    by_cust = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    fact = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    return fact.join(by_cust, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.sum("k").alias("n"))


@query(f"SELECT count(*) AS n FROM {JOIN}")
def sum1_factorized_left(t):
    fact = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    by_cust = fact.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("k").alias("k"))
    return by_cust.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).agg(F.sum("k").alias("n"))


@query(f"SELECT count(*) AS n FROM {JOIN}")
def sum1_preagg(t):
    fact = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    orders = t.orders.groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("k1"))
    cust = t.customer.groupBy("c_custkey").agg(F.count("*").alias("k2"))
    out = fact.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return out.agg(F.sum(F.col("k") * F.col("k1") * F.col("k2")).alias("n"))


# --- ring values -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {LI} SELECT {QP} FROM li")
def cofactor_cont(t):
    return t.li.agg(*co.sum_expressions(["q", "p"]))


@query(f"WITH {LI} SELECT rf, {QP} FROM li GROUP BY rf")
def cofactor_cont_grouped(t):
    return t.li.groupBy("rf").agg(*co.sum_expressions(["q", "p"]))


@query(f"WITH {LI} SELECT l_suppkey, {QP} FROM li GROUP BY l_suppkey HAVING count(*) > 600")
def cofactor_having(t):
    return t.li.groupBy("l_suppkey").agg(*co.sum_expressions(["q", "p"])).where("n > 600")


@query(f"WITH {LI} SELECT {QP} FROM li WHERE l_suppkey % 3 = 1")
def cofactor_where(t):
    return t.li.where("l_suppkey % 3 = 1").agg(*co.sum_expressions(["q", "p"]))


@query(f"WITH {LI} SELECT count(*) AS n, sum(q + d + t) AS s_0, sum((q + d + t) * (q + d + t)) AS q_0_0 FROM li")
def cofactor_expr_lift(t):
    return t.li.selectExpr("q + d + t AS e").agg(*co.sum_expressions(["e"]))


@query(f"WITH {LI} SELECT i, j, v FROM (SELECT count(*)::DOUBLE a00, sum(q) a01, sum(p) a02, sum(d) a03, sum(q*q) a11, sum(q*p) a12, sum(q*d) a13, sum(p*p) a22, sum(p*d) a23, sum(d*d) a33 FROM li), LATERAL (VALUES (0,0,a00),(0,1,a01),(0,2,a02),(0,3,a03),(1,1,a11),(1,2,a12),(1,3,a13),(2,2,a22),(2,3,a23),(3,3,a33)) x(i,j,v)")
def cofactor_gram(t):
    return co.gram(t.li, ["q", "p", "d"])


@query(f"WITH {LI} SELECT {K}, 1 AS n, q AS x0, p AS x1, q*q AS x00, q*p AS x01, p*p AS x11 FROM li")
def lift_rows(t):
    v = t.li.select(*KEYS, ring.lift([F.col("q"), F.col("p")], []).alias("v"))
    return v.select(*KEYS, "v.n", *(F.col("v.lin")[i].alias(f"x{i}") for i in range(2)), *(F.col("v.quad")[i].alias(a) for i, a in enumerate(("x00", "x01", "x11"))))


@query(f"WITH {LI} SELECT {K}, rf AS k, 1.0::DOUBLE AS one, q AS num, rf || '|' || ls AS pair FROM li")
def lift_cat_rows(t):
    v = t.li.select(*KEYS, ring.lift([F.col("q")], [F.col("rf"), F.col("ls")]).alias("v"))
    first = lambda c, i: F.map_entries(F.col(c)[i])[0]
    return v.select(*KEYS, first("v.lin_cat", 0)["key"].alias("k"), first("v.lin_cat", 0)["value"].alias("one"), first("v.num_cat", 0)["value"].alias("num"), first("v.cat_cat", 0)["key"].alias("pair"))


@query("SELECT r_regionkey, 7 AS n FROM region")
def const_lift(t):
    return t.region.select("r_regionkey", ring.const(7)["n"].alias("n"))


@query("SELECT l_returnflag AS k, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1")
def relation_sum(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").cast("double").alias("v"))


REL = "a AS (SELECT c_nationkey AS k, count(*)::DOUBLE AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*)::DOUBLE AS v FROM supplier GROUP BY 1)"


def _relations(t):
    """Two relations as single map values: bounded by the number of nations."""
    rel = lambda df, c: df.groupBy(F.col(c).cast("string").alias("k")).agg(F.count("*").cast("double").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(c))
    return rel(t.customer, "c_nationkey").withColumn("one", F.lit(1)).join(rel(t.supplier, "s_nationkey").withColumn("one", F.lit(1)), "one")


def _long(df: DataFrame, m) -> DataFrame:
    return df.select(F.explode(m).alias("k", "v"))


@query(f"WITH {REL} SELECT coalesce(a.k, b.k)::VARCHAR AS k, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM a FULL JOIN b ON a.k = b.k")
def relation_add(t):
    return _long(_relations(t), ring.relation_add(F.col("c_nationkey"), F.col("s_nationkey")))


@query(f"WITH {REL} SELECT coalesce(a.k, b.k)::VARCHAR AS k, coalesce(a.v, 0) - coalesce(b.v, 0) AS v FROM a FULL JOIN b ON a.k = b.k")
def relation_sub(t):
    return _long(_relations(t), ring.relation_sub(F.col("c_nationkey"), F.col("s_nationkey")))


@query(f"WITH {REL} SELECT a.k::VARCHAR || '|' || b.k::VARCHAR AS k, a.v * b.v AS v FROM a, b")
def relation_mul(t):
    return _long(_relations(t), ring.relation_mul(F.col("c_nationkey"), F.col("s_nationkey")))


@query(f"WITH {REL} SELECT k::VARCHAR AS k, v * 2.5 AS v FROM a")
def relation_scale(t):
    return _long(_relations(t), ring.relation_scale(F.col("c_nationkey"), F.lit(2.5)))


def _sets(t):
    return co.categorical_sums(t.li, ["q", "p"], ["rf", "ls"])


@query(f"WITH {LI} SELECT rf AS k, count(*) AS n FROM li GROUP BY rf")
def cofactor_lin_cat(t):
    return _sets(t).where("_gid = 1").select(F.col("rf").alias("k"), "n")


@query(f"WITH {LI} SELECT rf AS k, sum(q) AS s_q, sum(p) AS s_p FROM li GROUP BY rf")
def cofactor_num_cat(t):
    return _sets(t).where("_gid = 1").select(F.col("rf").alias("k"), F.col("s_0").alias("s_q"), F.col("s_1").alias("s_p"))


@query(f"WITH {LI} SELECT rf, ls, count(*) AS n FROM li GROUP BY rf, ls")
def cofactor_cat_cat(t):
    return _sets(t).where("_gid = 0").select("rf", "ls", "n")


def _value_row(t, v: co.Cofactor) -> DataFrame:
    k = len(v.cont)
    return t.one(n=float(v.n), **{f"s_{i}": float(v.lin[i]) for i in range(k)}, **{f"q_{i}_{j}": float(v.quad[i, j]) for i in range(k) for j in range(i, k)})


@query(f"WITH {LI} SELECT count(*)::DOUBLE AS n, sum(q) AS s_0, sum(p) AS s_1, sum(q*q) AS q_0_0, sum(q*p) AS q_0_1, sum(p*p) AS q_1_1 FROM li")
def cofactor_add(t):
    odd, even = (co.cofactor(t.li.where(f"l_partkey % 2 = {i}"), ["q", "p"]) for i in (1, 0))
    return _value_row(t, odd + even)


@query(f"WITH {NL} SELECT count(*)::DOUBLE AS n, sum(d) AS s_0, sum(t) AS s_1, sum(d*d) AS q_0_0, sum(d*t) AS q_0_1, sum(t*t) AS q_1_1 FROM nl WHERE q IS NOT NULL AND d IS NOT NULL")
def cofactor_sub_delta(t):
    """All rows less those where the column is missing: what the delta strategy trains on."""
    return _value_row(t, co.cofactor(t.nl, ["d", "t"]) - co.cofactor(t.nl.where("q IS NULL"), ["d", "t"]))


@query("WITH a AS (SELECT r_regionkey::DOUBLE AS x FROM region), b AS (SELECT n_nationkey::DOUBLE AS y FROM nation) SELECT count(*)::DOUBLE AS n, sum(x) AS s_0, sum(y) AS s_1, sum(x*x) AS q_0_0, sum(x*y) AS q_0_1, sum(y*y) AS q_1_1 FROM a, b")
def cofactor_mul_cross(t):
    return _value_row(t, co.cofactor(t.region, ["r_regionkey"]) * co.cofactor(t.nation, ["n_nationkey"]))


@query("SELECT r_regionkey AS k, 2 * count(*) AS n, sum(r_regionkey + n_nationkey)::DOUBLE AS s FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def ring_value_add(t):
    """Ring addition of row values: lift both sides of a join, add, sum."""
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    v = ring.add(ring.lift([F.col("n_nationkey")], []), ring.lift([F.col("r_regionkey")], []))
    return rows.select("r_regionkey", v.alias("v")).groupBy(F.col("r_regionkey").alias("k")).agg(F.sum("v.n").alias("n"), F.sum(F.col("v.lin")[0]).alias("s"))


@query("SELECT r_regionkey AS k, count(*) AS n, sum(r_regionkey)::DOUBLE AS s_0, sum(n_nationkey)::DOUBLE AS s_1, sum(r_regionkey * n_nationkey)::DOUBLE AS q_0_1 FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def ring_value_mul(t):
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    v = ring.mul(ring.lift([F.col("r_regionkey")], []), ring.lift([F.col("n_nationkey")], []), (1, 0), (1, 0))
    return rows.select("r_regionkey", v.alias("v")).groupBy(F.col("r_regionkey").alias("k")).agg(F.sum("v.n").alias("n"), *(F.sum(F.col("v.lin")[i]).alias(f"s_{i}") for i in range(2)), F.sum(F.col("v.quad")[1]).alias("q_0_1"))


@query(f"WITH {LI}, g AS (SELECT count(DISTINCT rf) AS a, count(DISTINCT ls) AS b, count(DISTINCT rf || ls) AS c FROM li) SELECT (a + b + a + b + c)::BIGINT AS total, least(a, b, c)::BIGINT AS least, greatest(a, b, c)::BIGINT AS most FROM g")
def cofactor_stats(t):
    s = co.cofactor(t.li, ["q"], ["rf", "ls"]).stats()
    return t.one(total=int(s["total"]), least=int(s["min"]), most=int(s["max"]))


@query(f"WITH {LI} SELECT ls, rf AS k, count(*)::DOUBLE AS c, sum(q) AS s, sum(count(*)) OVER (PARTITION BY ls)::BIGINT AS n, sum(sum(q * p)) OVER (PARTITION BY ls) AS qp FROM li GROUP BY ls, rf")
def ring_sum_cat(t):
    """SUM over stored ring values, maps included."""
    got = ring.sum_values(t.li.select("ls", ring.lift([F.col("q"), F.col("p")], [F.col("rf")]).alias("v")), "v", ["ls"])
    rows = got.select("ls", "v", F.explode(F.col("v.lin_cat")[0]).alias("k", "c"))
    return rows.select("ls", "k", "c", F.element_at(F.col("v.num_cat")[0], F.col("k")).alias("s"), F.col("v.n").alias("n"), F.col("v.quad")[1].alias("qp"))


@query(f"WITH {LI} SELECT rf || '|' || ls AS k, count(*)::DOUBLE AS c FROM li GROUP BY 1")
def ring_sum_pairs(t):
    got = ring.sum_values(t.li.select(ring.lift([], [F.col("rf"), F.col("ls")]).alias("v")), "v")
    return got.select(F.explode(F.col("v.cat_cat")[0]).alias("k", "c"))


@query(f"WITH {LI} SELECT ls, rf AS k, count(*)::DOUBLE AS v FROM li GROUP BY ls, rf")
def relation_sum_map(t):
    got = ring.sum_relations(t.li.select("ls", ring.relation(F.col("rf")).alias("r")), "r", ["ls"])
    return got.select("ls", F.explode("r").alias("k", "v"))


@query("SELECT n_nationkey, n_regionkey::VARCHAR AS k, 1.0::DOUBLE AS v FROM nation")
def relation_lift(t):
    return t.nation.select("n_nationkey", F.explode(ring.relation(F.col("n_regionkey"))).alias("k", "v"))


@query("SELECT r_regionkey AS k, (count(*) - 1) * 0 + 0 AS n, sum(n_nationkey - r_regionkey)::DOUBLE AS s, sum(n_nationkey * n_nationkey - r_regionkey * r_regionkey)::DOUBLE AS s2 FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def ring_value_sub(t):
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    v = ring.sub(ring.lift([F.col("n_nationkey")], [F.col("n_name")]), ring.lift([F.col("r_regionkey")], [F.col("r_name")]))
    return rows.select("r_regionkey", v.alias("v")).groupBy(F.col("r_regionkey").alias("k")).agg(F.sum("v.n").alias("n"), F.sum(F.col("v.lin")[0]).alias("s"), F.sum(F.col("v.quad")[0]).alias("s2"))


GROUPED = "a AS (SELECT r_regionkey % 2 AS g, count(*) AS n, sum(r_regionkey)::DOUBLE AS s FROM region GROUP BY 1), b AS (SELECT n_regionkey % 2 AS h, count(*) AS n, sum(n_nationkey)::DOUBLE AS s FROM nation GROUP BY 1)"
GROUPED_CAT = "ac AS (SELECT r_regionkey % 2 AS g, r_name AS k, count(*)::DOUBLE AS c FROM region GROUP BY 1, 2), bc AS (SELECT n_regionkey % 2 AS h, n_regionkey::VARCHAR AS k, count(*)::DOUBLE AS c FROM nation GROUP BY 1, 2)"


@query(f"WITH {GROUPED}, {GROUPED_CAT} SELECT a.g, b.h, a.n * b.n AS n, a.s * b.n AS s_0, b.s * a.n AS s_1, a.s * b.s AS q_0_1, ac.k || '|' || bc.k AS k, ac.c * bc.c AS c FROM a, b, ac, bc WHERE ac.g = a.g AND bc.h = b.h")
def cofactor_mul_grouped(t):
    """Product of two grouped sums, group by group (a few groups on both sides), categories included."""
    a = ring.sum_values(t.region.select((F.col("r_regionkey") % 2).alias("g"), ring.lift([F.col("r_regionkey")], [F.col("r_name")]).alias("va")), "va", ["g"])
    b = ring.sum_values(t.nation.select((F.col("n_regionkey") % 2).alias("h"), ring.lift([F.col("n_nationkey")], [F.col("n_regionkey")]).alias("vb")), "vb", ["h"])
    v = a.crossJoin(b).select("g", "h", ring.mul(F.col("va"), F.col("vb"), (1, 1), (1, 1)).alias("v"))
    return v.select("g", "h", F.col("v.n").alias("n"), F.col("v.lin")[0].alias("s_0"), F.col("v.lin")[1].alias("s_1"), F.col("v.quad")[1].alias("q_0_1"), F.explode(F.col("v.cat_cat")[0]).alias("k", "c"))


@query(f"WITH {LI} SELECT rf AS g, ls AS k, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY rf)::BIGINT AS n, sum(sum(q*q)) OVER (PARTITION BY rf) AS s2 FROM li GROUP BY rf, ls")
def nb_sum(t):
    got = ring.sum_values(t.li.select(F.col("rf").alias("g"), ring.nb_lift([F.col("q")], [F.col("ls")]).alias("v")), "v", ["g"], "nb")
    return got.select("g", F.explode(F.col("v.cat")[0]).alias("k", "c"), F.col("v.n").alias("n"), F.col("v.sq")[0].alias("s2"))


@query(f"WITH {LI} SELECT {K}, 0::BIGINT AS n, q - p AS s, q*q - p*p AS s2 FROM li")
def nb_sub(t):
    v = ring.nb_combine(ring.nb_lift([F.col("q")], []), ring.nb_lift([F.col("p")], []), -1)
    return t.li.select(*KEYS, v.alias("v")).select(*KEYS, "v.n", F.col("v.lin")[0].alias("s"), F.col("v.sq")[0].alias("s2"))


# --- joins and factorized statistics -----------------------------------------------------------------------------------------------

FACT = "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity AS q, CAST(floor(l_extendedprice) AS DOUBLE) AS p, l_returnflag AS rf FROM lineitem"
CJ = f"j AS (SELECT q, p, CAST(floor(o_totalprice / 100) AS DOUBLE) AS tp, CAST(floor(c_acctbal) AS DOUBLE) AS ab, c_mktsegment AS seg, rf FROM ({FACT}) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
_C = ["q", "p", "tp", "ab"]
CSUM = "count(*) AS n, " + ", ".join(f"sum({c}) AS s_{c}" for c in _C) + ", " + ", ".join(f"sum({a}*{b}) AS q_{min(a, b)}__{max(a, b)}" for i, a in enumerate(_C) for b in _C[i:])


def _tree(t, cats: bool, regroup: bool = True) -> fz.JoinTree:
    fact = t.lineitem.selectExpr("l_orderkey AS ok", "l_quantity AS q", "CAST(floor(l_extendedprice) AS DOUBLE) AS p", "l_returnflag AS rf")
    orders = t.orders.selectExpr("o_orderkey AS ok", "o_custkey AS ck", "CAST(floor(o_totalprice / 100) AS DOUBLE) AS tp")
    cust = t.customer.selectExpr("c_custkey AS ck", "CAST(floor(c_acctbal) AS DOUBLE) AS ab", "c_mktsegment AS seg")
    return fz.JoinTree(fact, ["q", "p"], ["rf"] if cats else [], ["ok"], [fz.Step(orders, ["ok"], ["tp"], [], ["ck"], regroup), fz.Step(cust, ["ck"], ["ab"], ["seg"] if cats else [])])


@query(f"WITH {CJ} SELECT {CSUM} FROM j")
def cofactor_join_mat(t):
    rows = _tree(t, False).joined()
    x = {c: F.col(c) for c in _C}
    return rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in _C), *(F.sum(x[a] * x[b]).alias(f"q_{min(a, b)}__{max(a, b)}") for i, a in enumerate(_C) for b in _C[i:]))


@query(f"WITH {CJ} SELECT {CSUM} FROM j")
def cofactor_factorized(t):
    return fz.factorized_sums(_tree(t, False))


@query(f"WITH {CJ} SELECT rf, seg, count(*) AS n, sum(q) AS s_q, sum(tp) AS s_tp FROM j GROUP BY rf, seg")
def cofactor_factorized_cat(t):
    rows, _, _ = fz.partial_sums(_tree(t, True))
    return rows.groupBy("rf", "seg").agg(F.sum("n").alias("n"), F.sum("s_q").alias("s_q"), F.sum("s_tp").alias("s_tp"))


@query(f"SELECT count(*) AS n, sum(q) AS s_q, sum(CAST(floor(p_retailprice) AS DOUBLE)) AS s_rp, sum(q * CAST(floor(p_retailprice) AS DOUBLE)) AS q_q__rp, sum(CAST(floor(s_acctbal) AS DOUBLE) * CAST(floor(p_retailprice) AS DOUBLE)) AS q_rp__sb FROM ({FACT}) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def cofactor_star5(t):
    fact = t.lineitem.selectExpr("l_partkey AS pk", "l_suppkey AS sk", "l_quantity AS q")
    part = t.part.selectExpr("p_partkey AS pk", "CAST(floor(p_retailprice) AS DOUBLE) AS rp")
    supp = t.supplier.selectExpr("s_suppkey AS sk", "s_nationkey AS nk", "CAST(floor(s_acctbal) AS DOUBLE) AS sb")
    steps = [fz.Step(part, ["pk"], ["rp"], [], ["sk"], True), fz.Step(supp, ["sk"], ["sb"], [], ["nk"], True), fz.Step(t.nation.selectExpr("n_nationkey AS nk", "n_regionkey AS rk"), ["nk"], [], [], ["rk"], True), fz.Step(t.region.selectExpr("r_regionkey AS rk"), ["rk"])]
    return fz.factorized_sums(fz.JoinTree(fact, ["q"], [], ["pk", "sk"], steps)).select("n", "s_q", "s_rp", "q_q__rp", "q_rp__sb")


STAR = "w AS (SELECT s_suppkey AS sk, x AS ln, ((s_suppkey * 7 + x * 5) % 13)::DOUBLE AS wx, ((s_suppkey + x) % 3)::INTEGER AS wc FROM supplier, range(1, 8) r(x)), sj AS (SELECT l_quantity AS q, CAST(floor(p_retailprice) AS DOUBLE) AS rp, CAST(floor(s_acctbal) AS DOUBLE) AS sb, wx, wc, n_regionkey AS rk, l_returnflag AS rf FROM lineitem JOIN part ON l_partkey = p_partkey JOIN w ON l_suppkey = w.sk AND l_linenumber = w.ln JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def _star(t, cats: bool = True) -> tuple[DataFrame, list[fz.Step]]:
    """A star of five tables, one of them with a composite key; supplier leads on to nation."""
    fact = t.lineitem.selectExpr("l_partkey AS pk", "l_suppkey AS sk", "l_linenumber AS ln", "l_quantity AS q", "l_returnflag AS rf")
    part = t.part.selectExpr("p_partkey AS pk", "CAST(floor(p_retailprice) AS DOUBLE) AS rp")
    weather = t.supplier.selectExpr("s_suppkey AS sk", "explode(sequence(1, 7)) AS x").selectExpr("sk", "x AS ln", "CAST((sk * 7 + x * 5) % 13 AS DOUBLE) AS wx", "CAST((sk + x) % 3 AS INT) AS wc")
    supp = t.supplier.selectExpr("s_suppkey AS sk", "s_nationkey AS nk", "CAST(floor(s_acctbal) AS DOUBLE) AS sb")
    nation = t.nation.selectExpr("n_nationkey AS nk", "n_regionkey AS rk")
    some = lambda *c: list(c) if cats else []
    steps = [fz.Step(part, ["pk"], ["rp"], [], ["sk", "ln"], True), fz.Step(weather, ["sk", "ln"], ["wx"], some("wc"), ["sk"], True), fz.Step(supp, ["sk"], ["sb"], [], ["nk"], True), fz.Step(nation, ["nk"], [], some("rk"))]
    return fact, steps


@query(f"WITH {STAR} SELECT count(*)::DOUBLE AS n, sum(q) AS s_q, sum(rp * wx) AS q_rp_wx, sum(sb * wx) AS q_sb_wx, count(*) FILTER (WHERE wc = 1 AND rk = 2)::DOUBLE AS c_wc_rk, count(*) FILTER (WHERE rf = 'R' AND wc = 0)::DOUBLE AS c_rf_wc, sum(sb) FILTER (WHERE rk = 3) AS s_sb_rk FROM sj")
def cofactor_star_composite(t):
    """Three categorical columns in three tables: sums of each pair go up the tree apart."""
    fact, steps = _star(t)
    v = fz.factorized_cofactor(fz.JoinTree(fact, ["q"], ["rf"], ["pk", "sk", "ln"], steps))
    i = v.cont.index
    return t.one(n=float(v.n), s_q=float(v.lin[i("q")]), q_rp_wx=float(v.quad[i("rp"), i("wx")]), q_sb_wx=float(v.quad[i("sb"), i("wx")]), c_wc_rk=v.cat_cat["wc", "rk"][1, 2], c_rf_wc=v.cat_cat["rf", "wc"]["R", 0], s_sb_rk=float(v.num_cat["sb", "rk"][3]))


@query(f"WITH {CJ}, m AS (SELECT round(regr_intercept(q, tp), 4) AS a, round(regr_slope(q, tp) * 1000, 5) AS b FROM j) SELECT x AS strategy, a, b FROM m, (VALUES ('auto'), ('factorized'), ('joined'), ('materialized')) v(x)")
def train_strategies(t):
    fact, steps = t.lineitem.selectExpr("l_orderkey AS ok", "l_quantity AS q"), [fz.Step(t.orders.selectExpr("o_orderkey AS ok", "CAST(floor(o_totalprice / 100) AS DOUBLE) AS tp"), ["ok"], ["tp"])]
    models = {s: fz.train(fz.JoinTree(fact, ["q"], [], ["ok"], steps), "q", s) for s in ("auto", "factorized", "joined", "materialized")}
    return t.rows([(s, float(m.theta[0]), float(m.theta[1])) for s, m in models.items()], "strategy string, a double, b double").select("strategy", F.round("a", 4).alias("a"), F.round(F.col("b") * 1000, 5).alias("b"))


@query("SELECT count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def semi_join_in(t):
    near = t.supplier.where("s_nationkey < 5")
    return t.lineitem.join(near, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"))


# --- linear algebra ------------------------------------------------------------------------------------------------------------------

OH = "z AS (SELECT 1.0::DOUBLE AS c0, q AS c1, (CASE WHEN rf = 'A' THEN 1 ELSE 0 END)::DOUBLE AS c2, (CASE WHEN rf = 'N' THEN 1 ELSE 0 END)::DOUBLE AS c3, (CASE WHEN rf = 'R' THEN 1 ELSE 0 END)::DOUBLE AS c4 FROM li)"


def _sigma_sql(cols: list[int]) -> str:
    return f"WITH {LI}, {OH}, s AS (SELECT " + ", ".join(f"sum(c{x}*c{y}) AS s{a}_{b}" for a, x in enumerate(cols) for b, y in enumerate(cols)) + " FROM z) SELECT i, j, v FROM s, LATERAL (VALUES " + ", ".join(f"({a},{b},s{a}_{b})" for a in range(len(cols)) for b in range(len(cols))) + ") x(i, j, v)"


def _matrix_rows(t, m) -> DataFrame:
    return t.rows([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "i int, j int, v double")


@query(_sigma_sql([0, 1, 2, 3, 4]))
def sigma_matrix(t):
    return _matrix_rows(t, co.cofactor(t.li, ["q"], ["rf"]).sigma()[1])


@query(_sigma_sql([0, 1, 3, 4]))
def onehot_drop_first(t):
    return _matrix_rows(t, co.cofactor(t.li, ["q"], ["rf"]).sigma(drop_first=True)[1])


@query(f"WITH {LI} SELECT (row_number() OVER (ORDER BY rf) + 1)::INTEGER AS i, rf AS k FROM (SELECT DISTINCT rf FROM li)")
def onehot_expand(t):
    names = co.cofactor(t.li, ["q"], ["rf"]).layout()
    return t.rows([(i, n[1]) for i, n in enumerate(names) if len(n) == 2], "i int, k string")


@query(f"WITH {LI} SELECT rf AS k, count(*)::DOUBLE AS s0, sum(q) AS s1 FROM li GROUP BY rf")
def class_sums(t):
    classes, _, sums = co.cofactor(t.li, ["q"], ["rf"]).class_sums("rf")
    return t.rows([(k, float(a), float(b)) for k, (a, b) in zip(classes, sums, strict=True)], "k string, s0 double, s1 double")


# --- models ----------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {LI} SELECT rf AS k, count(*) AS n, sum(q) AS s, sum(q*q) AS s2 FROM li GROUP BY rf")
def nb_aggregate(t):
    v = t.li.select("rf", ring.nb_lift([F.col("q")], [F.col("ls")]).alias("v"))
    return v.groupBy(F.col("rf").alias("k")).agg(F.sum("v.n").alias("n"), F.sum(F.col("v.lin")[0]).alias("s"), F.sum(F.col("v.sq")[0]).alias("s2"))


@query(f"WITH {LI} SELECT {K}, 2 AS n, q + p AS s, q*q + p*p AS s2 FROM li")
def nb_add(t):
    v = ring.nb_combine(ring.nb_lift([F.col("q")], []), ring.nb_lift([F.col("p")], []))
    return t.li.select(*KEYS, v.alias("v")).select(*KEYS, "v.n", F.col("v.lin")[0].alias("s"), F.col("v.sq")[0].alias("s2"))


@query("WITH a AS (SELECT count(*)::DOUBLE AS n, sum(r_regionkey)::DOUBLE AS s, sum(r_regionkey*r_regionkey)::DOUBLE AS s2 FROM region), b AS (SELECT count(*)::DOUBLE AS n FROM nation) SELECT (a.n * b.n)::BIGINT AS n, a.s * b.n AS s, a.s2 * b.n AS s2 FROM a, b")
def nb_mul(t):
    total = lambda df, c: df.agg(F.struct(F.count("*").alias("n"), F.array(F.sum(F.col(c).cast("double"))).alias("lin"), F.array(F.sum(F.col(c).cast("double") * F.col(c))).alias("sq"), F.array().cast("array<map<string,double>>").alias("cat")).alias(c), F.lit(1).alias("one"))
    both = total(t.region, "r_regionkey").join(total(t.nation, "n_nationkey"), "one")
    return both.select(ring.nb_mul(F.col("r_regionkey"), F.col("n_nationkey")).alias("v")).select("v.n", F.col("v.lin")[0].alias("s"), F.col("v.sq")[0].alias("s2"))


NB = "m AS (SELECT rf, count(*)::DOUBLE AS n, avg(q) AS mu, sum(q*q) / count(*) - (sum(q) / count(*)) * (sum(q) / count(*)) AS va FROM li GROUP BY rf), f AS (SELECT rf, ls, count(*)::DOUBLE AS c FROM li GROUP BY rf, ls)"


def _nb(t):
    return ml.naive_bayes(co.cofactor_by(t.li, "rf", ["q"], ["ls"]))


@query(f"WITH {LI}, {NB} SELECT rf AS k, round(n / (SELECT sum(n) FROM m), 9) AS prior, round(mu, 6) AS mean, round(va, 4) AS var FROM m")
def nb_train(t):
    m = _nb(t)
    return t.rows([(k, m.prior[i], float(m.mean[i][0]), float(m.var[i][0])) for i, k in enumerate(m.labels)], "k string, prior double, mean double, var double").select("k", F.round("prior", 9).alias("prior"), F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


@query(f"WITH {LI}, {NB}, s AS (SELECT {K}, q, li.ls, m.rf, n / (SELECT sum(n) FROM m) * exp(-(q - mu) * (q - mu) / (2 * (va + 1e-9))) / sqrt(2 * pi() * (va + 1e-9)) * coalesce(c / n, 0) AS v FROM li, m LEFT JOIN f ON f.rf = m.rf WHERE f.ls = li.ls), b AS (SELECT q, ls, arg_max(rf, v) AS y FROM (SELECT DISTINCT q, ls, rf, v FROM s) GROUP BY q, ls) SELECT y, count(*) AS n FROM li JOIN b ON li.q = b.q AND li.ls = b.ls GROUP BY y")
def nb_predict(t):
    return t.li.select(_nb(t).predict().alias("y")).groupBy("y").agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT round(regr_intercept(p, q), 3) AS a, round(regr_slope(p, q), 4) AS b FROM li")
def ridge_1feat(t):
    r = ml.ridge(co.cofactor(t.li, ["q", "p"]), "p")
    return t.one(a=float(r.theta[0]), b=float(r.theta[1])).select(F.round("a", 3).alias("a"), F.round("b", 4).alias("b"))


TWO = "c AS (SELECT covar_pop(q, q) AS a, covar_pop(q, d) AS b, covar_pop(d, d) AS c, covar_pop(q, p) AS u, covar_pop(d, p) AS v, avg(q) AS mq, avg(d) AS md, avg(p) AS mp FROM li), w AS (SELECT (u * c - v * b) / (a * c - b * b) AS bq, (a * v - b * u) / (a * c - b * b) AS bd, mq, md, mp FROM c)"


@query(f"WITH {LI}, {TWO} SELECT round(mp - bq * mq - bd * md, 3) AS a, round(bq, 4) AS bq, round(bd, 4) AS bd FROM w")
def ridge_2feat(t):
    r = ml.ridge(co.cofactor(t.li, ["q", "d", "p"]), "p")
    return t.one(a=float(r.theta[0]), bq=float(r.theta[1]), bd=float(r.theta[2])).select(F.round("a", 3).alias("a"), F.round("bq", 4).alias("bq"), F.round("bd", 4).alias("bd"))


@query(f"WITH {LI} SELECT round((var_pop(p) * (1 - regr_r2(p, q))) / 1000, 3) AS v FROM li")
def ridge_variance(t):
    return t.one(v=ml.ridge(co.cofactor(t.li, ["q", "p"]), "p").variance).select(F.round(F.col("v") / 1000, 3).alias("v"))


@query(f"WITH {LI} SELECT round(regr_intercept(p, q), 3) AS a, round(regr_slope(p, q), 4) AS b FROM li")
def ridge_from_params(t):
    r = t.li.agg(*co.sum_expressions(["q", "p"])).first()
    m = ml.ridge_from_params([r["n"], r["s_0"], r["s_1"], r["q_0_0"], r["q_0_1"], r["q_1_1"]], ["q", "p"], "p")
    return t.one(a=float(m.theta[0]), b=float(m.theta[1])).select(F.round("a", 3).alias("a"), F.round("b", 4).alias("b"))


@query(f"WITH {LI} SELECT {K}, round((SELECT regr_intercept(p, q) FROM li) + (SELECT regr_slope(p, q) FROM li) * q, 3) AS y FROM li")
def ridge_predict(t):
    return t.li.select(*KEYS, F.round(ml.ridge(co.cofactor(t.li, ["q", "p"]), "p").predict(), 3).alias("y"))


@query(f"WITH {LI} SELECT {K}, round(avg(p) OVER (PARTITION BY rf), 3) AS y FROM li")
def ridge_predict_cat(t):
    return t.li.select(*KEYS, F.round(ml.ridge(co.cofactor(t.li, ["p"], ["rf"]), "p").predict(), 3).alias("y"))


LDA = "k AS (SELECT rf, count(*)::DOUBLE AS n, sum(p) AS s FROM li GROUP BY rf), g AS (SELECT sum(n) AS n, ((SELECT sum(p*p) FROM li) - sum(s * s / n)) / sum(n) AS v FROM k)"


def _lda(t):
    return ml.lda(co.cofactor(t.li, ["p"], ["rf"]), "rf")


@query(f"WITH {LI}, {LDA} SELECT rf AS k, round((s / k.n) / v * 1e6, 4) AS w, round(-0.5 * (s / k.n) * (s / k.n) / v + ln(k.n / g.n), 6) AS b FROM k, g")
def lda_1feat_train(t):
    m = _lda(t)
    return t.rows([(k, float(w[1]), float(w[0])) for k, w in zip(m.labels, m.weights, strict=True)], "k string, w double, b double").select("k", F.round(F.col("w") * 1e6, 4).alias("w"), F.round("b", 6).alias("b"))


BEST = "best AS (SELECT p, arg_max(i, z) AS i, arg_max(rf, z) AS y FROM s GROUP BY p)"
LDA_Z = "s AS (SELECT x.p, k.rf, row_number() OVER (PARTITION BY x.p ORDER BY k.rf) - 1 AS i, x.p * (s / k.n) / v - 0.5 * (s / k.n) * (s / k.n) / v + ln(k.n / g.n) AS z FROM (SELECT DISTINCT p FROM li) x, k, g)"


@query(f"WITH {LI}, {LDA}, {LDA_Z}, {BEST} SELECT p, y, count(*) AS n FROM li JOIN best USING (p) GROUP BY p, y")
def lda_predict(t):
    return t.li.select("p", _lda(t).predict().alias("y")).groupBy("p", "y").agg(F.count("*").alias("n"))


@query(f"WITH {LI}, {LDA}, {LDA_Z}, {BEST} SELECT i::INTEGER AS i, count(*) AS n FROM li JOIN best USING (p) GROUP BY i")
def lda_predict_index(t):
    return t.li.select(_lda(t).predict_index().alias("i")).groupBy("i").agg(F.count("*").alias("n"))


LDA_C = "k AS (SELECT rf, count(*)::DOUBLE AS n, sum(p) AS s FROM li GROUP BY rf), g AS (SELECT sum(n) AS n, ((SELECT sum(p*p) FROM li) - sum(s * s / n)) / sum(n) AS v FROM k)"


@query(f"WITH {LI}, {LDA_C}, {LDA_Z}, {BEST} SELECT i::INTEGER AS i, count(*) AS n FROM li JOIN best USING (p) GROUP BY i")
def lda_predict_at(t):
    """The same from values and positions; a second, constant category of weight zero stands at position 2."""
    m = ml.lda(co.cofactor(t.li.withColumn("one", F.lit("x")), ["p"], ["rf", "one"]), "rf")
    return t.li.select(m.predict_at([F.col("p")], [F.lit(2)]).alias("i")).groupBy("i").agg(F.count("*").alias("n"))


QDA = "k AS (SELECT rf, count(*)::DOUBLE AS n, avg(p) AS mu, sum(p*p) / count(*) - avg(p) * avg(p) AS v FROM li GROUP BY rf), g AS (SELECT sum(n) AS n FROM k)"


def _qda(t):
    return ml.qda(co.cofactor_by(t.li, "rf", ["p"]))


@query(f"WITH {LI}, {QDA} SELECT rf AS k, round(-0.5 / v * 1e10, 3) AS a, round(mu / v * 1e6, 3) AS b, round(-0.5 * mu * mu / v - 0.5 * ln(v) + ln(k.n / g.n), 6) AS c FROM k, g")
def qda_1feat_train(t):
    m = _qda(t)
    return t.rows([(k, float(m.matrices[i][1, 1]), float(m.weights[i][1]), float(m.weights[i][0])) for i, k in enumerate(m.labels)], "k string, a double, b double, c double").select("k", F.round(F.col("a") * 1e10, 3).alias("a"), F.round(F.col("b") * 1e6, 3).alias("b"), F.round("c", 6).alias("c"))


@query(f"WITH {LI}, {QDA}, s AS (SELECT x.p, k.rf, 0 AS i, -0.5 * (x.p - mu) * (x.p - mu) / v - 0.5 * ln(v) + ln(k.n / g.n) AS z FROM (SELECT DISTINCT p FROM li) x, k, g), {BEST} SELECT p, y, count(*) AS n FROM li JOIN best USING (p) GROUP BY p, y")
def qda_predict(t):
    return t.li.select("p", _qda(t).predict().alias("y")).groupBy("p", "y").agg(F.count("*").alias("n"))


# --- imputation ------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {NL}, m AS (SELECT rf FROM nl WHERE rf IS NOT NULL GROUP BY rf ORDER BY count(*) DESC, rf LIMIT 1) SELECT {K}, round(coalesce(q, (SELECT avg(q) FROM nl)), 6) AS q, coalesce(rf, (SELECT rf FROM m)) AS rf FROM nl")
def fill_mean_mode(t):
    return im.prepare(t.nl, ["q"], ["rf"]).select(*KEYS, F.round("q", 6).alias("q"), "rf")


@query(f"WITH {NL} SELECT round(avg(q), 6) AS q, round(avg(p), 4) AS p, round(avg(d), 6) AS d FROM nl")
def standard_imputation(t):
    v = im.fill_values(t.nl, ["q", "p", "d"], [])
    return t.one(q=v["q"], p=v["p"], d=v["d"]).select(F.round("q", 6).alias("q"), F.round("p", 4).alias("p"), F.round("d", 6).alias("d"))


ALL4 = ["q", "p", "d", "rf"]
CNT = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in ALL4)


@query(f"WITH {NL} SELECT {K}, {CNT} AS null_cnt, CASE WHEN q IS NULL THEN 1 WHEN p IS NULL THEN 2 WHEN d IS NULL THEN 3 WHEN rf IS NULL THEN 4 ELSE 0 END AS null_col_id FROM nl")
def null_counts(t):
    return t.nl.select(*KEYS, im.null_count(ALL4).alias("null_cnt"), im.null_column_id(ALL4).alias("null_col_id"))


@query(f"WITH {NL} SELECT {CNT} AS null_cnt, count(*) AS n FROM nl GROUP BY 1")
def null_pattern_histogram(t):
    return t.nl.groupBy(im.null_count(ALL4).alias("null_cnt")).agg(F.count("*").alias("n"))


@query(f"WITH {NL} SELECT CASE WHEN c = 0 THEN '0' WHEN c = 4 THEN 'all' WHEN c > 1 THEN 'some' WHEN q IS NULL THEN 'one:q' WHEN p IS NULL THEN 'one:p' WHEN d IS NULL THEN 'one:d' ELSE 'one:rf' END AS bucket, count(*) AS n FROM (SELECT *, {CNT} AS c FROM nl) GROUP BY 1")
def partition_k(t):
    return t.nl.groupBy(im.null_bucket(ALL4).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {NL} SELECT CASE WHEN c = 4 THEN '0' WHEN c = 0 THEN 'all' WHEN c < 3 THEN 'some' WHEN q IS NOT NULL THEN 'one:q' WHEN p IS NOT NULL THEN 'one:p' WHEN d IS NOT NULL THEN 'one:d' ELSE 'one:rf' END AS bucket, count(*) AS n FROM (SELECT *, {CNT} AS c FROM nl) GROUP BY 1")
def reverse_partition_k(t):
    return t.nl.groupBy(im.null_bucket(ALL4, reverse=True).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {NL} SELECT CASE WHEN q IS NULL AND d IS NULL THEN 'all' WHEN q IS NULL THEN 'one:q' WHEN d IS NULL THEN 'one:d' ELSE '0' END AS bucket, count(*) AS n FROM nl GROUP BY 1")
def partition_reduced(t):
    return t.nl.groupBy(im.null_bucket(["q", "d"]).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {NL} SELECT DISTINCT rf FROM nl WHERE rf IS NOT NULL")
def distinct_categories(t):
    return t.nl.select("rf").where("rf IS NOT NULL").distinct()


ONE = "SELECT {k}, round(coalesce(q, (SELECT regr_intercept(q, t) FROM nl) + (SELECT regr_slope(q, t) FROM nl) * t), 4) AS q FROM nl"


def _mice(t, strategy, **more):
    out = im.mice(t.nl.select(*KEYS, "q", "t"), ["q", "t"], [], ["q"], [], strategy, **more)
    return out.select(*KEYS, F.round("q", 4).alias("q"))


@query(f"WITH {NL} " + ONE.format(k=K))
def mice_baseline_1it(t):
    return _mice(t, "baseline")


@query(f"WITH {NL} " + ONE.format(k=K))
def mice_delta_1it(t):
    return _mice(t, "delta")


@query(f"WITH {NL} " + ONE.format(k=K))
def mice_reverse_1it(t):
    return _mice(t, "reverse")


FJ = f"fj AS (SELECT {K}, q, CAST(floor(o_totalprice / 100) AS DOUBLE) AS tp, CAST(floor(c_acctbal) AS DOUBLE) AS ab FROM nl JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
ON_TP = "SELECT {k}, round(coalesce(q, (SELECT regr_intercept(q, tp) FROM fj) + (SELECT regr_slope(q, tp) FROM fj) * tp), 3) AS q FROM fj"


def _orders(t):
    return t.orders.selectExpr("o_orderkey AS l_orderkey", "o_custkey AS ck", "CAST(floor(o_totalprice / 100) AS DOUBLE) AS tp")


@query(f"WITH {NL}, {FJ} " + ON_TP.format(k=K))
def mice_factorized_1it(t):
    """Statistics are computed without the join's rows; only rows to be imputed look the dimension up."""
    out = im.mice(t.nl.select(*KEYS, "q"), ["q", "tp"], [], ["q"], [], "factorized", steps=[fz.Step(_orders(t), ["l_orderkey"], ["tp"])])
    return out.select(*KEYS, F.round("q", 3).alias("q"))


@query(f"WITH {NL}, {FJ} " + ON_TP.format(k=K))
def mice_joined(t):
    """Join first, then impute the wide table."""
    out = im.mice(t.nl.select(*KEYS, "q").join(_orders(t).drop("ck"), "l_orderkey"), ["q", "tp"], [], ["q"], [], "baseline")
    return out.select(*KEYS, F.round("q", 3).alias("q"))


def _plane(y: str, a: str, b: str, rows: str, out: str) -> str:
    """SQL of the least squares plane of y over a and b: columns {out}0, {out}1, {out}2."""
    c = f"c{out} AS (SELECT covar_pop({a}, {a}) AS aa, covar_pop({a}, {b}) AS ab, covar_pop({b}, {b}) AS bb, covar_pop({a}, {y}) AS ay, covar_pop({b}, {y}) AS bY, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my FROM {rows})"
    c = c.replace("AS bY", "AS yb")
    return f"{c}, {out} AS (SELECT my - {out}1 * ma - {out}2 * mb AS {out}0, {out}1, {out}2 FROM (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS {out}1, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS {out}2 FROM c{out}))"


@query(f"WITH {NL}, {FJ}, {_plane('q', 'tp', 'ab', '(SELECT * FROM fj WHERE q IS NOT NULL)', 'm')} SELECT {K}, round(coalesce(q, m0 + m1 * tp + m2 * ab), 3) AS q FROM fj, m")
def mice_factorized_flight(t):
    """A chain of tables: the fact's missing values from features one and two joins away."""
    cust = t.customer.selectExpr("c_custkey AS ck", "CAST(floor(c_acctbal) AS DOUBLE) AS ab")
    steps = [fz.Step(_orders(t), ["l_orderkey"], ["tp"], [], ["ck"], True), fz.Step(cust, ["ck"], ["ab"])]
    out = im.mice(t.nl.select(*KEYS, "q"), ["q", "tp", "ab"], [], ["q"], [], "factorized", steps=steps)
    return out.select(*KEYS, F.round("q", 3).alias("q"))


SN = f"sn AS (SELECT {K}, CASE WHEN {NULLS['q']} THEN NULL ELSE l_quantity END AS q, CAST(floor(p_retailprice) AS DOUBLE) AS rp, wx FROM lineitem JOIN part ON l_partkey = p_partkey JOIN w ON l_suppkey = w.sk AND l_linenumber = w.ln)"


@query(f"WITH {STAR}, {SN}, {_plane('q', 'rp', 'wx', '(SELECT * FROM sn WHERE q IS NOT NULL)', 'm')} SELECT {K}, round(coalesce(q, m0 + m1 * rp + m2 * wx), 3) AS q FROM sn, m")
def mice_factorized_retailer(t):
    """A star with a composite key, one missing column."""
    part, weather = (s.dim.withColumnsRenamed({"pk": "l_partkey", "sk": "l_suppkey", "ln": "l_linenumber"}) for s in _star(t, False)[1][:2])
    steps = [fz.Step(part, ["l_partkey"], ["rp"], [], ["l_suppkey", "l_linenumber"], True), fz.Step(weather, ["l_suppkey", "l_linenumber"], ["wx"])]
    out = im.mice(t.nl.select(*KEYS, "q"), ["q", "rp", "wx"], [], ["q"], [], "factorized", steps=steps)
    return out.select(*KEYS, F.round("q", 3).alias("q"))


TWO_NULL = f"f AS (SELECT {K}, t, q IS NULL AS nq, d IS NULL AS nd, coalesce(q, avg(q) OVER ()) AS q, coalesce(d, avg(d) OVER ()) AS d FROM nl), {_plane('q', 't', 'd', '(SELECT * FROM f WHERE NOT nq)', 'u')}, f1 AS (SELECT {K}, t, nq, nd, d, CASE WHEN nq AND NOT nd THEN u0 + u1 * t + u2 * d ELSE q END AS q, u0 + u1 * t + u2 * d AS guess FROM f, u), {_plane('d', 't', 'q', '(SELECT * FROM f1 WHERE NOT nd)', 'v')}"


def _two(strategy: str):
    @query(f"WITH {NL}, {TWO_NULL}, f2 AS (SELECT {K}, t, nd, d, CASE WHEN nq AND nd THEN guess ELSE q END AS q FROM f1) SELECT {K}, round(q, 4) AS q, round(CASE WHEN nd THEN v0 + v1 * t + v2 * q ELSE d END, 4) AS d FROM f2, v")
    def two(t):
        out = im.mice(t.nl.select(*KEYS, "q", "d", "t"), ["q", "d", "t"], [], ["q", "d"], [], strategy)
        return out.select(*KEYS, F.round("q", 4).alias("q"), F.round("d", 4).alias("d"))


for _s in ("baseline", "delta", "reverse"):
    _two(_s)
    _queries[f"mice_two_null_{_s}"], _sql[f"mice_two_null_{_s}"] = _queries.pop("two"), _sql.pop("two")


@query(f"WITH {NL} " + ONE.format(k=K))
def comparator_ml_mice(t):
    return ml_mice(t.nl.select(*KEYS, "q", "t"), ["q", "t"], [], ["q"], []).select(*KEYS, F.round("q", 4).alias("q"))


@query(f"WITH {NL} SELECT CASE WHEN c = 0 THEN '0' WHEN c = 4 THEN 'all' WHEN c > 1 THEN 'some' WHEN q IS NULL THEN 'one:q' WHEN p IS NULL THEN 'one:p' WHEN d IS NULL THEN 'one:d' ELSE 'one:rf' END AS bucket, count(*) AS n, sum(t) AS s FROM (SELECT *, {CNT} AS c FROM nl) GROUP BY 1 HAVING bucket <> 'some'")
def partition_union_drop(t):
    """A table written in parts by null pattern, one part dropped, the others put together by UNION ALL."""
    parts = Parts(t.nl.withColumn("bucket", im.null_bucket(ALL4)), "bucket")
    parts.drop("some")
    out = None
    for name in parts.part:
        part = parts.read(name).withColumn("bucket", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("s"))


CL = "k AS (SELECT rf, count(*)::DOUBLE AS n, sum(t) AS s FROM nl WHERE rf IS NOT NULL GROUP BY rf), g AS (SELECT sum(n) AS n, ((SELECT sum(t*t) FROM nl WHERE rf IS NOT NULL) - sum(s * s / n)) / sum(n) AS v FROM k), best AS (SELECT t, arg_max(rf, z) AS y FROM (SELECT DISTINCT nl.t, k.rf, nl.t * (s / k.n) / v - 0.5 * (s / k.n) * (s / k.n) / v + ln(k.n / g.n) AS z FROM nl, k, g) GROUP BY t)"


@query(f"WITH {NL}, {CL} SELECT {K}, coalesce(rf, y) AS rf FROM nl JOIN best ON nl.t = best.t")
def mice_classifier(t):
    return im.mice(t.nl.select(*KEYS, "rf", "t"), ["t"], ["rf"], [], ["rf"], "delta").select(*KEYS, "rf")


@query(f"WITH {NL}, {CL} SELECT {K}, coalesce(rf, y) AS rf FROM nl JOIN best ON nl.t = best.t")
def mice_classifier_5it(t):
    """Five rounds at shrinkage 0.4 (which leaves a single feature's variance as it is)."""
    return im.mice(t.nl.select(*KEYS, "rf", "t"), ["t"], ["rf"], [], ["rf"], "delta", iterations=5, shrinkage=0.4).select(*KEYS, "rf")


@query()
def mice_cols_4(t):
    """Column scalability: one, two (``mice_two_null_*``), four missing columns."""
    return im.mice(t.nl, ["q", "p", "d", "t"], ["rf", "ls"], ["q", "p", "d"], ["rf"], "delta", iterations=2).select(*KEYS, "q", "p", "d", "rf")


@query()
def mice_allnull_bucket(t):
    """Four null columns of both kinds, rows with all missing imputed last; the strategies are compared in the tests."""
    return im.mice(t.nl, ["q", "p", "d", "t"], ["rf", "ls"], ["q", "p", "d"], ["rf"], "delta").select(*KEYS, "q", "p", "d", "rf")


@query()
def mice_noise_2it(t):
    return im.mice(t.nl.drop("rf"), ["q", "p", "d", "t"], ["ls"], ["q", "p", "d"], [], "reverse", iterations=2, noise_keys=KEYS, seed=11).select(*KEYS, "q", "p", "d")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE CAST(floor(c_acctbal) AS DOUBLE) END AS ab FROM customer),
j AS (SELECT c_custkey, ab, CAST(floor(o_totalprice / 100) AS DOUBLE) AS tp FROM orders JOIN c ON o_custkey = c_custkey),
w AS (SELECT regr_intercept(ab, tp) AS a, regr_slope(ab, tp) AS b FROM j),
side AS (SELECT c_custkey, avg(a + b * tp) AS y FROM j, w WHERE ab IS NULL GROUP BY c_custkey)
SELECT c.c_custkey, round(coalesce(ab, y), 3) AS ab FROM c LEFT JOIN side ON c.c_custkey = side.c_custkey""")
def dim_sidetable_impute(t):
    dim = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE CAST(floor(c_acctbal) AS DOUBLE) END AS ab")
    fact = t.orders.selectExpr("o_custkey AS c_custkey", "CAST(floor(o_totalprice / 100) AS DOUBLE) AS tp")
    model = ml.ridge(fz.factorized_cofactor(fz.JoinTree(fact, ["tp"], [], ["c_custkey"], [fz.Step(dim, ["c_custkey"], ["ab"])])), "ab")
    return im.impute_dimension(fact, dim, "c_custkey", "ab", model.predict()).select("c_custkey", F.round("ab", 3).alias("ab"))


# --- features, masks, measures, stream ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, " + ", ".join(f"round({f}(2 * pi() * {v} / {p}), 9) AS {k}_{f}" for k, v, p in (("month", "month(o_orderdate)", 12), ("day", "day(o_orderdate)", 31), ("weekday", "(isodow(o_orderdate) - 1)", 7)) for f in ("sin", "cos")) + " FROM orders")
def cyclic_features(t):
    out = ft.date_features(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")
    return out.select("o_orderkey", *(F.round(f"{k}_{f}", 9).alias(f"{k}_{f}") for k in ("month", "day", "weekday") for f in ("sin", "cos")))


@query("SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS z FROM part")
def standard_scale(t):
    return ft.standard_scale(t.part.select("p_partkey", F.col("p_size").cast("double").alias("z")), ["z"]).select("p_partkey", F.round("z", 6).alias("z"))


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS code FROM part")
def label_encode(t):
    return ft.label_encode(t.part.select("p_partkey", "p_brand"), "p_brand", "code").select("p_partkey", "code")


@query("SELECT p_partkey, round(cos(ln(abs(ln(abs(p_retailprice) + .01)) + .01)) + ln(abs(ln(abs(p_retailprice) + .01)) + .01), 9) AS f FROM part")
def price_feature(t):
    return t.part.select("p_partkey", F.round(ft.price_feature(F.col("p_retailprice")), 9).alias("f"))


U = "(('0x' || substr(md5(p_partkey::VARCHAR || ':{s}'), 1, 8))::BIGINT / 4294967296.0)"


def _keys(s):
    return [F.col("p_partkey"), F.lit(s)]


@query(f"SELECT p_partkey, CASE WHEN {U.format(s='a')} >= 0.3 THEN p_size END AS v FROM part")
def mcar_mask(t):
    return t.part.select("p_partkey", ft.mcar("p_size", _keys("a"), 0.3).alias("v"))


RANK = "((rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) * 1.0 - 1 - (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / (count(*) OVER () + 1))"


@query(f"SELECT p_partkey, CASE WHEN {U.format(s='b')} >= 0.4 * {RANK.format(c='p_retailprice')} THEN p_size END AS v FROM part")
def mar_mask(t):
    return ft.mask_by_rank(t.part, "p_size", "p_retailprice", _keys("b"), 0.2).select("p_partkey", F.col("p_size").alias("v"))


@query(f"SELECT p_partkey, CASE WHEN {U.format(s='c')} >= 0.4 * {RANK.format(c='p_size')} THEN p_size END AS v FROM part")
def mnar_mask(t):
    return ft.mask_by_rank(t.part, "p_size", "p_size", _keys("c"), 0.2).select("p_partkey", F.col("p_size").alias("v"))


@query("SELECT o_orderkey, ((o_orderkey * 37) % 2400 // 100)::BIGINT AS dep_hour, ((o_orderkey * 37) % 2400 % 100)::BIGINT AS dep_min, CASE WHEN (o_orderkey * 91) % 2400 < (o_orderkey * 37) % 2400 THEN 1 ELSE 0 END AS overnight FROM orders")
def hour_minute_overnight(t):
    rows = ft.hour_minute(t.orders.selectExpr("o_orderkey", "(o_orderkey * 37) % 2400 AS dep", "(o_orderkey * 91) % 2400 AS arr"), "dep")
    return rows.select("o_orderkey", F.col("dep_hour").cast("long").alias("dep_hour"), F.col("dep_min").cast("long").alias("dep_min"), ft.overnight(F.col("dep"), F.col("arr")).alias("overnight"))


@query(f"WITH {LI}, w AS (SELECT regr_intercept(p, q) AS a, regr_slope(p, q) AS b FROM li) SELECT round(1 - sum((p - a - b * q) * (p - a - b * q)) / (var_pop(p) * count(p)), 6) AS r2 FROM li, w")
def downstream_r2(t):
    """R2 of a regressor trained on the table's statistics."""
    guess = ml.ridge(co.cofactor(t.li, ["q", "p"]), "p").predict()
    return t.li.select("p", guess.alias("y")).agg(F.round(ft.r_squared(F.col("p"), F.col("y")), 6).alias("r2"))


@query("SELECT round(avg(p_size) - 1.961 * stddev_samp(p_size) / sqrt(count(p_size)), 6) AS low, round(avg(p_size) + 1.961 * stddev_samp(p_size) / sqrt(count(p_size)), 6) AS high FROM part")
def mean_interval(t):
    low, high = ft.mean_interval(F.col("p_size"), 1.961)
    return t.part.agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"WITH {NL} SELECT round(sqrt(avg((li.q - m) * (li.q - m))), 6) AS rmse FROM li JOIN (SELECT avg(q) AS m FROM nl) ON true WHERE {NULLS['q']}")
def rmse_masked(t):
    mean = im.fill_values(t.nl, ["q"], [])["q"]
    return t.li.where(NULLS["q"]).agg(F.round(ft.rmse(F.col("q"), F.lit(mean)), 6).alias("rmse"))


@query("SELECT event_type, count(*) AS n, sum(floor(value * 100)) AS s_0, sum(floor(value * 100) * floor(value * 100)) AS q_0_0 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def stream_cofactor_events(t):
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*").selectExpr("event_type", "CAST(floor(value * 100) AS DOUBLE) AS v")
    name = "stream_cofactor_events"
    into_memory(running_sums(stream, ["event_type"], ["v"]), name).awaitTermination()
    return t.spark.table(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

