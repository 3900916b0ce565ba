"""Ring values, models and imputation against goldens, laws and dense NumPy."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumring.functions import ring
from sumring.operators import cofactor as co
from sumring.operators import factorized as fz
from sumring.operators import impute as im
from sumring.operators import models as ml
from sumring.sources import tables

ROWS = [(1, 1.0, 2.0, 3.0, 4, 5, 6), (1, 5.0, 6.0, 7.0, 8, 9, 10), (2, 2.0, 1.0, 3.0, 4, 6, 8), (2, 5.0, 7.0, 6.0, 8, 10, 12), (2, 2.0, 1.0, 3.0, 4, 6, 8)]
SCHEMA = "gb int, a double, b double, c double, d int, e int, f int"


@pytest.fixture(scope="module")
def fixture(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def same(x, y):
    assert (x.cont, x.cat, x.n) == (y.cont, y.cat, y.n)
    np.testing.assert_allclose(x.lin, y.lin, atol=1e-9)
    np.testing.assert_allclose(x.quad, y.quad, atol=1e-9)
    for a, b in ((x.lin_cat, y.lin_cat), (x.num_cat, y.num_cat), (x.cat_cat, y.cat_cat)):
        for k in a:
            assert {i: v for i, v in a[k].items() if v} == pytest.approx({i: v for i, v in b[k].items() if v})


@pytest.mark.parametrize("strategy", ["native", "gram"])
def test_sum_golden(fixture, strategy):
    v = co.cofactor(fixture, ["a", "b", "c"], ["d", "e", "f"], strategy)
    assert v.n == 5 and v.lin.tolist() == [15, 17, 22] and v.quad[np.triu_indices(3)].tolist() == [59, 71, 80, 91, 96, 112]
    assert v.lin_cat == {"d": {4: 3, 8: 2}, "e": {5: 1, 6: 2, 9: 1, 10: 1}, "f": {6: 1, 8: 2, 10: 1, 12: 1}}
    two = co.cofactor(fixture.where("gb = 2"), ["a", "b", "c"], ["d", "e", "f"], strategy)
    assert two.lin.tolist() == [9, 9, 12] and two.num_cat["a", "d"] == {4: 4, 8: 5} and two.num_cat["c", "d"] == {4: 6, 8: 6}


def test_product_golden_and_laws(fixture):
    x = co.cofactor(fixture.where("gb = 1"), ["b", "c"], ["d", "e"])
    y = co.cofactor(fixture.where("gb = 2").selectExpr("a", "c AS c2", "d AS d2", "f"), ["a", "c2"], ["d2", "f"])
    p = x * y
    assert p.n == 6 and p.lin.tolist() == [24, 30, 18, 24]
    assert p.quad[np.triu_indices(4)].tolist() == [120, 144, 72, 96, 174, 90, 120, 66, 84, 108]
    assert p.num_cat["b", "d"] == {4: 6, 8: 18} and p.cat_cat["d", "d2"] == {(4, 4): 2, (4, 8): 1, (8, 4): 2, (8, 8): 1}
    same(p + p - p, p)
    same((x + x) * y, p + p)
    same(x - x + x, x)
    same(tables.cofactor_from_text(tables.cofactor_to_text(p)), p)


def test_lift_values(fixture):
    v = fixture.limit(1).select(ring.lift([F.col("a"), F.col("b"), F.col("c")], [F.col("d"), F.col("e")]).alias("v")).first()["v"]
    assert v["n"] == 1 and v["lin"] == [1, 2, 3] and v["quad"] == [1, 2, 3, 4, 6, 9] and v["lin_cat"] == [{"4": 1}, {"5": 1}] and v["cat_cat"] == [{"4|5": 1}]
    both = fixture.select(ring.mul(ring.lift([F.col("a")], [F.col("d")]), ring.lift([F.col("b")], [F.col("e")]), (1, 1), (1, 1)).alias("x"), ring.lift([F.col("a"), F.col("b")], [F.col("d"), F.col("e")]).alias("y"))
    assert all(r["x"] == r["y"] for r in both.collect())
    zero = fixture.select(ring.sub(ring.lift([F.col("a")], [F.col("d")]), ring.lift([F.col("a")], [F.col("d")])).alias("z")).first()["z"]
    assert zero["n"] == 0 and zero["lin"] == [0] and zero["lin_cat"] == [{"4": 0}]


def test_empty_and_null_rows(spark, fixture):
    assert co.cofactor(fixture.where("false"), ["a"], ["d"]).n == 0
    nulls = spark.createDataFrame([(1.0, 1), (None, 1), (2.0, None)], "a double, d int")
    assert co.cofactor(nulls, ["a"], ["d"]).lin.tolist() == [1.0]


def test_lda_golden(fixture, spark):
    rows = spark.createDataFrame([(1, 5.0, 7.0, 6.0, 8, 10, 12) if i == 3 else r for i, r in enumerate(ROWS)], SCHEMA)
    m = ml.lda(co.cofactor(rows, ["a", "b", "c"], ["d", "e", "f"]), "d", 0.4)
    assert [r[0] for r in rows.select(m.predict()).collect()] == [4, 8, 4, 8, 4]


def test_ridge(spark):
    df = spark.createDataFrame([(2.0, 35.0, 1.0, 4.0), (4.0, 12.0, 2.0, 9.0), (3.0, 1.0, 43.0, 0.0), (4.0, 3.0, 6.0, 9.0)], "A double, B double, C double, D double")
    v = co.cofactor(df, ["A", "B", "C", "D"])
    np.testing.assert_allclose(ml.ridge(v, "A").theta, [-2.78929, 0.05923, 0.13326, 0.64579], atol=1e-4)
    np.testing.assert_allclose(ml.ridge(v, "A", solver="gd").theta, [-2.78929, 0.05923, 0.13326, 0.64579], atol=5e-3)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    k = rng.integers(0, 3, 300)
    y = 2 + x @ [1.0, -3.0] + np.array([0.0, 5.0, -1.0])[k] + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, k, y, strict=True)], "a double, b double, k int, y double")
    m = ml.ridge(co.cofactor(df, ["a", "b", "y"], ["k"]), "y")
    dense = np.column_stack([np.ones(300), x, np.eye(3)[k]])
    want = dense @ np.linalg.lstsq(dense, y, rcond=None)[0]
    np.testing.assert_allclose([r[0] for r in df.select(m.predict()).collect()], want, atol=1e-6)
    assert m.variance == pytest.approx(np.mean((y - want) ** 2), rel=1e-6)


def test_qda_and_naive_bayes_separate(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal(4 * k)), float(rng.normal(-k, 2)), int((k + (rng.random() < 0.2)) % 2), k) for k in (0, 1) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, z double, c int, y int")
    values = co.cofactor_by(df, "y", ["x", "z"], ["c"])
    for m in (ml.qda(values), ml.naive_bayes(values)):
        assert np.mean([a == b for a, b in df.select("y", m.predict()).collect()]) > 0.95


def test_factorized_equals_joined(spark):
    rng = np.random.default_rng(2)
    fact = spark.createDataFrame([(int(rng.integers(20)), float(rng.integers(9)), "uv"[rng.integers(2)]) for _ in range(300)], "k int, x double, f string")
    dim = spark.createDataFrame([(i, i % 4, float(i * i % 7), "pqr"[i % 3]) for i in range(20)], "k int, r int, d double, g string")
    top = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "r int, t double")
    for regroup in (True, False):
        tree = fz.JoinTree(fact, ["x"], ["f"], ["k"], [fz.Step(dim, ["k"], ["d"], ["g"], ["r"], regroup), fz.Step(top, ["r"], ["t"])])
        same(fz.factorized_cofactor(tree), co.cofactor(tree.joined(), ["x", "d", "t"], ["f", "g"]))


def test_strategies_agree_and_delta_invariant(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, k = rng.normal(), int(rng.integers(3))
        b = 2 * a + k + rng.normal() * 0.1
        c = "xyz"[k]
        rows.append((i, *(None if rng.random() < 0.25 else v for v in (float(a), float(b), c)), float(rng.normal() + a)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, t double")
    seen = []
    run = lambda s, **m: {r["id"]: (r["a"], r["b"], r["c"]) for r in im.mice(df, ["a", "b", "t"], ["c"], ["a", "b"], ["c"], s, **m).collect()}
    base = run("baseline", iterations=2)

    def invariant(col, value, current):
        same(value, co.cofactor(current.where(f"NOT {im.flag(col)} AND null_cnt < 3"), ["a", "b", "t"], ["c"]))
        seen.append(col)

    for got in (run("delta", iterations=2, on_train=invariant), run("reverse", iterations=2)):
        assert all(got[i][2] == base[i][2] and got[i][:2] == pytest.approx(base[i][:2], abs=1e-6) for i in base)
    assert seen == ["c", "a", "b"] * 2 and None not in [x for v in base.values() for x in v]
    assert all(base[r[0]][j] == r[1 + j] for r in rows for j in range(3) if r[1 + j] is not None)
    noisy = [run("baseline", noise_keys=["id"], seed=5) for _ in range(2)]
    assert noisy[0] == noisy[1] != run("baseline")


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2.5\n,\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "x.csv"), "a int, b double").collect()] == [(1, 2.5), (None, None)]
    (tmp_path / "x.tbl").write_text("1|q\n")
    assert tuple(tables.read_pipe(spark, str(tmp_path / "x.tbl"), "a int, b string").first()) == (1, "q")
    df = spark.createDataFrame([(1, None), (None, None), (3, 4)], "a int, b int")
    tables.write_partitioned(df, str(tmp_path / "p"), im.null_bucket(["a", "b"]))
    assert sorted(r["null_bucket"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == ["0", "all", "one:b"]


def _with_nulls(n=300, seed=4):
    """Rows of three features and a category with nulls in all patterns, all-null rows included."""
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 9, n).astype(float)
    a, c = 2 * t + rng.normal(size=n), np.where(t + rng.normal(size=n) > 4, "x", "y")
    b = a - t + rng.normal(size=n)
    gone = rng.random((n, 3)) < 0.25
    gone[:5] = True
    blank = lambda v, g: [None if x else (y.item() if hasattr(y, "item") else str(y)) for x, y in zip(g, v, strict=True)]
    return list(zip(range(n), blank(a, gone[:, 0]), blank(b, gone[:, 1]), t.tolist(), blank(c, gone[:, 2]), strict=True))


def _numpy_mice(rows, rounds):
    """Chained equations with dense matrices: c by linear discriminants, then a and b by least squares; all-null rows last."""
    get = lambda i: [r[i] for r in rows]
    t, miss = np.array(get(3)), np.array([[r[1] is None, r[2] is None, r[4] is None] for r in rows])
    a, b = (np.array([np.nan if x is None else x for x in get(i)]) for i in (1, 2))
    a, b = (np.where(np.isnan(v), np.nanmean(v), v) for v in (a, b))
    names = sorted({x for x in get(4) if x})
    top = max(names, key=lambda k: (get(4).count(k), -names.index(k)))
    c = np.array([names.index(x or top) for x in get(4)])
    every, hot = miss.all(1), lambda c: np.eye(len(names))[c]
    for _ in range(rounds):
        x, use = np.column_stack([a, b, t]), ~miss[:, 2] & ~every
        mean = np.array([x[use & (c == k)].mean(0) for k in range(len(names))])
        share = np.array([(use & (c == k)).sum() for k in range(len(names))]) / use.sum()
        inverse = np.linalg.pinv((x[use] - mean[c[use]]).T @ (x[use] - mean[c[use]]) / use.sum())
        label = lambda x, m=mean, s=share, v=inverse: np.argmax(x @ v @ m.T - (m @ v * m).sum(1) / 2 + np.log(s), 1)
        c = np.where(miss[:, 2] & ~every, label(x), c)
        planes = []
        for i, (y, other) in enumerate((("a", "b"), ("b", "a"))):
            now = {"a": a, "b": b}
            z = np.column_stack([now[other], t, hot(c)])
            use = ~miss[:, i] & ~every
            w = np.linalg.lstsq(z[use], now[y][use], rcond=None)[0]
            new = np.where(miss[:, i] & ~every, z @ w, now[y])
            a, b = (new, b) if y == "a" else (a, new)
            planes.append(w)
        c = np.where(every, label(np.column_stack([a, b, t])), c)
        a = np.where(every, np.column_stack([b, t, hot(c)]) @ planes[0], a)
        b = np.where(every, np.column_stack([a, t, hot(c)]) @ planes[1], b)
    return a, b, [names[k] for k in c]


@pytest.mark.parametrize("strategy", ["baseline", "delta", "reverse"])
def test_mice_against_numpy(spark, strategy):
    rows = _with_nulls()
    df = spark.createDataFrame(rows, "id long, a double, b double, t double, c string").repartition(3)
    a, b, c = _numpy_mice(rows, 2)
    got = sorted(map(tuple, im.mice(df, ["a", "b", "t"], ["c"], ["a", "b"], ["c"], strategy, iterations=2).select("id", "a", "b", "c").collect()))
    assert np.allclose([r[1] for r in got], a, atol=1e-6) and np.allclose([r[2] for r in got], b, atol=1e-6) and [r[3] for r in got] == c


def test_factorized_strategy_equals_the_joined_table(spark):
    rng = np.random.default_rng(2)
    rows = [(r[0], r[1], r[2], r[4], int(rng.integers(0, 12)), int(rng.integers(0, 3))) for r in _with_nulls(200)]
    fact = spark.createDataFrame(rows, "id long, a double, b double, c string, k int, h int")
    dim = spark.createDataFrame([(k, h, float((k * 7 + h * 3) % 11), f"g{(k + h) % 3}", k % 4) for k in range(12) for h in range(3)], "k int, h int, x double, g string, up int")
    top = spark.createDataFrame([(u, float(u * u), f"w{u % 2}") for u in range(4)], "up int, y double, w string")
    steps = [fz.Step(dim, ["k", "h"], ["x"], ["g"], ["up"], True), fz.Step(top, ["up"], ["y"], ["w"])]
    wide = fact.join(dim, ["k", "h"]).join(top, "up")
    columns = (["a", "b", "x", "y"], ["c", "g", "w"], ["a", "b"], ["c"])
    one = sorted(map(tuple, im.mice(fact, *columns, "factorized", iterations=2, steps=steps).select("id", "c", "a", "b").collect()))
    two = sorted(map(tuple, im.mice(wide, *columns, "baseline", iterations=2).select("id", "c", "a", "b").collect()))
    assert [r[:2] for r in one] == [r[:2] for r in two] and np.allclose([r[2:] for r in one], [r[2:] for r in two], atol=1e-6)
    joined, below = co.cofactor(wide, *columns[:2]), fz.factorized_cofactor(fz.JoinTree(fact, ["a", "b"], ["c"], ["k", "h"], steps))
    assert joined.n == below.n and joined.lin_cat == below.lin_cat and joined.cat_cat == below.cat_cat


def test_unknown_strategies_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, t double")
    for strategy in ("nonsense", "factorized"):
        with pytest.raises(ValueError):
            im.mice(df, ["a", "t"], [], ["a"], [], strategy)


def test_old_parts_are_removed(spark, tmp_path):
    from sumring.operators.lineage import Parts

    parts = Parts(spark.createDataFrame([(i, "pq"[i % 2]) for i in range(10)], "x int, part string"), "part")
    old = parts.folder["p"]
    parts.rewrite("p", lambda r: r.withColumn("x", r["x"] + 100))
    assert not Path(old.removeprefix("file:")).exists() and sorted(r["x"] for r in parts.read("p", "q").collect()) == [1, 3, 5, 7, 9, 100, 102, 104, 106, 108]
    parts.drop("q")
    assert parts.names == ["p", "q"] and parts.read("q").count() == 0


def test_sum_of_stored_values_equals_the_fused_sum(spark):
    rows = [(g, float(i % 5), float(i % 3), f"c{i % 4}", f"d{i % 2}") for i, g in enumerate([None, "u", "v"] * 10)]
    df = spark.createDataFrame(rows, "g string, x double, y double, c string, d string")
    v = df.select("g", ring.lift([df["x"], df["y"]], [df["c"], df["d"]]).alias("v"))
    for r in ring.sum_values(v, "v", ["g"]).collect():
        w = co.cofactor(df.where(df["g"].eqNullSafe(r["g"])), ["x", "y"], ["c", "d"])
        assert r["v"]["n"] == w.n and r["v"]["lin"] == w.lin.tolist() and r["v"]["quad"] == [w.quad[0, 0], w.quad[0, 1], w.quad[1, 1]]
        assert r["v"]["lin_cat"] == [w.lin_cat["c"], w.lin_cat["d"]] and r["v"]["num_cat"][3] == w.num_cat["y", "d"]
        assert r["v"]["cat_cat"] == [{f"{a}|{b}": x for (a, b), x in w.cat_cat["c", "d"].items()}]
    assert ring.sum_values(v.where("false"), "v").first()["v"]["n"] == 0


def test_naive_bayes_with_many_columns_does_not_underflow(spark):
    rows = [(k, *[k * 0.5 + ((i * 31 + j * 17) % 10) / 10 for j in range(60)]) for i in range(60) for k in (0, 1)]
    names = [f"x{j}" for j in range(60)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))
    far = df.select("k", *((df[n] + 40).alias(n) for n in names))  # every product of densities is 0
    assert [r[0] for r in far.select(ml.naive_bayes(co.cofactor_by(df, "k", names)).predict()).distinct().collect()] == [1]
