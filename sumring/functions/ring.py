"""The ring of sufficient statistics as Column expressions (row values), for use inside ``select`` and ``agg``.

A cofactor value is a struct: n, lin (sums), quad (upper triangle, row by row), lin_cat (a map category -> count for each categorical),
num_cat (for each continuous, each categorical: category -> sum), cat_cat (for each pair i < j: "a|b" -> count). Add, subtract and
multiply follow the ring; a key missing on one side counts as zero. A relation is a map category -> value.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = "map<string,double>"


def _arr(items: list[Column], kind: str) -> Column:
    return F.array(*items).cast(f"array<{kind}>") if items else F.array().cast(f"array<{kind}>")


def _name(c: Column) -> Column:
    return c.cast("string")


def lift(cont: list[Column], cat: list[Column]) -> Column:
    """One row as a ring value; null if any argument is null."""
    x = [c.cast("double") for c in cont]
    value = F.struct(
        F.lit(1).cast("long").alias("n"),
        _arr(x, "double").alias("lin"),
        _arr([x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))], "double").alias("quad"),
        _arr([F.create_map(_name(c), F.lit(1.0)) for c in cat], _NUM).alias("lin_cat"),
        _arr([F.create_map(_name(c), v) for v in x for c in cat], _NUM).alias("num_cat"),
        _arr([F.create_map(F.concat_ws("|", _name(a), _name(b)), F.lit(1.0)) for a, b in combinations(cat, 2)], _NUM).alias("cat_cat"),
    )
    missing = F.lit(False)
    for c in [*cont, *cat]:
        missing = missing | c.isNull()
    return F.when(~missing, value)


def const(k: int) -> Column:
    """k times one: no columns, count k."""
    empty = F.array()
    return F.struct(F.lit(k).cast("long").alias("n"), *(empty.cast(f"array<{t}>").alias(c) for c, t in (("lin", "double"), ("quad", "double"), ("lin_cat", _NUM), ("num_cat", _NUM), ("cat_cat", _NUM))))


def relation(key: Column) -> Column:
    return F.create_map(_name(key), F.lit(1.0))


def relation_add(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def relation_sub(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))


def relation_scale(a: Column, f) -> Column:
    return F.transform_values(a, lambda _, v: v * f)


def relation_mul(a: Column, b: Column) -> Column:
    """All pairs of keys, with the product of their values."""
    pairs = F.flatten(F.transform(F.map_entries(a), lambda x: F.transform(F.map_entries(b), lambda y: F.struct(F.concat_ws("|", x["key"], y["key"]).alias("key"), (x["value"] * y["value"]).alias("value")))))
    return F.map_from_entries(pairs)


def _both(a: Column, b: Column, sign: int) -> Column:
    rel = relation_add if sign > 0 else relation_sub
    num = lambda x, y: x + y if sign > 0 else x - y
    fields = [num(a["n"], b["n"]).alias("n")]
    fields += [F.zip_with(a[c], b[c], num).alias(c) for c in ("lin", "quad")]
    fields += [F.zip_with(a[c], b[c], rel).alias(c) for c in ("lin_cat", "num_cat", "cat_cat")]
    return F.struct(*fields)


def add(a: Column, b: Column) -> Column:
    return _both(a, b, 1)


def sub(a: Column, b: Column) -> Column:
    return _both(a, b, -1)


def mul(a: Column, b: Column, shape_a: tuple[int, int], shape_b: tuple[int, int]) -> Column:
    """Product of values over disjoint columns; shapes are (continuous, categorical) numbers."""
    (na, ma), (nb, mb) = shape_a, shape_b
    tri = lambda n, i, j: i * n - i * (i - 1) // 2 + j - i
    n1, n2 = a["n"].cast("double"), b["n"].cast("double")
    lin = [F.get(a["lin"], i) * n2 for i in range(na)] + [F.get(b["lin"], i) * n1 for i in range(nb)]
    quad, n, m = [], na + nb, ma + mb
    for i in range(n):
        for j in range(i, n):
            if j < na:
                quad.append(F.get(a["quad"], tri(na, i, j)) * n2)
            elif i >= na:
                quad.append(F.get(b["quad"], tri(nb, i - na, j - na)) * n1)
            else:
                quad.append(F.get(a["lin"], i) * F.get(b["lin"], j - na))
    lin_cat = [relation_scale(F.get(a["lin_cat"], i), n2) for i in range(ma)] + [relation_scale(F.get(b["lin_cat"], i), n1) for i in range(mb)]
    num_cat = []
    for i in range(n):
        for j in range(m):
            if i < na and j < ma:
                num_cat.append(relation_scale(F.get(a["num_cat"], i * ma + j), n2))
            elif i >= na and j >= ma:
                num_cat.append(relation_scale(F.get(b["num_cat"], (i - na) * mb + j - ma), n1))
            elif i < na:
                num_cat.append(relation_scale(F.get(b["lin_cat"], j - ma), F.get(a["lin"], i)))
            else:
                num_cat.append(relation_scale(F.get(a["lin_cat"], j), F.get(b["lin"], i - na)))
    cat_cat = []
    pair = lambda m, i, j: i * m - i * (i + 1) // 2 + j - i - 1
    for i, j in combinations(range(m), 2):
        if j < ma:
            cat_cat.append(relation_scale(F.get(a["cat_cat"], pair(ma, i, j)), n2))
        elif i >= ma:
            cat_cat.append(relation_scale(F.get(b["cat_cat"], pair(mb, i - ma, j - ma)), n1))
        else:
            cat_cat.append(relation_mul(F.get(a["lin_cat"], i), F.get(b["lin_cat"], j - ma)))
    return F.struct((a["n"] * b["n"]).alias("n"), _arr(lin, "double").alias("lin"), _arr(quad, "double").alias("quad"), _arr(lin_cat, _NUM).alias("lin_cat"), _arr(num_cat, _NUM).alias("num_cat"), _arr(cat_cat, _NUM).alias("cat_cat"))


def _summed_maps(rows, by: list[str], maps: dict[str, Column]):
    """(by, where, slot, k, v): sums by key of the maps in each array of maps, in long form, so that no map is ever one buffer of an aggregate."""
    parts = None
    for name, arrays in maps.items():
        part = rows.select(*by, F.posexplode(arrays).alias("slot", "m")).select(*by, F.lit(name).alias("where"), "slot", F.explode("m").alias("k", "v"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*by, "where", "slot", "k").agg(F.sum("v").alias("v"))


def sum_relations(rows, relation: str, by: list[str] | None = None):
    """SUM over stored relations: (by, ``relation``), keys added up; null relations do not count. No rows give no groups (one empty relation
    without ``by``)."""
    by = by or []
    long = rows.select(*by, F.explode(relation).alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    return long.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(relation))


def sum_values(rows, value: str, by: list[str] | None = None, kind: str = "cofactor"):
    """SUM over stored ring values, maps included: (by, ``value``). Numbers are added by position, maps by key; the maps of one result have an
    entry for each category, or pair of categories, of the group. ``kind``: cofactor, or nb for the Naive Bayes ring. Null values do not
    count; all values have one shape."""
    by = by or []
    numbers, maps = (["lin", "quad"], ["lin_cat", "num_cat", "cat_cat"]) if kind == "cofactor" else (["lin", "sq"], ["cat"])
    rows = rows.where(F.col(value).isNotNull())
    size = {c: F.max(F.size(F.col(value)[c])).alias(f"_{c}") for c in [*numbers, *maps]}
    total = rows.groupBy(*by).agg(F.sum(F.col(value)["n"]).alias("_n"), *size.values())
    flat = None
    for c in numbers:
        part = rows.select(*by, F.lit(c).alias("where"), F.posexplode(F.col(value)[c]).alias("slot", "v")).groupBy(*by, "where", "slot").agg(F.sum("v").alias("v"))
        flat = part if flat is None else flat.unionByName(part)
    entries = _summed_maps(rows, by, {c: F.col(value)[c] for c in maps}).groupBy(*by, "where", "slot").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))
    both = flat.withColumn("m", F.lit(None).cast(_NUM)).unionByName(entries.withColumn("v", F.lit(None).cast("double")))
    got = both.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "where", F.col("slot").cast("string")).alias("at"), F.struct("v", "m").alias("x")))).alias("_got"))
    cond = [total[c].eqNullSafe(got[c]) for c in by]
    joined = total.join(got, cond, "left") if by else total.join(got, F.lit(True), "left")

    def gathered(c: str, of: str, empty: Column) -> Column:
        at = lambda i: F.element_at("_got", F.concat(F.lit(f"{c}/"), i.cast("string")))[of]
        slots = F.when(F.col(f"_{c}") > 0, F.sequence(F.lit(0), F.col(f"_{c}") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(slots, lambda i: F.coalesce(at(i), empty))

    fields = [F.coalesce("_n", F.lit(0)).cast("long").alias("n"), *(gathered(c, "v", F.lit(0.0)).alias(c) for c in numbers), *(gathered(c, "m", F.create_map().cast(_NUM)).alias(c) for c in maps)]
    return joined.select(*(total[c] for c in by), F.struct(*fields).alias(value))


def nb_lift(cont: list[Column], cat: list[Column]) -> Column:
    """The Naive Bayes ring: count, sums, sums of squares, category counts."""
    x = [c.cast("double") for c in cont]
    return F.struct(F.lit(1).cast("long").alias("n"), _arr(x, "double").alias("lin"), _arr([v * v for v in x], "double").alias("sq"), _arr([F.create_map(_name(c), F.lit(1.0)) for c in cat], _NUM).alias("cat"))


def nb_combine(a: Column, b: Column, sign: int = 1) -> Column:
    num = lambda x, y: x + y if sign > 0 else x - y
    return F.struct(num(a["n"], b["n"]).alias("n"), F.zip_with(a["lin"], b["lin"], num).alias("lin"), F.zip_with(a["sq"], b["sq"], num).alias("sq"), F.zip_with(a["cat"], b["cat"], relation_add if sign > 0 else relation_sub).alias("cat"))


def nb_mul(a: Column, b: Column) -> Column:
    """Counts and sums, squares included, scaled by the other side's count."""
    n1, n2 = a["n"].cast("double"), b["n"].cast("double")
    scaled = lambda v, k: F.transform(v, lambda x: x * k)
    rel = lambda v, k: F.transform(v, lambda r: relation_scale(r, k))
    return F.struct((a["n"] * b["n"]).alias("n"), *(F.concat(scaled(a[c], n2), scaled(b[c], n1)).alias(c) for c in ("lin", "sq")), F.concat(rel(a["cat"], n2), rel(b["cat"], n1)).alias("cat"))
