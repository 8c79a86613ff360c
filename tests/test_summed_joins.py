"""Joins whose sides are summed up first: against plain loops on odd rows, and on names that very many rows have."""

import random

from pyspark.sql import functions as F

from tracewright.operators import access, resolve

MANY = 200_000  # all pairs of so many rows would be 40 thousand million


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_match_procedure(spark):
    rng = random.Random(1)
    inv = [(i, rng.choice("abc"), rng.choice(["", "hr", "dbo", "x"])) for i in range(60)] + [(7, "a", "hr")]
    nodes = [(i, rng.choice("ab"), rng.choice(["", "hr", "dbo"])) for i in range(6)]
    hits = {i: [n for j, k, s in inv if j == i for n, key, held in nodes if k == key and (s == "" or held == "" or s == held)] for i, _, _ in inv}
    why = lambda n: "stored_procedure_not_in_graph" if n == 0 else "ambiguous_stored_procedure_graph_target" if n > 1 else ""
    want = sorted([(i, h[0] if len(h) == 1 else None, len(h), why(len(h))) for i, h in hits.items()], key=str)
    assert rows(resolve.match_procedure(spark.createDataFrame(inv, "invocation_id int, key string, schema string"), spark.createDataFrame(nodes, "node_id int, key string, schema string"))) == want


def test_match_procedure_of_one_name(spark):
    each = spark.range(MANY)
    got = resolve.match_procedure(each.select(F.col("id").alias("invocation_id"), F.lit("a").alias("key"), F.lit("").alias("schema")), each.select(F.col("id").alias("node_id"), F.lit("a").alias("key"), F.lit("dbo").alias("schema")))
    assert [tuple(r) for r in got.select("n", "reason").distinct().collect()] == [(MANY, "ambiguous_stored_procedure_graph_target")]


def test_parent_application(spark):
    sites = [(1, 0, "a"), (2, 0, "a/b"), (3, 0, "a/b/c"), (4, 0, "a/b/c"), (5, 0, "a/b/c/d"), (6, 1, "a/b"), (7, 0, None), (8, 0, "x/y/z"), (9, 0, "x"), (9, 0, "x/y"), (10, 0, "q"), (10, 0, "q/r")]
    got = rows(access.parent_application(spark.createDataFrame(sites, "site int, origin int, path string")).distinct())
    # 9 and 10 stand at two paths each: a site is not above itself
    assert got == sorted([(1, None, "root"), (2, 1, ""), (3, 2, ""), (4, 2, ""), (5, None, "ambiguous"), (6, None, "root"), (7, None, "root"), (8, 9, ""), (9, None, "root"), (10, None, "root")], key=str)


def test_parent_application_of_one_path(spark):
    sites = spark.range(2 * MANY).select(F.col("id").alias("site"), F.lit(0).alias("origin"), F.when(F.col("id") < MANY, "a").otherwise("a/b").alias("path"))
    got = access.parent_application(sites).groupBy("reason").count().collect()
    assert dict(map(tuple, got)) == {"root": MANY, "ambiguous": MANY}


def test_nearest_reason(spark):
    rng = random.Random(2)
    line = lambda: rng.choice([None, *range(12)])
    uses = [(i, rng.choice([None, "f", "g", "h"]), line()) for i in range(80)] + [(5, "f", 3)]
    reasons = [(rng.choice([None, "f", "g"]), line(), rng.choice(["x", "y", None])) for _ in range(12)] + [("e", None, "z")]
    last = lambda v: (v is None, "" if v is None else v)
    met = {}
    for u, f, n in uses:
        for g, at, r in reasons:
            if f is not None and f == g:
                d = None if n is None or at is None else abs(n - at)
                met.setdefault(u, []).append((d is None, d or 0, at is None, at or 0, last(r), r))
    want = sorted([(u, min(c, key=lambda x: x[:5])[5]) for u, c in met.items()], key=str)
    assert rows(access.nearest_reason(spark.createDataFrame(uses, "use_id int, file string, line int"), spark.createDataFrame(reasons, "file string, line int, reason string"))) == want


def test_nearest_reason_of_one_file(spark):
    each = spark.range(MANY)
    got = access.nearest_reason(each.select(F.col("id").alias("use_id"), F.lit("f").alias("file"), (10 * F.col("id") + 4).alias("line")), each.select(F.lit("f").alias("file"), (10 * F.col("id")).alias("line"), F.col("id").cast("string").alias("reason")))
    assert got.filter("reason = use_id").count() == MANY


def test_first_layer_and_shared_component_of_one_key(spark):
    each = spark.range(MANY)
    layers = each.select((F.col("id") + 1).alias("layer"), F.lit("k").alias("key"), F.col("id").cast("string").alias("value"), (F.col("id") == 5).alias("stops"))
    got = resolve.first_layer(each.select(F.col("id").alias("lookup_id"), F.lit("k").alias("key")), layers)
    assert [tuple(r) for r in got.select("layer", "value").distinct().collect()] == [(1, "0")] and got.count() == MANY
    right = each.select(F.lit("k").alias("key"), F.when(F.col("id") == 9, 0).otherwise(1).alias("tier"), F.col("id").cast("string").alias("target"))
    got = resolve.tiered_match(each.select("id", F.lit("k").alias("key")), right, "key")
    assert [tuple(r) for r in got.select("target", "n").distinct().collect()] == [("9", 1)] and got.count() == MANY


def test_shared_component_of_several_keys(spark):
    left = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b"), (3, None), (4, None), (5, "z"), (6, "c")]
    right = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", 0, "x"), ("b", 0, "w"), ("c", None, "v")]
    got = rows(resolve.tiered_match(spark.createDataFrame(left, "id int, key string"), spark.createDataFrame(right, "key string, tier int, target string"), "key"))
    assert got == [(1, None, 2), (2, "x", 1), (3, None, 2), (4, None, 0), (5, None, 0), (6, None, 0)]


def test_overloads(spark):
    rng = random.Random(3)
    calls = [(i, rng.choice(["F", "g", "none", None]), rng.choice([None, 0, 1, 2, 3])) for i in range(80)] + [(5, "f", 2), (5, "f", 2)]
    ops = [(rng.choice(["f", "G", None]), i, rng.choice([None, 0, 1, 2]), rng.choice([None, 1, 2, 3])) for i in range(9)]
    low = lambda s: s and s.lower()
    want = []
    for c in {c[0] for c in calls}:
        met = [(o, n) for i, name, n in calls if i == c for o in ops if name is not None and low(o[0]) == low(name)]
        exact = [o[1] for o, n in met if n is not None and o[3] == n]
        loose = [o[1] for o, n in met if n is not None and o[3] != n and None not in o[2:] and o[2] <= n < o[3]]
        fit = exact or loose
        why = "unresolved_method" if not met else "no_matching_overload" if not fit else "ambiguous_overload" if len(fit) > 1 else ""
        want.append((c, fit[0] if len(fit) == 1 else None, why))
    assert rows(access.select_overload(spark.createDataFrame(calls, "call_id int, name string, n_args int"), spark.createDataFrame(ops, "name string, identity int, required int, declared int"))) == sorted(want, key=str)


def test_overloads_of_one_name(spark):
    each = spark.range(MANY)
    ops = each.select(F.lit("f").alias("name"), F.col("id").alias("identity"), F.lit(1).alias("required"), F.when(F.col("id") == 3, 2).otherwise(5).alias("declared"))
    got = access.select_overload(each.select(F.col("id").alias("call_id"), F.lit("F").alias("name"), F.lit(2).alias("n_args")), ops)
    assert [tuple(r) for r in got.select("identity", "reason").distinct().collect()] == [(3, "")] and got.count() == MANY
