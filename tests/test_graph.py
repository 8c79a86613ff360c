import time

from pyspark.sql import functions as F

from tracewright import catalogue
from tracewright.operators import answers, evidence, graph, paths, rank, resolve


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def test_expansion_finds_cycles_before_cuts_and_keeps_duplicate_calls(spark):
    calls = edges(spark, [(0, 1), (0, 1), (1, 0), *[(i, i + 1) for i in range(10, 20)]])
    starts = spark.createDataFrame([(0,), (10,)], "module long")
    got = graph.expand_bounded(starts, calls).groupBy("entry", "status").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(0, "ok"): 3, (0, "stored_procedure_call_cycle"): 2, (10, "ok"): 6, (10, "call_expansion_truncated"): 1}


def test_worked_table_question(spark):
    """A direct and a nested write of one table."""
    chains = graph.expand_bounded(spark.createDataFrame([(1,), (2,)], "module long"), edges(spark, [(2, 3)]))
    ops = spark.createDataFrame([(1, 1, "UPDATE", "SOrder", False), (3, 2, "INSERT", "SOrder", False), (3, 3, "SELECT", "Other", True)], "module long, operation_no long, operation_type string, target string, dynamic_sql boolean")
    inv = spark.createDataFrame([(7, 1, "a.cs", "proven"), (8, 2, "b.cs", "proven")], "invocation_id long, module long, file string, evidence string")
    records = paths.path_records(inv, paths.terminal_operations(chains, ops, edges(spark, [(2, 3)])))
    got = {(r["file"], r["access_type"], r["is_write"], tuple(r["chain"])) for r in paths.table_accesses(records, "sorder").collect()}
    assert got == {("a.cs", "UPDATE", True, (1,)), ("b.cs", "WRITE_INDIRECT", True, (2, 3)), ("b.cs", "UNRESOLVED", False, (2, 3))}
    assert answers.find_by_table(records, "SOrder", write_only=True).count() == 2


def test_module_with_nothing(spark):
    chains = graph.expand_bounded(spark.createDataFrame([(1,)], "module long"), edges(spark, []))
    ops = spark.createDataFrame([], "module long, operation_no long, operation_type string, target string, dynamic_sql boolean")
    assert paths.terminal_operations(chains, ops, edges(spark, [])).first()["unresolved_reason"] == "stored_procedure_has_no_terminal_dml"


def test_reach_on_a_cycle_and_on_nothing(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1)])
    got = graph.reach(spark.createDataFrame([(1, 1)], "origin long, node long"), e).collect()
    assert {(r["node"], r["depth"]) for r in got} == {(1, 0), (2, 1), (3, 2)}
    assert graph.reach(spark.createDataFrame([], "origin long, node long"), e).count() == 0


def chain_fills(spark, k=40, length=4):
    """k procedures that each fill #t1 to #t<length> from a table of their own."""
    fills = [(i, "#t1", f"base{i}") for i in range(k)] + [(i, f"#t{j}", f"#t{j - 1}") for i in range(k) for j in range(2, length + 1)]
    return spark.createDataFrame(fills, "module long, temp string, base string")


def test_temp_lineage_of_many_chains_is_quick(spark):
    began = time.time()
    got = graph.temp_table_lineage(spark, chain_fills(spark), edges(spark, [])).filter("temp = '#t4'").collect()
    assert {(r["module"], r["base"]) for r in got} == {(i, f"base{i}") for i in range(40)} and len(got) == 40
    assert time.time() - began < 15


def test_temp_lineage_on_a_cycle_of_calls(spark):
    fills = spark.createDataFrame([(1, "#t", "A"), (2, "#t", "B")], "module long, temp string, base string")
    got = {(r["module"], r["base"]): r["chain"] for r in graph.temp_table_lineage(spark, fills, edges(spark, [(1, 2), (2, 1)])).collect()}
    assert got[(1, "A")] == [1] and got[(1, "B")] == [1, 2] and got[(2, "A")] == [2, 1] and got[(2, "B")] == [2]


def test_locate_falls_back_and_reports_what_is_not_indexed(spark):
    wanted = spark.createDataFrame([(1, "t", "hr"), (2, "t", "zz"), (3, "u", "")], "want_id int, key string, schema string")
    index = spark.createDataFrame([("a", "hr", "t"), ("b", "dbo", "t")], "database string, schema string, key string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "database string")
    got = {tuple(r) for r in resolve.locate(wanted, index, known).collect()}
    assert got == {(1, "a", "matched"), (2, "a", "matched"), (2, "b", "matched"), (None, "c", "unindexed")}


def test_bound_target_reasons(spark):
    calls = spark.createDataFrame([(1, "I", "m"), (2, "J", "m"), (3, "K", "m"), (4, "L", "m")], "call_id int, interface string, method string")
    impl = spark.createDataFrame([("I", "m", "A", True), ("J", "m", "A", True), ("J", "m", "B", True), ("K", "m", "A", False)], "interface string, method string, class_name string, mapped boolean")
    assert [tuple(r) for r in evidence.bound_target(calls, impl).orderBy("call_id").collect()] == [(1, "A", ""), (2, None, "ambiguous_implementation"), (3, None, "unmapped_implementation"), (4, None, "no_local_implementer")]


def test_aliases_on_a_cycle_end(spark):
    got = evidence.flatten_aliases(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, target string")).collect()
    assert dict(map(tuple, got)) == {"a": "c", "b": "c", "x": "y", "y": "x"}


def test_top_is_bounded(spark):
    assert rank.top(spark.range(500), 100, F.col("id")).count() == 60
    assert rank.top(spark.range(5), -1, F.col("id")).count() == 0


def test_places_of_an_order_are_those_of_all_rows(spark):
    """Ranges come from a sample and may be merged at run time, and two plans over them do not see the same ones."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "200")
    try:
        got = catalogue.QUERIES["path_order"](spark, "/root/testdata/sf0.1").collect()
    finally:
        spark.conf.set(key, before)
    rows = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").select("o_orderkey", "o_custkey").collect()
    n = spark.read.parquet("/root/testdata/sf0.1/part.parquet").count()
    want = sorted((f"f{r['o_custkey']}.cs", r["o_orderkey"] % n, r["o_orderkey"]) for r in rows)
    assert {r["invocation_no"]: r["position"] for r in got} == {w[2]: i for i, w in enumerate(want)}


def test_a_cut_forgets_what_its_plan_knew_of_columns(spark):
    """Else each round of a loop derives longer conditions from those of the round before."""
    held = graph.cut(spark.range(50).select(F.floor(F.col("id") / 2).alias("node")).filter("node > 3"))
    plan = held.join(spark.range(50).withColumnRenamed("id", "node"), "node")._jdf.queryExecution().optimizedPlan().toString()
    assert "> 3" not in plan and held.count() == 42
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == "true"


def test_temp_lineage_writes_each_state_once(spark, monkeypatch):
    held, written = graph.cut, []

    def counted(df):
        out = held(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    fills = spark.createDataFrame([(0, "#t", "A")], "module long, temp string, base string")
    got = graph.temp_table_lineage(spark, fills, edges(spark, [(i, i + 1) for i in range(5)])).collect()
    # up, down and here of the first, up and here of the five that it calls
    assert {tuple(r["chain"]) for r in got} == {tuple(range(i, -1, -1)) for i in range(6)} and sum(written) == 13
