"""The execution graph of a handful of modules, and texts that the star schema cannot hold."""

import time

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import build, evidence, graph, paths

OBJECTS = "type string, schema string, name string, definition string"


def built(spark, *modules, database="Main"):
    return build.build(spark.createDataFrame([(*m, None) if len(m) == 3 else m for m in modules], OBJECTS), database)


def edges(g, *kinds):
    return {(r["type"], r["source"], r["target"], r["schema_source"]) for r in g.edges.collect() if r["type"] in kinds}


def test_references_name_listed_views_and_tables_by_schema(spark):
    text = "SELECT * FROM v JOIN dbo.T ON 1=1 JOIN Main..x ON 1=1 JOIN Other.dbo.v ON 1=1; INSERT INTO hr.Log (a) VALUES (dbo.f(1)); EXEC sp_who; EXEC q; EXEC Other.dbo.q; EXEC srv.Main.dbo.q; EXEC nobody"
    g = built(spark, ("stored_procedure", "", "P", text), ("view", "dbo", "V"), ("table", "dbo", "t"), ("function", "dbo", "F"), ("stored_procedure", "dbo", "q"))
    p, first, second = "stored_procedure:dbo.p", "dml_operation:stored_procedure:dbo.p:1", "dml_operation:stored_procedure:dbo.p:2"
    assert edges(g, "reads", "writes") == {
        ("reads", first, "view:dbo.v", "module_schema"), ("reads", first, "table:dbo.t", "written"), ("reads", first, "table:.x", "unresolved"), ("reads", first, "table:dbo.v", "written"),
        ("writes", second, "table:hr.log", "written"),
    }
    assert edges(g, "uses") == {("uses", p, "view:dbo.v", "module_schema"), ("uses", p, "function:dbo.f", "written")}
    assert edges(g, "calls") == {
        ("calls", p, "stored_procedure:sys.sp_who", "system"), ("calls", p, "stored_procedure:dbo.q", "module_schema"), ("calls", p, "stored_procedure:Other.dbo.q", "written"),
        ("calls", p, "stored_procedure:srv.Main.dbo.q", "written"), ("calls", p, "stored_procedure:.nobody", "unresolved"),
    }
    kinds = {r["node_id"]: r["type"] for r in g.nodes.collect()}
    assert kinds["table:hr.log"] == "table" and kinds[first] == "dml_operation" and kinds["view:dbo.v"] == "view" and len(kinds) == 10


def test_dynamic_text_and_text_that_does_not_parse(spark):
    g = built(spark, ("stored_procedure", "dbo", "d", "EXEC (@s); SELECT * FROM t1"), ("stored_procedure", "dbo", "bad", "SELECT (1 FROM t1"))
    assert {(r["type"], r["confidence"]) for r in g.edges.collect()} >= {("unresolved", "unresolved"), ("contains", "proven")}
    assert [r["module_id"] for r in g.errors.collect()] == ["stored_procedure:dbo.bad"]


def test_temporary_tables_belong_to_their_module_and_are_followed(spark):
    g = built(
        spark,
        ("stored_procedure", "dbo", "outer", "INSERT INTO #t (a) SELECT a FROM Base1; EXEC inner_one"), ("stored_procedure", "dbo", "inner_one", "SELECT * FROM #t"),
        ("stored_procedure", "dbo", "own", "SELECT a INTO #t FROM Base2; EXEC inner_two"), ("stored_procedure", "dbo", "above", "INSERT INTO #t (a) SELECT a FROM Base3; EXEC own"),
        ("stored_procedure", "dbo", "inner_two", "SELECT * FROM #t"), ("stored_procedure", "dbo", "g1", "INSERT INTO ##g (a) SELECT a FROM Base4"), ("stored_procedure", "dbo", "g2", "SELECT * FROM ##g"),
    )
    found = {(r["source"].split(".")[1], r["target"]) for r in g.edges.filter("lineage is not null").collect()}
    assert found == {("inner_one:1", "table:.base1"), ("inner_two:1", "table:.base2"), ("g2:1", "table:.base4")}
    ids = {r["node_id"] for r in g.nodes.filter("name like '#%'").collect()}
    assert "table:.#t@stored_procedure:dbo.outer" in ids and "table:.##g" in ids


def test_temp_lineage_never_mixes_directions(spark):
    """A table filled from one that a callee fills is not seen by the callees through that callee."""
    fills = spark.createDataFrame([(1, "#a", "#b"), (2, "#b", "Base")], "module long, temp string, base string")
    calls = spark.createDataFrame([(1, 2), (1, 3)], "source long, target long")
    got = {(r["module"], r["temp"]) for r in graph.temp_table_lineage(spark, fills, calls).collect()}
    assert got == {(2, "#b"), (1, "#b"), (1, "#a")}


def test_caller_chains_of_any_length_and_one_that_meets_itself(spark):
    pairs = [(i + 1, i) for i in range(30)] + [(101, 100), (102, 101), (101, 102), (103, 101), (200, 200)]
    starts = spark.createDataFrame([(0,), (100,), (200,)], "node long")
    got = {(r["node"], r["root"]): r["chain"] for r in graph.root_chains(starts, spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert got.pop((0, 30)) == list(range(30, -1, -1))
    # 103 calls 101, a root; 101 and 102 call each other, and that chain is the longest of node 100
    assert got.pop((100, 103)) == [103, 101, 100] and got.pop((100, 101)) == [101, 102, 101, 100] and got.pop((200, 200)) == [200, 200] and not got


def test_aliases_of_any_length_end(spark):
    pairs = [(str(i), str(i + 1)) for i in range(100)] + [("x", "y"), ("y", "z"), ("z", "y"), ("self", "self")]
    got = {r["name"]: r["final"] for r in evidence.flatten_aliases(spark.createDataFrame(pairs, "name string, target string")).collect()}
    assert all(got[str(i)] == "100" for i in range(100)) and got["x"] == "z" and got["y"] == "z" and got["z"] == "y" and got["self"] == "self" and len(got) == 104


def test_tables_of_texts(spark):
    texts = {
        "SELECT u.Id FROM PUR.dbo.Users u JOIN [COMMON].[AVM] a ON 1=1 JOIN Orders o ON 1=1": {"PUR.dbo.Users", "COMMON.AVM", "Orders"},
        "SELECT q.Id FROM OPENQUERY(LNK, 'SELECT 1') q JOIN OPENJSON(@json) j ON 1=1": set(),
        "UPDATE SET a = 1": set(), "SELECT 1 -- FROM no": set(), "FROM t": set(), None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["x"] if r["x"] is None else set(r["x"]) for r in df.select("t", X.tables(F.col("t")).alias("x")).collect()}
    assert got == texts


def test_reach_of_many_levels_is_compacted(spark):
    began = time.time()
    got = graph.reach(spark.createDataFrame([(0, 0)], "origin long, node long"), spark.createDataFrame([(i, i + 1) for i in range(25)], "source long, target long"))
    assert got.count() == 26 and got.agg(F.max("depth")).first()[0] == 25 and time.time() - began < 120


def test_paths_and_accesses_over_a_graph(spark):
    g = built(
        spark,
        ("stored_procedure", "dbo", "top", "UPDATE dbo.SOrder SET a = 1 WHERE k = 2; EXEC sub; EXEC dyn"), ("stored_procedure", "dbo", "sub", "IF @x = 1 BEGIN INSERT INTO SOrder (b) SELECT b FROM vOrder END"),
        ("stored_procedure", "dbo", "dyn", "EXEC (@s)"), ("stored_procedure", "hr", "other", "DELETE FROM hr.SOrder"), ("view", "dbo", "vOrder", "CREATE VIEW vOrder AS SELECT * FROM dbo.Base1"),
        ("table", "dbo", "SOrder"), ("stored_procedure", "dbo", "bad", "SELECT (1 FROM t1"),
    )
    rows = [(1, "stored_procedure:dbo.top", "proven", "", "a.cs"), (2, "stored_procedure:hr.other", "likely", "", "b.cs"), (3, "stored_procedure:dbo.bad", "proven", "", "c.cs")]
    records = paths.graph_records(g, spark.createDataFrame(rows, "invocation_id long, node string, evidence string, reason string, file string")).cache()
    got = {(r["invocation_id"], r["operation_type"], r["target"], tuple(r["risk_flags"]), r["path_evidence"], r["unresolved_reason"]) for r in records.collect()}
    assert got == {
        (1, "UPDATE", "SOrder", (), "proven", ""), (1, "INSERT", "SOrder", (), "proven", ""), (1, "DYNAMIC_SQL", "", ("dynamic_sql",), "unresolved", "unresolved_dynamic_sql"),
        (2, "DELETE", "SOrder", ("likely_invocation",), "likely", ""), (3, None, "", ("sql_parse_error",), "unresolved", "stored_procedure_has_no_terminal_dml"),
    }
    assert records.select("path_id").distinct().count() == 5
    ask = lambda *q, **k: sorted((r["invocation_id"], r["access_type"], r["is_write"], r["is_indirect"]) for r in paths.graph_accesses(records, g, q, "Main", **k).collect())
    assert ask("", "dbo", "sorder") == [(1, "INSERT", True, True), (1, "UNRESOLVED", False, True), (1, "UPDATE", True, False)]
    assert ask("", "", "SOrder", access="write") == [(1, "INSERT", True, True), (1, "UPDATE", True, False), (2, "UNRESOLVED", False, False)]
    assert ask("other", "dbo", "SOrder") == [(1, "UNRESOLVED", False, True)]
    assert ask("", "", "Base1", access="read") == [(1, "READ", False, True)]
    assert ask("", "", "vOrder") == [(1, "READ", False, True), (1, "UNRESOLVED", False, True)]
