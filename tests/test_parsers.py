import pytest
from pyspark.sql import functions as F

from tracewright.functions import lexing, pages
from tracewright.functions import text as X
from tracewright.functions.tsql import analyze
from tracewright.sources import config, files


def names(ns):
    return [".".join(p for p in n if p) for n in ns]


def shape(sql):
    return [(o.operation_type, names(o.read_tables), names(o.write_tables), o.branch_path) for o in analyze(sql)[0]]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT * FROM dbo.A a JOIN [hr].[B] b ON 1=1", [("SELECT", ["dbo.A", "hr.B"], [], [])]),
        ("SELECT * INTO #t FROM A", [("SELECT_INTO", ["A"], ["#t"], [])]),
        ("UPDATE a SET x = 1 FROM A a JOIN B ON 1=1", [("UPDATE", ["B"], ["A"], [])]),
        ("DELETE FROM F WHERE k IN (SELECT k FROM G)", [("DELETE", ["G"], ["F"], [])]),
        ("INSERT INTO A EXEC dbo.p", [("INSERT", [], ["A"], []), ("CALL", [], [], [])]),
        ("WITH c AS (SELECT * FROM X) SELECT * FROM c", [("SELECT", ["X"], [], [])]),
        ("MERGE T USING S ON 1=1 WHEN MATCHED THEN UPDATE SET a = 1;", [("MERGE", ["S"], ["T"], [])]),
        ("IF EXISTS (SELECT 1 FROM T) DELETE T ELSE EXEC(@s)", [("SELECT", ["T"], [], []), ("DELETE", [], ["T"], ["IF EXISTS (SELECT 1 FROM T)"]), ("DYNAMIC_SQL", [], [], ["ELSE (NOT (EXISTS (SELECT 1 FROM T)))"])]),
        ("BEGIN TRY UPDATE q SET a = 1 END TRY BEGIN CATCH INSERT INTO e VALUES (1) END CATCH", [("UPDATE", [], ["q"], ["TRY"]), ("INSERT", [], ["e"], ["CATCH"])]),
        ("INSERT INTO @v SELECT * FROM A; SELECT 1", [("INSERT", ["A"], [], [])]),
        ("", []),
    ],
)
def test_tsql(sql, expected):
    assert shape(sql) == expected


def test_tsql_reports_what_it_cannot_read():
    assert analyze("SELECT ((1") == ([], ["unbalanced parentheses"])


def test_derived_target_is_unresolved():
    assert analyze("UPDATE d SET a = 1 FROM (SELECT * FROM A) d")[0][0].unresolved_write_targets == ["d"]


def test_comments():
    assert lexing.strip_sql_comments("a '--' /* x /* y */ */ b -- c\nd") == "a '--'   b  \nd"
    text = 's = "// no"; // yes\n/* a\nb */ x = @"c:\\";'
    clean = lexing.strip_csharp_comments(text)
    assert len(clean) == len(text) and '"// no"' in clean and "yes" not in clean and clean.count("\n") == 2 and clean.endswith('x = @"c:\\";')


def test_long_blank_run_is_quick():
    assert list(pages.csharp("class A {" + " " * 20000 + "}"))[0][:2] == ("class", "A")


def test_csharp_outline():
    found = {(k, n) for k, n, *_ in pages.csharp('namespace N;\npublic class Repo : Base { public void Save(int x) { db.Execute("UPDATE T SET a=1"); Run("EXEC dbo.usp_A"); } }\n// class No {}')}
    assert {("namespace", "N"), ("class", "Repo"), ("method", "Save"), ("sql_text", "UPDATE"), ("procedure_call", "dbo.usp_A"), ("call", "Execute")} <= found
    assert ("class", "No") not in found


def test_views(spark):
    df = spark.createDataFrame([("a.cshtml", '@model Foo\n<form action="/Order/Save/3">\n@Html.Partial("_Row")<a asp-action="Edit" asp-controller="Order">'), (None, None)], "path string, content string")
    got = {(r["kind"], r["name"], r["detail"], r["strength"]) for r in pages.facts(df, "razor").collect()}
    assert {("directive", "model", "Foo", "determined"), ("anchor", "Save", "Order", "candidate"), ("anchor", "Edit", "Order", "determined"), ("partial", "_Row", "", "determined")} == got
    aspx = {(k, n) for k, n, *_ in pages.webforms('<%@ Page CodeBehind="a.cs" Inherits="N.A" %><asp:Button ID="b" OnClick="Go" runat="server" />')}
    assert {("code_behind", "a.cs"), ("control", "b"), ("event", "Go")} <= aspx
    assert ("api_call", "/api/x", "POST", "determined") in {f[:4] for f in pages.vue("axios.post('/api/x', d)")}


def test_configuration(spark):
    xml = '<configuration><connectionStrings><add name="A" connectionString="x"/><clear/><add name="A" connectionString="Server=s;Database=d"/><add name="B" connectionString="y"/><remove name="B"/></connectionStrings></configuration>'
    js = '{ // c\n "ConnectionStrings": {"Main": "Server=h;Database=q",}, "A": {"B": 1}}'
    df = spark.createDataFrame([("w", xml), ("bad", "<x")], "path string, content string")
    got = {(r["key"], r["value"]) for r in config.table(config.entries(df, "web_config")).collect()}
    assert got == {("A", "Server=s;Database=d")}
    rows = config.entries(spark.createDataFrame([("a", js)], "path string, content string"), "appsettings").collect()
    assert {(r["namespace"], r["key"], r["value"]) for r in rows} == {("connection_strings", "Main", "Server=h;Database=q"), ("root_configuration", "A:B", "1")}
    code = 'services.AddDbContext<App.Shop>(o => o.UseSqlServer(c.GetConnectionString("Main")));'
    assert [r["value"] for r in config.entries(spark.createDataFrame([("s", code)], "path string, content string"), "composition_root").collect()] == ["Main"]
    parts = spark.range(1).select(config.connection_parts(F.lit("Password=p;Data Source=h;Initial Catalog=d;Database=e")).alias("c")).first()["c"]
    assert tuple(parts) == ("h", "d")


def test_resource_reasons(spark):
    res = spark.createDataFrame([("r", "k", "Text")], "resource string, key string, value string")
    fields = spark.createDataFrame([("a", "r", "k"), ("b", "r", "z"), ("c", "q", "k")], "field string, resource string, key string")
    assert {tuple(r) for r in config.display_text(fields, res).collect()} == {("a", "Text", ""), ("b", None, "resource_key_not_found"), ("c", None, "resource_file_not_found")}


def test_source_scan_and_stores(spark, tmp_path):
    for name, body in {"a/X.cs": b"\xef\xbb\xbfclass X {}", "bin/Y.cs": b"class Y {}", "a/v.vue": b"<template>", "b/Z.cs": "中".encode("cp950")}.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(body)
    got = {r["path"]: r["content"] for r in files.scan(spark, str(tmp_path / "src")).collect()}
    assert got == {"a/X.cs": "class X {}", "b/Z.cs": "中"}
    assert {r["path"] for r in files.scan(spark, str(tmp_path / "src"), files.VIEWS).collect()} == {"a/v.vue"}
    files.store(spark.range(3), str(tmp_path / "s"), 2)
    assert files.load(spark, str(tmp_path / "s"), 2).count() == 3 and files.load(spark, str(tmp_path / "s"), 1).count() == 0


def test_text_functions(spark):
    row = spark.createDataFrame([("SELECT * FROM dbo.Aa, x JOIN [hr].[Bb] b ON f(1)=1 -- c",)], "t string").select(X.tables(F.col("t")).alias("t"), X.sql_type(F.col("t")).alias("k"), X.clean_sql(F.col("t")).alias("c"), X.flags(F.lit("CREATE TABLE #a; EXEC (@s)")).alias("f")).first()
    assert row["t"] == ["dbo.Aa", "hr.Bb"] and row["k"] == "SELECT" and row["c"].endswith("=1") and row["f"]["dynamic_sql"] and row["f"]["temp_table"] and not row["f"]["cursor"]
    a = spark.range(1).select(X.attributes(F.lit("<a HREF='x\"y' id=\"1\" id=\"2\">")).alias("m")).first()["m"]
    assert a == {"href": 'x"y', "id": "1"}
