import pytest
from pyspark.sql import functions as F

from tracewright import names as N

CASES = [  # written, database, schema, name, bare key, full key
    ("Orders", "", "", "Orders", "orders", "..orders"),
    ("dbo.Orders", "", "dbo", "Orders", "orders", ".dbo.orders"),
    ("PUR..Orders", "PUR", "", "Orders", "orders", "pur..orders"),
    ("srv.PUR.dbo.Users", "PUR", "dbo", "Users", "users", "pur.dbo.users"),
    (" [Sales] . [Straße] ", "", "Sales", "Straße", "strasse", ".sales.strasse"),
    ("[a.b]", "", "a", "b", "b", ".a.b"),
    ("x.srv.D.s.n", "D", "s", "n", "n", "d.s.n"),
    (None, "", "", "", "", ".."),
]


def test_names_on_columns(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, w string").withColumn("p", N.parse(F.col("w")))
    rows = df.select("i", "p.database", "p.schema", "p.name", N.bare_key(F.col("p")), N.full_key(F.col("p"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [c[1:] for c in CASES]


def test_folding_is_python_folding(spark):
    letters = ["µ", "ß", "ŉ", "ſ", "ǰ", "Σ", "İ", "A", "ﬃ"]
    got = spark.createDataFrame([(x,) for x in letters], "x string").select("x", N.fold_key(F.col("x"))).collect()
    assert all(b == a.casefold() for a, b in got)


@pytest.mark.parametrize("written, key", [("tcp:HOST,1433", "host.corp"), (r"Db1\SQL", "db1.corp"), ("a.b", "a.b"), ("", "")])
def test_server_key(spark, written, key):
    assert spark.range(1).select(N.server_key(F.lit(written), ".corp")).first()[0] == key


def test_source_strength(spark):
    df = spark.createDataFrame([(s,) for s in ["unresolved", "system", "written", "odd", "module_schema", "default_schema"]], "s string")
    assert [r[0] for r in df.orderBy(N.source_rank(F.col("s"))).collect()] == ["written", "module_schema", "default_schema", "system", "unresolved", "odd"]
