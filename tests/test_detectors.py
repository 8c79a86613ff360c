"""Procedure calls and connections of C# texts."""

import pytest

from tracewright.functions import pages


def found(text, kind):
    return {(name, detail) for k, name, detail, _, _ in pages.csharp(text) if k == kind}


@pytest.mark.parametrize("text, want", [
    ('db.ExecuteSP("dbo.usp_Orders", p);', {("dbo.usp_Orders", "wrapper")}),
    ('string sp = "usp_Load"; helper.RunProcedure(sp, 1);', {("usp_Load", "wrapper")}),
    ('string sp = "usp_A"; sp = "usp_B"; helper.RunProcedure(sp);', set()),
    ('conn.Query<Order>("usp_Q", new { a = 1 }, commandType: CommandType.StoredProcedure);', {("usp_Q", "dapper"), ("usp_Q", "command_type")}),
    ('await conn.ExecuteAsync("EXEC usp_E @a", new { a });', {("usp_E", "dapper"), ("usp_E", "exec_text")}),
    ('conn.Query<Order>("SELECT * FROM t1");', set()),
    ('ctx.Orders.FromSqlRaw("EXECUTE dbo.usp_F {0}", 1);', {("dbo.usp_F", "entity_framework"), ("dbo.usp_F", "exec_text")}),
    ('const string N = "usp_V"; var c = new SqlCommand(N, conn); c.CommandType = CommandType.StoredProcedure;', {("usp_V", "variable"), ("usp_V", "command_type")}),
    ('// db.ExecuteSP("usp_No");', set()),
])
def test_procedure_calls(text, want):
    assert found(text, "procedure_call") == want


@pytest.mark.parametrize("text, want", [
    ('var c = new SqlConnection(ConfigurationManager.ConnectionStrings["Main"].ConnectionString);', {("c", "connection_strings:Main")}),
    ('string s = Configuration.GetConnectionString("Pur"); var c = new SqlConnection(s);', {("c", "connection_strings:Pur")}),
    ('var f = new SQLFunc("PUR");', {("f", "connection_strings:PUR")}),
    ('var c = new SqlConnection("Server=a;Database=b");', {("c", "text:Server=a;Database=b")}),
    ('_s = _configuration["ConnectionStrings:Hr"]; this.c = new SqlConnection(_s);', {("c", "root:Hr")}),
    ('var h = new DbHelper(AppSettings["Key"]);', {("h", "app_settings:Key")}),
    ('private readonly OrderContext _db;', {("_db", "context:OrderContext")}),
    ('var c = new SqlConnection(Make());', {("c", "unresolved:dynamic_connection_source")}),
])
def test_connections(text, want):
    assert found(text, "connection") == want
