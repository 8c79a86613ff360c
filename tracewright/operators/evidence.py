"""Evidence rating of database invocations, as decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Reasons and status in the order in which the conditions are tried.
PROVEN, LIKELY, UNRESOLVED = "proven", "likely", "unresolved"


def gate_reason(row: dict[str, Column]) -> Column:
    """Reason of the first gate that fails before any catalog is asked; null if all are passed."""
    return (
        F.when(row["command_type"] == "unknown", "command_type_unresolved")
        .when(~row["sink_known"], "terminal_sink_unresolved")
        .when(~row["is_literal"], "dynamic_command_text")
        .when((row["mode"] == "unknown") & row["procedure_like"], "procedure_prefix_without_mode")
        .when(row["mode"] == "unknown", "command_type_unresolved")
    )


def rate(invocations: DataFrame) -> DataFrame:
    """``(invocation_id, evidence, reason)`` of invocations with their catalog facts.

    Columns: command_type, sink_known, is_literal, mode (unknown, inline, stored_procedure), procedure_like,
    database (null if unknown), connection_state ('', unresolved, ambiguous), in_catalog, match_reason, n_databases.
    """
    c = {n: F.col(n) for n in invocations.columns}
    gate = gate_reason(c)
    known = c["database"].isNotNull()
    evidence = (
        F.when(gate.isNotNull(), UNRESOLVED)
        .when(c["mode"] == "inline", PROVEN)
        .when(known & c["in_catalog"], PROVEN)
        .when(known, UNRESOLVED)
        .when(c["connection_state"] != "", UNRESOLVED)
        .when(c["n_databases"] == 1, LIKELY)
        .otherwise(UNRESOLVED)
    )
    reason = (
        F.when(gate.isNotNull(), gate)
        .when(c["mode"] == "inline", "inline_sql")
        .when(known & c["in_catalog"], c["match_reason"])
        .when(known, "not_in_resolved_catalog")
        .when(c["connection_state"] == "unresolved", "connection_source_unresolved")
        .when(c["connection_state"] == "ambiguous", "ambiguous_connection_source")
        .when(c["n_databases"] == 1, "unique_across_catalogs")
        .when(c["n_databases"] == 0, "unknown_database_source")
        .otherwise("ambiguous_cross_database")
    )
    return invocations.select("invocation_id", evidence.alias("evidence"), reason.alias("reason"))


def wrapper_gate(status: Column, source_available: Column, sink_known: Column, mode: Column, is_literal: Column) -> Column:
    """Reason of a wrapper call's first failing gate; '' if it goes to the catalog, null if it is no invocation."""
    return (
        F.when(status == "not_applicable", None)
        .when(~source_available & (status == "ambiguous_overload"), "ambiguous_overload")
        .when(~source_available & (status == "explicit_selected") & ~sink_known, "wrapper_contract_sink_unresolved")
        .when(~source_available & (status == "explicit_selected") & (mode == "unknown"), "wrapper_mode_unresolved")
        .when(~source_available & (status == "explicit_selected") & (mode == "inline") & is_literal, "inline_sql")
        .when(~source_available & (status == "explicit_selected") & is_literal, "")
        .when(~source_available, "wrapper_source_unavailable")
        .when(~sink_known, "terminal_sink_unresolved")
        .when(mode == "unknown", "command_type_unresolved")
        .when(~is_literal, "dynamic_command_text")
        .otherwise("")
    )


def command_mode(role: Column, raw: Column, default: Column) -> Column:
    """Mode of a call: by its role at rating time, by the raw fact, by the default, else a reason."""
    known = lambda x: x.isin("inline", "stored_procedure")
    return F.when(known(role), role).when(known(raw), raw).when(known(default), default).otherwise("call_site_requires_explicit_stored_procedure_mode")


def attribution(database: Column, n_candidates: Column) -> Column:
    return F.when(F.coalesce(database, F.lit("")) != "", "resolved").when(n_candidates > 0, "candidate").otherwise("unresolved")


def observed_calls(calls: DataFrame) -> DataFrame:
    """Whether any call of a wrapper method touched a database receiver; a method without calls has no row."""
    return calls.groupBy("class_name", "method_name").agg(F.bool_or("touches_database").alias("observed"))


def bound_target(calls: DataFrame, implementers: DataFrame) -> DataFrame:
    """``calls(call_id, interface, method)`` against ``implementers(interface, method, class_name, mapped)``.

    One implementer binds if it maps the method; none or several leave a reason.
    """
    joined = calls.join(implementers, ["interface", "method"], "left").groupBy("call_id").agg(F.count("class_name").alias("n"), F.min("class_name").alias("c"), F.min("mapped").alias("mapped"))
    reason = F.when(F.col("n") == 0, "no_local_implementer").when(F.col("n") > 1, "ambiguous_implementation").when(~F.col("mapped"), "unmapped_implementation").otherwise("")
    return joined.select("call_id", F.when(reason == "", F.col("c")).alias("target_class"), reason.alias("reason"))


def _jump(steps: DataFrame, moves: DataFrame, rounds: int) -> DataFrame:
    """``steps(name, at)`` along ``moves(at, to)``, both doubled each round, until nothing moves or ``rounds`` are over."""
    for _ in range(rounds):
        ahead = cut(steps.join(moves, "at", "left"))
        steps = ahead.select("name", F.coalesce("to", "at").alias("at"))
        if ahead.filter("`to` is not null").isEmpty():
            break
        moves = cut(moves.alias("m").join(moves.alias("n"), F.col("m.to") == F.col("n.at"), "left").select(F.col("m.at"), F.coalesce("n.to", "m.to").alias("to")))
    return steps


def flatten_aliases(aliases: DataFrame) -> DataFrame:
    """``aliases(name, target)``, a row for each name -> ``(name, final)``: the end of each chain of delegations.

    A walk stops before a name that it has been at, so on a circle it ends with the name before the one it came in by.
    Jumps double each round, so a chain of any length takes the logarithm of the number of names.
    """
    moves = cut(aliases.select(F.col("name").alias("at"), F.col("target").alias("to")))
    rounds = max(1, moves.count()).bit_length() + 1
    ends = _jump(aliases.select("name", F.col("target").alias("at")), moves, rounds)
    # after as many steps as there are names, who still can go on is on a circle
    circle = cut(ends.select("at").distinct().join(moves, "at"))
    if circle.isEmpty():
        return ends.select("name", F.col("at").alias("final"))
    around = circle.select("at")
    # the first name on a circle that each walk meets, the name itself for those on it
    entry = _jump(aliases.select("name", F.col("name").alias("at")), cut(moves.join(around, "at", "left_anti")), rounds)
    before = circle.select(F.col("to").alias("entry"), F.col("at").alias("last"))
    stopped = entry.withColumnRenamed("at", "entry").join(before, "entry").select("name", "last")
    return ends.join(stopped, "name", "left").select("name", F.coalesce("last", "at").alias("final"))


def branch_compatible(branch: Column, other: Column) -> Column:
    """Whether one branch context is a prefix of the other."""
    starts = lambda a, b: F.slice(b, F.lit(1), F.size(a)) == a
    return F.when(F.size(branch) <= F.size(other), starts(branch, other)).otherwise(starts(other, branch))
