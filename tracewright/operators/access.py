"""Table matches, formal calls, inline relations, screens and connection rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rank import first_by

SP_KINDS = ("source_wrapper", "dapper", "ef")


def formal_calls(calls: DataFrame) -> DataFrame:
    """Calls that are procedures by command type, or by kind and mode."""
    return calls.filter((F.col("command_type") == "StoredProcedure") | (F.col("kind").isin(*SP_KINDS) & (F.col("mode") == "stored_procedure")))


def project_calls(calls: DataFrame, sources: DataFrame) -> DataFrame:
    """Procedure and database of formal calls: the record's own, the connection's, else ``unknown``."""
    joined = calls.join(sources.select("connection", F.col("database").alias("source_database")), "connection", "left")
    filled = lambda c: F.when(c != "", c)
    return joined.select("call_id", F.col("text").alias("procedure"), F.coalesce(filled(F.col("database")), filled(F.col("source_database")), F.lit("unknown")).alias("database_name"))


def table_match(targets: DataFrame, question: tuple[str, str, str], own: Column) -> DataFrame:
    """``targets(database, schema, name)`` that answer a question of (database, schema, name) keys.

    Databases and schemas conflict only where both are known. ``unproven_schema``: the target states none;
    ``stated_database``: it names another than its holder's own, which is known.
    """
    database, schema, name = (q.lower() for q in question)
    held = F.when(F.col("database") != "", F.col("database")).otherwise(own)
    ok = F.lower("name") == name
    if database:
        ok = ok & ((held == "") | (F.lower(held) == database))
    if schema:
        ok = ok & ((F.col("schema") == "") | (F.lower("schema") == schema))
    other = (own != "") & (F.lower(held) != F.lower(own))
    return targets.filter(ok).withColumn("unproven_schema", F.col("schema") == "").withColumn("stated_database", F.when(other, held))


def connection_of(variables: DataFrame, sources: DataFrame) -> DataFrame:
    """``variables(var_id, name)`` with the source of exactly that name, else of the name in another case."""
    s = sources.select(F.col("name").alias("source_name"), "database")
    joined = variables.join(s, F.lower("name") == F.lower("source_name"), "left")
    return first_by(joined.select("var_id", "name", "source_name", "database"), ["var_id"], (F.col("name") != F.col("source_name")).cast("int"), F.col("source_name")).select("var_id", "database")


def parsed_over_regex(regex_rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows found by pattern, but those of texts that were parsed, and the parsed rows."""
    return regex_rows.join(parsed.select("file", "text").distinct(), ["file", "text"], "left_anti").withColumn("reason", F.lit("inline_sql_regex")).unionByName(parsed.withColumn("reason", F.lit("inline_sql_parsed")))


def rated_relations(relations: DataFrame, invocations: DataFrame) -> DataFrame:
    """Relations with the evidence of the first invocation of their span."""
    first = first_by(invocations, ["path", "start", "end"], F.col("ord")).select("path", "start", "end", "evidence")
    return relations.join(first, ["path", "start", "end"], "left")


def handled_events(methods: DataFrame, controls: DataFrame) -> DataFrame:
    """Methods that are handlers of the paired view's controls. ``controls(view, events MAP)``."""
    events = controls.select("view", F.explode("events").alias("event", "method"))
    return methods.join(events.select("view", "method").distinct(), ["view", "method"], "left_semi")


def view_texts(tables: DataFrame, views: DataFrame, most: int = 8000) -> DataFrame:
    return tables.select("name").distinct().join(views, "name").select("name", F.substring("definition", 1, most).alias("definition"))


def program_screens(views: DataFrame, controllers: DataFrame, actions: DataFrame) -> DataFrame:
    """``views(view, folder)``, ``controllers(controller, declared)``, ``actions(controller, action, method)``.

    A view's controller has the folder's name and is declared once; its actions are the screen's.
    """
    only = controllers.groupBy("controller").agg(F.count("*").alias("n")).filter("n = 1").select("controller")
    placed = views.join(only, F.lower("folder") == F.lower("controller"))
    return placed.join(actions, "controller").select("view", "controller", "action", "method")


def anchored_actions(anchors: DataFrame, actions: DataFrame) -> DataFrame:
    """Anchors with the method of their action, if one method alone has the name in its controller."""
    one = actions.groupBy("controller", "action").agg(F.countDistinct("method").alias("n"), F.first("method").alias("method")).filter("n = 1").drop("n")
    return anchors.join(one, ["controller", "action"], "left")


def nearest_reason(uses: DataFrame, reasons: DataFrame) -> DataFrame:
    """``uses(use_id, file, line)`` with the reason in their file that is nearest by line, the earlier of two.

    Reasons and uses meet in one order of lines, the last reason before a use and the first after it; a reason without a
    line comes after all others.
    """
    held = reasons.groupBy("file", "line").agg(F.min("reason").alias("reason")).select("file", "line", F.lit(None).cast(uses.schema["use_id"].dataType).alias("use_id"), F.struct(F.col("line").alias("at"), "reason").alias("r"), F.lit(0).alias("kind"))
    rows = held.unionByName(uses.select("file", "line", "use_id", F.lit(None).cast(held.schema["r"].dataType).alias("r"), F.lit(1).alias("kind"))).filter("file is not null")
    stated = F.when(F.col("line").isNotNull(), F.col("r"))
    # both from the start of their frame: a frame up to the end is gone through again for each row
    forth, back = (W.partitionBy("file").orderBy(*o).rowsBetween(W.unboundedPreceding, W.currentRow) for o in (("line", "kind"), (F.desc("line"), F.desc("kind"))))
    found = rows.withColumns({
        "before": F.last(stated, ignorenulls=True).over(forth),
        "after": F.last(stated, ignorenulls=True).over(back),
        "other": F.first(F.when(F.col("line").isNull(), F.col("r")), ignorenulls=True).over(W.partitionBy("file")),
    })
    last = lambda c: (c.isNull(), c)
    ranked = lambda r: F.when(r.isNotNull(), F.struct(*[x.alias(f"c{i}") for i, x in enumerate([*last(F.abs(F.col("line") - r["at"])), *last(r["at"]), *last(r["reason"])])]))
    best = F.least(ranked(F.col("before")), ranked(F.col("after")), ranked(F.col("other")))
    return found.filter("kind = 1").select("use_id", best.alias("b")).filter("b is not null").groupBy("use_id").agg(F.min("b").alias("b")).select("use_id", F.col("b.c5").alias("reason"))


def parent_application(sites: DataFrame) -> DataFrame:
    """``sites(site, origin, path)`` -> the site of the longest proper path prefix, or why there is none.

    Of the sites at a path only the least and the most are carried, each with the next one for a site that is itself
    there: whether there are several is all that has to be known of their number.
    """
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 2), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n + 1), "/"))
    at = sites.filter("site is not null and path is not null").select("site", "origin", F.col("path").alias("up"))
    ends = at.groupBy("origin", "up").agg(F.min("site").alias("least"), F.max("site").alias("most"))
    inner = at.join(ends, ["origin", "up"])
    inner = inner.groupBy("origin", "up").agg(F.min(F.when(F.col("site") > F.col("least"), F.col("site"))).alias("least2"), F.max(F.when(F.col("site") < F.col("most"), F.col("site"))).alias("most2"))
    child = sites.select("site", "origin", F.explode(F.when(F.size(F.split("path", "/")) > 1, above)).alias("up"))
    joined = child.join(ends.join(inner, ["origin", "up"]), ["origin", "up"])
    other = lambda one, two: F.when(F.col("site").eqNullSafe(F.col(one)), F.col(two)).otherwise(F.col(one)).alias(one)
    met = joined.select("site", F.length("up").alias("len"), other("least", "least2"), other("most", "most2")).filter("least is not null")
    met = met.groupBy("site", "len").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found = met.groupBy("site").agg(F.max(F.struct("len", "least", "most")).alias("b")).select("site", F.col("b.least").alias("parent"), (F.col("b.least") != F.col("b.most")).alias("several"))
    several = F.col("several")
    return sites.select("site").join(found, "site", "left").select("site", F.when(~several, F.col("parent")).alias("parent"), F.when(several, "ambiguous").when(~several, "").otherwise("root").alias("reason"))


def select_overload(calls: DataFrame, operations: DataFrame) -> DataFrame:
    """``calls(call_id, name, n_args)`` against ``operations(name, identity, required, declared)``.

    Exact arity first, else one whose required arguments are given; several are ambiguous. Operations are summed up once
    for each name and number of arguments that is called, however many calls there are.
    """
    made = calls.select("call_id", F.lower("name").alias("called"), "n_args")
    asked = made.select("called", "n_args").distinct()
    joined = asked.join(operations.select(F.lower("name").alias("called"), "identity", "required", "declared"), "called")
    fit = F.when(F.col("declared") == F.col("n_args"), 0).when((F.col("required") <= F.col("n_args")) & (F.col("n_args") < F.col("declared")), 1)
    of = lambda k: F.col("fit") == k
    summed = joined.withColumn("fit", fit).groupBy(F.col("called").alias("key"), F.col("n_args").alias("args")).agg(
        F.count_if(of(0)).alias("n0"), F.count_if(of(1)).alias("n1"), F.min(F.when(of(0), F.col("identity"))).alias("id0"), F.min(F.when(of(1), F.col("identity"))).alias("id1")
    )
    met = made.join(summed, (F.col("called") == F.col("key")) & F.col("n_args").eqNullSafe(F.col("args")), "left")
    sums = met.groupBy("call_id").agg(
        F.max(F.col("key").isNotNull()).alias("named"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1")], *[F.min(c).alias(c) for c in ("id0", "id1")]
    )
    found = sums.select("call_id", "named", F.when(F.col("n0") > 0, F.col("n0")).otherwise(F.col("n1")).alias("n"), F.when(F.col("n0") > 0, F.col("id0")).otherwise(F.col("id1")).alias("identity"))
    reason = F.when(~F.col("named"), "unresolved_method").when(F.col("n") == 0, "no_matching_overload").when(F.col("n") > 1, "ambiguous_overload").otherwise("")
    return found.select("call_id", F.when(F.col("n") == 1, F.col("identity")).alias("identity"), reason.alias("reason"))


def overrides(base: DataFrame, environment: DataFrame) -> DataFrame:
    """Entries of environment files that the base file does not have with that value; reported and not applied."""
    return environment.join(base.select("key", "value"), ["key", "value"], "left_anti")


def contract_fingerprint(operations: DataFrame) -> DataFrame:
    """SHA-256 of each contract's operations in canonical order, whatever the order of its rows."""
    row = F.concat_ws("\x1e", "identity", "mode", F.col("required").cast("string"))
    return operations.groupBy("contract").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\x1f"), 256).alias("fingerprint"))


def possible_callers(unresolved: DataFrame, reached: DataFrame) -> DataFrame:
    """Unresolved calls of which a candidate class is among those reached. ``unresolved(call_id, candidates)``."""
    return unresolved.select("call_id", F.explode("candidates").alias("class_name")).join(reached.select("class_name").distinct(), "class_name", "left_semi").select("call_id").distinct()


def wrapper_summary(rows: DataFrame) -> DataFrame:
    """Totals of wrapper observations by status, one row."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "source_wrapper").alias("source"), F.count_if(F.col("status") == "explicit_selected").alias("selected"), F.count_if(F.col("status").startswith("ambiguous")).alias("ambiguous"))


def action_name(method: Column, attribute: Column) -> Column:
    """Routed name of a method: [ActionName], else the name without ``Async``."""
    return F.coalesce(F.when(attribute != "", attribute), F.regexp_replace(method, "(?<=.)Async$", ""))


def route(controller_route: Column, action_route: Column, controller: Column, action: Column) -> Column:
    """Route of an endpoint; an action's route from the root stands alone, tokens are filled in."""
    base = F.when(action_route.startswith("/") | action_route.startswith("~/"), F.regexp_replace(action_route, "^~?/", "")).otherwise(F.concat_ws("/", F.when(controller_route != "", controller_route), F.when(action_route != "", action_route)))
    filled = F.regexp_replace(F.regexp_replace(base, r"(?i)\[controller\]", F.regexp_replace(controller, "Controller$", "")), r"(?i)\[action\]", action)
    return F.concat(F.lit("/"), filled)


def embedded_target(text: Column) -> Column:
    """The procedure that a text executes: the first EXEC outside quotes, else a lone identifier."""
    bare = F.regexp_replace(F.regexp_replace(text, r"'(?:[^']|'')*'", "''"), r"--[^\n]*|/\*[\s\S]*?\*/", " ")
    called = F.regexp_extract(bare, r"(?i)\bEXEC(?:UTE)?\s+(?!AS\b)(?:@\w+\s*=\s*)?((?:\[[^\]]+\]|\w+)(?:\.(?:\[[^\]]+\]|\w+)?){0,3})", 1)
    alone = F.regexp_extract(bare, r"^\s*((?:\[[^\]]+\]|\w+)(?:\.(?:\[[^\]]+\]|\w+)?){0,3})\s*$", 1)
    return F.when(called != "", called).otherwise(alone)


def database_of_key(lookups: DataFrame, table: DataFrame) -> DataFrame:
    """``lookups(lookup_id, key, has_table)`` against ``table(key, database)`` -> ``(lookup_id, database, reason)``.

    A file without a lookup table answers the key itself; one with a table that lacks the key answers nothing.
    """
    joined = lookups.join(table, "key", "left")
    database = F.when(F.col("has_table"), F.col("database")).otherwise(F.col("key"))
    return joined.select("lookup_id", database.alias("database"), F.when(database.isNull(), "connection_key_not_found").otherwise("").alias("reason"))


def contract_revisions(contracts: DataFrame, accepted: DataFrame) -> DataFrame:
    """``contracts(contract, fingerprint)`` against ``accepted(contract, fingerprint, revision)`` -> ``(contract, revision, state)``.

    A fingerprint that was accepted keeps its first revision; another one is the next revision of its contract, and
    what was accepted is never changed.
    """
    same = accepted.groupBy("contract", "fingerprint").agg(F.min("revision").alias("held"))
    last = accepted.groupBy("contract").agg(F.max("revision").alias("last"))
    joined = contracts.join(same, ["contract", "fingerprint"], "left").join(last, "contract", "left")
    state = F.when(F.col("held").isNotNull(), "reused").when(F.col("last").isNotNull(), "new_revision").otherwise("new_contract")
    return joined.select("contract", F.coalesce("held", F.col("last") + 1, F.lit(1)).alias("revision"), state.alias("state"))
