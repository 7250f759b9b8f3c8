"""Tool-call linking for chat transcripts, in DataFrame expressions only.

1. Results are reduced to one row per (conversation, call id) - the first
   result and how many there are - and hash-joined to the calls by that pair.
   Both the counting and the choice of the first combine before they shuffle, so an
   identifier that a third of all results carry is one row per task. All further
   results are joined to the first call of their pair, one row each; pairs that hold
   1/64 of all results and more are dealt over 64 salts.
2. Calls are levelled topologically: a call that waits for nothing is level 0,
   any other is one above the highest it waits for. Chains of calls that wait for one
   other are followed by pointer doubling, in as many rounds as the longest
   has binary digits; only calls that wait for several settle in rounds of their own. What never settles lies on or behind a
   cycle and has no level.
3. Arguments are parsed and checked against the schema of their tool: known
   names, required names, types and limits (a subset of JSON Schema).
4. Call and result are written as canonical JSON: keys sorted, no white space.

Edge cases: a null conversation or call id links to nothing (the call is
unanswered, the result an orphan) and never enters a join; a result without a call is
an orphan row; a repeated call id is an error of each call that carries it, and each
links to the same first result, while further results link to the first such call; a predecessor that doesn't exist is an error and is
not waited for; null or malformed arguments are errors; null texts stay null; empty tables give
empty results; other columns are ignored.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: JSON Schema types and the way a variant is read as them.
TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
#: Parts into which the further results of a hot call id are dealt.
SALTS = 64


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain transcript.

    Every user turn is a call of ``answer`` that waits for the user turn before
    it; every assistant turn is a result for the latest user turn before
    it. A turn's predecessors are found by (conversation, turn) joins, so a
    conversation is never gathered.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    name = F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    asked = turns.where("role = 'user'")
    steps = turns.where("conv_id is not null and turn is not null and role in ('user', 'assistant')")
    users = stored(steps.where("role = 'user'").select("conv_id", "turn").distinct(), "user-turns")
    latest = stored(_latest_before(steps.select("conv_id", "turn").distinct(), users), "latest-user-turns")
    before = latest.withColumnRenamed("user_turn", "_user")
    calls = asked.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", name.alias("call_id"), "turn", F.lit("answer").alias("name"),
        F.to_json(F.struct(F.col("text").alias("question"), F.length("text").alias("chars"), F.col("turn").alias("turn"))).alias("arguments"),
        F.when(F.col("_user").isNull(), F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("_user")))).alias("after"))
    results = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select(
        "conv_id", F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.coalesce("_user", F.lit(-1))).alias("call_id"),
        "turn", F.col("text").alias("content"))
    return calls, results


def _latest_before(steps: DataFrame, users: DataFrame, span: int = 64) -> DataFrame:
    """(conv_id, turn, user_turn): the latest user turn before each step.

    Turns are binned; inside a bin the nearest earlier user turn is a running
    maximum over at most ``span`` distinct turns, and across bins it is the last
    of the nearest earlier bin, found over one row per bin.
    """
    from pyspark.sql.window import Window
    at = F.floor(F.col("turn") / span).alias("bin")
    flagged = steps.join(users.withColumn("user", F.lit(1)), ["conv_id", "turn"], "left").select("conv_id", "turn", at, "user")
    inside = Window.partitionBy("conv_id", "bin").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = flagged.withColumn("near", F.max(F.when(F.col("user") == 1, F.col("turn"))).over(inside))
    across = Window.partitionBy("conv_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = flagged.groupBy("conv_id", "bin").agg(F.max(F.when(F.col("user") == 1, F.col("turn"))).alias("last")) \
        .withColumn("far", F.max("last").over(across)).select("conv_id", "bin", "far")
    return near.join(bins, ["conv_id", "bin"]).select("conv_id", "turn", F.coalesce("near", "far").alias("user_turn")).where("user_turn is not null")


def _chain_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, dist, done): the start of the chain that each call stands on, and how far behind it.

    A chain runs through calls that wait for one other call; it starts at one
    that waits for none or for several. Pointers double each round, so there are
    as many rounds as the longest chain has binary digits. What is not done after
    that follows a cycle.
    """
    degree = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("needs"))
    single = F.coalesce("n", F.lit(0)) == 1
    chains = stored(nodes.select("conv_id", "call_id").join(degree, ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", F.when(single, F.col("needs")).otherwise(F.col("call_id")).alias("anchor"),
        single.cast("bigint").alias("dist"), (~single).alias("done"), F.coalesce("n", F.lit(0)).alias("n")), "call-chains")
    longest = chains.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):
        if chains.where("not done").isEmpty():
            break
        ahead = chains.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"),
                              F.col("dist").alias("more"), F.col("done").alias("ended"))
        moved = chains.where("not done").join(ahead, ["conv_id", "anchor"]).select(
            "conv_id", "call_id", F.col("next").alias("anchor"), (F.col("dist") + F.col("more")).alias("dist"),
            F.col("ended").alias("done"), "n")
        chains = stored(chains.where("done").unionByName(moved), "call-chains")
    return chains


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every settled call; calls on or behind a cycle are absent."""
    pair = ["conv_id", "call_id"]
    calls = calls.where("conv_id is not null and call_id is not null")
    nodes = stored(calls.select(*pair).distinct(), "call-nodes")
    edges = calls.select(*pair, F.explode("after").alias("needs")).distinct()
    known = nodes.select("conv_id", F.col("call_id").alias("needs"))
    edges = stored(edges.join(known, ["conv_id", "needs"]), "call-edges")
    chains = _chain_ends(nodes, edges)
    settled = stored(chains.where("n = 0").select(*pair, F.lit(0).cast("bigint").alias("level")), "levels")
    several = chains.where("n > 1").select(*pair)
    if not several.isEmpty():  # joins of chains settle in rounds, one per link between such calls
        ends = chains.select("conv_id", F.col("call_id").alias("needs"), F.when(F.col("done"), F.col("anchor")).alias("anchor"), "dist")
        waiting = stored(edges.join(several, pair).join(ends, ["conv_id", "needs"]).select(
            *pair, "anchor", (F.col("dist") + 1).alias("dist")), "call-joins")
        while True:
            at = settled.select("conv_id", F.col("call_id").alias("anchor"), "level")
            ready = waiting.join(at, ["conv_id", "anchor"], "left").groupBy(*pair).agg(
                F.count(F.lit(1)).alias("all"), F.count("level").alias("met"), F.max(F.col("level") + F.col("dist")).alias("level"))
            ready = stored(ready.where("met = all").select(*pair, "level"), "levels")
            if ready.isEmpty():
                break
            settled = stored(settled.unionByName(ready), "levels")
            waiting = stored(waiting.join(ready, pair, "left_anti"), "call-joins")
    starts = settled.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("base"))
    return chains.where("done").join(starts, ["conv_id", "anchor"]).select(*pair, (F.col("base") + F.col("dist")).alias("level"))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments under its tool's schema, as a sorted array of texts."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    checks = [F.when(value.isNull() | keys.isNull(), F.lit("arguments: not a JSON object")),
              F.when(name.isNull() | ~name.isin(*schemas), F.lit("name: unknown tool"))]
    for tool, schema in schemas.items():
        here = (name == tool) & value.isNotNull() & keys.isNotNull()
        properties = schema.get("properties", {})
        known = F.array(*[F.lit(p) for p in properties]).cast("array<string>")
        checks.append(F.when(here & (F.size(F.array_except(keys, known)) > 0), F.lit("arguments: unknown name")))
        for prop, rule in properties.items():
            field = F.try_variant_get(value, f"$['{prop}']", "string")
            kind = F.schema_of_variant(F.try_variant_get(value, f"$['{prop}']", "variant"))
            typed = F.try_variant_get(value, f"$['{prop}']", TYPES[rule["type"]])
            if prop in schema.get("required", ()):
                checks.append(F.when(here & ~F.array_contains(keys, F.lit(prop)), F.lit(f"{prop}: missing")))
            fits = {"string": kind == "STRING", "boolean": kind == "BOOLEAN", "integer": kind == "BIGINT",
                    "number": kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")}[rule["type"]]
            held = here & F.array_contains(keys, F.lit(prop))
            checks.append(F.when(held & ~F.coalesce(fits, F.lit(False)), F.lit(f"{prop}: not of type {rule['type']}")))
            limits = {"minimum": lambda v, f: v < F.lit(f), "maximum": lambda v, f: v > F.lit(f)}
            for limit, breaks in limits.items():
                if limit in rule:
                    checks.append(F.when(held & fits & breaks(typed, rule[limit]), F.lit(f"{prop}: beyond its {limit}")))
            lengths = {"minLength": lambda n, f: n < F.lit(f), "maxLength": lambda n, f: n > F.lit(f)}
            for limit, breaks in lengths.items():
                if limit in rule:
                    checks.append(F.when(held & fits & breaks(F.length(field), rule[limit]), F.lit(f"{prop}: beyond its {limit}")))
            if "enum" in rule:
                checks.append(F.when(held & fits & ~field.isin(*[v if isinstance(v, str) else json.dumps(v) for v in rule["enum"]]),
                                     F.lit(f"{prop}: not a listed value")))
    return F.sort_array(F.array_compact(F.array(*checks)))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, turn, status, level, n_results, errors, json) of every call, with its first result, and of every orphan result.

    ``calls`` has conv_id, call_id, turn, name, arguments (JSON) and after (call ids); ``results`` has conv_id, call_id, turn and content.
    """
    return _link(calls, results, schemas, every=False).drop("result_turn")


def link_results(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """The rows of ``link_calls`` and result_turn, and one such row for every further result of a call."""
    return _link(calls, results, schemas, every=True)


def _further(calls: DataFrame, results: DataFrame, facts: DataFrame) -> DataFrame:
    """Every result but the first of a call id, with the facts and the first call of that id."""
    pair = ["conv_id", "call_id"]
    several = facts.where("n_results > 1")
    asked = calls.join(several.select(*pair), pair, "left_semi").groupBy(*pair).agg(
        F.min(F.struct("turn", "name", "arguments")).alias("asked"))
    total = F.lit(facts.agg(F.sum("n_results")).first()[0] or 0)
    hot = F.col("n_results") * SALTS >= total
    salted = several.join(asked, pair).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
    dealt = results.join(F.broadcast(several.where(hot).select(*pair, F.lit(True).alias("hot"))), pair, "left")  # at most SALTS rows
    dealt = dealt.select(*pair, F.struct("turn", "content", "id").alias("result"),
                         F.when(F.col("hot"), F.pmod("id", F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    return dealt.join(salted, [*pair, "salt"]).where("result.id != first.id").drop("salt", "first").select(
        "*", "asked.*").drop("asked")


def _link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], every: bool) -> DataFrame:
    calls = stored(calls.select("conv_id", "call_id", "turn", "name", "arguments", "after"), "calls")
    results = stored(results.select("conv_id", "call_id", "turn", "content", F.monotonically_increasing_id().alias("id")), "results")
    pair = ["conv_id", "call_id"]
    linked = "conv_id is not null and call_id is not null"
    answers = stored(results.where(linked).groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content", "id")).alias("first")), "answers")
    repeats = stored(calls.where(linked).groupBy(*pair).agg(F.count(F.lit(1)).alias("n_calls")), "call-ids")
    lost = calls.where(linked).select("conv_id", "call_id", F.explode("after").alias("needs")).join(
        repeats.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti").select(
        *pair, F.lit(True).alias("lost")).distinct()
    facts = repeats.join(answers, pair, "left").join(topological_levels(calls), pair, "left").join(stored(lost, "lost-predecessors"), pair, "left")
    facts = stored(facts, "call-facts")
    joined = calls.where(linked).join(facts.withColumnRenamed("first", "result"), pair).drop("after")
    if every:
        joined = joined.unionByName(_further(calls.where(linked), results.where(linked), facts))
    joined = joined.unionByName(calls.where(f"not ({linked})").drop("after"), allowMissingColumns=True)
    errors = F.sort_array(F.array_compact(F.concat(
        argument_errors(F.col("name"), F.col("arguments"), schemas),
        F.array(F.when(F.col("n_calls") > 1, F.lit("call_id: repeated")), F.when(F.col("lost"), F.lit("after: no such call")),
                F.when(F.col("n_calls").isNull(), F.lit("call_id: none")),
                F.when(F.col("n_calls").isNotNull() & F.col("level").isNull(), F.lit("after: part of a cycle"))))))
    body = F.to_json(F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"),
        F.col("result.content").alias("result")))
    out = joined.select(
        "conv_id", "call_id", "turn", F.when(F.col("n_results").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.col("level").cast("bigint").alias("level"), F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        errors.alias("errors"), body.alias("json"), F.col("result.turn").alias("result_turn"))
    orphans = results.where(linked).join(repeats, pair, "left_anti").unionByName(results.where(f"not ({linked})")).select(
        "conv_id", "call_id", "turn", F.lit("orphan").alias("status"), F.lit(None).cast("bigint").alias("level"),
        F.lit(1).cast("bigint").alias("n_results"), F.array(F.lit("call_id: no such call")).alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"),
        F.col("turn").alias("result_turn"))
    return out.unionByName(orphans)
