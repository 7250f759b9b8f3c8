import json

from pyspark.sql import functions as F

import edge
from readaloud.llm import tool_calls as T

CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"
TOOLS = {"get": {"required": ["city"], "properties": {"city": {"type": "string", "minLength": 2}, "days": {"type": "integer", "minimum": 1, "maximum": 9},
                                                     "unit": {"type": "string", "enum": ["c", "f"]}, "exact": {"type": "boolean"}}},
         "none": {"properties": {}}}


def link(spark, calls, results):
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    for name in (*edge.CLASH, "status", "level", "first", "n_calls"):
        c, r = c.withColumn(name, F.lit("clash")), r.withColumn(name, F.lit("clash"))
    return T.link_calls(c, r, TOOLS).collect()


def test_links_levels_and_canonical_json(spark):
    calls = [(1, "c", 3, "get", '{ "days": 2, "city" : "Köln\\u00e9" }', ["a", "b"]), (1, "a", 1, "get", '{"city":"Rom"}', []),
             (1, "b", 2, "none", "{}", ["a"]), (2, "a", 1, "get", '{"city":"Oslo","unit":"c","exact":true}', None)]
    results = [(1, "a", 4, "first"), (1, "a", 5, "second"), (1, "c", 9, "line\n\"q\""), (2, "zz", 1, "nobody asked")]
    got = {(r.conv_id, r.call_id): r for r in link(spark, calls, results)}
    assert {k: (r.status, r.level, r.n_results, r.errors) for k, r in got.items()} == {
        (1, "a"): ("linked", 0, 2, []), (1, "b"): ("unanswered", 1, 0, []), (1, "c"): ("linked", 2, 1, []),
        (2, "a"): ("unanswered", 0, 0, []), (2, "zz"): ("orphan", None, 1, ["call_id: no such call"])}
    assert got[1, "c"].json == '{"arguments":{"city":"Kölné","days":2},"id":"c","name":"get","result":"line\\n\\"q\\""}'
    assert json.loads(got[1, "a"].json)["result"] == "first"


def test_argument_checks(spark):
    cases = [('{"city":"Rom"}', []), ('{"city":"R"}', ["city: beyond its minLength"]), ('{"days":1}', ["city: missing"]),
             ('{"city":5}', ["city: not of type string"]), ('{"city":"Rom","days":0}', ["days: beyond its minimum"]),
             ('{"city":"Rom","days":10}', ["days: beyond its maximum"]), ('{"city":"Rom","days":"3"}', ["days: not of type integer"]),
             ('{"city":"Rom","unit":"k"}', ["unit: not a listed value"]), ('{"city":"Rom","exact":1}', ["exact: not of type boolean"]),
             ('{"city":"Rom","other":1}', ["arguments: unknown name"]), ('{"city":', ["arguments: not a JSON object"]),
             ('[1]', ["arguments: not a JSON object"]), (None, ["arguments: not a JSON object"]), ("", ["arguments: not a JSON object"]),
             ('{"city":null}', ["city: not of type string"])]
    got = {r.turn: r.errors for r in link(spark, [(1, f"c{i}", i, "get", a, []) for i, (a, _) in enumerate(cases)], [])}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_nulls_repeats_cycles_and_missing_predecessors(spark):
    good = '{"city":"Rom"}'
    calls = [(1, "a", 1, "get", good, ["b"]), (1, "b", 2, "get", good, ["a"]), (1, "c", 3, "get", good, ["b"]), (1, "d", 4, "get", good, ["gone"]),
             (None, "a", 1, "get", good, []), (1, None, 1, None, good, []), (2, "x", 1, "get", good, []), (2, "x", 2, "get", good, []), (3, "s", 1, "get", good, ["s"])]
    results = [(None, "a", 1, "r"), (1, None, 1, "r"), (2, "x", 3, "r"), (2, "x", 3, "r"), (1, "d", None, None)]
    rows = link(spark, calls, results)
    got = sorted(((r.conv_id, r.call_id, r.turn, r.status, r.level, r.n_results, tuple(r.errors)) for r in rows), key=repr)
    assert got == sorted([
        (1, "a", 1, "unanswered", None, 0, ("after: part of a cycle",)), (1, "b", 2, "unanswered", None, 0, ("after: part of a cycle",)),
        (1, "c", 3, "unanswered", None, 0, ("after: part of a cycle",)), (1, "d", 4, "linked", 0, 1, ("after: no such call",)),
        (None, "a", 1, "unanswered", None, 0, ("call_id: none",)), (1, None, 1, "unanswered", None, 0, ("call_id: none", "name: unknown tool")),
        (2, "x", 1, "linked", 0, 2, ("call_id: repeated",)), (2, "x", 2, "linked", 0, 2, ("call_id: repeated",)),
        (3, "s", 1, "unanswered", None, 0, ("after: part of a cycle",)),
        (None, "a", 1, "orphan", None, 1, ("call_id: no such call",)), (1, None, 1, "orphan", None, 1, ("call_id: no such call",))], key=repr)


def test_long_chains_and_joins_of_chains(spark):
    good = '{"city":"Rom"}'
    calls = [(1, f"c{i}", i, "get", good, [f"c{i - 1}"] if i else []) for i in range(70)]
    calls += [(1, "j", 99, "get", good, ["c69", "c3"]), (1, "k", 100, "get", good, ["j"]), (1, "l", 101, "get", good, ["k", "c5"]),
              (1, "x", 1, "get", good, ["y"]), (1, "y", 1, "get", good, ["x", "c1"]), (1, "z", 1, "get", good, ["x"])]
    got = {r.call_id: r.level for r in T.topological_levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {**{f"c{i}": i for i in range(70)}, "j": 70, "k": 71, "l": 72}


def test_a_repeated_call_id_is_never_gathered(spark, monkeypatch):
    plans, stored = [], T.stored
    monkeypatch.setattr(T, "stored", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or stored(df, name))
    calls = [(1, f"c{i}", i, "get", "{}", []) for i in range(5)] + [(1, "hot", 9, "get", "{}", [f"c{i % 5}", None]) for i in range(40)]
    calls += [(1, "hot", 9, "get", "{}", None), (1, "last", 10, "get", "{}", ["hot", "hot"]), (1, "end", 11, "get", "{}", ["last", "c1"])]
    got = {r.call_id: r.level for r in T.topological_levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {**{f"c{i}": 0 for i in range(5)}, "hot": 1, "last": 2, "end": 3}
    assert plans and not any("collect_list" in p for p in plans)


def test_every_result_is_a_row(spark):
    good = '{"city":"Rom"}'
    calls = [(1, "a", 1, "get", good, []), (1, "b", 2, "none", "{}", ["a"]), (1, "x", 4, "none", "{}", []), (1, "x", 3, "get", good, []),
             (1, "one", 7, "none", "{}", []), (1, "hot", 8, "get", good, ["b"])]
    results = [(1, "a", 5, "second"), (1, "a", 4, "first"), (1, "a", 5, "second"), (1, "a", None, None), (1, "x", 9, "r1"), (1, "x", 10, "r2"),
               (1, "one", 8, "only"), (1, "gone", 1, "o1"), (1, "gone", 2, "o2"), (None, "a", 1, "n")] + [(1, "hot", 20 + i, f"h{i}") for i in range(500)]
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    rows = T.link_results(c, r, TOOLS).collect()
    got = sorted(((x.call_id, x.turn, x.status, x.level, x.n_results, x.result_turn, json.loads(x.json).get("result")) for x in rows if x.call_id != "hot"), key=repr)
    assert got == sorted([
        ("a", 1, "linked", 0, 4, None, None), ("a", 1, "linked", 0, 4, 4, "first"), ("a", 1, "linked", 0, 4, 5, "second"), ("a", 1, "linked", 0, 4, 5, "second"),
        ("b", 2, "unanswered", 1, 0, None, None), ("x", 3, "linked", 0, 2, 9, "r1"), ("x", 4, "linked", 0, 2, 9, "r1"), ("x", 3, "linked", 0, 2, 10, "r2"),
        ("one", 7, "linked", 0, 1, 8, "only"), ("gone", 1, "orphan", None, 1, 1, "o1"), ("gone", 2, "orphan", None, 1, 2, "o2"),
        ("a", 1, "orphan", None, 1, 1, "n")], key=repr)
    hot = [x for x in rows if x.call_id == "hot"]
    assert sorted((x.result_turn, x.json) for x in hot) == [(20 + i, json.dumps({"arguments": {"city": "Rom"}, "id": "hot", "name": "get", "result": f"h{i}"}, separators=(",", ":"))) for i in range(500)]
    assert {(x.level, x.n_results, tuple(x.errors)) for x in hot} == {(2, 500, ())}


def test_the_query_holds_both_answers_to_one_turn(spark, tmp_path):
    from readaloud.llm import queries
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "r")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op5_tool_call_linking(spark, str(tmp_path)).collect()
    assert sorted((r.turn, r.status, r.n_results) for r in got) == [(0, "linked", 2), (0, "linked", 2), (3, "unanswered", 0)]
    assert len({r.json_sha256 for r in got}) == 3


def test_turns_become_calls(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "assistant", "early"), (1, 2, "user", "q1"), (1, 3, "assistant", "a1"), (1, 4, "assistant", "a1b"),
             (1, 90, "user", "q2"), (1, 300, "user", "q3"), (1, 400, "assistant", "a3"), (None, 0, "user", "q"), (2, None, "user", None), (2, 1, None, "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    calls, results = T.turns_as_calls(df)
    c = {(r.conv_id, r.turn): (r.call_id, r.after) for r in calls.collect()}
    assert c[1, 2] == ("call-1-2", []) and c[1, 90] == ("call-1-90", ["call-1-2"]) and c[1, 300] == ("call-1-300", ["call-1-90"])
    assert c[None, 0] == (None, []) and c[2, None] == (None, [])
    assert {(r.turn, r.call_id) for r in results.collect()} == {(1, "call-1--1"), (3, "call-1-2"), (4, "call-1-2"), (400, "call-1-300")}


def test_empty_tables(spark):
    assert link(spark, [], []) == []
    assert len(link(spark, [], [(1, "a", 1, "r")])) == 1
