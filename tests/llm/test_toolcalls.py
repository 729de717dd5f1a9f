import json
from collections import defaultdict

from tidegate.llm import toolcalls

CALLS = "conv_id long, call_id string, name string, arguments string, position long, after array<string>"
RESULTS = "call_id string, position long, content string"
SCHEMA = {"t": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}}, "required": ["x"], "additionalProperties": False}}


def test_query(spark, sf_dir):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    answer = {(c, t - 1): x for c, t, role, x in turns if role == "assistant"}
    asked = defaultdict(list)
    for c, t, role, x in turns:
        if role == "user":
            asked[c].append((t, x))
    want = {}
    for c, calls in asked.items():
        for k, (t, x) in enumerate(sorted(calls), 1):
            after = [f"call_{c}_{t - 2}"] if t >= 2 else []
            bad = ([] if (c, t) in answer else ["no result"]) + [f"missing dependency {a}" for a in after if int(a.split("_")[2]) not in dict(calls)]
            want[f"call_{c}_{t}"] = {"arguments": {"after": after, "chars": len(x), "text": x, "turn": t}, "call_id": f"call_{c}_{t}", "errors": bad,
                                     "name": "answer", "result": answer.get((c, t)), "step": k}
    rows = [r for r in toolcalls.op3_tool_calls(spark, sf_dir).collect() if "no call" not in r.errors]
    assert {r.call_id: r.record for r in rows} == {k: toolcalls.canonical(v) for k, v in want.items()}


def test_turns_of_other_roles_are_carried(spark, sf_dir):
    turns = [r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect() if r.role not in ("user", "assistant")]
    rows = [json.loads(r.record) for r in toolcalls.op3_tool_calls(spark, sf_dir).collect() if '"role":' in r.record and r.errors == ["no call"]]
    assert turns and sorted((x["turn"], x["role"], x["result"]) for x in rows if "role" in x) == sorted((r.turn, r.role, r.text or "") for r in turns)
    odd = spark.createDataFrame([(1, 0, None, None), (1, 1, "tool", "x"), (1, 2, "user", "y")], "conv_id int, turn int, role string, text string")
    assert sorted(json.loads(r.record)["turn"] for r in toolcalls.turns_without_call(odd).collect()) == [0, 1]


def linked(spark, calls, results=()):
    frame = toolcalls.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), RESULTS), SCHEMA)
    return sorted(frame.collect(), key=lambda r: (str(r.call_id), r.step is None, str(r.step)))


def test_order_and_cycles(spark):
    ok = '{"x":1}'
    rows = {r.call_id: r for r in linked(spark, [
        (1, "a", "t", ok, 0, ["c"]), (1, "b", "t", ok, 1, ["a"]), (1, "c", "t", ok, 2, []), (1, "d", "t", ok, 3, ["e"]), (1, "e", "t", ok, 4, ["d"]),
        (1, "f", "t", ok, 5, ["e"]), (2, "g", "t", ok, 7, ["zz", "zz"]), (2, "h", "t", ok, 6, None)])}
    assert {k: r.step for k, r in rows.items()} == {"c": 1, "a": 2, "b": 3, "d": None, "e": None, "f": None, "h": 1, "g": 2}
    assert "dependency cycle" in rows["f"].errors and "missing dependency zz" in rows["g"].errors


def test_long_conversation_is_ranked_by_slices(spark):
    rows = linked(spark, [(1, f"c{i:05d}", "t", "{}", i, [f"c{i - 1:05d}"] if i else []) for i in range(1500)])
    assert [r.step for r in rows] == list(range(1, 1501))


def test_odd_rows(spark):
    rows = linked(spark, [
        (1, "a", "t", '{"x":1}', 0, []), (1, "a", "t", '{"x":2}', 9, []), (1, "r", "t", '{"x":3}', 2, []), (1, "r", "t", '{"x":3}', 2, []),
        (None, None, "t", "{}", None, None), (3, "b", "u", "{", None, []), (3, "q", "t", '{"x":-1,"y":2}', 1, [])],
        [("a", 5, "late"), ("a", 4, "first"), ("lost", 1, "x"), (None, 2, "y")])
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.call_id].append(r)
    first, second = by_id["a"]
    assert first.step == 1 and json.loads(first.record)["result"] == "first" and "duplicate identifier" in second.errors
    assert len(by_id["r"]) == 2 and by_id["lost"][0].errors == ["no call"]
    assert "arguments: not JSON" in by_id["b"][0].errors
    assert [e for e in by_id["q"][0].errors if e.startswith("/")] == ["/y: unknown", "/x: below 0"]
    assert linked(spark, []) == []


def test_arguments_that_no_record_can_hold(spark):
    deep = "[" * 200_000 + "]" * 200_000
    odd = {"s": '{"x":"\\ud800"}', "k": '{"\\udfff":1}', "n": '{"x":NaN}', "i": '{"x":1e999}', "d": deep, "l": json.dumps({"x": 1, "y": "z" * 1_000_000}), "m": None}
    calls = spark.createDataFrame([(1, k, "t", v, i, []) for i, (k, v) in enumerate(odd.items())], CALLS)
    results = spark.createDataFrame([(k, 9, "ok") for k in odd], RESULTS)
    rows = {r.call_id: r for r in toolcalls.link_tool_calls(calls, results, SCHEMA).collect()}
    assert set(rows) == set(odd) and not any(r.valid for r in rows.values())
    assert rows["s"].errors == ["/x: not integer"] and json.loads(rows["s"].record)["arguments"] == {"x": "\ud800"}
    assert rows["k"].errors == ["/x: missing", "/\\udfff: unknown"] and json.loads(rows["k"].record)["arguments"] == {"\udfff": 1}
    assert {k: rows[k].errors for k in "nim"} == dict.fromkeys("nim", ["arguments: not JSON"])
    assert rows["d"].errors == ["arguments: nested too deeply"] and len(rows["l"].record) > 1_000_000
    assert all(json.loads(r.record)["arguments"] is None for k, r in rows.items() if k in "nimd")
