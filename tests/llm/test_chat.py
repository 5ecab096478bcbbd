import json
import random
import re

from pyspark.sql import functions as F

from tabveil.llm import chat


def call(i, name="f", **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_links_order_and_checks(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", json.dumps({"content": "go", "tool_calls": [call("b", z=1, a="$a"), call("a", z="x", k=[1, {"q": 2, "b": 3}])]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "42"})),
        (1, 3, "assistant", json.dumps({"tool_calls": [call("c", "g", x="$d"), call("d", "g", x="$c"), call("e", x="$c")]})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("a", z=5)]})),
        (None, None, None, None),
        (3, 0, "user", "{not json"),
    ]
    schemas = spark.createDataFrame([("f", ["z"], {"z": "integer", "a": "string", "k": "array"})], "name string, required array<string>, types map<string,string>")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("calls", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in chat.formatted(df, schemas).collect()}
    assert got[1, 1].line == '{"content":"go","role":"assistant","tool_calls":[{"arguments":{"k":[1,{"b":3,"q":2}],"z":"x"},"id":"a","level":0,"name":"f","result_turn":2,"valid":false},{"arguments":{"a":"$a","z":1},"id":"b","level":1,"name":"f","result_turn":null,"valid":true}]}'
    assert (got[1, 1].n_calls, got[1, 1].n_linked, got[1, 1].n_valid) == (2, 1, 1)
    assert [c["level"] for c in json.loads(got[1, 3].line)["tool_calls"]] == [None, None, None]
    assert got[2, 0].n_linked == 0 and got[2, 0].n_valid == 1
    assert got[1, 2].line == '{"content":"42","role":"tool","tool_call_id":"a"}'
    assert got[None, None].line == '{"content":"","role":"unknown"}' and got[3, 0].line == '{"content":"{not json","role":"user"}'
    assert all(json.loads(r.line) for r in got.values())


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")] * 3, "conv_id long, turn long, role string, text string")
    assert chat.formatted(df).count() == 3


def test_long_chains(spark):
    n = 45
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [call(f"c{i}", **({"x": f"$c{i - 1}", "y": f"$c{i // 2}"} if i else {}))]})) for i in range(n)]
    rows += [(1, n, "assistant", json.dumps({"tool_calls": [call("p", x="$q"), call("q", x="$p", y="$c3"), call("r", x="$q")]}))]
    found = chat.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.id: r.level for r in chat.linked(found).collect()}
    assert got == {**{f"c{i}": i for i in range(n)}, "p": None, "q": None, "r": None}


LOOKS = {"integer": lambda v: type(v) is int, "string": lambda v: type(v) is str, "array": lambda v: type(v) is list}


def plain(rows):
    """What formatted gives for JSON calls, by loops over conversations."""
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    convs, out = {}, []
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    for own in convs.values():
        calls, results, tools = {}, {}, {}
        for _, turn, role, text in own:
            x = json.loads(text) if text.startswith("{") else {}
            for c in x.get("tool_calls", []) if role == "assistant" else []:
                key = (turn, c["name"], json.dumps(c["arguments"], separators=(",", ":"), ensure_ascii=False))
                if c["id"] not in calls or key < calls[c["id"]][0]:
                    calls[c["id"]] = (key, c)
            if role == "tool":
                results.setdefault(x["tool_call_id"], []).append(turn)
            for t in x.get("tools", []) if role == "system" else []:
                if t["name"] not in tools or turn < tools[t["name"]][0]:
                    tools[t["name"]] = (turn, t["parameters"])
        needs = {i: {n for n in re.findall(r'"\$([^"\\]+)"', dump(c["arguments"])) if n in calls} for i, (_, c) in calls.items()}
        level, k = {}, 0
        while new := [i for i in calls if i not in level and all(n in level for n in needs[i])]:
            level |= dict.fromkeys(new, k)
            k += 1
        info = {}
        for i, ((turn, *_), c) in calls.items():
            a, p = c["arguments"], tools.get(c["name"])
            ok = p is None or (all(r in a for r in p[1].get("required", [])) and all(n in p[1]["properties"] and LOOKS[p[1]["properties"][n]["type"]](v) for n, v in a.items()))
            info[i] = (level.get(i), min((t for t in results.get(i, []) if t > turn), default=None), ok)
        for conv, turn, role, text in own:
            x = json.loads(text) if text.startswith("{") else {}
            made = x.get("tool_calls", []) if role == "assistant" else []
            if made:
                lines = {dump({"arguments": c["arguments"], "id": c["id"], "level": info[c["id"]][0], "name": c["name"], "result_turn": info[c["id"]][1], "valid": info[c["id"]][2]}): c["id"] for c in made}
                order = sorted(lines, key=lambda j: (1 << 30 if info[lines[j]][0] is None else info[lines[j]][0], lines[j], j))
                line = '{"content":' + dump(x.get("content", "")) + ',"role":"assistant","tool_calls":[' + ",".join(order) + "]}"
                ids = [lines[j] for j in order]
            else:
                line, ids = dump({"content": x.get("content", ""), "role": "tool", "tool_call_id": x["tool_call_id"]} if role == "tool" else {"content": text, "role": role}), []
            out.append((conv, turn, role, line, len(ids), sum(info[i][1] is not None for i in ids), sum(info[i][2] for i in ids), x.get("tool_call_id") if role == "tool" else None))
    return out


def test_against_plain(spark):
    r = random.Random(4)
    rows = []
    for conv in range(30):
        tools = [{"name": n, "parameters": {"required": r.sample(["x", "y"], r.randint(0, 2)), "properties": {"x": {"type": "integer"}, "y": {"type": "string"}, "z": {"type": "array"}}}} for n in ("f", "g")]
        rows.append((conv, 0, "system", json.dumps({"tools": tools}) if conv % 3 else "be kind"))
        ids = [f"c{k}" for k in range(8)]
        for turn in range(1, 14):
            kind = r.random()
            if kind < 0.5:
                made = []
                for _ in range(r.randint(1, 3)):
                    a = {k: v for k, v in (("x", r.randint(-9, 9)), ("y", r.choice(["$" + r.choice(ids), "é\n", "plain"])), ("z", [1, {"b": True, "a": "$" + r.choice(ids)}]), ("q", 1)) if r.random() < 0.5}
                    made.append(call(r.choice(ids), r.choice("fgh"), **a))
                rows.append((conv, turn, "assistant", json.dumps({"content": "go", "tool_calls": made})))
            elif kind < 0.8:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": r.choice([*ids, "other"]), "content": "42"})))
            else:
                rows.append((conv, turn, "user", "and {then}"))
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert got.columns == ["conv_id", "turn", "role", "line", "n_calls", "n_linked", "n_valid", "result_of"]
    found, want = sorted(map(tuple, got.collect()), key=str), sorted(plain(rows), key=str)
    assert found == want
    assert sum(x[5] for x in want) > 30 and 30 < sum(x[6] for x in want) < sum(x[4] for x in want) and any('"level":null' in x[3] for x in want) and any('"level":2' in x[3] for x in want)


def test_ties_and_long_texts(spark):
    long = "word " * 50_000
    rows = [(1, 1, "assistant", json.dumps({"tool_calls": [call("a", "g", x=1)]})), (1, 1, "assistant", json.dumps({"tool_calls": [call("a", "f", x=2)]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": long})), (1, 2, "user", long)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, calls string, level int")
    got = sorted(map(tuple, chat.formatted(df).collect()), key=str)
    assert len(got) == 4 and [x[4:7] for x in got if x[2] == "assistant"] == [(1, 1, 1)] * 2 and {x[7] for x in got} == {None, "a"} and all(long in x[3] for x in got if x[1] == 2)
