import json

import pytest
from pyspark.sql import functions as F

from tabveil.plans import service
from tabveil.sources import csvfile, documents, quick
from tabveil.streaming import pseudonyms

CSV = 'id,email,note\n1,ann@x.org,"a, ""b""\nc"\n2,bob@y.org\n,,\n3,ann@x.org,=cmd,,\n'


def test_csv_scan_and_sink(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text("﻿" + CSV, encoding="utf-8")
    rows = csvfile.scan(spark, str(f))
    cells = [[r[c] for c in ("_c0", "_c1", "_c2")] for r in rows.orderBy("row_idx").collect()]
    assert cells == [["1", "ann@x.org", 'a, "b"\nc'], ["2", "bob@y.org", ""], ["", "", ""], ["3", "ann@x.org", "=cmd"]]
    assert csvfile.headers(spark, str(f)) == ["id", "email", "note"]
    assert csvfile.data_rows(rows, ["_c0", "_c1", "_c2"]) == 3
    csvfile.sink(rows.orderBy("row_idx").drop("row_idx"), ["id", "email", "note"], str(tmp_path / "out"), single=True)
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == 'id,email,note\n1,ann@x.org,"a, ""b""\nc"\n2,bob@y.org,\n,,\n3,ann@x.org,\'=cmd\n'


def test_surplus_cells_are_refused(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text("a,b\n1,2,EXTRA\n")
    with pytest.raises(Exception, match="more cells"):
        csvfile.scan(spark, str(f)).collect()
    with pytest.raises(ValueError, match="more cells"):
        csvfile.padded([["1", "2", "3"]], 2)
    assert csvfile.padded([["1"], ["1", "2", " "]], 2) == [["1", ""], ["1", "2"]]


def test_encodings():
    assert csvfile.sniff("a,b".encode("utf-16")) == "utf-16"
    assert csvfile.sniff("abcdef".encode("utf-16-le")) == "utf-16"
    assert csvfile.sniff(b"\x00\x01" + b"a" * 50) == "utf-8" and csvfile.sniff(b"\x00\x01\x00" + b"a" * 50) == "binary"


JSON = '{"user": {"id": 7, "tags": ["a", "b"], "x/y": null}, "ok": true, "rate": 1.5}'


def test_json_round_trip():
    assert [(f[0], f[1], f[3]) for f in documents.json_fields(JSON)] == [("json/k:user/k:id", "user.id", "7"), ("json/k:user/k:tags/a", "user.tags[]", "a"), ("json/k:user/k:tags/a", "user.tags[]", "b"), ("json/k:user/k:x~1y", 'user."x/y"', "null"), ("json/k:ok", "ok", "true"), ("json/k:rate", "rate", "1.5")]
    assert json.loads(documents.rewritten_json(JSON, lambda p, v: v)) == json.loads(JSON)
    out = json.loads(documents.rewritten_json(JSON, lambda p, v: {"7": "8", "true": "[X]"}.get(v, v)))
    assert out["user"]["id"] == 8 and out["ok"] == "[X]" and out["user"]["x/y"] is None


def test_yaml_and_xml():
    assert [f[3] for f in documents.yaml_fields("a: 1\nb: [x, y]\n")] == ["1", "x", "y"]
    xml = '<u id="1"><n>Ann &amp; Bo</n><c><![CDATA[raw <x>]]></c><!-- k --></u>'
    assert [(f[0], f[3]) for f in documents.xml_fields(xml)] == [("xml/e:u/@:id", "1"), ("xml/e:u/e:n/text", "Ann & Bo"), ("xml/e:u/e:c/text", "raw <x>")]
    assert documents.rewritten_xml(xml, lambda p, v: v) == xml
    assert "[N]" in documents.rewritten_xml(xml, lambda p, v: "[N]" if p.endswith("n/text") else v)


def test_text_and_formats():
    assert documents.rewritten_text("to a@b.co now", lambda p, v: "[EMAIL]") == "to [EMAIL] now"
    given = {"": "text", JSON: "json", "<a><b/></a>": "xml", "a,b\n1,2": "csv", "a: 1\nb: 2": "yaml", "2024-01-01T10:00:00 INFO x": "logs", "plain words": "text"}
    assert {k: documents.sniffed(k) for k in given} == given


def test_replay():
    text = "Ann wrote to a@b.co"
    assert documents.replayed(text, [(0, 3, "person", "Ann")], lambda p, v: f"[{p[5:]}]") == "[person] wrote to [email]"
    for bad in ((0, 3, "person", "Bob"), (13, 16, "person", "a@b")):
        with pytest.raises(ValueError):
            documents.replayed(text, [bad], lambda p, v: v)


def test_documents_in_a_table(spark):
    df = spark.createDataFrame([(1, JSON), (2, '{"ok": false}')], "id long, doc string")
    fields = documents.flattened(df, "id", "doc", "json")
    assert fields.count() == 7
    released = fields.where("path = 'json/k:ok'").select("id", "path", "value", F.lit("[X]").alias("output"))
    assert [json.loads(r.content)["ok"] for r in documents.rewritten(df, "id", "doc", "json", released).orderBy("id").collect()] == ["[X]", "[X]"]


def test_quick(spark):
    for kind in quick.TYPES:
        a = [r.value for r in quick.generated(spark, kind, 5, "s").collect()]
        assert len(a) == 5 and all(a) and a == [r.value for r in quick.generated(spark, kind, 5, "s").collect()]
    with pytest.raises(ValueError):
        quick.generated(spark, "email", 1001)


def test_service(spark, tmp_path):
    f = tmp_path / "people.csv"
    f.write_text("id,email,full_name,status\n" + "".join(f"{1000 + i},p{i % 20}@x.org,Ann{'abcdefghij'[i % 10]} Lee,{['new', 'old'][i % 2]}\n" for i in range(60)))
    rows, plans = service.analyze_csv(spark, str(f))
    assert [p.kind for p in plans] == ["numericId", "email", "fullName", "enum"]
    r = service.anonymize_csv(spark, str(f), str(tmp_path / "out"), "k", [1, 2], {1: {"strategy": "pseudonymize"}, 2: {"strategy": "label"}}, single=True)
    assert r["status"] == "review" and r["directIdentifiers"] == 2
    lines = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert len(lines) == 61 and lines[1].startswith("1000,user") and "@x.org,[FULL_NAME_1],new" in lines[1]
    assert len({x.split(",")[1] for x in lines[1:]}) == 20
    tokens = [service.protected(rows, service.controlled(plans, [1], {1: {"strategy": "tokenize"}}), F.lit("k"), "row_idx", token_key="ab" * 32).orderBy("row_idx").first()["_c1"] for _ in range(2)]
    assert tokens[0] == tokens[1] and tokens[0].startswith("tok_")
    text = service.snapshot(plans, "abc")
    assert [p.name for p in service.restored(text, "abc")] == ["id", "email", "full_name", "status"]
    with pytest.raises(ValueError):
        service.restored(text, "other")
    assert service.preflight(service.controlled(plans, []))["status"] == "blocked"
    assert len(service.preview(rows, service.controlled(plans, [1]), F.lit("k"))) == 5


def test_stream_keeps_pseudonyms(spark, tmp_path):
    src = tmp_path / "src"
    paths = [str(tmp_path / x) for x in ("map", "out", "check")]
    spark.createDataFrame([("a", 1), ("b", 2)], "user string, n int").coalesce(1).write.parquet(str(src))
    for extra in ([("b", 3), ("c", 4)], [("a", 5), ("d", 6)]):
        pseudonyms.run(spark.readStream.schema("user string, n int").parquet(str(src)), "user", *paths, "seed").awaitTermination()
        spark.createDataFrame(extra, "user string, n int").coalesce(1).write.mode("append").parquet(str(src))
    pseudonyms.run(spark.readStream.schema("user string, n int").parquet(str(src)), "user", *paths, "seed").awaitTermination()
    out = {r.n: r.user for r in spark.read.parquet(paths[1]).collect()}
    assert len(out) == 6 and out[1] == out[5] and out[2] == out[3] and len(set(out.values())) == 4


def test_plans_see_all_rows(spark):
    rows = spark.range(0, 30_000, 1, 1).select(F.when(F.col("id") >= 12_000, F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@mail.org"))).alias("note"), F.lit("open").alias("state"))
    plans = service.planned(rows)
    assert [(p.kind, p.selected) for p in plans] == [("email", True), ("enum", False)]


def test_surplus_at_any_place(spark, tmp_path):
    def rows(body):
        (tmp_path / "x.csv").write_text(body)
        return [tuple(r)[1:] for r in csvfile.scan(spark, str(tmp_path / "x.csv")).collect()]

    for bad in ("3,4,,secret\n", "3,4,secret\n", '3,4," z"\n', '3,4,,"a,b"\n'):
        with pytest.raises(Exception, match="more cells"):
            rows(f"a,b\n1,2\n{bad}")
    assert rows('a,b\n1,2\n3,4,,\n5\n"x,\ny","q""z", ,\n') == [("1", "2"), ("3", "4"), ("5", ""), ("x,\ny", 'q"z')]


def test_csv_from_and_to_strings(spark):
    rows, names = csvfile.from_text(spark, '\ufeffid,note\n1,"a, ""b""\nc"\n2\n3,=1+1,,\n')
    assert names == ["id", "note"] and [tuple(r) for r in rows.orderBy("row_idx").collect()] == [(0, "1", 'a, "b"\nc'), (1, "2", ""), (2, "3", "=1+1")]
    assert csvfile.to_text(rows, names) == 'id,note\n1,"a, ""b""\nc"\n2,\n3,\'=1+1\n'
    with pytest.raises(ValueError, match="more cells"):
        csvfile.from_text(spark, "a\n1,,x\n")
    assert csvfile.from_text(spark, "")[1] == []
