"""Scalar cases, properties and file sources."""

from __future__ import annotations

import hashlib
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.operators import dedup, eav, lifecycle, rules, vector
from ferrule.sources import files
from ferrule.streaming import workload


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("x", [None, "NaN", "null", "NULL", "N/A", "#N/A", "na", "none", "None", "", "-", "—", " - "])
def test_no_value(spark, x):
    assert one(spark, x, tx.normalize_na) is None


@pytest.mark.parametrize("x", ["hello", "42", "项目名称", " padded "])
def test_value_is_unchanged(spark, x):
    assert one(spark, x, tx.normalize_na) == x


@pytest.mark.parametrize(("x", "kind"), [("123", "number"), ("3.14", "number"), ("1,234,567", "number"), ("0", "number"), ("是", "bool"), ("否", "bool"), ("yes", "bool"), ("No", "bool"), ("true", "bool"), ("2024-01-15", "datetime"), ("2024-01-15 10:30:00", "datetime"), ("2024/01/15", "datetime"), ("-456", "datetime"), ("项目名称ABC", "text"), ("", "text"), (None, "text")])
def test_type(spark, x, kind):
    assert one(spark, x, tx.value_type) == kind


def test_vote_ties(spark):
    cells = spark.createDataFrame([("a", "123"), ("a", "abc"), ("b", "是"), ("b", "否"), ("b", "是")], "attribute string, raw string")
    assert {r["attribute"]: r["type"] for r in eav.vote(cells).collect()} == {"a": "number", "b": "bool"}


def test_row_hash(spark):
    got = spark.createDataFrame([("a", None)], "a string, b string").select(tx.row_hash([F.col("a"), F.col("b")]).alias("h")).first()["h"]
    assert got == hashlib.sha1(b"a\x1f\xff\x1f").hexdigest()


def test_melt_and_pivot_are_inverse(spark):
    rows = spark.createDataFrame([(1, "x", "1"), (2, None, "2"), (3, "N/A", "3")], "k long, a string, b string")
    back = {r["entity_id"]: (r["a"], r["b"]) for r in eav.pivot(eav.melt(rows, "k"), ["a", "b"]).collect()}
    assert back == {1: ("x", "1"), 2: (None, "2"), 3: (None, "3")}


def test_import_twice_skips(spark):
    h = spark.createDataFrame([(1, "a"), (2, "b")], "entity_id long, row_hash string")
    assert {r["action"] for r in eav.incremental(h, h).collect()} == {"SKIP"}
    assert {r["action"] for r in eav.incremental(h, h, force=True).collect()} == {"UPDATE"}
    assert sorted(r["action"] for r in eav.incremental(h, h.where("entity_id = 1")).collect()) == ["KEEP", "SKIP"]


def test_jaccard_bounds(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], ["a"])], "a array<string>, b array<string>")
    got = [(r["x"], r["y"]) for r in df.select(tx.jaccard(F.col("a"), F.col("b")).alias("x"), tx.jaccard(F.col("b"), F.col("a")).alias("y")).collect()]
    assert got == [(1 / 3, 1 / 3), (0.0, 0.0), (1.0, 1.0)]


@pytest.mark.parametrize(("text", "want"), [("x * y", 2200.0), ("x + y", 230.0), ("x - y", 210.0), ("x / y", 22.0), ("x / zero", None), ("x + none", 220.0), ("x", None)])
def test_formula(spark, text, want):
    df = spark.createDataFrame([(220.0, 10.0, 0.0)], "x double, y double, zero double")
    value = lambda n: F.col(n) if n in df.columns else F.lit(0.0)
    assert df.select(rules.formula(text, value).alias("r")).first()["r"] == want


def test_merge_keeps_rows_and_weakens(spark):
    r = spark.createDataFrame([(1, "CONCEPT", "a", 1.0, None), (2, "CONCEPT", "b", 1.0, None)], "object_id long, layer string, entity_name string, strength double, method string")
    got = sorted((x["object_id"], x["entity_name"], x["strength"]) for x in dedup.merge(r, 1, 2).collect())
    assert got == [(2, "a", 0.9), (2, "b", 1.0)]


def test_transition_rules(spark):
    rows = [(1, 1, "a", 1, ""), (2, 1, "c", 2, ""), (3, 1, "b", 3, ""), (4, 1, "b", 4, ""), (5, 1, "a", 5, "why"), (6, 1, "zzz", 6, "")]
    e = spark.createDataFrame(rows, "event_id long, object_id long, stage string, entered int, notes string")
    assert [r["verdict"] for r in lifecycle.transitions(e, ["a", "b", "c"]).orderBy("event_id").collect()] == ["OK", "SKIPPED", "BACK_WITHOUT_NOTES", "OK", "OK", "UNKNOWN_STAGE"]


@pytest.mark.parametrize("frame", [10_000, 2])
def test_stateful_stream_equals_batch(spark, tmp_path, frame):
    """Also where the events of an object, out of order, come in several frames."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frame)
    rows = [(i, i % 3, "abc"[(i * 7) % 3], i, "n" if i % 4 == 0 else "") for i in range(30)]
    schema = "event_id long, object_id long, stage string, entered int, notes string"
    spark.createDataFrame(rows[::-1], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = workload.run_to_folder(workload.transitions_stream(stream, ["a", "b", "c"]), str(tmp_path / "out"), "append")
    want = lifecycle.transitions(spark.createDataFrame(rows, schema), ["a", "b", "c"])
    key = lambda df: sorted((r["event_id"], r["verdict"]) for r in df.collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert key(got) == key(want)


def test_linkage():
    rng = np.random.default_rng(0)
    centres = np.eye(3) * 10
    v = np.concatenate([c + rng.normal(0, 0.1, (5, 3)) for c in centres])
    for label in (vector.linkage(v, 3), vector.linkage(v, distance=0.2)):
        assert len(set(label)) == 3 and all(len(set(label[i : i + 5])) == 1 for i in (0, 5, 10))


def test_components_are_the_closure(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    edges = spark.createDataFrame([(i, i + 2) for i in range(30)] + [(35, 36)], "a long, b long")
    got = {r["id"]: r["component"] for r in vector.components(nodes, edges).collect()}
    assert all(got[i] == i % 2 for i in range(32)) and got[36] == 35 and got[39] == 39


def workbook(path, sheets):
    """A minimal workbook with shared and inline strings and numbers."""
    shared: list[str] = []
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{files.NS[1:-1]}" xmlns:r="{files.REL[1:-1]}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, int):
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                    elif c == 0:
                        shared.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                    else:
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{files.NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{files.NS[1:-1]}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def test_workbooks(spark, tmp_path):
    (tmp_path / "dom").mkdir()
    (tmp_path / "_skip").mkdir()
    workbook(tmp_path / "dom" / "2.xlsx", {"DA-01 概念": [["概念实体", "编号"], ["客户", "C1"], ["客户", "C2"], [" ", "C3"], ["订单", 7]], "other": [["x"]]})
    workbook(tmp_path / "_skip" / "1.xlsx", {"s": [["a"], ["1"]]})
    cells = files.read_workbooks(spark, str(tmp_path / "dom"))
    assert {(r["sheet"], r["row"], r["attribute"], r["value"]) for r in cells.collect()} >= {("DA-01 概念", 2, "概念实体", "客户"), ("DA-01 概念", 5, "编号", "7")}
    rows = files.inventory(cells, "DA-01", {"概念实体": "name", "编号": "code"})
    assert sorted((r["name"], r["code"], r["row"]) for r in rows.collect()) == [("客户", "C1", 2), ("订单", "7", 5)]
    got = files.list_domains(spark, str(tmp_path)).collect()
    assert [(r["domain"], r["has_ba"], r["has_da"], r["has_aa"]) for r in got] == [("dom", False, True, False)]


def test_csv_encodings(spark, tmp_path):
    for name in ("utf-8-sig", "utf-8", "gb18030"):
        path = tmp_path / f"{name}.csv"
        path.write_bytes("列,b\n数据,1\n".encode(name))
        row = files.read_csv(spark, str(path)).first()
        assert [row[0], row[1]] == ["数据", "1"]


def test_extraction_json(spark, tmp_path):
    (tmp_path / "sales_extraction.json").write_text(json.dumps({"data_domain": "", "objects": [{"object_code": "A", "object_name": "a", "cluster_size": 2}], "relations": [{"object_code": "A", "entity_layer": "concept", "entity_name": "n" * 600, "entity_code": ""}, {"object_code": "A", "entity_layer": "bad", "entity_name": "x"}]}))
    (tmp_path / "global_extraction.json").write_text("{}")
    e = files.read_extractions(spark, str(tmp_path))
    assert [tuple(r) for r in files.extracted_objects(e).select("data_domain", "object_code", "cluster_size").collect()] == [("sales", "A", 2)]
    r = files.extracted_relations(e).collect()
    assert len(r) == 1 and len(r[0]["entity_name"]) == 512 and r[0]["entity_code"] is None and r[0]["entity_layer"] == "CONCEPT"


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 3, "c", 0.123456789, 2)], "from_text string, freq int, canonical_text string, similarity double, cluster_size int")
    files.write_report(rows, str(tmp_path / "r"))
    assert pd.concat(pd.read_csv(p) for p in (tmp_path / "r").glob("*.csv")).iloc[0].tolist() == ["a，b", 3, "c", 0.12346, 2]


def test_routes(spark):
    r = spark.createDataFrame([(1, "GET", "/a/b"), (2, "POST", "/z"), (3, "GET", "/a"), (4, "PUT", "/q")], "id long, method string, path string")
    routes = [("exact", "/a", "TP"), ("prefix", "/a", "AP"), ("method", "POST", "TP"), ("method", "GET", "AP")]
    table = spark.createDataFrame([(*x, i) for i, x in enumerate(routes)], "kind string, pattern string, class string, position int")
    want = {1: "AP", 2: "TP", 3: "TP"}
    assert {x["id"]: x["class"] for x in workload.classify(r, table).collect() if x["class"]} == want
    assert {x["id"]: x["class"] for x in workload.classify_columns(r, routes).collect()} == want | {4: "TP"}
