"""Readers on awkward files, and operators whose cases the registered queries don't reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ferrule.functions import text
from ferrule.functions import text as tx
from ferrule.operators import dedup as dd
from ferrule.operators import rules as ru
from ferrule.sources import files
from ferrule.streaming import workload


def test_encoding_is_judged_over_whole_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"plain,1\n" * 11_000 + "数据,2\n".encode("gb18030"))
    (tmp_path / "utf.csv").write_bytes("a,c\n列,\"x,\ny\"\n".encode("utf-8-sig"))
    rows = files.read_csv(spark, str(tmp_path))
    assert rows.count() == 11_002 and sorted(rows.columns) == ["a", "b", "c"]
    assert {(r["a"], r["b"]) for r in rows.where("a not in ('plain')").collect()} == {("数据", "2"), ("列", None)}
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
    (tmp_path / "bad.csv").write_bytes(b"a\n\xff\xff\n")
    try:
        files.read_csv(spark, str(tmp_path))
    except ValueError as e:
        assert "bad.csv" in str(e)
    else:
        raise AssertionError


def test_header_modes(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(files.workbook_bytes({"late": [[None, " "], ["k", "v"], ["1", "x"]], "plain": [["k", None], ["2", "N/A"], [None, "y"]], "bare": [["k"]]}))
    read = lambda mode: {(r["sheet"], r["row"], r["attribute"], r["value"]) for r in files.read_workbooks(spark, str(tmp_path), mode).collect()}
    plain = {("plain", 2, "k", "2"), ("plain", 3, "col_1", "y")}
    assert read("first") == plain | {("late", 3, "k", "1"), ("late", 3, "v", "x")}
    assert read("strict") == plain


def test_sheets_are_cleaned(spark, tmp_path):
    from ferrule.operators import maintenance as mt

    (tmp_path / "b.xlsx").write_bytes(files.workbook_bytes({"keep": [["a", "b"], ["1", "2"]], "readme": [["a", "b"], ["1", "2"]], "tmp1": [["a", "b"], ["1", "2"]]}))
    got = mt.clean_sheets(files.read_workbooks(spark, str(tmp_path)), ["readme"], ["tmp"]).collect()
    assert [(r["sheet"], r["attribute"], r["value"]) for r in got] == [("keep", "a", "1")]


def test_equal_requests_stay(spark):
    r = spark.createDataFrame([("GET", "/a")] * 3 + [("GET", None)], "method string, path string")
    routes = spark.createDataFrame([("exact", "/a", "TP", 0), ("method", "GET", "AP", 1)], "kind string, pattern string, class string, position int")
    assert sorted(x["class"] for x in workload.classify(r, routes).collect()) == ["AP", "TP", "TP", "TP"]


def test_repeated_attributes(spark):
    v = spark.createDataFrame([(1, "a", 1.0, 1), (1, "a", 3.0, 0), (1, "b", 2.0, 0)], "object_id long, name string, number double, row int")
    manual = spark.createDataFrame([(1, "b", 9.0), (2, "c", 1.0)], "object_id long, name string, number double")
    assert {r["object_id"]: r["values"] for r in ru.with_eav(v, manual).collect()} == {1: {"a": 1.0, "b": 9.0}, 2: {"c": 1.0}}


def test_only_garbage_is_renamed(spark):
    o = spark.createDataFrame([(1, "project"), (2, "project"), (3, "ab"), (4, "cd"), (5, "x")], "object_id long, object_name string")
    better = spark.createDataFrame([(3, "project"), (4, "project"), (1, "other")], "object_id long, better_name string")
    got = {r["object_id"]: r["object_name"] for r in dd.clean_names(o, tx.is_garbage(F.col("object_name"), []), better).collect()}
    assert got == {1: "project", 2: "project", 3: "project_2", 4: "project_3", 5: "x"}


def test_merge_decisions_become_a_plan(spark):
    request = spark.createDataFrame([(1, 2, "merge", "c", "d"), (3, 4, "link", "c", "d"), (5, 6, "ignore", "c", "d")], "a long, b long, action string, code string, domain string")
    assert [(r["source"], r["target"]) for r in dd.merges_of(request).collect()] == [(2, 1)]


def test_overlap_of_samples(spark):
    row = spark.createDataFrame([(["合同信息"], ["合同台账"], ["x1"], ["1y"])], "a array<string>, b array<string>, c array<string>, d array<string>")
    got = row.select(tx.gram_overlap(F.col("a"), F.col("b")), tx.gram_overlap(F.col("c"), F.col("d"))).first()
    assert tuple(got) == (1, 1)


def test_chosen_files(spark):
    listing = spark.createDataFrame([(p,) for p in ("d/2.xlsx", "d/1.xlsx", "d/x.csv", "e/1.xlsx", "b.xlsx", "a.xlsx", "d/sub/9.xlsx")], "path string")
    pick = lambda *a: [r["path"] for r in files.chosen_files(listing, *a).collect()]
    assert pick("d") == ["d/1.xlsx", "d/2.xlsx"] and pick("d", ["b.xlsx", "none.xlsx"]) == ["b.xlsx"]
    assert pick("d", ["none.xlsx"]) == ["d/1.xlsx", "d/2.xlsx"] and pick("z", None, ["b.xlsx", "gone.xlsx"]) == ["b.xlsx"] and pick("z") == ["a.xlsx", "b.xlsx"]


def test_extractions_by_alias_and_catalog(spark, tmp_path):
    for name, code in (("extraction_gongying.json", "O1"), ("extraction_audit.json", None)):
        (tmp_path / name).write_text(json.dumps({"data_domain": name[11:-5], "objects": [{"object_code": code, "object_name": "n"}], "relations": [{"object_code": code, "entity_layer": "concept", "entity_name": "e"}]}))
    found = files.read_extractions(spark, str(tmp_path))
    of = lambda d: [r["data_domain"] for r in files.extraction_of(found, d, {"供应链": "gongying"}).collect()]
    assert of("供应链") == ["gongying"] and of("audit") == ["audit"] and of("none") == []
    objects = spark.createDataFrame([("audit", "T1", "from the table")], "data_domain string, object_code string, object_name string")
    relations = spark.createDataFrame([("audit", "T1", "x")], "data_domain string, object_code string, entity_name string")
    have = lambda d: [[r["object_code"] for r in t.collect()] for t in files.catalog(objects, relations, found, d, {"供应链": "gongying"})]
    assert have("audit") == [["T1"], ["T1"]] and have("供应链") == [["O1"], ["O1"]] and have("none") == [[], []]
    assert files.catalog(objects.limit(0), relations, found, "audit")[0].first()["object_code"] == ""


def test_arguments_of_requests():
    assert text.known(None, ["A"], "layer") is None and text.known("A", ["A"], "layer") == "A"
    with pytest.raises(ValueError):
        text.known("b", ["A"], "layer")
    assert [text.clamped(*a) for a in ((None, 200), (None, 200, 50), (999, 200), (0, 50), (7, 50))] == [200, 50, 200, 1, 7]


def test_large_wide_file_in_ranges(spark, tmp_path):
    """A GB18030 file read by many ranges, with another header beside it."""
    body = "名,值\r\n" + "".join(f'"中,{i}",{i}\r\n' for i in range(3000))
    (tmp_path / "a.csv").write_bytes(body.encode("gb18030"))
    (tmp_path / "b.csv").write_bytes("值,别\n1,中\n".encode("gb18030"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_csv(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3 and set(got.columns) == {"名", "值", "别"}
        assert sorted((r["名"] or "", r["值"], r["别"] or "") for r in got.collect()) == sorted([(f"中,{i}", str(i), "") for i in range(3000)] + [("", "1", "中")])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sheets_are_read_row_by_row():
    """Rows that were read leave the tree: 30,000 rows are never held together."""
    import tracemalloc

    data = files.workbook_bytes({"a": [[str(i), None, "x"] for i in range(30_000)]})
    tracemalloc.start()
    assert sum(1 for _ in files.sheet_cells(data)) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_500_000
