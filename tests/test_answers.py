"""Cases in which an earlier version gave another answer, and the needle index against loops."""

from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.operators import dedup, extract, lineage, needles, rules
from ferrule.sources import files


def test_inventory_of_two_sheets_with_one_prefix(spark):
    cells = [("f", "DA-01 a", r, 0, "概念实体", n) for r, n in ((2, "A"), (3, "B"))] + [("f", "DA-01 b", r, 0, "概念实体", n) for r, n in ((2, "C"), (3, "D"), (4, "A"), (5, " "), (6, "NaN"))]
    df = spark.createDataFrame(cells, "file string, sheet string, row long, column int, attribute string, value string")
    got = files.inventory(df, "DA-01", {"概念实体": "name"}).collect()
    assert sorted((r["name"], r["row"]) for r in got) == [("A", 2), ("B", 3), ("C", 2), ("D", 3)]


def test_phonetic_runs_are_no_text(tmp_path, spark):
    ns = files.NS[1:-1]
    path = tmp_path / "d" / "1.xlsx"
    path.parent.mkdir()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{files.REL[1:-1]}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>h</t></si><si><r><t>漢</t></r><r><t>字</t></r><rPh sb="0" eb="2"><t>かんじ</t></rPh></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c t="s"><v>0</v></c></row><row><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>仮</t><rPh sb="0" eb="1"><t>か</t></rPh></is></c></row></sheetData></worksheet>')
    assert sorted(r["value"] for r in files.read_workbooks(spark, str(tmp_path)).collect()) == ["仮", "漢字"]


def test_repeated_header_keeps_both_columns(tmp_path, spark):
    (tmp_path / "a.csv").write_bytes("x,x,,y\n中,2,3,4\n,5,6\n".encode("gb18030"))
    got = files.read_csv(spark, str(tmp_path))
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.csv").write_bytes("x,x,,y\n中,2,3,4\n,5,6\n".encode())
    want = files.read_csv(spark, str(tmp_path / "u"))
    assert got.columns == want.columns == ["x0", "x1", "_c2", "y"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_names_stay_apart(spark):
    rows = [(1, "project", "OBJ_project"), (2, "project_2", "OBJ_project_2"), (3, "abc", "OBJ_abc"), (4, "xy", "X9"), (5, "cd", "OBJ_cd"), (6, "good name", "OBJ_g"), (7, "ef", "OBJ_ef")]
    objects = spark.createDataFrame(rows, "object_id long, object_name string, object_code string")
    better = spark.createDataFrame([(3, "project"), (4, "project"), (5, "project_4"), (7, None)], "object_id long, better_name string")
    relations = spark.createDataFrame([(3, "OBJ_abc", "e"), (6, "OBJ_g", "f")], "object_id long, object_code string, entity string")
    out, rel = dedup.clean_names(objects, tx.is_garbage(F.col("object_name"), []), better, relations)
    got = {r["object_id"]: (r["object_name"], r["object_code"]) for r in out.collect()}
    assert got == {1: ("project", "OBJ_project"), 2: ("project_2", "OBJ_project_2"), 3: ("project_3", "OBJ_project_3"), 4: ("project_5", "X9"), 5: ("project_4", "OBJ_project_4"), 6: ("good name", "OBJ_g"), 7: ("ef", "OBJ_ef")}
    assert sorted(tuple(r) for r in rel.collect()) == [(3, "OBJ_project_3", "e"), (6, "OBJ_g", "f")]


def test_percent_needs_a_hundred(spark):
    row = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    value = lambda n: F.col(n)
    cases = {"a × b / 2": 12.0, "a / b × 100": 75.0, "a / b * 100": 75.0, "a / b": 12.0, "a / b 100": 12.0}
    assert {t: row.select(rules.freeform(t, value)).first()[0] for t in cases} == cases


def test_upsert_of_repeated_keys_and_kept_ids(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, code string, v string")
    new = spark.createDataFrame([(9, "a", "n1"), (8, "a", "n2"), (7, "c", None)], "id long, code string, v string")
    assert sorted(tuple(r) for r in dedup.upsert(old, new, ["code"], kept=("id",)).collect()) == [(1, "a", "n1"), (2, "b", "y"), (7, "c", None)]
    assert sorted(r["v"] or "" for r in dedup.upsert(old, new.withColumn("at", -F.col("id")), ["code"], order="at").collect()) == ["", "n2", "y"]


def test_required_objects_take_their_next_best(spark):
    objects = spark.createDataFrame([], "object_code string, object_name string, cluster_id int, cluster_size long")
    clusters = spark.createDataFrame([(1, 9, ["ab", "ab", "abc", "bc"]), (2, 5, ["ab"]), (3, 4, ["bcab"])], "cluster_id int, size long, samples array<string>")
    required = spark.createDataFrame([(0, "R0", "ab"), (1, "R1", "bc"), (2, "R2", "ab"), (3, "R3", "ab")], "position int, object_code string, object_name string")
    got = {r["object_code"]: r["cluster_id"] for r in extract.with_required(objects, clusters, required).collect()}
    assert got == {"R0": 1, "R1": 3, "R2": 2, "R3": -1}


def test_duplicates_keep_every_link(spark):
    """All undecided pairs of objects, counted by hand; first objects of two names may share a code or be decided."""
    rnd = random.Random(5)
    names = ["steel pipe", "steel pipes", "steel pip", "glass", None]
    rows = [(i, rnd.choice(["c1", "c2", "c3", f"d{i}", None]), rnd.choice(names)) for i in range(60)]
    rows += [(100, "k", "red lamp"), (101, "k", "red lamps"), (102, "l", "red lamps")]
    decided = {(i, i + rnd.randint(1, 9)) for i in range(0, 50, 2)}
    grams = lambda t: {t[i : i + k] for k in (2, 3) for i in range(len(t) - k + 1) if " " not in t[i : i + k]}
    first = {}
    for i, c, n in rows:
        first.setdefault(("c", c), i), first.setdefault(("n", n), i)
    want: dict = {}
    for x in rows:
        for y in rows:
            if x[0] >= y[0] or (x[0], y[0]) in decided:
                continue
            if x[1] is not None and x[1] == y[1] or x[2] is not None and x[2] == y[2]:
                kind, key = ("EXACT_CODE", ("c", x[1])) if x[1] is not None and x[1] == y[1] else ("EXACT_NAME", ("n", x[2]))
                keys = [(first[key], i, kind) for i in (x[0], y[0]) if i != first[key]]
            elif x[2] is not None and y[2] is not None and len(grams(x[2]) & grams(y[2])) / len(grams(x[2]) | grams(y[2])) >= 0.6:
                keys = [(*sorted([first["n", x[2]], first["n", y[2]]]), "SEMANTIC")]
            else:
                continue
            for k in keys:
                want[k] = want.get(k, 0) + 1
    df = spark.createDataFrame(rows, "id long, code string, name string")
    got = dedup.duplicates(df, spark.createDataFrame([(b, a) for a, b in decided], "a long, b long"), 0.6).collect()
    assert {(r["id"], r["other"], r["match_type"]): r["links"] for r in got} == want and len(got) == len(want)
    assert want[100, 101, "SEMANTIC"] == 1


def test_required_objects_without_next_best(spark):
    """Both definitions have their best cluster in -2; as in the query's SQL, the later one gets none, not the cluster -1."""
    objects = spark.createDataFrame([], "object_code string, object_name string, cluster_id int, cluster_size long")
    clusters = spark.createDataFrame([(i, 20, ["a plate", "a gizmo"]) for i in (-2, -1, 5)], "cluster_id int, size long, samples array<string>")
    required = spark.createDataFrame([(0, "R1", "plate"), (1, "R2", "gizmo"), (2, "R3", "none")], "position int, object_code string, object_name string")
    got = {r["object_code"]: (r["cluster_id"], r["cluster_size"]) for r in extract.with_required(objects, clusters, required, next_best=False).collect()}
    assert got == {"R1": (-2, 20), "R2": (-1, 0), "R3": (-1, 0)}


@pytest.mark.parametrize("size", [2, 4])
def test_needles_against_a_loop(spark, size):
    rnd = random.Random(size)
    word = lambda n: "".join(rnd.choice("ab中c ") for _ in range(n))
    texts = [(i, word(rnd.randint(0, 14))) for i in range(200)] + [(900, None), (901, ""), (5, "ab")]
    needle = sorted({word(rnd.randint(0, 6)) for _ in range(60)} | {"", "zzzz"})
    df = spark.createDataFrame(texts, "id long, text string")
    nd = spark.createDataFrame([(n,) for n in needle] + [("ab",), (None,)], "needle string")
    got = sorted((r["id"], r["needle"]) for r in needles.contained(df, nd, size).distinct().collect())
    assert got == sorted({(i, n) for i, t in texts for n in {*needle, "ab"} if t is not None and n in t})
    plan = needles.contained(df, nd, size)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_relinked_nodes(spark):
    objects = spark.createDataFrame([(3, "b"), (1, "ab"), (2, "c"), (7, "ab"), (9, None)], "object_id long, object_name string")
    nodes = spark.createDataFrame([(1, "xabx", None), (2, "b c", None), (3, "c", 5), (4, "zz", None), (5, None, None)], "node_id long, node_label string, object_id long")
    got = {r["node_id"]: r["object_id"] for r in lineage.relink(nodes, objects).collect()}
    assert got == {1: 7, 2: 2, 3: 5, 4: None, 5: None}
