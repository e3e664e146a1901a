"""Tables that change together, imports by hash, archives of workbooks, numbering and sampled votes."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ferrule.operators import eav, imports, writes
from ferrule.session import shared_path
from ferrule.sources import archives
from ferrule.sources.files import workbook_bytes
from ferrule.sources.versions import Store


def rows_of(spark, state):
    """Entities and cells of {row number: (hash, {attribute: value})}."""
    rows = spark.createDataFrame([("d", k, f"x{k}", h) for k, (h, _) in state.items()], imports.ENTITIES)
    cells = spark.createDataFrame([("d", k, a, v) for k, (_, own) in state.items() for a, v in own.items()], imports.VALUES)
    return rows, cells


def held(store):
    own = {r["row_number"]: r["row_hash"] for r in store.table("entities").collect()}
    return own, sorted((r["row_number"], r["attribute"], r["raw"]) for r in store.table("values").collect())


def test_imports_against_a_loop(spark):
    rnd = random.Random(1)
    store, hashes, values = Store(spark, shared_path(spark, "t")), {}, {}
    for step in range(4):
        state = {k: (f"h{rnd.randint(0, 2)}", {a: f"{step}{a}" for a in "ab" if rnd.random() < 0.7}) for k in rnd.sample(range(30), 15)}
        force = step == 3
        want = {"inserted": sum(k not in hashes for k in state), "skipped": 0 if force else sum(hashes.get(k) == h for k, (h, _) in state.items())}
        want["updated"] = len(state) - sum(want.values())
        for k, (h, own) in state.items():
            if hashes.get(k) != h or force:
                hashes[k], values[k] = h, own
        assert imports.import_rows(store, *rows_of(spark, state), force=force, buckets=4) == want
        assert held(store) == (hashes, sorted((k, a, v) for k, own in values.items() for a, v in own.items()))


def test_an_import_rewrites_only_what_changed(spark):
    store = Store(spark, shared_path(spark, "t"))
    state = {k: ("h", {"a": "1"}) for k in range(40)}
    imports.import_rows(store, *rows_of(spark, state), buckets=8)
    before = store.manifest()["tables"]
    assert imports.import_rows(store, *rows_of(spark, state)) == {"inserted": 0, "updated": 0, "skipped": 40} and store.version() == 1
    state[7] = ("other", {})
    assert imports.import_rows(store, *rows_of(spark, state), buckets=99)["updated"] == 1 and store.version() == 2
    after = store.manifest()["tables"]
    for name in ("entities", "values"):
        assert sum(before[name]["parts"][p] != f for p, f in after[name]["parts"].items()) == 1
    assert len(held(store)[1]) == 39
    assert store.table("values", version=1).count() == 40  # the version before is still there
    assert store.vacuum() == 0 or store.table("values").count() == 39


def test_parts_are_written_without_a_shuffle(spark):
    store = Store(spark, shared_path(spark, "t"))
    rows = spark.range(0, 1000, 1, 3).select(F.lit("d").alias("dataset"), F.col("id").alias("row_number"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("parts", "parts")
    try:
        change = store.write("rows", rows, imports.bucket(4))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = tracker.getJobIdsForGroup("parts")
    assert len(jobs) == 1 and [len(tracker.getJobInfo(j).stageIds) for j in jobs] == [1]
    store.publish([change], 0)
    assert sorted(change[2]) == ["0", "1", "2", "3"] and store.table("rows").distinct().count() == store.table("rows").count() == 1000
    assert store.table("rows", parts=["2"]).where(imports.bucket(4) != 2).isEmpty()


def test_an_import_writes_down_only_what_changed(spark, monkeypatch):
    """Rows that are skipped are counted, not written; hashes keep their text, hex or not."""
    hashes = ["00ff", "00FF", "abc", "0abc", "", "h1", "é", "a9993e364706816aba3e25717850c26c9cd0d89d", None, "\x01ab", "\x00"]
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    got = df.select("h", imports.packed(F.col("h")).alias("p")).select("h", F.hex("p"), imports.unpacked(F.col("p"))).collect()
    assert [r[2] for r in got] == [r[0] for r in got] == hashes and len({r[1] for r in got}) == len(hashes)
    store, seen = Store(spark, shared_path(spark, "t")), []
    monkeypatch.setattr(imports, "written", lambda df, name="table", f=imports.written: (seen.append((name, (out := f(df, name)).count())), out)[1])
    state = {k: (hashes[k % 8], {"a": "1"}) for k in range(40)}
    for want in ({"inserted": 40, "updated": 0, "skipped": 0}, {"inserted": 0, "updated": 0, "skipped": 40}):
        assert imports.import_rows(store, *rows_of(spark, state), buckets=4) == want
    assert imports.import_rows(store, *rows_of(spark, {}), buckets=4) == {"inserted": 0, "updated": 0, "skipped": 0}
    state[3] = ("other", {"a": "2"})
    assert imports.import_rows(store, *rows_of(spark, state))["updated"] == 1
    assert seen == [("actions", 40), ("actions", 0), ("actions", 0), ("actions", 1)] and store.version() == 2
    assert held(store)[0] == {k: h for k, (h, _) in state.items()}


def test_a_failed_refresh_is_never_seen(spark):
    store = Store(spark, shared_path(spark, "t"))
    objects = spark.createDataFrame([("A", "a"), ("A", "z"), ("B", "b")], "object_code string, object_name string")
    synonyms = spark.createDataFrame([("A", "s"), ("A", "s"), ("X", "t")], "object_code string, synonym string")
    relations = spark.createDataFrame([("A", "e"), ("X", "f")], "object_code string, entity_name string")
    imports.refresh_domain(store, "d1", objects, synonyms, relations)
    imports.refresh_domain(store, "default", objects, synonyms, relations)
    show = lambda: {n: sorted(tuple(r) for r in store.table(n).collect()) for n in ("objects", "synonyms", "relations")}
    seen = show()
    assert seen["objects"] == [("A", "z", "default"), ("A_d1", "z", "d1"), ("B", "b", "default"), ("B_d1", "b", "d1")]
    assert seen["synonyms"] == [("A", "s", "default"), ("A_d1", "s", "d1")] and seen["relations"] == [("A", "e", "default"), ("A_d1", "e", "d1")]
    broken = relations.withColumn("entity_name", F.when(F.col("object_code") == "A", F.raise_error(F.lit("lost"))).otherwise(F.col("entity_name")))
    with pytest.raises(Exception, match="lost"):
        imports.refresh_domain(store, "d1", objects.where("object_code = 'A'"), synonyms, broken)
    assert show() == seen and store.version() == 2
    imports.refresh_domain(store, "d1", objects.where("object_code = 'B'"), synonyms, relations)
    assert show()["objects"] == [("A", "z", "default"), ("B", "b", "default"), ("B_d1", "b", "d1")] and len(show()["relations"]) == 1
    assert store.vacuum() >= 5 and len(show()["objects"]) == 3


def test_two_changes_at_a_time(spark):
    store = Store(spark, shared_path(spark, "t"))
    change = store.write("t", spark.range(3))
    store.publish([change], 0)
    with pytest.raises(RuntimeError):
        store.publish([change], 0)
    assert store.table("t").count() == 3 and store.table("none", "a int").count() == 0


def archive(folder, name, members):
    with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (member, data) in enumerate(members):
            info = zipfile.ZipInfo(member)
            info.compress_type = zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED
            z.writestr(info, data)


def test_archives(spark, tmp_path):
    book = lambda *rows: workbook_bytes({"s": [["名称", "值", "导入校验"], *rows], "t": [["a"], ["x"]]})
    archive(tmp_path, "one.zip", [("供应链/清单.xlsx", book(["old", "1", "ok"])), ("供应链二.xlsx", book(["new", "2", "ok"], ["b", "3"])), ("无人.xlsx", book(["lost", "1"])), ("供应链.txt", b"")])
    archive(tmp_path, "two.zip", [("企业架构数字化.xlsx", book(["c", "4", "ok"]))])
    archive(tmp_path, "three.zip", [("审计.xlsx", book(["d", "5", "ok"]))])
    routes = [("供应链", "supply"), ("企业架构", "ea"), ("数字化", "digital"), ("审计", "audit")]
    slots = {"one.zip": "1", "two.zip": "2"}
    got = archives.read_archives(spark, str(tmp_path), routes, slots)
    assert sorted((r["domain"], r["slot"], r["file"], r["sheet"], r["attribute"], r["value"]) for r in got.collect()) == sorted(
        [("supply", "1", "supply/1.xlsx", "s", a, v) for a, v in (("名称", "new"), ("值", "2"), ("名称", "b"), ("值", "3"))]
        + [("ea", "2", "ea/2.xlsx", "s", a, v) for a, v in (("名称", "c"), ("值", "4"))]
        + [("supply", "1", "supply/1.xlsx", "t", "a", "x"), ("ea", "2", "ea/2.xlsx", "t", "a", "x")]
    )
    assert [r["name"] for r in archives.members(spark, str(tmp_path), routes, slots).where("domain is null").collect()] == ["无人.xlsx"]
    assert archives.read_archives(spark, str(tmp_path), routes).where("slot = 'three'").count() == 3
    assert archives.read_archives(spark, str(tmp_path), routes, check=None).where("attribute like '%校验'").count() == 3


def test_member_names():
    named = lambda name, mark: archives.member_name(type("I", (), {"filename": name, "flag_bits": mark})())
    gbk = "数据域".encode("gbk").decode("cp437")
    assert [named(gbk, 0), named(gbk, 0x800), named("é中", 0), named("a.xlsx", 0)] == ["数据域", gbk, "é中", "a.xlsx"]
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("x", b"1" * 100)
    assert body.getvalue()[:4] == b"PK\x03\x04"


def test_row_numbers_of_one_large_sheet(spark):
    rows = spark.createDataFrame([("a" if i < 250 else "b", i, i) for i in range(300)], "sheet string, r long, x long").repartition(5)
    got = {r["x"]: r["row_number"] for r in eav.number_rows(rows, "sheet", "r").collect()}
    assert got == {i: i + 1 for i in range(300)}
    plan = eav.number_rows(rows, "sheet", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(sheet" in plan.lower().replace("#", "").replace("`", "") or "Window" in plan


def test_votes_by_the_first_values(spark):
    cells = [("f", "s", i, "a", "1" if i < 5 else "x") for i in range(20)] + [("f", "t", i, "a", "2") for i in range(3)] + [("f", "s", 1, "b", " "), ("f", "s", 2, "b", None)]
    df = spark.createDataFrame(cells, "file string, sheet string, row long, attribute string, raw string").repartition(4)
    assert sorted(tuple(r) for r in eav.vote_by_samples(df, 5).collect()) == [("f", "a", "number", 8), ("f", "b", "text", 0)]
    assert sorted(tuple(r) for r in eav.vote_by_samples(df, 200).collect())[0] == ("f", "a", "text", 23)
    assert "WindowGroupLimit" in eav.vote_by_samples(df, 5)._jdf.queryExecution().executedPlan().toString()


def test_writes_again_change_nothing(spark):
    objects = spark.createDataFrame([(1, "A", "a", "CORE"), (4, "B", "b", None)], "object_id long, object_code string, object_name string, object_type string")
    request = spark.createDataFrame([("C", "c"), ("C", "d"), ("A", "x"), (None, "n"), ("", "e"), ("BB", "f")], "object_code string, object_name string")
    once = writes.create(objects, request, "object_id", "object_code", object_type="CORE")
    want = [(1, "A", "a", "CORE"), (4, "B", "b", None), (5, "BB", "f", "CORE"), (6, "C", "c", "CORE")]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in writes.create(once, request, "object_id", "object_code", object_type="CORE").collect()) == want
    assert [r["object_id"] for r in writes.delete(once, spark.createDataFrame([("A",), ("A",), ("Z",)], "object_code string"), "object_code").orderBy("object_id").collect()] == [4, 5, 6]
    first = writes.create(objects.limit(0), request, "object_id", "object_code")
    assert sorted((r["object_id"], r["object_code"]) for r in first.collect()) == [(1, "A"), (2, "BB"), (3, "C")]
