"""Registered queries over workbooks: the driver tables are written as inventories, a workbook a region, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import maintenance as mt
from ferrule.sources import files

from .bindings import table
from .sources import folder

QUERIES: dict = {}
ORACLES: dict = {}

# Sheets and columns of the inventories.
CONCEPTS = "DA-01 数据实体清单-概念实体清单"
LOGICAL = "DA-02 数据实体清单-逻辑实体清单"
PHYSICAL = "DA-03数据实体清单-物理实体清单"
BUSINESS = "BA-04 业务对象清单"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def sheet(rows: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """file, sheet, row, cells of a sheet; columns: header -> expression over rows, which has region and place."""
    body = rows.select(F.concat("region", F.lit("/2.xlsx")).alias("file"), F.lit(name).alias("sheet"), F.col("place").cast("long").alias("row"), F.array(*[F.expr(e).cast("string") for e in columns.values()]).alias("cells"))
    head = body.select("file", "sheet").distinct().select("file", "sheet", F.lit(-1).cast("long").alias("row"), F.array(*[F.lit(h) for h in columns]).alias("cells"))
    return head.unionByName(body)


def written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the regions' workbooks."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "region")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("place", F.col("s_suppkey"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("place", F.col("c_custkey"))
    nation = nation.withColumn("place", F.col("n_nationkey"))
    sheets = [
        sheet(customer, CONCEPTS, {"业务对象": "nullif(c_mktsegment, 'HOUSEHOLD')", "概念实体": "concat(' ', n_name)", "编号": "c_nationkey"}),
        sheet(supplier, LOGICAL, {"概念实体": "n_name", "逻辑实体名称": "if(s_suppkey % 9 = 0, 'nan', s_name)", "逻辑实体编码": "s_suppkey"}),
        sheet(customer, PHYSICAL, {"逻辑实体名称": "concat('L', c_custkey % 40)", "物理实体名称": "concat('T', c_custkey % 7)", "物理实体编码": "c_custkey"}),
        sheet(nation.where("region <> 'AFRICA'"), BUSINESS, {"业务对象名称 ": "n_name", "说明": "region"}),
    ]
    rows = sheets[0]
    for s in sheets[1:]:
        rows = rows.unionByName(s)
    path = folder(spark, "books")
    files.write_workbooks(rows, path)
    return path


def cells(spark: SparkSession, sf_dir: str, header: str = "first") -> DataFrame:
    """The written workbooks' cells; file is the region."""
    read = files.read_workbooks(spark, written(spark, sf_dir), header)
    return read.withColumn("file", F.element_at(F.split("file", "/"), -2))


BY_REGION = """n AS (SELECT n_nationkey, n_name, r_name AS file FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {BY_REGION} SELECT file, n_name AS upper, s_name AS lower, arg_min(CAST(s_suppkey AS VARCHAR), s_suppkey) AS code FROM supplier JOIN n ON s_nationkey = n_nationkey WHERE s_suppkey % 9 <> 0 GROUP BY ALL")
def concept_logical_pairs(spark, sf_dir):
    return files.entity_pairs(cells(spark, sf_dir), LOGICAL, "概念实体", "逻辑实体名称", "逻辑实体编码").drop("row")


@query(f"WITH {BY_REGION} SELECT file, 'L' || c_custkey % 40 AS upper, 'T' || c_custkey % 7 AS lower, arg_min(CAST(c_custkey AS VARCHAR), c_custkey) AS code FROM customer JOIN n ON c_nationkey = n_nationkey GROUP BY ALL")
def logical_physical_pairs(spark, sf_dir):
    return files.entity_pairs(cells(spark, sf_dir), PHYSICAL, "逻辑实体名称", "物理实体名称", "物理实体编码").drop("row")


@query(f"WITH {BY_REGION} SELECT DISTINCT file, n_name AS name FROM n WHERE file = (SELECT min(file) FROM n WHERE file <> 'AFRICA')")
def business_object_names(spark, sf_dir):
    return files.business_objects(cells(spark, sf_dir), BUSINESS, "业务对象名称")


@query(f"WITH {BY_REGION} SELECT DISTINCT c_mktsegment AS business, n_name AS concept FROM customer JOIN n ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'HOUSEHOLD'")
def business_object_concepts(spark, sf_dir):
    return files.business_object_concepts(cells(spark, sf_dir), CONCEPTS, "业务对象", "概念实体")


LAYERS = {"CONCEPT": (CONCEPTS, "概念实体", "编号"), "LOGICAL": (LOGICAL, "逻辑实体名称", "逻辑实体编码"), "PHYSICAL": (PHYSICAL, "物理实体名称", "物理实体编码")}


@query(f"""WITH {BY_REGION} SELECT 'CONCEPT' AS layer, file, n_name AS name, CAST(n_nationkey AS VARCHAR) AS code FROM n WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
 UNION ALL SELECT 'LOGICAL', file, s_name, arg_min(CAST(s_suppkey AS VARCHAR), s_suppkey) FROM supplier JOIN n ON s_nationkey = n_nationkey WHERE s_suppkey % 9 <> 0 GROUP BY ALL
 UNION ALL SELECT 'PHYSICAL', file, 'T' || c_custkey % 7, arg_min(CAST(c_custkey AS VARCHAR), c_custkey) FROM customer JOIN n ON c_nationkey = n_nationkey GROUP BY ALL""")
def all_inventories(spark, sf_dir):
    return files.all_inventories(cells(spark, sf_dir), LAYERS).drop("row")


@query(f"""WITH {BY_REGION}, c AS (SELECT file, c_mktsegment FROM customer JOIN n ON c_nationkey = n_nationkey), p AS (SELECT file, s_suppkey FROM supplier JOIN n ON s_nationkey = n_nationkey), u AS (
 SELECT file, 0 AS s, unnest([0, 1]) AS i, unnest(['业务对象名称', '说明']) AS a FROM n WHERE file <> 'AFRICA'
 UNION ALL SELECT file, 1, 0, '业务对象' FROM c WHERE c_mktsegment <> 'HOUSEHOLD' UNION ALL SELECT file, 1, unnest([1, 2]), unnest(['概念实体', '编号']) FROM c
 UNION ALL SELECT file, 2, unnest([0, 2]), unnest(['概念实体', '逻辑实体编码']) FROM p UNION ALL SELECT file, 2, 1, '逻辑实体名称' FROM p WHERE s_suppkey % 9 <> 0
 UNION ALL SELECT file, 3, unnest([0, 1, 2]), unnest(['逻辑实体名称', '物理实体名称', '物理实体编码']) FROM c),
f AS (SELECT file, a, min(10 * s + i) AS k FROM u GROUP BY ALL)
SELECT file, a AS attribute, a AS display, CAST(row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS INTEGER) AS place FROM f UNION ALL SELECT DISTINCT file, '__sheet__', '__sheet__', -1 FROM u""")
def workbook_columns(spark, sf_dir):
    return files.column_union(cells(spark, sf_dir))


@query(f"""WITH {BY_REGION}, v AS (SELECT file AS domain, 'DA-01' AS s, unnest([nullif(c_mktsegment, 'HOUSEHOLD'), n_name, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer JOIN n ON c_nationkey = n_nationkey
 UNION ALL SELECT file, 'DA-02', unnest([n_name, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END, CAST(s_suppkey AS VARCHAR)]) FROM supplier JOIN n ON s_nationkey = n_nationkey
 UNION ALL SELECT file, 'DA-03', unnest(['L' || c_custkey % 40, 'T' || c_custkey % 7, CAST(c_custkey AS VARCHAR)]) FROM customer JOIN n ON c_nationkey = n_nationkey
 UNION ALL SELECT file, 'BA-04', unnest([n_name, file]) FROM n WHERE file <> 'AFRICA')
SELECT 'PLANNING' AS stage, domain, s AS sheet, count(*) AS cells, count(DISTINCT value) AS texts FROM v WHERE value IS NOT NULL GROUP BY ALL""")
def workbook_import(spark, sf_dir):
    """A folder of workbooks as labelled cells, counted by sheet."""
    read = files.labelled_import(files.read_workbooks(spark, written(spark, sf_dir), "strict"), "PLANNING")
    cells = read.select(F.concat_ws("|", "file", "sheet", F.col("row").cast("string")).alias("entity_id"), "attribute", F.trim("value").alias("raw"), "stage", "domain", F.substring("sheet", 1, 5).alias("sheet"))
    return cells.groupBy("stage", "domain", "sheet").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("raw").alias("texts"))


@query(f"""WITH {BY_REGION}, v AS (SELECT file AS domain, 'DA-01' AS sheet, unnest([nullif(c_mktsegment, 'HOUSEHOLD'), n_name]) AS value FROM customer JOIN n ON c_nationkey = n_nationkey
 UNION ALL SELECT file, 'DA-02', unnest([n_name, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END]) FROM supplier JOIN n ON s_nationkey = n_nationkey UNION ALL SELECT file, 'BA-04', n_name FROM n WHERE file <> 'AFRICA')
SELECT domain, sheet, count(*) AS cells FROM v WHERE value IS NOT NULL AND domain <> 'ASIA' GROUP BY ALL""")
def cleaned_workbooks(spark, sf_dir):
    """Workbooks without sheets of a prefix and without each sheet's last column; a legacy domain that exists is left alone."""
    read = cells(spark, sf_dir)
    clean = mt.clean_sheets(read, ["no such sheet"], ["DA-03"]).withColumn("domain", F.col("file"))
    existing = table(spark, sf_dir, "region").where("r_name in ('ASIA', 'EUROPE')").select(F.col("r_name").alias("domain"))
    return mt.not_overwritten(clean, existing, ["ASIA", "nowhere"]).groupBy("domain", F.substring("sheet", 1, 5).alias("sheet")).agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT r_name AS domain, CASE WHEN r_name < 'B' THEN 'the ' || r_name ELSE r_name END AS name, false AS has_ba, true AS has_da, false AS has_aa FROM region WHERE r_name IN (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey)")
def domain_listing(spark, sf_dir):
    """Folders with workbooks, which of the three they have, and the display names that some give themselves."""
    path = written(spark, sf_dir)
    names = table(spark, sf_dir, "region").where("r_name < 'B'").select(F.col("r_name").alias("region"), F.to_json(F.struct(F.concat(F.lit("the "), "r_name").alias("name"))).alias("body"))

    def save(frame):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        with store.open_output_stream(f"{root}/{frame['region'].iloc[0]}/domain.json") as f:
            f.write(frame["body"].iloc[0].encode())
        return frame[["region"]]

    names.groupBy("region").applyInPandas(save, "region string").count()
    return files.named_domains(spark, path)
