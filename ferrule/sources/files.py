"""File sources: workbooks, CSV with encoding fallback, extraction JSON, domain listings; CSV and JSON sinks."""

from __future__ import annotations

import csv
import io
import functools
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import NA_TOKENS, attribute_name
from ferrule.session import small, workers_import

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

RELATION = "struct<object_code:string,entity_layer:string,entity_name:string,entity_code:string,relation_type:string,relation_strength:double,match_method:string,via_concept_entity:string,data_domain:string>"
OBJECT = "struct<object_code:string,object_name:string,object_type:string,cluster_id:int,cluster_size:int,sample_entities:array<string>,synonyms:array<string>>"
EXTRACTION_SCHEMA = f"data_domain string, data_domain_name string, extraction_time string, objects array<{OBJECT}>, relations array<{RELATION}>, relations_count long"


def column_index(reference: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _string(item: ElementTree.Element) -> str:
    """The text of a shared or inline string; how it is read (phonetic runs) is no part of it."""
    return "".join(t.text or "" for part in item if part.tag in (f"{NS}t", f"{NS}r") for t in part.iter(f"{NS}t"))


def sheet_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every cell of a workbook; rows stream, shared strings are read once."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_string(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{NS}sheet"):
            path = targets[sheet.get(f"{REL}id")].lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            number = 0
            with book.open(path) as stream:
                rows_of = None
                for event, row in ElementTree.iterparse(stream, ("start", "end")):
                    if event == "start":
                        rows_of = row if row.tag == f"{NS}sheetData" else rows_of
                        continue
                    if row.tag != f"{NS}row":
                        continue
                    number = int(row.get("r") or number + 1)
                    column = -1
                    for cell in row.iter(f"{NS}c"):
                        column = column_index(cell.get("r")) if cell.get("r") else column + 1
                        value = cell.find(f"{NS}v")
                        if cell.get("t") == "inlineStr":
                            text = "".join(_string(x) for x in cell.iter(f"{NS}is"))
                        elif value is None or value.text is None:
                            continue
                        else:
                            text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                        yield sheet.get("name"), number, column, text
                    row.clear()
                    if rows_of is not None:
                        rows_of.clear()  # rows that were read


def sheet_rows(data: bytes, header: str, check: str | None = None) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, column, attribute, text) of the cells below each sheet's header that hold a value.

    check: where the last header cell holds this text, and is in one of the first six rows, its column is left out.
    """
    dropped: dict[str, int] = {}
    names: dict[str, tuple[int, dict[int, str]]] = {}
    for sheet, cells in itertools.groupby(sheet_cells(data), key=lambda c: c[0]):
        for row, found in itertools.groupby(cells, key=lambda c: c[1]):
            texts = {column: text for _, _, column, text in found}
            if sheet not in names:
                if header == "first" and not any(t.strip() for t in texts.values()):
                    continue
                if header == "strict" and (row != 1 or not any(t.strip() for t in texts.values())):
                    names[sheet] = (0, {})  # its first row is blank: the sheet has no header
                    continue
                names[sheet] = (row, {c: " ".join(t.split()) for c, t in texts.items()})
                last = max((c for c, t in texts.items() if t), default=-1)
                if check is not None and row <= 6 and check in texts.get(last, ""):
                    dropped[sheet] = last
                continue
            at, known = names[sheet]
            if not at:
                continue
            for column, text in texts.items():
                if text.strip().lower() not in NA_TOKENS and column != dropped.get(sheet):
                    yield sheet, row, column, known.get(column) or f"col_{column}", text


def read_workbooks(spark: SparkSession, path: str, header: str = "first") -> DataFrame:
    """file, sheet, row, column, attribute, value of all cells below the header, as strings.

    header: "first" takes the first row that isn't blank; "strict" takes row 1 alone and
    leaves out sheets where it is blank. Blank header cells are col_<i>; cells that say
    that there is no value are left out. A file is one task.
    """

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                rows = sheet_rows(bytes(data), header)
                while part := list(itertools.islice(rows, 50_000)):
                    yield pd.DataFrame([(name, *r) for r in part], columns=["file", "sheet", "row", "column", "attribute", "value"])

    workers_import(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(cells, "file string, sheet string, row long, column int, attribute string, value string")


def _save_book(target, sheets: Iterator[tuple[str, Iterator[list]]]) -> None:
    """A workbook of inline strings into a binary stream, a row at a time; None leaves a cell out."""
    names = []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, rows) in enumerate(sheets, 1):
            names.append(name)
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                part.write(f'<worksheet xmlns="{NS[1:-1]}"><sheetData>'.encode())
                for row in rows:
                    part.write(("<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for v in row) + "</row>").encode())
                part.write(b"</sheetData></worksheet>")
        listed = "".join(f"<sheet name={quoteattr(n)} sheetId=\"{i}\" r:id=\"rId{i}\"/>" for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of inline strings; None leaves a cell out."""
    out = io.BytesIO()
    _save_book(out, ((n, iter(rows)) for n, rows in sheets.items()))
    return out.getvalue()


def write_workbooks(rows: DataFrame, folder: str) -> int:
    """One workbook for each name in `file`; rows: file, sheet, row, cells (array<string>, the header being row 0). Returns the number of files.

    A file is one task's, which gets its rows in order and writes them as they come.
    """

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        each = ((r.file, r.sheet, list(r.cells)) for frame in frames for r in frame.itertuples(index=False))
        for file, own in itertools.groupby(each, key=lambda r: r[0]):
            path = f"{root}/{file}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as f:
                _save_book(f, ((sheet, (r[2] for r in part)) for sheet, part in itertools.groupby(own, key=lambda r: r[1])))
            yield pd.DataFrame({"file": [path]})

    workers_import(rows.sparkSession)
    ordered = rows.select("file", "sheet", "row", "cells").repartition("file").sortWithinPartitions("file", "sheet", "row")
    return ordered.mapInPandas(save, "file string").count()


def _named(cells: DataFrame, sheet_prefix: str, columns: dict[str, str]) -> DataFrame:
    """file, row and the renamed columns of the sheets with a name prefix; blank and "nan" cells are null."""
    squeezed = F.regexp_replace("sheet", " ", "")
    own = cells.where(squeezed.startswith(sheet_prefix.replace(" ", ""))).withColumn("attribute", F.trim("attribute"))
    rows = own.groupBy("file", "sheet", "row").pivot("attribute", list(columns)).agg(F.first("value"))
    for old, new in columns.items():
        rows = rows.withColumnRenamed(old, new).withColumn(new, F.trim(new))
        rows = rows.withColumn(new, F.when((F.col(new) != "") & (F.col(new) != "nan"), F.col(new)))
    return rows


def entity_pairs(cells: DataFrame, sheet_prefix: str, upper: str, lower: str, code: str) -> DataFrame:
    """file, upper, lower, code, row: distinct pairs of each file, both there; the first row of a pair counts."""
    rows = _named(cells, sheet_prefix, {upper: "upper", lower: "lower", code: "code"}).where("upper is not null and lower is not null")
    return rows.groupBy("file", "upper", "lower").agg(F.min(F.struct("row", "code")).alias("first")).select("file", "upper", "lower", "first.code", "first.row")


def business_objects(cells: DataFrame, sheet_prefix: str, column: str) -> DataFrame:
    """file, name: the distinct names of the first file, by its path, that has the sheet and the column with a name."""
    rows = _named(cells, sheet_prefix, {column: "name"}).where("name is not null")
    first = rows.agg(F.min("file").alias("f"))
    return rows.withColumn("f", first.scalar()).where("file = f").select("file", "name").distinct()


def business_object_concepts(cells: DataFrame, sheet_prefix: str, business: str, concept: str) -> DataFrame:
    """business, concept: distinct pairs over all files, both there."""
    rows = _named(cells, sheet_prefix, {business: "business", concept: "concept"})
    return rows.where("business is not null and concept is not null").select("business", "concept").distinct()


def all_inventories(cells: DataFrame, layers: dict[str, tuple[str, str, str]]) -> DataFrame:
    """layer, file, name, code, row: the inventories of all layers; layers: name -> (sheet prefix, name column, code column)."""
    parts = [inventory(cells, sheet, {name: "name", code: "code"}).select(F.lit(layer).alias("layer"), "file", "name", "code", "row") for layer, (sheet, name, code) in layers.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def column_union(cells: DataFrame, system: bool = True) -> DataFrame:
    """attribute, display, place of the columns of all sheets of each file, equal names after normalising being one.

    The display name and the order are those of the first occurrence (sheets by name); the
    system attribute __sheet__ has place -1.
    """
    seen = cells.groupBy("file", "sheet", "column", F.col("attribute").alias("display")).agg(F.min("row").alias("row"))
    first = seen.groupBy("file", attribute_name(F.col("display")).alias("attribute")).agg(F.min(F.struct("sheet", "column", "display")).alias("s"))
    w = Window.partitionBy("file").orderBy("s")  # one row a column of a file
    rows = first.select("file", "attribute", F.col("s.display").alias("display"), (F.row_number().over(w) - 1).alias("place"))
    if not system:
        return rows
    own = cells.select("file").distinct().select("file", F.lit("__sheet__").alias("attribute"), F.lit("__sheet__").alias("display"), F.lit(-1).alias("place"))
    return rows.unionByName(own)


def labelled_import(cells: DataFrame, stage: str, domain: str | None = None) -> DataFrame:
    """Cells of a folder of workbooks with the stage and the domain (the folder's name if absent) of their batch."""
    own = F.element_at(F.split("file", "/"), -2)
    return cells.withColumns({"stage": F.lit(stage), "domain": F.lit(domain) if domain else own})


def inventory(cells: DataFrame, sheet_prefix: str, columns: dict[str, str]) -> DataFrame:
    """Rows of the sheets with a name prefix, columns renamed, distinct by name in each file: the first row counts, of the first sheet by name."""
    rows = _named(cells, sheet_prefix, columns).where("name is not null").where(F.lower("name") != "nan")
    w = Window.partitionBy("file", "name").orderBy("sheet", "row")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "sheet")


def csv_encodings(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding (UTF-8, GB18030 or null) and broken (a quoted cell holds a line end) of each file.

    Files are read by lines, which Spark's reader splits into ranges, so a file of any
    size is many tasks'. A line end is never part of a character in these encodings, and a
    line with an odd number of quotes ends inside quotes or begins there.
    """

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def readable(line: bytes) -> bool:
            try:
                line.decode("gb18030")
                return True
            except UnicodeDecodeError:
                return False

        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "wide": [readable(bytes(x)) for x in frame["line"]]})

    workers_import(spark)
    lines = _lines(spark, path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    plain = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("broken"))
    odd = lines.where(~F.is_valid_utf8("value")).select("path", F.col("value").cast("binary").alias("line"))
    wide = odd.mapInPandas(judge, "path string, wide boolean").groupBy("path").agg(F.bool_and("wide").alias("wide"))
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("wide"), "GB18030")
    return plain.join(wide, "path", "left").select("path", encoding.alias("encoding"), "broken")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, value (its bytes, whatever the encoding), at and first (of the file's first range) of every line."""
    read = spark.read.option("lineSep", "\n").option("pathGlobFilter", "[!._]*").text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"), (F.col("_metadata.file_block_start") == 0).alias("first"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, all columns strings; each file is read in its own encoding.

    UTF-8 files are read by Spark's reader. Spark's readers don't admit GB18030 by
    default, so files in it are parsed in tasks, by ranges of lines. A file whose quoted
    cells hold line ends is one task's. Columns are those of all files, null where a file
    lacks one; a file that no encoding reads raises.
    """
    found = csv_encodings(spark, path).collect()  # a name a file
    if not all(r["encoding"] for r in found):
        raise ValueError(f"no known encoding: {[r['path'] for r in found if not r['encoding']][:3]}")
    of = lambda encoding, broken: [r["path"] for r in found if r["encoding"] == encoding and r["broken"] == broken]
    read = spark.read.option("header", True).option("inferSchema", False)
    parts = [read.option("multiLine", lines).option("escape", '"').csv(paths) for lines in (False, True) if (paths := of("UTF-8", lines))]
    parts += [_read_wide_lines(spark, paths) for paths in [of("GB18030", False)] if paths] + [_read_wide(spark, paths) for paths in [of("GB18030", True)] if paths]
    if not parts:
        return spark.createDataFrame([], "value string")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _cells(lines: list[str], columns: list[str], names: list[str]) -> pd.DataFrame:
    at = {c: i for i, c in enumerate(names)}
    rows = [r for r in csv.reader(lines) if r]
    return pd.DataFrame({c: pd.Series([(r[at[c]] or None) if c in at and at[c] < len(r) else None for r in rows], dtype=object) for c in columns})


def _read_wide_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """GB18030 files without line ends in cells, by ranges of lines; each line carries the header of its file."""
    workers_import(spark)
    lines = _lines(spark, paths)
    heads = lines.where("first").groupBy("path").agg(F.min(F.struct("at", "value")).alias("h")).select("path", F.col("h.value").cast("binary").alias("head"), F.col("h.at").alias("skip"))
    text = lambda b: bytes(b).decode("gb18030").rstrip("\r")
    names = lambda b: unlike(next(csv.reader([text(b)]), []))
    heads = small(heads)  # a row a file
    known = [names(r["head"]) for r in heads.orderBy("path").collect()]
    columns = list(dict.fromkeys(c for own in known for c in own))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for head, part in frame.groupby(frame["head"].map(bytes), sort=False):
                yield _cells([text(x) for x in part["line"]], columns, names(head))

    rows = lines.join(heads, "path").where("at <> skip").select("head", F.col("value").cast("binary").alias("line"))
    return rows.mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def unlike(names: list[str]) -> list[str]:
    """Names of columns as Spark's CSV reader makes them: repeated ones, without case, get their place, empty ones are _c<place>."""
    count: dict[str, int] = {}
    for n in names:
        count[n.lower()] = count.get(n.lower(), 0) + 1
    return [f"_c{i}" if not n else f"{n}{i}" if count[n.lower()] > 1 else n for i, n in enumerate(names)]


def _read_wide(spark: SparkSession, paths: list[str]) -> DataFrame:
    """GB18030 files: cells are parsed in tasks, a file a task, and come back as columns by one projection."""

    def rows_of(data: bytes) -> tuple[list[str], Iterator[list[str]]]:
        rows = csv.reader(io.StringIO(data.decode("gb18030"), newline=""))
        return unlike(next(rows, [])), rows

    def header(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(c, i) for data in frame["content"] for i, c in enumerate(rows_of(bytes(data))[0])]
            yield pd.DataFrame(found, columns=["column", "at"])

    files = spark.read.format("binaryFile").load(paths).select("content")
    columns = [r["column"] for r in files.mapInPandas(header, "column string, at int").groupBy("column").agg(F.min("at").alias("at")).orderBy("at", "column").collect()]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                names, reader = rows_of(bytes(data))
                at = {c: i for i, c in enumerate(names)}
                while part := list(itertools.islice(reader, 10_000)):
                    rows = [r for r in part if r]
                    yield pd.DataFrame({c: pd.Series([(r[at[c]] or None) if c in at and at[c] < len(r) else None for r in rows], dtype=object) for c in columns})

    return files.mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def read_extractions(spark: SparkSession, path: str, skip: tuple[str, ...] = ("global_extraction", "sample_join")) -> DataFrame:
    """Extraction results, one row a file; the domain is the field or else the file's name."""
    rows = spark.read.schema(EXTRACTION_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    for name in skip:
        rows = rows.where(~F.col("file").startswith(name))
    return rows.withColumn("data_domain", F.coalesce(F.nullif("data_domain", F.lit("")), F.regexp_extract("file", r"^(.*?)(_extraction)?\.json$", 1)))


def extracted_objects(extractions: DataFrame) -> DataFrame:
    rows = extractions.select("data_domain", F.explode("objects").alias("o"))
    return rows.select("data_domain", "o.*")


def extracted_relations(extractions: DataFrame) -> DataFrame:
    """Relations with the layer upper-cased and known, names cut to 512 and codes to 256 characters, '' null."""
    rows = extractions.select(F.col("data_domain").alias("domain"), F.explode("relations").alias("r")).select("domain", "r.*")
    layer = F.upper("entity_layer")
    rows = rows.withColumn("entity_layer", layer).where(layer.isin("CONCEPT", "LOGICAL", "PHYSICAL"))
    return rows.withColumn("entity_name", F.substring("entity_name", 1, 512)).withColumn("entity_code", F.nullif(F.substring("entity_code", 1, 256), F.lit("")))


def list_domains(spark: SparkSession, root: str) -> DataFrame:
    """Subfolders with workbooks and which of 1, 2, 3.xlsx they have; names with a leading _ are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("domain"), F.element_at(parts, -1).alias("file")).where(~F.col("domain").startswith("_"))
    return rows.groupBy("domain").agg(*[F.bool_or(F.col("file") == f"{i}.xlsx").alias(n) for i, n in ((1, "has_ba"), (2, "has_da"), (3, "has_aa"))])


def named_domains(spark: SparkSession, root: str) -> DataFrame:
    """list_domains() with name: `name` of the folder's domain.json, the folder's own name where there is none or it can't be read."""
    found = spark.read.schema("name string").option("multiLine", True).option("pathGlobFilter", "domain.json").option("recursiveFileLookup", True).json(root)
    named = found.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("domain"), F.col("name").alias("__name")).groupBy("domain").agg(F.max("__name").alias("__name"))
    rows = list_domains(spark, root).join(named, "domain", "left")
    return rows.select("domain", F.coalesce(F.nullif(F.trim("__name"), F.lit("")), "domain").alias("name"), "has_ba", "has_da", "has_aa")


def chosen_files(listing: DataFrame, domain: str, explicit: list[str] | None = None, configured: list[str] | None = None) -> DataFrame:
    """The files of listing (path, relative to the root) that a domain's run reads, by name.

    Explicit files that exist; else the workbooks in the domain's folder; else the
    configured files of the root that exist, or all workbooks of the root where none is
    configured.
    """
    name = F.element_at(F.split("path", "/"), -1)
    book = F.col("path").endswith(".xlsx")
    choices = [F.col("path").isin(explicit)] if explicit else []
    choices += [book & F.col("path").rlike(f"^{re.escape(domain)}/[^/]+$"), F.col("path").isin(configured) if configured else book & ~F.col("path").contains("/")]
    rank = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(choices)])
    rows = listing.select("path", name.alias("name"), rank.alias("rank")).where("rank is not null")
    return rows.withColumn("least", rows.agg(F.min("rank").alias("r")).scalar()).where("rank = least").select("path", "name").orderBy("name", "path")


def extraction_of(extractions: DataFrame, domain: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """The extraction of a domain by its own name, else by its alias (a legacy code); none where there is neither."""
    codes = [domain, *([aliases[domain]] if aliases and domain in aliases else [])]
    place = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("data_domain"))
    rows = extractions.where(F.col("data_domain").isin(codes)).withColumn("__place", place)
    return rows.withColumn("__first", rows.agg(F.min("__place").alias("p")).scalar()).where("__place = __first").drop("__place", "__first")


def blank_nulls(rows: DataFrame) -> DataFrame:
    """rows with null texts empty, as readers of the export expect them."""
    return rows.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rows.schema])


def catalog(objects: DataFrame, relations: DataFrame, extractions: DataFrame, domain: str, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, relations) of a domain: the tables' rows, or the extraction's where the tables have no object of it."""
    own = objects.where(F.col("data_domain") == domain)
    if not own.isEmpty():
        return own, relations.where(F.col("data_domain") == domain)
    one = extraction_of(extractions, domain, aliases)
    return blank_nulls(extracted_objects(one)), blank_nulls(extracted_relations(one))


def write_report(rows: DataFrame, path: str) -> None:
    """from_text, freq, canonical_text, similarity, cluster_size as CSV; commas in texts become wide ones."""
    text = lambda c: F.translate(c, ",", "，").alias(c)
    rows.select(text("from_text"), "freq", text("canonical_text"), F.round("similarity", 5).alias("similarity"), "cluster_size").write.mode("overwrite").option("header", True).csv(path)


def export_objects(objects: DataFrame, relations: DataFrame, path: str) -> None:
    """Objects with their relations as JSON lines, ordered by code."""
    nested = relations.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("layer", "entity_name", "strength"))).alias("relations"))
    objects.join(nested, "object_id", "left").orderBy("object_code").write.mode("overwrite").json(path)
