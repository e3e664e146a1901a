"""Workbooks inside zip archives, read member by member.

Tasks read the central directory of each archive, members are dealt to tasks as rows
with their place in the archive, and a task reads just the bytes of its members. No
archive is unpacked, or held by a task, as a whole.
"""

from __future__ import annotations

import itertools
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import first_match
from ferrule.session import workers_import

from .files import sheet_rows

MEMBERS = "archive string, slot string, place int, name string, offset long, size long, method int"
#: Fixed value: what the header of a column of import checks holds.
CHECK = "校验"


def open_ranges(uri: str):
    """A handle that reads ranges of a file of any filesystem."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def member_name(info: zipfile.ZipInfo) -> str:
    """The member's name; one without the UTF-8 mark is GBK that was read as cp437, unless it can't be."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        return info.filename.encode("cp437").decode("gbk")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return info.filename


def members(spark: SparkSession, path: str, routes: list[tuple[str, str]], slots: dict[str, str] | None = None) -> DataFrame:
    """The columns of MEMBERS and domain, of the workbooks in all archives under path.

    domain is the target of the first keyword in routes that the name contains, else
    null. slot: of the archive's file name in slots, by default that name without .zip.
    """

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["path"]:
                file = archive.rsplit("/", 1)[1]
                slot = slots.get(file) if slots is not None else file.rsplit(".", 1)[0]
                if slot is None:
                    continue
                with open_ranges(archive) as stream, zipfile.ZipFile(stream) as z:
                    found = ((archive, slot, i, member_name(m), m.header_offset, m.compress_size, m.compress_type) for i, m in enumerate(z.infolist()) if not m.is_dir() and m.filename.lower().endswith(".xlsx"))
                    while part := list(itertools.islice(found, 10_000)):
                        yield pd.DataFrame(part, columns=["archive", "slot", "place", "name", "offset", "size", "method"])

    workers_import(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInPandas(listed, MEMBERS).withColumn("domain", first_match(F.col("name"), routes))


def member_bytes(archive: str, offset: int, size: int, method: int) -> bytes:
    """One member's content, from the bytes of it alone; stored or deflated."""
    with open_ranges(archive) as stream:
        stream.seek(offset)
        head = stream.read(30)
        if head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile(f"no member at {offset} of {archive}")
        name, extra = struct.unpack("<HH", head[26:30])
        stream.seek(offset + 30 + name + extra)
        data = stream.read(size)
    if method == zipfile.ZIP_STORED:
        return data
    if method != zipfile.ZIP_DEFLATED:
        raise NotImplementedError(f"compression {method} in {archive}")
    return zlib.decompress(data, -zlib.MAX_WBITS)


def read_archives(spark: SparkSession, path: str, routes: list[tuple[str, str]], slots: dict[str, str] | None = None, check: str | None = CHECK) -> DataFrame:
    """domain, slot, file, sheet, row, column, attribute, value of the routed workbooks' cells; a member is one task's.

    Of several members for one domain and slot the last in its archive counts, of several
    archives the last by path. A sheet whose last header cell holds `check` loses that
    column.
    """

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m in frame.itertuples(index=False):
                rows = sheet_rows(member_bytes(m.archive, m.offset, m.size, m.method), "first", check)
                while part := list(itertools.islice(rows, 50_000)):
                    yield pd.DataFrame([(m.domain, m.slot, f"{m.domain}/{m.slot}.xlsx", *r) for r in part], columns=["domain", "slot", "file", "sheet", "row", "column", "attribute", "value"])

    w = Window.partitionBy("domain", "slot").orderBy(F.desc("archive"), F.desc("place"))
    routed = members(spark, path, routes, slots).where("domain is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return routed.repartition(parts, "archive", "place").mapInPandas(cells, "domain string, slot string, file string, sheet string, row long, column int, attribute string, value string")
