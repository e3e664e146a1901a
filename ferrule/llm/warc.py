"""WARC archives: a writer with revisit records and a splittable reader.

write() makes one gzip member per record and one archive per partition, each headed by
a warcinfo record. A record's block is an HTTP response: a head and the payload. Of
records with equal payloads of at least MIN_REVISIT bytes the one with the largest id is
the response; the others are revisits that name it and carry the head alone.

read() lists the archives with their lengths through Spark, deals byte ranges to
tasks, and each task looks for the gzip magic in its range. A candidate counts as a
member only if it inflates to a WARC header; a task owns the records whose member
starts inside its range and reads past the end only to finish the last one.

Defined cases: a null payload is empty; a null url is written as NO_URL and read back as
null; rows that repeat the largest id and the payload are all responses, with one record
id; a null id is written as no id and read back as null, and is a revisit where another
row of its payload has an id; a payload of any length is one record, inflated whole by
one task; columns but the three named ones are not read; a gzip member inside a payload
that itself holds a WARC record would count as a record, which no text payload can; an
empty table gives an empty archive folder and no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, storage

MIN_REVISIT = 1000
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
READ_SCHEMA = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


NO_URL = "urn:page:no-url"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page")


def record_id(page_id, digest: str, place: str = "") -> str:
    """A record's URN: of its page and payload, or of its place where it has no page id."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}' if page_id is not None else place)}>"


def http_head(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def header(page_id, url, kind: str, length: int, digest: str, size: int, refers_to, date: str, place: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {date}"]
    lines += ["WARC-Target-URI: " + (NO_URL if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def info(date: str, place: str) -> bytes:
    """The warcinfo record of an archive."""
    body = b"software: ferrule\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, '', place)}", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def parse(record: bytes) -> dict | None:
    """The fields of a record, None where it does not begin with a WARC header."""
    head, gap, body = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "surrogatepass").partition(":") for x in lines[1:])}
    block = body[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    number = lambda text: int(text) if text else None
    url = fields.get("warc-target-uri")
    out = {"id": number(fields.get("x-page-id")), "url": None if url in (None, NO_URL) else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": fields["warc-type"], "refers_to": number(fields.get("x-refers-to-page")), "payload": payload}
    whole = out["record_type"] == "response"
    out["payload_bytes"] = len(payload) if whole else int(fields.get("x-payload-bytes", len(payload)))
    out["payload_digest"] = hashlib.sha1(payload).hexdigest() if whole else fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return out


def with_types(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """id, url, payload, digest, record_type and refers_to of every row.

    Only digests that occur twice or more are joined back, salted, so that a payload
    that a third of all rows share is not one task.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_revisit)
    # partial aggregates: a row for each digest and task
    groups = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("chief")).where("n > 1").select("digest", "chief")
    rows = rows.withColumn("size", F.octet_length("payload"))
    joined = common.small_join(rows, common.cut(groups), ["digest"], "left")
    again = F.coalesce((F.col("size") >= min_revisit) & F.col("chief").isNotNull() & ~F.col("id").eqNullSafe(F.col("chief")), F.lit(False))
    return joined.select("id", "url", "payload", "digest", "size", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("chief")).alias("refers_to"))


def write(records: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Archives in folder, one a partition; returns path and records of each, written when the result is.

    date: the records' WARC-Date, the time of the call if absent.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        stream, commit = None, None
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    stream, commit = storage.open_new(path)
                    stream.write(member(info(date, path)))
                body = http_head(row["size"]) + (row["payload"] if row["record_type"] == "response" else b"")
                head = header(row["id"], row["url"], row["record_type"], len(body), row["digest"], row["size"], row["refers_to"], date, f"{path} {n}")
                stream.write(member(head + body + b"\r\n\r\n"))
                n += 1
        if stream is not None:
            commit()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return records.mapInArrow(task, "path string, records long")


def members(source, start: int, stop: int, size: int) -> Iterator[bytes]:
    """The inflated WARC records whose gzip members start in [start, stop) of an open file."""
    step = 1 << 20
    buffer, base = b"", start

    def more() -> bool:
        nonlocal buffer
        at = base + len(buffer)
        if at >= size:
            return False
        source.seek(at)
        buffer += source.read(min(step, size - at))
        return True

    while True:
        at = buffer.find(MAGIC)
        if at < 0:
            keep = max(0, len(buffer) - len(MAGIC) + 1)
            base, buffer = base + keep, buffer[keep:]
            if base >= stop or not more():
                return
            continue
        base, buffer = base + at, buffer[at:]
        if base >= stop:
            return
        inflate, out, used, good = zlib.decompressobj(31), [], 0, True
        try:
            while not inflate.eof:
                if used == len(buffer) and not more():
                    good = False
                    break
                piece = buffer[used:]
                out.append(inflate.decompress(piece))
                used = len(buffer) - len(inflate.unused_data)
                if not out[0].startswith(b"WARC/1.") and sum(map(len, out)) >= 7:
                    good = b"".join(out).startswith(b"WARC/1.")
                    if not good:
                        break
        except zlib.error:
            good = False
        if good:
            yield b"".join(out)
            base, buffer = base + used, buffer[used:]
        else:
            base, buffer = base + 1, buffer[1:]


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, kinds: tuple[str, ...] = ("response", "revisit"), payload: bool = True) -> DataFrame:
    """One row a record of the archives in folder; columns of READ_SCHEMA."""
    common.prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("at"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
        for batch in batches:
            for r in batch.to_pylist():
                with storage.open_ranges(r["path"]) as source:
                    for record in members(source, r["at"], min(r["at"] + range_bytes, r["length"]), r["length"]):
                        found = parse(record)
                        if found is None or found["record_type"] not in kinds:
                            continue
                        held += len(found["payload"])
                        if not payload:
                            found["payload"] = None
                        rows.append(found)
                        if len(rows) >= 2000 or held >= 16 << 20:
                            yield batch_of()
                            rows, held = [], 0
        if rows:
            yield batch_of()

    return ranges.repartition(tasks, "path", "at").mapInArrow(task, READ_SCHEMA)
