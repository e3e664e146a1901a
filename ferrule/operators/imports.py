"""Imports that change tables: rows merged by hash, a domain replaced with all that hangs on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ferrule.session import written
from ferrule.sources.versions import Store

KEY = ["dataset", "row_number"]
ENTITIES = "dataset string, row_number long, external_id string, row_hash string"
VALUES = "dataset string, row_number long, attribute string, raw string"
#: Buckets of the two tables; one with a changed row is written anew.
BUCKETS = 64


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def packed(text: Column) -> Column:
    """A hash in half the bytes, if it is lower-case hex, else as it is; unpacked() gives the text again."""
    raw = F.unhex(text)
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.unhex(F.lit("01")), raw)).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(text, "UTF-8")))


def unpacked(data: Column) -> Column:
    rest = F.substring(data, 2, 1 << 30)
    return F.when(F.substring(data, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def import_rows(store: Store, rows: DataFrame, cells: DataFrame, force: bool = False, buckets: int = BUCKETS) -> dict[str, int]:
    """Merge rows and their cells into the tables entities and values of a store; returns inserted, updated, skipped.

    rows: the columns of ENTITIES, a key once; cells: those of VALUES. A row of a known
    key and hash is skipped (with force it is updated); one of another hash has its
    values replaced. Rows that are gone at the source stay. Only buckets with a new or
    changed row are read whole and written again, and where there is none nothing is
    written. What happens to each row is counted on the way; only new and changed rows are
    written down, and hashes are shuffled packed. A store keeps the number of buckets that
    its first import set.
    """
    version = store.version()
    first = "entities" not in store.manifest(version)["tables"]
    buckets = store.manifest(version)["settings"].get("buckets", buckets)
    short = lambda df: df.select(*KEY, "external_id", packed(F.col("row_hash")).alias("row_hash"))
    new = short(rows.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in ENTITIES.split(", "))]))
    same = F.lit(False) if force else F.col("__old") == F.col("row_hash")
    action = F.when(F.col("__had").isNull(), "INSERT").when(same, "SKIP").otherwise("UPDATE")
    if first:
        met = new.select("*", F.lit(None).alias("__had"), F.lit(None).cast("binary").alias("__old"))
    else:
        old = short(store.table("entities", ENTITIES, version=version))
        met = new.join(old.select(*KEY, F.col("row_hash").alias("__old"), F.lit(True).alias("__had")), KEY, "left")
    joined = met.select(*new.columns, action.alias("action"), bucket(buckets).alias("bucket"))
    counts = Observation()
    seen = joined.observe(counts, *[F.count_if(F.col("action") == a).alias(n) for a, n in (("INSERT", "inserted"), ("UPDATE", "updated"), ("SKIP", "skipped"))])
    changed = written(seen.where("action <> 'SKIP'"), "actions")
    stats = {n: int(counts.get[n]) for n in ("inserted", "updated", "skipped")}
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # at most `buckets` numbers
    if not touched:
        return stats
    parts = [str(b) for b in touched]
    entities = changed.select(*new.columns)
    values = cells.select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in VALUES.split(", "))]).join(changed.select(*KEY), KEY, "left_semi")
    if not first:
        kept = lambda name, schema: store.table(name, schema, parts, version).join(changed.select(*KEY), KEY, "left_anti")
        entities, values = short(kept("entities", ENTITIES)).unionByName(entities), kept("values", VALUES).unionByName(values)
    changes = [store.write("entities", entities, bucket(buckets), [*KEY, "external_id", unpacked(F.col("row_hash")).alias("row_hash")]), store.write("values", values, bucket(buckets))]
    # a bucket whose last value went has no folder any more
    changes = [(n, s, {**dict.fromkeys(parts), **p}) for n, s, p in changes]
    store.publish(changes, version, buckets=buckets)
    return stats


def domain_code(code: Column, domain: str) -> Column:
    return code if domain == "default" else F.concat(code, F.lit(f"_{domain}"))


def refresh_domain(store: Store, domain: str, objects: DataFrame, synonyms: DataFrame, relations: DataFrame) -> int:
    """Replace all objects, synonyms and relations of a domain together; returns the store's new version.

    objects: object_code and more, a code once (the largest row counts); synonyms:
    object_code, synonym; relations: object_code and more. Codes get the suffix
    _<domain>, but for the domain `default`; synonyms and relations of unknown codes are
    left out. A reader sees the old domain until all three tables are written.
    """
    version = store.version()
    others = [c for c in objects.columns if c != "object_code"]
    one = objects.groupBy("object_code").agg(F.max(F.struct(*others)).alias("o")).select("object_code", *[F.col(f"o.`{c}`") for c in others])
    one = written(one, "objects")
    named = lambda df: df.withColumn("object_code", domain_code(F.col("object_code"), domain)).withColumn("domain", F.lit(domain))
    known = one.select("object_code")
    tables = {"objects": one, "synonyms": synonyms.join(known, "object_code", "left_semi").distinct(), "relations": relations.join(known, "object_code", "left_semi")}
    changes = [store.write(name, named(df)) for name, df in tables.items()]
    return store.publish([(name, schema, {domain: parts[""]}) for name, schema, parts in changes], version)
