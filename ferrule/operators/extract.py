"""Object extraction: naming clusters and linking objects to their entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import char_grams, sample_grams, sample_letters
from ferrule.session import small, workers_import, written

from . import needles


def keyword_extract(entities: DataFrame, keywords: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, object_code, entity_name): every object whose keyword occurs in the name.

    Entity names are distinct (by domain, say), the last row of a name wins. Names and
    keywords meet in the needle index, each distinct name once.
    """
    last = written(entities.groupBy(*by, "entity_name").agg(F.max_by("entity_code", "row").alias("entity_code")), "names")
    hit = needles.contained(last.select(F.col("entity_name").alias("id"), F.col("entity_name").alias("text")), keywords.select(F.col("keyword").alias("needle")))
    hit = hit.join(keywords, F.col("needle") == F.col("keyword")).select("object_code", F.col("id").alias("entity_name")).distinct()
    return hit.join(last, "entity_name").select(*by, "object_code", "entity_name", "entity_code", F.lit(0.8).alias("strength"))


def keyword_objects(entities: DataFrame, keywords: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, object_code, concept, logical, physical, total): the objects of keyword_extract() with their entities by layer, most first.

    entities has a layer; a name counts in the layer of its last row.
    """
    rows = keyword_extract(entities.withColumn("entity_code", F.col("layer")), keywords, by)
    count = [F.count_if(F.col("entity_code") == x).alias(x.lower()) for x in ("CONCEPT", "LOGICAL", "PHYSICAL")]
    return rows.groupBy(*by, "object_code").agg(*count, F.count(F.lit(1)).alias("total")).orderBy(*by, F.desc("total"), "object_code")


def rule_naming(clusters: DataFrame, keywords: DataFrame) -> DataFrame:
    """cluster_id, object_code, hits: the object with most keyword hits in a cluster's samples.

    clusters: cluster_id, size, samples. Ties go to the earlier keyword; of clusters that get
    one code the largest keeps it and the others vanish.
    """
    samples = clusters.select(F.struct("cluster_id", "size").alias("id"), F.explode("samples").alias("text"))
    hits = needles.contained(samples, keywords.select(F.col("keyword").alias("needle")), distinct=False).select("needle", "id.*")
    hits = hits.join(keywords, F.col("needle") == F.col("keyword"))
    counts = hits.groupBy("cluster_id", "size", "object_code").agg(F.count(F.lit(1)).alias("hits"), F.min("position").alias("position"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("hits"), "position"))).where("r = 1")
    owner = Window.partitionBy("object_code").orderBy(F.desc("size"), "cluster_id")
    return best.withColumn("r", F.row_number().over(owner)).where("r = 1").select("cluster_id", "object_code", "hits", F.lit(0.7).alias("confidence"))


#: Words that no object is named after.
NAME_STOP = ["信息", "数据", "管理", "记录", "清单", "明细", "编码", "名称", "类型", "状态"]


def content_naming(clusters: DataFrame, stop: list[str], least: int = 3, garbage=None, top: int | None = None) -> DataFrame:
    """The most common 2- or 3-gram of a cluster's names, or a pending mark below `least` occurrences; ties by gram.

    garbage: predicate of names (a column function) that no object gets; top: only so many
    most common grams are looked at. The confidence of such a name is 0.5.
    """
    grams = clusters.select("cluster_id", F.explode(char_grams(F.col("name"))).alias("gram"))
    counts = grams.groupBy("cluster_id", "gram").agg(F.count(F.lit(1)).alias("freq"))
    if top is not None:
        first = Window.partitionBy("cluster_id").orderBy(F.desc("freq"), "gram")
        counts = counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).drop("r")
    counts = counts.where(~F.col("gram").isin(stop))
    if garbage is not None:
        counts = counts.where(~garbage(F.col("gram")))
    best = counts.groupBy("cluster_id").agg(F.min(F.struct((-F.col("freq")).alias("m"), "gram")).alias("b")).select("cluster_id", F.col("b.gram").alias("gram"), (-F.col("b.m")).alias("freq"))
    ids = clusters.select("cluster_id").distinct().join(best, "cluster_id", "left")
    good = F.coalesce(F.col("freq"), F.lit(0)) >= least
    return ids.select("cluster_id", F.when(good, F.col("gram")).otherwise(F.concat(F.lit("OBJ__PENDING_MERGE_"), F.col("cluster_id").cast("string"))).alias("name"), F.coalesce("freq", F.lit(0)).alias("freq"), F.lit(0.5).alias("confidence"))


def hierarchical_relations(members: DataFrame, concept_logical: DataFrame, logical_physical: DataFrame) -> DataFrame:
    """Relations down the layers: concept (.9 for samples, .8), logical .7 via concept, physical .6 via logical.

    members: object_code, concept, is_sample; the pair tables: concept, logical and logical, physical.
    """
    c = members.select("object_code", F.lit("CONCEPT").alias("layer"), F.col("concept").alias("entity_name"), F.lit(None).cast("string").alias("via"), F.when(F.col("is_sample"), 0.9).otherwise(0.8).alias("strength"), F.lit("DIRECT").alias("relation_type"))
    l = members.join(concept_logical, "concept")
    low = l.select("object_code", F.lit("LOGICAL").alias("layer"), F.col("logical").alias("entity_name"), F.col("concept").alias("via"), F.lit(0.7).alias("strength"), F.lit("INDIRECT").alias("relation_type"))
    p = l.join(logical_physical, "logical").select("object_code", F.lit("PHYSICAL").alias("layer"), F.col("physical").alias("entity_name"), F.col("logical").alias("via"), F.lit(0.6).alias("strength"), F.lit("INDIRECT").alias("relation_type"))
    return c.unionByName(low).unionByName(p)


def infer_physical(logical: DataFrame, physical: DataFrame) -> DataFrame:
    """The physical entities, or one inferred for each logical one where there are none at all."""
    if not physical.isEmpty():
        return physical.select("entity_name", "entity_code")
    return logical.groupBy("entity_name").agg(F.min("entity_code").alias("entity_code")).select(F.concat("entity_name", F.lit("（推断）")).alias("entity_name"), F.concat(F.lit("INFERRED_"), "entity_code").alias("entity_code"))


def business_match(samples: DataFrame, business: DataFrame) -> DataFrame:
    """(object_code, business, score): hits of an object's samples in each business object over its most hits."""
    hits = samples.join(business, "concept").groupBy("object_code", "business").agg(F.count(F.lit(1)).alias("hits"))
    most = F.max("hits").over(Window.partitionBy("object_code"))
    return hits.select("object_code", "business", F.round(F.col("hits") / most, 4).alias("score"))


#: Strength of a relation over a business object, in shares of its score.
BRIDGED = {"CONCEPT": 0.75, "LOGICAL": 0.55, "PHYSICAL": 0.45}


def bridged_relations(matches: DataFrame, business: DataFrame, concept_logical: DataFrame, logical_physical: DataFrame, existing: DataFrame) -> DataFrame:
    """Relations over business objects at .75, .55 and .45 of the score, without existing keys; the strongest of a key.

    An entity carries the business objects that it belongs to down the layers, and meets
    the objects matched with them only at the end: no row is multiplied by the number of
    objects before it is written out. Existing keys are grouped with the entities.
    """
    best = small(matches.where("business is not null").groupBy("business", "object_code").agg(F.max("score").alias("score")))
    gathered = F.sort_array(F.array_distinct(F.flatten(F.collect_set("of")))).alias("of")
    c = business.join(best.select("business").distinct(), "business", "left_semi").groupBy("concept").agg(F.sort_array(F.collect_set("business")).alias("of"))
    l = concept_logical.join(c, "concept").groupBy("logical").agg(gathered)
    p = logical_physical.join(l, "logical")
    row = lambda layer, name, of, known: (layer.alias("layer"), F.col(name).alias("entity_name"), of.alias("of"), known.cast("string").alias("known"))
    rows = existing.where("object_code is not null and entity_name is not null").select(*row(F.col("layer"), "entity_name", F.lit(None).cast("array<string>"), F.col("object_code")))
    for df, layer, name in ((c, "CONCEPT", "concept"), (l, "LOGICAL", "logical"), (p, "PHYSICAL", "physical")):
        rows = rows.unionByName(df.select(*row(F.lit(layer), name, F.col("of"), F.lit(None))))
    held = rows.groupBy("layer", "entity_name").agg(gathered, F.collect_set("known").alias("known"))
    found = held.select("layer", "entity_name", "known", (F.size("of") > 1).alias("several"), F.explode("of").alias("business")).join(best, "business")
    found = found.where(~F.coalesce(F.array_contains("known", F.col("object_code")), F.lit(False)))
    key = ["object_code", "layer", "entity_name"]
    strongest = found.where("several").groupBy(*key).agg(F.max("score").alias("score"))
    share = F.coalesce(*[F.when(F.col("layer") == x, f) for x, f in BRIDGED.items()])
    return found.where("not several").select(*key, "score").unionByName(strongest).select(*key, F.round(F.col("score") * share, 4).alias("strength"))


def extraction_stats(relations: DataFrame) -> DataFrame:
    """Rows per layer of each object and how many came by which method."""
    count = lambda c: F.count_if(c)
    return relations.groupBy("object_code").agg(*[count(F.col("layer") == x).alias(x.lower()) for x in ("CONCEPT", "LOGICAL", "PHYSICAL")], F.count(F.lit(1)).alias("total"), count(F.col("method") == "CLUSTER").alias("cluster_relations"), count(F.col("method") == "BRIDGE").alias("bridge_relations"))


def occurrences(entities: DataFrame) -> DataFrame:
    """Distinct names with how often and in which files they occur."""
    return entities.groupBy("entity_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def lacking(objects: DataFrame, relations: DataFrame, required: list[str], least: int = 10) -> DataFrame:
    """The required objects without any relation, or with a cluster of fewer than `least`."""
    have = relations.select("object_code", F.lit(True).alias("__have")).distinct()
    rows = objects.where(F.col("object_name").isin(required)).join(have, "object_code", "left")
    return rows.where(F.col("__have").isNull() | (F.col("cluster_size") < least)).drop("__have")


def supplement(objects: DataFrame, entities: DataFrame, business: DataFrame, keywords: DataFrame, first: int = 30) -> DataFrame:
    """Relations for objects without enough: an exact business name (.8), else a contained name (.65), else a keyword (.5).

    The best kind that finds anything is used; at most `first` entities by name.
    """
    exact = objects.join(business, F.col("object_name") == F.col("business")).select("object_code", F.col("concept").alias("entity_name"), F.lit(1).alias("kind"), F.lit(0.8).alias("strength"))
    names = entities.select(F.col("entity_name").alias("id"), F.col("entity_name").alias("text"))
    inside = needles.contained(names, objects.select(F.col("object_name").alias("needle"))).join(objects, F.col("needle") == F.col("object_name")).select("object_code", F.col("id").alias("entity_name"), F.lit(2).alias("kind"), F.lit(0.65).alias("strength"))
    by_word = needles.contained(names, keywords.select(F.col("keyword").alias("needle"))).join(keywords, F.col("needle") == F.col("keyword")).select("object_code", F.col("id").alias("entity_name"), F.lit(3).alias("kind"), F.lit(0.5).alias("strength"))
    found = exact.unionByName(inside).unionByName(by_word.join(objects.select("object_code"), "object_code", "left_semi")).distinct()
    best = found.groupBy("object_code").agg(F.min("kind").alias("kind"))
    w = Window.partitionBy("object_code").orderBy("entity_name")
    return found.join(best, ["object_code", "kind"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).select("object_code", "entity_name", "strength")


def cluster_relations(objects: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """Flat relations: each object to all entities of its cluster, 0.9 for its samples, 0.7 for the others.

    objects: object_code, cluster_id, samples; members: cluster_id, entity_name; entities:
    entity_name, layer, entity_code, domain. Objects with a negative cluster have none.
    """
    own = objects.where("cluster_id >= 0").join(members, "cluster_id").join(entities, "entity_name")
    strength = F.when(F.array_contains("samples", F.col("entity_name")), 0.9).otherwise(0.7)
    return own.select("object_code", "layer", "entity_name", "entity_code", "domain", strength.alias("strength"), F.lit("CLUSTER").alias("relation_type"))


def with_required(objects: DataFrame, clusters: DataFrame, required: DataFrame, next_best: bool = True) -> DataFrame:
    """objects (object_code, object_name, cluster_id, cluster_size) with the required ones that are missing.

    required: position, object_code, object_name: a list of definitions. Each, in order,
    takes the cluster still free with most samples that hold its name, the smallest id
    among equals; an object without one gets cluster -1 and size 0. One of n definitions
    needs its n best clusters at most; only those reach the driver. Without next_best an
    object whose best cluster went to an earlier definition gets none.
    """
    spark = objects.sparkSession
    missing = required.join(objects.select("object_name"), "object_name", "left_anti")
    free = clusters.join(objects.where("cluster_id >= 0").select("cluster_id"), "cluster_id", "left_anti")
    n = missing.count() if next_best else 1
    samples = free.select("cluster_id", "size", F.explode("samples").alias("s"))
    found = needles.contained(samples.select(F.struct("cluster_id", "size").alias("id"), F.col("s").alias("text")), missing.select(F.col("object_name").alias("needle")), distinct=False)
    hits = found.join(missing.select(F.col("object_name").alias("needle"), "position"), "needle").groupBy("position", "id").agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy("position").orderBy(F.desc("hits"), "id.cluster_id")
    best = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("position", "id.cluster_id", "id.size", "r").orderBy("position", "r").collect()
    taken: dict = {}
    for row in best:
        if row["position"] not in {t[0] for t in taken.values()} and row["cluster_id"] not in taken:
            taken[row["cluster_id"]] = (row["position"], row["size"])
    given = spark.createDataFrame([(p, c, s) for c, (p, s) in taken.items()], "position int, cluster_id int, size long")
    rows = missing.join(given, "position", "left")
    new = rows.select("object_code", "object_name", F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"), F.coalesce("size", F.lit(0)).cast("long").alias("cluster_size"))
    return objects.select("object_code", "object_name", F.col("cluster_id").cast("int").alias("cluster_id"), F.col("cluster_size").cast("long").alias("cluster_size")).unionByName(new)


def absorb(objects: DataFrame, garbage) -> DataFrame:
    """object_code and absorbed_by (null: it stays) after naming.

    objects: object_code, object_name, cluster_size, samples. Pending objects go into the
    named one with which their samples share most grams (else characters); garbage names
    into the largest that stays; of equal names the largest stays. Ties go to the
    smaller code. A pending object that shares nothing goes into the first named one, by
    code. All go at once, for any number of objects; settle() does it one after another.
    """
    rows = objects.withColumn("pending", F.col("object_code").contains("_PENDING_MERGE_")).withColumn("bad", ~F.col("pending") & garbage)
    named = rows.where("not pending")
    waiting = rows.where("pending")

    def best(parts, who: DataFrame) -> DataFrame:
        """The named object with most parts in common; only sets of parts that share one meet, each once, however many objects have it."""
        lists = lambda df: df.groupBy("samples").agg(F.min("object_code").alias("code")).withColumn("parts", F.array_sort(parts(F.col("samples"))))
        sets = lambda df: written(df.groupBy("parts").agg(F.min("code").alias("code")), "sets")
        mine = written(lists(who), "lists")
        own = sets(mine)
        left = own.select("code", F.explode("parts").alias("part"))
        right = sets(lists(named)).select(F.col("code").alias("target"), F.explode("parts").alias("part"))
        score = left.join(right, "part").groupBy("code", "target").agg(F.count(F.lit(1)).alias("score"))
        first = score.groupBy("code").agg(F.min(F.struct((-F.col("score")).alias("m"), "target")).alias("b")).select("code", F.col("b.target").alias("absorbed_by"))
        found = mine.select("samples", "parts").join(own.join(first, "code").select("parts", "absorbed_by"), "parts").select("samples", "absorbed_by")
        return who.join(found, "samples").select("object_code", "absorbed_by")

    by_grams = written(best(sample_grams, waiting), "absorbed")
    by_letters = best(sample_letters, waiting.join(by_grams, "object_code", "left_anti"))
    found = by_grams.unionByName(by_letters)
    first = named.agg(F.min("object_code").alias("m"))
    pending = waiting.select("object_code").join(found, "object_code", "left").withColumn("absorbed_by", F.coalesce("absorbed_by", first.scalar()))
    good = named.where("not bad")
    largest = good.agg(F.max_by("object_code", F.struct("cluster_size", "object_code")).alias("m"))
    bad = named.where("bad").select("object_code", largest.scalar().alias("absorbed_by"))
    same = Window.partitionBy("object_name").orderBy(F.desc("cluster_size"), "object_code")
    twins = good.withColumn("first", F.first("object_code").over(same)).select("object_code", F.when(F.col("first") != F.col("object_code"), F.col("first")).alias("absorbed_by"))
    return pending.unionByName(bad).unionByName(twins)


def _joined(a: list[str], b: list[str]) -> list[str]:
    """The first 20 distinct samples of two lists."""
    return list(dict.fromkeys([*a, *b]))[:20]


def _settled(frame: pd.DataFrame) -> pd.DataFrame:
    """settle() of one domain."""
    rows = frame.sort_values(["position", "object_code"]).to_dict("records")
    for r in rows:
        r |= {"samples": list(r["samples"]), "synonyms": set(r["synonyms"]), "absorbed_by": None}

    def merge(keeper: dict, gone: dict) -> None:
        keeper["cluster_size"] += gone["cluster_size"]
        keeper["samples"] = _joined(keeper["samples"], gone["samples"])
        gone["absorbed_by"] = keeper["object_code"]

    pieces = lambda r: {s[i : i + k] for s in r["samples"] for k in (2, 3) for i in range(len(s) - k + 1)}
    letters = lambda r: set(" ".join(r["samples"]))
    named = [r for r in rows if "_PENDING_MERGE_" not in r["object_code"]]
    for r in rows if named else []:
        if "_PENDING_MERGE_" not in r["object_code"]:
            continue
        for parts in (pieces, letters):
            own = parts(r)
            score = [len(own & parts(n)) for n in named]
            if max(score) or parts is letters:  # the first of the best; the first of all where nothing is shared
                merge(named[score.index(max(score))], r)
                break
    good = [r for r in named if not r["garbage"]] or named[:1]
    for r in named:
        if r["garbage"] and r is not good[0]:
            merge(max(good, key=lambda n: n["cluster_size"]), r)
    for i, a in enumerate(good):
        if a["absorbed_by"] is not None:
            continue
        for b in good[i + 1 :]:  # an object that went to a larger one on the way is compared on, as the original does
            alike = a["object_name"] == b["object_name"] or a["object_name"] in b["synonyms"] or b["object_name"] in a["synonyms"]
            if b["absorbed_by"] is None and alike:
                merge(*((a, b) if a["cluster_size"] >= b["cluster_size"] else (b, a)))
    return pd.DataFrame([(r["domain"], r["object_code"], r["object_name"], r["absorbed_by"], r["cluster_size"], r["samples"]) for r in rows], columns=["domain", "object_code", "object_name", "absorbed_by", "cluster_size", "samples"])


def settle(objects: DataFrame, garbage) -> DataFrame:
    """domain, object_code, object_name, absorbed_by, cluster_size, samples after naming, one merge after another.

    objects: domain, position, object_code, object_name, cluster_size, samples, synonyms;
    garbage: predicate of names. In order of position, pending objects go into the named
    one that shares most 2- and 3-grams of samples with them, as these have grown by then,
    else most characters, else into the first; garbage names into the largest other one;
    then of two objects of one name, or of which one's name is a synonym of the other's,
    the smaller goes into the larger. Who absorbs grows in size and takes samples, up to
    20. absorbed_by is null for objects that stay, and may itself have gone on.

    A domain is one group: its objects are the clusters that target_clusters() allows,
    20 and the required ones at most. For larger sets absorb() does it all at once.
    """
    empty = F.array().cast("array<string>")
    rows = objects.select("domain", "position", "object_code", F.coalesce("object_name", F.lit("")).alias("object_name"), F.col("cluster_size").cast("long").alias("cluster_size"), F.coalesce("samples", empty).alias("samples"), F.coalesce("synonyms", empty).alias("synonyms"), garbage(F.col("object_name")).alias("garbage"))
    workers_import(objects.sparkSession)
    return rows.groupBy("domain").applyInPandas(_settled, "domain string, object_code string, object_name string, absorbed_by string, cluster_size long, samples array<string>")


def by_domain(entities: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, relations) of all domains in one job: keyword_objects() and keyword_extract() by domain."""
    return keyword_objects(entities, keywords, ("domain",)), keyword_extract(entities, keywords, ("domain",))
