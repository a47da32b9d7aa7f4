"""A knowledge graph as two DataFrames: entities and relations, in source order `ord`.

entities: id, name, type, language, description, aliases, ord.
relations: src, dst, rel, confidence, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilune.sources.tables import stored

# The closed domains of types, relations and languages.
ENTITY_TYPES = [
    "Word",
    "Grammar",
    "Pragmatics",
    "Culture",
    "Topic",
    "Exercise",
    "Task",
    "Test",
    "Outcome",
    "CEFR_Skill",
    "Textbook",
    "Reference",
    "Article",
    "Media",
    "LexCorpus",
    "Course",
    "Level",
]
RELATION_TYPES = ["belongsTo", "supports", "tests", "covers", "hasPrereq", "translatedAs", "sameAs"]
LANGUAGES = ["zh", "fr", "en"]


def first_per(df: DataFrame, keys: list, *order) -> DataFrame:
    """One row per key: the first in the given order. Null keys are keys too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def entity_id(name: Column, kind: Column, language: Column) -> Column:
    """type_language_hash, the same in every run."""
    digest = F.md5(F.concat_ws("¦", kind, language, F.lower(name)).cast("binary"))
    return F.concat_ws("_", F.lower(kind), language, F.substring(digest, 1, 8))


def checked_language(language: Column) -> Column:
    return F.when(language.isin(LANGUAGES), language).otherwise(
        F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(language, F.lit("null")))),
    )


def added_entities(entities: DataFrame) -> DataFrame:
    """Insert if absent by id: the first row of an id stays."""
    return first_per(entities, ["id"], "ord")


def name_index(entities: DataFrame) -> DataFrame:
    """(key, id): of entities with one lower-cased name, the last inserted."""
    rows = entities.select(F.lower("name").alias("key"), "id", "ord")
    return rows.groupBy("key").agg(F.max_by("id", "ord").alias("id"))


def resolved(names: DataFrame, column: str, entities: DataFrame) -> DataFrame:
    """names with `resolved`: the id that the column is, or that its lower-cased text names; else null."""
    ids = entities.select(F.col("id").alias("_id")).distinct()
    index = name_index(entities).select(F.col("key").alias("_key"), F.col("id").alias("_by_name"))
    out = names.join(ids, names[column] == F.col("_id"), "left").join(
        index,
        F.lower(names[column]) == F.col("_key"),
        "left",
    )
    return out.withColumn("resolved", F.coalesce("_id", "_by_name")).drop("_id", "_key", "_by_name")


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with known ends; translations cross languages within a type, prerequisites stay in a language."""
    end = lambda c: entities.select(
        F.col("id").alias(c),
        F.col("type").alias(f"{c}_type"),
        F.col("language").alias(f"{c}_language"),
    )
    ok = (
        F.when(
            F.col("rel") == "translatedAs",
            (F.col("src_type") == F.col("dst_type")) & (F.col("src_language") != F.col("dst_language")),
        )
        .when(F.col("rel") == "hasPrereq", F.col("src_language") == F.col("dst_language"))
        .otherwise(True)
    )
    return relations.join(end("src"), "src").join(end("dst"), "dst").where(ok).select(*relations.columns)


def added_relations(relations: DataFrame) -> DataFrame:
    """Set insert by (src, dst, rel): the first confidence stays."""
    return first_per(relations, ["src", "dst", "rel"], "ord")


def best_entities(extracted: DataFrame) -> DataFrame:
    """Of extracted rows with one lower-cased name, type and language the most confident, the earliest of those."""
    return first_per(extracted, [F.lower("name"), "type", "language"], F.desc("confidence"), "ord")


def best_relations(extracted: DataFrame) -> DataFrame:
    return first_per(extracted, [F.lower("src"), F.lower("dst"), "rel"], F.desc("confidence"), "ord")


def without_conflicts(relations: DataFrame, pairs=(("belongsTo", "sameAs"),)) -> DataFrame:
    """Where both types of a pair join the same two entities, only the more confident relation of the two stays."""
    for a, b in pairs:
        w = Window.partitionBy("src", "dst")
        both = F.max(F.col("rel") == a).over(w) & F.max(F.col("rel") == b).over(w)
        among = F.row_number().over(
            Window.partitionBy("src", "dst", F.col("rel").isin(a, b)).orderBy(F.desc("confidence"), "ord"),
        )
        relations = (
            relations.withColumn("_both", both)
            .withColumn("_n", among)
            .where(~(F.col("_both") & F.col("rel").isin(a, b) & (F.col("_n") > 1)))
            .drop("_both", "_n")
        )
    return relations


def statistics(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, key, n): entities by type and language, relations by type, totals; and the average out-degree, times 100."""
    by = entities.groupingSets([["type"], ["language"], []], "type", "language").agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping_id("type", "language").alias("g"),
    )
    ent = by.select(
        F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "language").otherwise("entities").alias("kind"),
        F.coalesce("type", "language").alias("key"),
        "n",
    )
    rel = (
        relations.rollup("rel")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.when(F.col("rel").isNull(), "relations").otherwise("relation").alias("kind"),
            F.col("rel").alias("key"),
            "n",
        )
    )
    both = (  # a row each
        rel.where("kind = 'relations'")
        .select(F.col("n").alias("r"))
        .crossJoin(ent.where("kind = 'entities'").select(F.col("n").alias("e")))
    )
    degree = both.select(
        F.lit("degree").alias("kind"),
        F.lit(None).cast("string").alias("key"),
        F.round(F.try_divide(100 * F.col("r"), "e")).cast("long").alias("n"),
    )
    return ent.unionByName(rel).unionByName(degree)


def schema_report(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per supported language: entities, their share in per cent, and how many have no relation."""
    ends = relations.select(F.col("src").alias("id")).union(relations.select("dst")).distinct()
    alone = entities.join(ends, "id", "left_anti").groupBy("language").agg(F.count(F.lit(1)).alias("isolated"))
    total = entities.count()
    domain = entities.sparkSession.createDataFrame([(x,) for x in LANGUAGES], "language string")
    out = (
        domain.join(entities.groupBy("language").agg(F.count(F.lit(1)).alias("n")), "language", "left")
        .join(alone, "language", "left")
        .fillna(0)
    )
    return out.withColumn("percent", F.round(F.col("n") * 100.0 / max(total, 1), 6))


def isolated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    ends = relations.select(F.col("src").alias("id")).union(relations.select("dst")).distinct()
    return entities.join(ends, "id", "left_anti")


#: Up to so many edits, names meet on what is left of them after deletions; beyond, on cuts.
MOST_DELETED = 2


def shortened(name: Column, deleted: Column) -> Column:
    """The different texts that are left of a name without 0, 1 or 2 of its characters."""
    n = F.length(name)
    cut = lambda i, j: F.substring(name, i, j - i)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(cut(F.lit(1), i), cut(i + 1, n + 1)))
    later = lambda i: F.sequence(i + 1, n)
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(later(i), lambda j: F.concat(cut(F.lit(1), i), cut(i + 1, j), cut(j + 1, n + 1)))))
    return F.array_distinct(F.when(deleted == 0, F.array(name)).when(deleted == 1, one).when(n > 1, two).otherwise(F.array().cast("array<string>")))


def near_by_deletion(names: DataFrame, least: float, edits) -> DataFrame:
    """(no, no2, distance) of candidates whose longer name allows 1 or 2 edits.

    With k edits two names have a common part as long as the longer one without k characters, so each gives all its parts of that
    length, at most 190 for a name of 20, as keys. Names that differ in a few digits only meet in small groups.
    """
    n = F.length("name")
    keys = names.withColumn("long", F.explode(F.sequence(n, F.floor(n / least + F.lit(1e-9)).cast("int"))))
    keys = keys.withColumn("deleted", n - F.col("long") + edits(F.col("long"))).where(edits(F.col("long")).between(1, MOST_DELETED) & (F.col("deleted") >= 0))
    keys = keys.select("no", "name", "kind", "long", F.explode(shortened(F.col("name"), F.col("deleted"))).alias("part"))
    keys = keys.select(F.xxhash64("kind", "long", "part").alias("key"), "no", "name", (n == F.col("long")).alias("longest"))
    # Groups cost by their pairs, not by their bytes: as many tasks as there are shuffle partitions.
    keys = stored(keys, "parts").repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    b = keys.where("longest").select("key", F.col("no").alias("no2"), F.col("name").alias("name2"))
    both = keys.join(b.hint("shuffle_hash"), "key").where(~F.col("longest") | (F.col("no") < F.col("no2")))
    return both.select("no", "no2", F.levenshtein("name", "name2", MOST_DELETED).alias("distance")).where("distance > 0").distinct()


def near_by_cuts(names: DataFrame, least: float, edits) -> DataFrame:
    """(no, no2, distance) of candidates whose longer name allows more edits: as many edits leave one of edits + 1 equal cuts of the shorter untouched."""
    n = F.length("name")
    many = edits(F.col("long")) > MOST_DELETED
    place = lambda i: F.floor(i * F.col("short") / F.col("cuts")).cast("int")
    # Every length that a partner may have is a key; cuts are made for the shorter name's length at the allowed edits of the longer.
    a = names.withColumn("short", n).withColumn("long", F.explode(F.sequence(n, F.floor(n / least + F.lit(1e-9)).cast("int")))).where(many)
    # The longer name offers every substring of a cut's size at most `edits` off the cut's place.
    b = names.withColumn("long", n).where(many).withColumn("short", F.explode(F.sequence(F.ceil(n * least - F.lit(1e-9)).cast("int"), n)))
    cut = lambda x: (
        x.withColumn("cuts", edits(F.col("long")) + 1)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("at", place(F.col("i")))
        .withColumn("size", place(F.col("i") + 1) - F.col("at"))
    )
    on = ["kind", "long", "short", "i", "part"]
    a = cut(a).select(*on[:-1], F.expr("substring(name, at + 1, size)").alias("part"), "no", "name")
    b = cut(b).withColumn("shift", F.explode(F.sequence(-(F.col("cuts") - 1), F.col("cuts") - 1)))
    b = b.where((F.col("at") + F.col("shift") >= 0) & (F.col("at") + F.col("shift") + F.col("size") <= F.col("long")))
    b = b.select(*on[:-1], F.expr("substring(name, at + shift + 1, size)").alias("part"), F.col("no").alias("no2"), F.col("name").alias("name2"))
    both = a.join(b, on).where((F.col("short") < F.col("long")) | (F.col("no") < F.col("no2"))).select("no", "no2", "name", "name2").distinct()
    return both.select("no", "no2", F.levenshtein("name", "name2").alias("distance"))


def similar_names(entities: DataFrame, least: float = 0.85, same_type: bool = True) -> DataFrame:
    """Pairs of entities whose lower-cased names are that similar by edit distance.

    Names that similar differ in length and in edits by at most (1 - least) of the longer. Different names are compared
    once, whatever the number of entities that have them; entities are brought to what their names found.
    """
    e = entities.select("id", F.col("type") if same_type else F.lit("").alias("type"), F.lower("name").alias("name"))
    e = e.where("name <> '' and type is not null").withColumnRenamed("type", "kind").distinct()
    names = stored(e.select("kind", "name").distinct().withColumn("no", F.monotonically_increasing_id()), "names")
    edits = lambda size: F.floor(F.lit(1 - least) * size + F.lit(1e-9)).cast("int")
    pairs = near_by_deletion(names, least, edits).unionByName(near_by_cuts(names, least, edits))
    size = lambda no, n: names.select(F.col("no").alias(no), F.length("name").alias(n))
    pairs = pairs.join(size("no", "n"), "no").join(size("no2", "n2"), "no2")
    pairs = pairs.select("no", "no2", (1 - F.col("distance") / F.greatest("n", "n2")).alias("similarity")).where(F.col("similarity") >= least)
    pairs = pairs.unionByName(names.select("no", F.col("no").alias("no2"), F.lit(1.0).alias("similarity")))
    own = stored(e.join(names, ["kind", "name"]).select("no", "id"), "own")
    both = pairs.join(own, "no").join(own.select(F.col("no").alias("no2"), F.col("id").alias("id2")), "no2")
    both = both.where((F.col("no") != F.col("no2")) & (F.col("id") != F.col("id2")) | (F.col("id") < F.col("id2")))
    return both.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), "similarity")


def representatives(entities: DataFrame, clusters: DataFrame, strategy: str = "confidence") -> DataFrame:
    """(id, new) for members of clusters (id, component) other than their representative: the most confident, first or smallest."""
    best = {"confidence": F.struct(F.coalesce("confidence", F.lit(0.5)), -F.col("ord")), "first": F.struct(-F.col("ord")), "smallest": None}[strategy]
    rows = clusters.join(entities, "id")
    chosen = rows.groupBy("component").agg((F.min("id") if best is None else F.max_by("id", best)).alias("new"))
    return rows.join(chosen, "component").where("id <> new").select("id", "new")


def remapped(entities: DataFrame, relations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with merged entities gone and relations led to their representatives, equal ones once."""
    for c in ("src", "dst"):
        relations = (
            relations.join(mapping.select(F.col("id").alias(c), F.col("new").alias("_new")), c, "left")
            .withColumn(c, F.coalesce("_new", c))
            .drop("_new")
        )
    return entities.join(mapping, "id", "left_anti"), added_relations(relations)


# Names of the header's and of entities' properties.
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"


def triples(
    entities: DataFrame,
    relations: DataFrame,
    base: str,
    label: str = "French Learning Ontology",
    version: str = "1.0",
) -> DataFrame:
    """N-Triples lines: header, type, label, comment and aliases of entities with their language, and relations."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), c, F.lit(">"))
    escaped = lambda c: F.replace(
        F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
        F.lit("\n"),
        F.lit("\\n"),
    )
    text = lambda c: F.concat(F.lit('"'), escaped(c), F.lit('"@'), F.col("language"))
    line = lambda s, p, o: F.concat(s, F.lit(f" <{p}> "), o, F.lit(" .")).alias("line")
    id_ = iri(F.col("id"))
    header = [
        f"<{base}> <{RDF}type> <{OWL}Ontology> .",
        f'<{base}> <{RDFS}label> "{label}" .',
        f'<{base}> <{OWL}versionInfo> "{version}" .',
    ]
    parts = [
        entities.sparkSession.createDataFrame([(x,) for x in header], "line string"),
        entities.select(line(id_, f"{RDF}type", iri(F.col("type")))),
        entities.select(line(id_, f"{RDFS}label", text(F.col("name")))),
        entities.where("description is not null").select(line(id_, f"{RDFS}comment", text(F.col("description")))),
        entities.select("id", "language", F.explode("aliases").alias("alias")).select(
            line(id_, f"{base}alias", text(F.col("alias"))),
        ),
        relations.select(
            F.concat(iri(F.col("src")), F.lit(" "), iri(F.col("rel")), F.lit(" "), iri(F.col("dst")), F.lit(" .")).alias(
                "line",
            ),
        ),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
