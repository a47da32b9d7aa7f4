"""Names in texts by substring, evidence about a question out of the graph, and exercises made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilune.operators import graph as G
from trilune.operators.extract import contained
from trilune.sources.tables import stored


def forms(entities: DataFrame) -> DataFrame:
    """(id, form, alias) of entities: lower-cased names and aliases, none empty."""
    names = entities.select("id", F.lower("name").alias("form"), F.lit(False).alias("alias"))
    others = entities.select("id", F.explode("aliases").alias("form")).select(
        "id",
        F.lower("form").alias("form"),
        F.lit(True).alias("alias"),
    )
    return names.unionByName(others).where(F.length("form") > 0).distinct()


def matched(texts: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """(key, id, by_name, by_alias): entities of which a name or alias is a stretch of the text, or the text one of it, in any letter case."""
    t = texts.select(F.col(key), F.lower(text).alias("_text")).distinct()
    known = forms(entities)
    hits = contained(known, t, "form", "_text").unionByName(
        contained(t, known, "_text", "form").select("id", "form", "alias", key, "_text"),
    )
    return hits.groupBy(key, "id").agg(F.max(~F.col("alias")).alias("by_name"), F.max("alias").alias("by_alias"))


def evidence(
    questions: DataFrame,
    entities: DataFrame,
    relations: DataFrame,
    expansion: DataFrame | None = None,
    top_k: int = 5,
    most_near: int = 10,
) -> DataFrame:
    """(query_id, place, id, name, type, score, near): what the graph has on a question (query_id, query_text).

    A name counts 2, an alias 1; names that hold a term of the expansion (query_id, name, weight) count 1 and its
    weight; the larger counts. near: relations to the first neighbours, as texts.
    """
    own = matched(questions, "query_id", "query_text", entities)
    scores = own.select(
        "query_id",
        "id",
        (F.when(F.col("by_name"), 2.0).otherwise(0.0) + F.when(F.col("by_alias"), 1.0).otherwise(0.0)).alias("score"),
    )
    if expansion is not None:
        terms = expansion.select("query_id", F.lower("name").alias("_term"), "weight")
        names = entities.select("id", F.lower("name").alias("_name"))
        scores = scores.unionByName(
            contained(terms, names, "_term", "_name").select("query_id", "id", (1 + F.col("weight")).alias("score")),
        )
    best = (
        scores.groupBy("query_id", "id")
        .agg(F.max("score").alias("score"))
        .join(entities.select("id", "name", "type", "ord"), "id")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    best = stored(best.withColumn("place", place).where(F.col("place") <= top_k), "evidence")
    edge = F.row_number().over(Window.partitionBy("src").orderBy("ord"))
    first = (
        relations.join(best.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
        .withColumn("_n", edge)
        .where(F.col("_n") <= most_near)
    )
    first = first.join(entities.select(F.col("id").alias("dst"), F.col("name").alias("_target")), "dst")
    said = F.concat(F.lit("-("), "rel", F.lit(")-> "), "_target")
    near = first.groupBy("src").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", said.alias("t")))), lambda x: x["t"]).alias("near"),
    )
    out = best.join(near, best["id"] == near["src"], "left")
    return out.select(
        "query_id",
        "place",
        "id",
        "name",
        "type",
        "score",
        F.coalesce("near", F.array().cast("array<string>")).alias("near"),
    )


def exercises(found: DataFrame, most: int = 5) -> DataFrame:
    """A question with four options for each piece of evidence; the first one is right."""
    name = F.col("name")
    options = F.array(
        name,
        F.lower(name),
        F.upper(name),
        F.concat(F.upper(F.left(name, F.lit(1))), F.lower(F.substr(name, F.lit(2)))),
    )
    asked = F.concat(F.lit("请根据证据["), F.col("place") - 1, F.lit("]："), name, F.lit("，选择正确的关系或含义。"))
    return found.where(F.col("place") <= most).select(
        "query_id",
        F.concat(F.lit("q"), "place").alias("id"),
        F.lit("mcq").alias("type"),
        asked.alias("question"),
        options.alias("options"),
        name.alias("answer"),
    )


def evidence_lines(found: DataFrame) -> DataFrame:
    """(query_id, evidence): a prompt's lines about a question, numbered from 0."""
    line = F.concat(
        F.lit("["),
        F.col("place") - 1,
        F.lit("] "),
        "name",
        F.lit(" ("),
        "type",
        F.lit(") | "),
        F.array_join("near", ", "),
    )
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias(
            "evidence",
        ),
    )


def json_part(text: Column) -> Column:
    """The stretch from the first brace to the last one of a model's answer; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def answered(answers: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, id, question, answer) of exercises in a model's answers (query_id, text); what is no such JSON gives none."""
    shape = "struct<exercises: array<struct<id: string, type: string, question: string, answer: string>>>"
    rows = answers.select("query_id", F.from_json(json_part(F.col("text")), shape)["exercises"].alias("e"))
    return rows.select("query_id", F.inline(F.slice("e", 1, most))).select("query_id", "id", "question", "answer")


def paths_between(
    pairs: DataFrame,
    query_entities: DataFrame,
    doc_entities: DataFrame,
    edges: DataFrame,
    most_paths: int = 3,
    most_hops: int = 3,
) -> DataFrame:
    """(query_id, doc_id, src, dst, path) of the first paths that lead from a question's entities (query_id, id, ord) to a document's (doc_id, id, ord)."""
    both = pairs.select("query_id", "doc_id").distinct()
    both = both.join(query_entities.select("query_id", F.col("id").alias("src"), F.col("ord").alias("_q")), "query_id")
    both = both.join(doc_entities.select("doc_id", F.col("id").alias("dst"), F.col("ord").alias("_d")), "doc_id")
    found = G.shortest_paths(both.where("src <> dst").select("src", "dst"), edges, most_hops)
    out = both.join(found, ["src", "dst"])
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("_q", "_d"))
    return (
        out.withColumn("place", place)
        .where(F.col("place") <= most_paths)
        .select("query_id", "doc_id", "place", "src", "dst", "path")
    )


def either_way(pairs: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """Shortest paths along the edges, and where there is none, along edges in both directions."""
    wanted = pairs.select("src", "dst").distinct()
    along = stored(G.shortest_paths(wanted, edges, most).withColumn("directed", F.lit(True)), "paths")
    last = edges.agg(F.max("ord")).first()[0] or 0
    back = edges.select(
        F.col("dst").alias("src"),
        F.col("src").alias("dst"),
        "rel",
        (F.col("ord") + last + 1).alias("ord"),
    )
    rest = wanted.join(along.select("src", "dst"), ["src", "dst"], "left_anti")
    return along.unionByName(
        G.shortest_paths(rest, edges.select("src", "dst", "rel", "ord").unionByName(back), most).withColumn(
            "directed",
            F.lit(False),
        ),
    )


def around(sources: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(source, id, hop): what lies within `depth` edges in any direction, the source itself at 0."""
    return sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hop")).unionByName(
        G.neighbours(sources, G.undirected(edges), depth).select("source", "id", "hop"),
    )


def of_level(entities: DataFrame, relations: DataFrame, level: str, kind: str = "CEFR_Skill") -> DataFrame:
    """(id): what belongs to entities of the kind whose name holds the level."""
    skills = entities.where((F.col("type") == kind) & F.contains(F.col("name"), F.lit(level))).select(
        F.col("id").alias("dst"),
    )
    return (
        relations.where("rel = 'belongsTo'")
        .join(skills, "dst", "left_semi")
        .select(F.col("src").alias("id"))
        .distinct()
    )


def node_table(entities: DataFrame) -> DataFrame:
    """Rows for a graph store's bulk import of nodes."""
    return entities.select(F.col("id").alias("id:ID"), "name", "language", F.col("type").alias(":LABEL"))


def edge_table(relations: DataFrame) -> DataFrame:
    """Rows for a graph store's bulk import of edges; their types in capitals."""
    return relations.select(
        F.col("src").alias(":START_ID"),
        F.col("dst").alias(":END_ID"),
        F.upper("rel").alias(":TYPE"),
        "confidence",
    )


def digraph(relations: DataFrame) -> DataFrame:
    """One edge per ordered pair of nodes: of several relations, the last."""
    return (
        relations.groupBy("src", "dst")
        .agg(F.max_by(F.struct("rel", "confidence"), "ord").alias("x"))
        .select("src", "dst", "x.rel", "x.confidence")
    )


def exported(writers: dict) -> dict[str, str | None]:
    """Calls each writer; what went wrong with it, or None. One that fails does not keep the others from writing."""
    out: dict[str, str | None] = {}
    for name, write in writers.items():
        try:
            write()
            out[name] = None
        except Exception as problem:  # a writer is a caller's code
            out[name] = str(problem)
    return out
