"""Queries over papers that are put together from the tables, so that what is to be found is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.functions import patterns as P
from trilune.functions import text as T
from trilune.operators import extract as X
from trilune.operators import kg as K
from trilune.operators import passages as A
from trilune.plans.kg import doubled
from trilune.plans.lexicon import SQL as LEX
from trilune.plans.lexicon import graph
from trilune.sources.tables import stored, table


def papers(spark, d):
    """A paper for each document: its letters and blanks as abstract, captions and references with its number."""
    n = F.col("doc_id").cast("string")
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace("text", r"[^A-Za-z]+", " ")), " +", " "))
    parts = [
        F.lit("Paper "),
        n,
        F.lit("\nAbstract: "),
        F.substring(plain, 1, 120),
        F.lit("\n关键词: a\n表 1: prices of "),
        n,
        F.lit("\nand more\n图 2：sizes "),
        n,
        F.lit("\n表 3 last\nReferences: \n1. "),
        n,
        F.lit(" first entry, long enough to stay\n2. short\n[3] "),
        n,
        F.lit(" third entry, long enough too"),
    ]
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("doc"),
        F.trim(F.substring(plain, 1, 120)).alias("plain"),
        F.concat(*parts).alias("text"),
    )


def abstracts(spark, d):
    return papers(spark, d).select("doc", A.abstract(F.col("text")).alias("abstract"))


def reference_lists(spark, d):
    return (
        papers(spark, d)
        .select("doc", F.posexplode(A.references(F.col("text"))).alias("at", "entry"))
        .select("doc", F.col("at").cast("long"), "entry")
    )


def table_captions(spark, d):
    return A.captions(papers(spark, d).select("doc", "text"), P.TABLES)


def figure_captions(spark, d):
    return A.captions(papers(spark, d).select("doc", "text"), P.FIGURES)


def statements(spark, d):
    """Sentences about parts, in which the pattern tables occur."""
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    a, b = name(F.col("p_brand")), name(F.col("p_type"))
    said = F.element_at(
        F.array(
            *[F.concat(a, F.lit(f" {verb} "), b, F.lit("; ")) for verb in ("means", "is a", "belongs to", "refers to")],
        ),
        (F.col("p_partkey") % 4 + 1).cast("int"),
    )
    verb = F.element_at(
        F.array(*[F.concat(a, F.lit(f" {v} "), b) for v in ("requires", "causes", "leads to")]),
        (F.col("p_partkey") % 3 + 1).cast("int"),
    )
    other = F.concat(b, F.lit(" means x; "))
    text = F.concat(said, F.when(F.col("p_partkey") % 2 == 0, other).otherwise(F.lit("")), F.lit("then; "), verb)
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("doc"),
        text.alias("text"),
        a.alias("a"),
        b.alias("b"),
    )


def concept_patterns(spark, d):
    return (
        A.concepts(statements(spark, d))
        .groupBy("doc", "type", "name", "definition")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def concept_relations(spark, d):
    s = statements(spark, d)
    return A.verb_relations(s, A.concepts(s)).groupBy("doc", "subject", "object").agg(F.count(F.lit(1)).alias("n"))


def concept_pairs(spark, d):
    """Words in -tion fewer than 100 characters apart: how often, and how near."""
    found = stored(
        X.places(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "[a-z]+tion"),
        "places",
    )
    x = A.near_concepts(found)
    return x.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def concept_context(spark, d):
    """The text around the first two words in -tion of a document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    first = F.array_sort(F.collect_list(F.struct("at")))
    two = X.places(docs, "[a-z]+tion").groupBy("doc").agg(first.alias("p")).where(F.size("p") > 1)
    both = docs.join(two, "doc")
    return both.select("doc", A.between(F.col("text"), F.col("p")[0]["at"], F.col("p")[1]["at"]).alias("context"))


def alignment_scores(spark, d):
    """Each document against the next one: sentences of the shorter are aligned, words of eight letters are names."""
    rows = table(spark, d, "documents").select(
        "doc_id",
        "lang",
        F.size(T.sentences(F.col("text"))).alias("s"),
        F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) == 8)).alias(
            "names",
        ),
    )
    after = rows.select(
        (F.col("doc_id") - 1).alias("doc_id"),
        F.col("lang").alias("lang2"),
        F.col("s").alias("s2"),
        F.col("names").alias("names2"),
    )
    score = A.alignment_score(
        F.least("s", "s2"),
        F.col("s"),
        F.col("lang").eqNullSafe(F.col("lang2")),
        F.col("names"),
        F.col("names2"),
    )
    return rows.join(after, "doc_id").select("doc_id", F.round(score, 6).alias("score"))


def lessons(spark, d):
    """Course texts with the catalogue's expressions."""
    terms = ["the subjunctive", "the past perfect", "a gerund", "level B2"]
    pick = F.element_at(F.array(*map(F.lit, terms)), (F.col("p_partkey") % 4 + 1).cast("int"))
    en = F.concat(F.lit("Lesson "), F.col("p_size"), F.lit(" has "), pick)
    fr = F.concat(F.lit("Chapitre "), F.col("p_size"), F.lit(" : le subjonctif, niveau A1"))
    zh = F.concat(F.lit("第"), F.col("p_size"), F.lit("课 初级 虚拟式"))
    lang = F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("zh")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.when(lang == "en", en).when(lang == "fr", fr).otherwise(zh)
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc"), lang.alias("language"), text.alias("text"))


def lesson_entities(spark, d):
    """The catalogue's grammar, course and level expressions in course texts."""
    return X.entities(lessons(spark, d)).groupBy("language", "type", "name").agg(F.count(F.lit(1)).alias("n"))


def sentence_relations(spark, d):
    """The catalogue's relations in sentences that state one each."""
    verbs = [
        ("en", "means", "translatedAs"),
        ("en", "tests", "tests"),
        ("en", "includes", "covers"),
        ("fr", "signifie", "translatedAs"),
        ("fr", "exige", "hasPrereq"),
        ("fr", "vérifie", "tests"),
    ]
    pick = lambda i: F.element_at(F.array(*[F.lit(v[i]) for v in verbs]), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.concat(F.col("p_brand"), F.lit(" "), pick(1), F.lit(" "), F.col("p_type"))
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc"),
        pick(0).alias("language"),
        text.alias("text"),
    )
    return X.relation_spans(rows).groupBy("rel", "left", "right").agg(F.count(F.lit(1)).alias("n"))


def stated(spark, d):
    """Sentences about brands and types with words around them."""
    text = F.concat(F.lit("The "), F.lower("p_brand"), F.lit(" kind includes "), F.col("p_type"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("doc"),
        F.lit("en").alias("language"),
        text.alias("text"),
    )


def related_entities(spark, d):
    """Relations of sentences, led to the names that their sides contain."""
    part = table(spark, d, "part")
    names = part.select(F.col("p_brand").alias("id")).union(part.select("p_type")).distinct()
    names = names.select("id", F.col("id").alias("name"), F.col("id").alias("ord"))
    return X.related_entities(X.relation_spans(stated(spark, d)), names).select("src", "dst", "rel", "confidence")


def entity_contexts(spark, d):
    """Words in -tion with 50 characters on both sides."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    found = X.places(docs, "[a-z]+tion").join(docs, "doc")
    around = T.context(F.col("text"), F.col("at"), F.col("at") + F.length("name"), 50)
    rows = found.select("doc", "name", around.alias("context"))
    return rows.groupBy("doc", "name", "context").agg(F.count(F.lit(1)).alias("n"))


def added_once(spark, d):
    """Of entities that are inserted twice, the first one stays."""
    rows = K.added_entities(doubled(graph(spark, d)[0]))
    return rows.select("id", "name", "confidence", K.checked_language(F.lit("fr")).alias("language"))


QUERIES = {
    f.__name__: f
    for f in (abstracts, reference_lists, table_captions, figure_captions, concept_patterns, concept_relations, concept_pairs, concept_context, alignment_scores, lesson_entities, sentence_relations, related_entities, entity_contexts, added_once)
}

_PLAIN = "trim(regexp_replace(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' +', ' ', 'g'))"
_PAPERS = (
    f"WITH p AS (SELECT doc_id AS doc, trim(substr({_PLAIN}, 1, 120)) AS plain,"
    f" length('Paper ' || doc_id || e'\\nAbstract: ' || substr({_PLAIN}, 1, 120) || e'\\n关键词: a\\n') AS before,"
    f" doc_id::VARCHAR AS n FROM documents)"
)
_BRAND, _TYPE = "regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')", "regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')"
_SAID = f"WITH s AS (SELECT p_partkey AS doc, {_BRAND} AS a, {_TYPE} AS b FROM part)"
_TION = """WITH g AS (SELECT doc_id AS doc, text, regexp_extract_all(text, '[a-z]+tion') AS n, regexp_split_to_array(text, '[a-z]+tion') AS g FROM documents
), w AS (SELECT doc, text, unnest(range(len(n))) AS i, n, g FROM g
), pl AS (SELECT doc, text, i, (coalesce(list_sum(list_transform(n[1:i], lambda s: length(s))), 0) + list_sum(list_transform(g[1:i + 1], lambda s: length(s))))::BIGINT AS pos FROM w)"""

_NAMES = "n AS (SELECT p_brand AS id FROM part UNION SELECT p_type FROM part)"

SQL = {
    "added_once": LEX + " SELECT id, name, confidence, 'fr' AS language FROM ent",
    "related_entities": f"""WITH {_NAMES}, s AS (SELECT p_partkey, 'The ' || lower(p_brand) || ' kind' AS l, p_type AS r FROM part
), m AS (SELECT p_partkey, (SELECT min(id) FROM n WHERE contains(lower(l), lower(id)) OR contains(lower(id), lower(l))) AS src,
  (SELECT min(id) FROM n WHERE contains(lower(r), lower(id)) OR contains(lower(id), lower(r))) AS dst FROM s)
SELECT DISTINCT src, dst, 'covers' AS rel, 0.85::DOUBLE AS confidence FROM m WHERE src <> dst""",
    "entity_contexts": f"""{_TION}, o AS (SELECT doc, regexp_extract(text[pos + 1:], '^[a-z]+tion') AS name, pos, text FROM pl)
SELECT doc, name, regexp_replace(text[greatest(pos - 50, 0) + 1 : pos + length(name) + 50], '^\\s+|\\s+$', '', 'g') AS context, count(*) AS n FROM o GROUP BY ALL""",
    "abstracts": f"{_PAPERS} SELECT doc, CASE WHEN length(plain) > 50 THEN plain END AS abstract FROM p",
    "reference_lists": """SELECT doc_id AS doc, 0 AS "at", '1. ' || doc_id || ' first entry, long enough to stay' AS entry FROM documents
UNION ALL SELECT doc_id, 1, doc_id || ' third entry, long enough too' FROM documents""",
    "table_captions": f"""{_PAPERS} SELECT doc, 0 AS "index", 'prices of ' || n AS title, before AS "at" FROM p
UNION ALL SELECT doc, 1, 'last', before + length('表 1: prices of ' || n || e'\\nand more\\n图 2：sizes ' || n || e'\\n') FROM p""",
    "figure_captions": f"""{_PAPERS} SELECT doc, 0 AS "index", 'sizes ' || n AS title, before + length('表 1: prices of ' || n || e'\\nand more\\n') AS "at" FROM p""",
    "concept_patterns": f"""{_SAID}, c AS (
  SELECT doc, 'definition' AS type, a AS name, b AS definition FROM s WHERE doc % 4 IN (0, 3)
  UNION ALL SELECT doc, 'classification', a, b FROM s WHERE doc % 4 IN (1, 2)
  UNION ALL SELECT doc, 'definition', b, 'x' FROM s WHERE doc % 2 = 0
) SELECT doc, type, name, definition, count(*) AS n FROM c GROUP BY ALL""",
    "concept_relations": f"{_SAID} SELECT doc, a AS subject, b AS object, 1 AS n FROM s WHERE doc % 2 = 0",
    "concept_pairs": f"{_TION} SELECT x.doc, count(*) AS n, round(sum(1 - (y.pos - x.pos) / 100.0::DOUBLE), 4) AS confidence FROM pl x JOIN pl y ON x.doc = y.doc AND y.pos > x.pos AND y.pos - x.pos < 100 GROUP BY x.doc",
    "concept_context": f"{_TION} SELECT x.doc, regexp_replace(x.text[x.pos + 1 : y.pos + 100], '^\\s+|\\s+$', '', 'g') AS context FROM pl x JOIN pl y ON x.doc = y.doc AND x.i = 0 AND y.i = 1",
    "alignment_scores": r"""WITH r AS (SELECT doc_id, lang, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？]+'), lambda s: trim(s, e' \n\t\r')), lambda s: s <> '')) AS s,
    list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) = 8), lambda x: lower(x))) AS names FROM documents
), p AS (SELECT a.doc_id, a.s, b.s AS s2, a.lang IS NOT DISTINCT FROM b.lang AS same, len(list_intersect(a.names, b.names)) AS common, len(list_distinct(list_concat(a.names, b.names))) AS total FROM r a JOIN r b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN least(s, s2) = 0 THEN 0 ELSE least(0.5::DOUBLE * least(s, s2) / s + CASE WHEN same THEN 0.3::DOUBLE ELSE 0.15 END + CASE WHEN total = 0 THEN 0 ELSE 0.2::DOUBLE * common / total END, 1) END, 6) AS score FROM p""",
    "lesson_entities": """WITH p AS (SELECT *, p_partkey % 3 AS l, p_partkey % 4 AS t FROM part), e AS (
  SELECT 'en' AS language, 'Course' AS type, 'Lesson ' || p_size AS name FROM p WHERE l = 0
  UNION ALL SELECT 'en', CASE WHEN t = 3 THEN 'Level' ELSE 'Grammar' END, ['subjunctive', 'past perfect', 'gerund', 'B2'][t + 1] FROM p WHERE l = 0
  UNION ALL SELECT 'fr', unnest(['Course', 'Grammar', 'Level']), unnest(['Chapitre ' || p_size, 'subjonctif', 'A1']) FROM p WHERE l = 1
  UNION ALL SELECT 'zh', unnest(['Course', 'Level', 'Grammar']), unnest(['第' || p_size || '课', '初级', '虚拟式']) FROM p WHERE l = 2
) SELECT language, type, name, count(*) AS n FROM e GROUP BY ALL""",
    "sentence_relations": """SELECT ['translatedAs', 'tests', 'covers', 'translatedAs', 'hasPrereq', 'tests'][p_partkey % 6 + 1] AS rel, p_brand AS "left", p_type AS "right", count(*) AS n FROM part GROUP BY ALL""",
}
