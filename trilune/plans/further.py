"""Queries of experiments and their files, graph lines, totals of learning paths, rules of a caller's own, scraped pages, metrics by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from trilune.functions import statistics as S
from trilune.functions.text import heuristic_language
from trilune.operators import metrics as M
from trilune.operators import quality as Q
from trilune.plans import learner as L
from trilune.plans import quality as Y
from trilune.plans import retrieval as P
from trilune.plans import text as T
from trilune.plans.lexicon import SQL as LEX
from trilune.plans.lexicon import graph
from trilune.sources import files as W
from trilune.sources.tables import scratch, stored, table


def experiment(spark, d):
    """Users' mean values before and after the middle of the month, by the parity of their number."""
    mid = F.lit("2024-01-16 00:00:00").cast("timestamp")
    per = table(spark, d, "events").groupBy("user_id").agg(
        F.avg(F.when(F.col("ts") < mid, F.col("value"))).alias("pre_score"),
        F.avg(F.when(F.col("ts") >= mid, F.col("value"))).alias("post_score"),
    )
    return per.select(F.col("user_id").cast("string").alias("learner_id"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("group"), "pre_score", "post_score")


def experiment_files(spark, d):
    """An experiment's table as a file, read, evaluated by group, and its results as files, read back."""
    path = scratch(spark, "experiment")
    experiment(spark, d).write.option("header", True).option("sep", "\t").csv(f"{path}/table")
    rows = W.read_experiment(spark, f"{path}/table", tabs=True)
    n, gain = F.count(F.lit(1)), F.col("post_score") - F.col("pre_score")
    d_ = S.cohen_d(n, F.avg("post_score"), F.stddev_samp("post_score"), n, F.avg("pre_score"), F.stddev_samp("pre_score"))
    told = rows.groupBy("group").agg(
        n.alias("n"),
        F.round(F.avg("pre_score"), 4).alias("pre_mean"),
        F.round(F.avg("post_score"), 4).alias("post_mean"),
        F.round(F.avg(gain), 4).alias("delta_mean"),
        F.round(S.paired_t(gain), 4).alias("t"),
        F.round(d_, 4).alias("cohens_d"),
    )
    W.write_results(stored(told, "told"), path)
    return spark.read.schema(told.schema).option("header", True).csv(f"{path}/summary")


def graph_lines(spark, d):
    e, r = graph(spark, d)
    W.write_graph_lines(e, r, path := scratch(spark, "lines"))
    return W.read_graph_lines(spark, path)[1]


def graph_lines_entities(spark, d):
    e, r = graph(spark, d)
    W.write_graph_lines(e, r, path := scratch(spark, "lines"))
    return W.read_graph_lines(spark, path)[0].select("id", "name", "type", "language", F.array_join("aliases", "|").alias("aliases"))


def learning_path_totals(spark, d):
    """Each path's length and minutes in all."""
    return L.learning_path(spark, d).groupBy("learner").agg(F.count("*").alias("steps"), F.sum("minutes").alias("total_time"))


def learning_path_edges(spark, d):
    """Prerequisites between the steps of each path."""
    path = stored(L.learning_path(spark, d), "path")
    needs = graph(spark, d)[1].where("rel = 'hasPrereq'").select("src", "dst").distinct()
    end = lambda c: path.select("learner", F.col("id").alias(c))
    return end("src").join(needs, "src").join(end("dst"), ["learner", "dst"]).select("learner", F.col("dst").alias("first"), F.col("src").alias("then"))


#: Rules of a caller's own beside the fixed ones: least and greatest length, or a pattern and its field.
OWN = {"short_title": (3, 60, None, None), "year": (None, None, r"^20\d\d/", "publish_date"), "doi_format": (None, None, r"^10\.\d*[05]/", "doi")}


def custom_rules(spark, d):
    """Records under the fixed rules with some replaced and added; their abstracts are texts too."""
    rules = Q.RULES | OWN
    x = Y.records(spark, d).withColumn("abstract", F.substring("content", 1, 300))
    return x.select("id", *[Q.rule_passes(n, rules, ("title", "abstract")).alias(n) for n in OWN])


def scraped_pages(spark, d):
    """Pages as texts with the language that they seem to be in."""
    x = T.html_to_text(spark, d)
    return x.select("page_id", "title", F.length("text").cast("long").alias("chars"), heuristic_language(F.col("text")).alias("language"))


NAMED = ["ndcg@10", "mrr@10", "recall@20", "precision@5", "map"]


def metric_specifications(spark, d):
    """Metrics by their names over the dense run."""
    return M.evaluated(*P.judged_run(spark, d), NAMED).select("metric", F.round("value", 6).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (experiment_files, graph_lines, graph_lines_entities, learning_path_totals, learning_path_edges, custom_rules, scraped_pages, metric_specifications)
}

_NAMED = " UNION ALL ".join(
    f"SELECT '{spec}' AS metric, round(avg({P._columns(k)[name]}), 6) AS \"value\" FROM m{k}"
    for spec, name, k in (("ndcg@10", "ndcg", 10), ("mrr@10", "mrr", 10), ("recall@20", "recall", 20), ("precision@5", "precision", 5), ("map", "ap_judged", 20))
)
_BETWEEN = "({0} = '' OR length({0}) BETWEEN {1} AND {2})"

SQL = {
    "experiment_files": """WITH p AS (SELECT user_id, avg(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value END) AS a, avg(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN value END) AS b FROM events GROUP BY user_id
), q AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS "group", a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT "group", count(*) AS n, round(avg(a), 4) AS pre_mean, round(avg(b), 4) AS post_mean, round(avg(b - a), 4) AS delta_mean, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))), 4) AS t,
  round((avg(b) - avg(a)) / sqrt((var_samp(a) + var_samp(b)) / 2), 4) AS cohens_d FROM q GROUP BY "group" """,
    "graph_lines": f"{LEX} SELECT src, dst, rel, confidence FROM rel",
    "graph_lines_entities": f"{LEX} SELECT id, name, type, language, translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS aliases FROM ent",
    "learning_path_totals": f"SELECT learner, count(*) AS steps, sum(minutes)::BIGINT AS total_time FROM ({L.SQL['learning_path']}) GROUP BY learner",
    "learning_path_edges": f"""{LEX}, path AS (SELECT * FROM ({L.SQL['learning_path']})), n AS (SELECT DISTINCT src, dst FROM rel WHERE rel = 'hasPrereq')
SELECT a.learner, b.id AS "first", a.id AS "then" FROM path a JOIN n ON n.src = a.id JOIN path b ON b.learner = a.learner AND b.id = n.dst""",
    "custom_rules": f"""WITH {Y._REC}, x AS (SELECT *, left(content, 300) AS abstract FROM rc)
SELECT id, {_BETWEEN.format('title', 3, 60)} AND {_BETWEEN.format('abstract', 3, 60)} AS short_title, regexp_matches(publish_date, '^20\\d\\d/') AS "year", coalesce(doi, '') = '' OR regexp_matches(doi, '^10\\.\\d*[05]/') AS doi_format FROM x""",
    "scraped_pages": f"""WITH h AS (SELECT page_id, title, text AS content FROM ({T.SQL['html_to_text']})) SELECT page_id, title, length(content)::BIGINT AS chars, {Y._GUESS} AS language FROM h""",
    "metric_specifications": f"WITH {P._LQ}, {P._JUDGED}, {P._metrics(5, 'm5')}, {P._metrics(10, 'm10')}, {P._metrics(20, 'm20')} {_NAMED}",
}
