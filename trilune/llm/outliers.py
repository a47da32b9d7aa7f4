"""Quality rules: robust multivariate outliers among the statistics of texts, with DataFrame operations only.

Each text gives counts (`statistics`), those give a vector of transformed statistics (`transformed`) in steps of
1 / STEP, and documents of one language and source are a group. A group's centre and scatter are its
minimum-covariance-determinant estimate: of the subsets with a share `SUBSET` of the group, the one whose covariance
matrix has the least determinant, found by concentration steps from three deterministic starts (scales by
quartiles; covariance of spatial signs; covariance of tanh scores), then reweighted once. A document is rejected
if its squared Mahalanobis distance is beyond the chi-square quantile of `KEPT`.

Concentration works on the distinct vectors of a group with their counts, so copies are one row. A step is one
aggregation: squared distances fall into bins of a sixteenth of an octave, moments are summed exactly per group,
start and bin, and the subset takes the nearest bins whole and of the last one the share that is left. Sums are of
whole numbers, so results do not depend on partitions or order. Every diagonal gets a floor, FLOOR squared: statistics
that hardly vary in a group, such as counts that are nearly all zero, do not make a small difference an outlier, and
groups of a single document are defined (the document is kept).

Null and empty texts have no words; they fail the base rules, as do all texts with few words or many repeated ones,
and take no part in the estimates. Null languages and sources are values of their own. Repeated rows count as often
as they occur and are judged alike. Empty tables give no rows. Other columns are not used, whatever they are called.
Windows are ordered within a group's bins or histogram steps, of which there is a fixed number. Equal windows of
words are told by 96 bits of hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilune.llm.common import WORD, dropped, let, table, with_facts, written

#: Transformed statistics are whole numbers of 1 / STEP, held within +-MOST steps.
STEP, MOST = 16, 4096
#: The least standard deviation of a statistic, in its own unit.
FLOOR = 0.5
#: Share of a group that the determinant is minimised over, and concentration steps.
SUBSET, STEPS = 0.75, 6
#: Share of a normal sample that reweighting keeps.
REWEIGHTED = 0.975
#: Share of a normal sample that is kept; its chi-square quantile is the squared distance beyond which a document is rejected.
KEPT = 0.9999
GROUP = ["lang", "source"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, size: int = 8) -> Column:
    """Words inside windows of `size` words that occur twice or more among them, the first included."""

    def covered(w: Column, keys: Column) -> Column:
        other = lambda i: F.hash(F.slice(w, i + 1, F.lit(size)))
        marks = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), other(i).alias("o"), i.alias("i"))))
        same = lambda x, y: F.coalesce((x["k"] == y["k"]) & (x["o"] == y["o"]), F.lit(False))
        again = lambda s: F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, F.greatest(i - 1, F.lit(0))))) | same(x, F.get(s, i + 1)))
        at = lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"]))
        room = lambda p: F.transform(p, lambda v, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - v, F.lit(size))))
        return let(marks, lambda s: let(at(s), lambda p: F.aggregate(room(p), F.lit(0), lambda a, b: a + b)))

    def counted(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        some = let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(w, k)))
        return F.when(F.size(w) > size, some).otherwise(F.lit(0))

    return let(words, counted)


def statistics(text: Column) -> dict[str, Column]:
    """The counts of a text, by name; `base_failed` follows from them."""
    of = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(of, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(of, "\n"), lambda line: line.rlike(WORD))
    long = lambda c: c.cast("long")
    return {
        "n_words": long(F.size(words)),
        "word_chars": long(F.length(F.regexp_replace(of, r"[\x20\x09-\x0D]+", ""))),
        "n_symbols": long(F.length(F.regexp_replace(of, "[^#*$%&|<>]+", ""))),
        "n_dup_lines": long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": long(repeated_words(words)),
    }


def failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def transformed() -> list[Column]:
    """The vector that is judged, in steps: logarithm of the length, word length, and densities of symbols, repeated lines and repeated words on a scale that is nearly linear for few and logarithmic for many."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    density = lambda c, per: F.log2(1 + per * F.col(c) / n)
    values = [
        F.log2(n),
        2 * F.log2((1 + F.col("word_chars")) / n),
        density("n_symbols", 50.0),
        density("n_dup_lines", 50.0),
        density("n_repeat_words", 10.0),
    ]
    return [F.least(F.greatest(F.round(v * STEP).cast("int"), F.lit(-MOST)), F.lit(MOST)) for v in values]


def chi_square(x: float, p: int) -> float:
    """Probability that a chi-square variable of p degrees is at most x, by the series of the incomplete gamma function."""
    term = total = 1 / (p / 2)
    for i in range(1, 1000):
        term *= x / 2 / (p / 2 + i)
        total += term
    return total * math.exp(p / 2 * math.log(x / 2) - x / 2 - math.lgamma(p / 2)) if x > 0 else 0.0


def chi_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, p) < share else (low, middle)
    return low


def consistency(share: float, p: int) -> float:
    """What the covariance of the nearest share of a normal sample is multiplied by to be that of all."""
    return share / chi_square(chi_quantile(share, p), p + 2)


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def inverted(estimate: DataFrame, p: int) -> DataFrame:
    """From the covariance s_i_j: l_i_j, the inverse of its Cholesky factor, and log_det. Diagonals have a floor, so roots are of positive numbers."""
    kept = [c for c in estimate.columns if not c.startswith("s_")]
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"s_{i}_{j}") - sum((F.col(f"_g_{i}_{k}") * F.col(f"_g_{j}_{k}") for k in range(j)), F.lit(0.0))
            g = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"_g_{j}_{j}")
            estimate = estimate.withColumn(f"_g_{i}_{j}", g)
    for i in range(p):
        for j in range(i, -1, -1):
            if i == j:
                inverse = 1 / F.col(f"_g_{i}_{i}")
            else:
                inverse = -sum((F.col(f"_g_{i}_{k}") * F.col(f"l_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"_g_{i}_{i}")
            estimate = estimate.withColumn(f"l_{i}_{j}", inverse)
    log_det = sum((F.log(F.col(f"_g_{i}_{i}")) for i in range(p)), F.lit(0.0))
    return estimate.select(*kept, *[f"l_{i}_{j}" for i, j in pairs(p)], log_det.alias("log_det"))


def distance(p: int) -> Column:
    """Squared Mahalanobis distance of q_0, q_1 ... from m_0, m_1 ... under l_i_j."""
    gap = [F.col(f"q_{j}") - F.col(f"m_{j}") for j in range(p)]
    along = [sum((F.col(f"l_{i}_{j}") * gap[j] for j in range(i + 1)), F.lit(0.0)) for i in range(p)]
    return sum((F.pow(a, F.lit(2.0)) for a in along), F.lit(0.0))


def moments(p: int) -> dict[str, Column]:
    """Exact sums over weighted vectors: n, a_i, b_i_j. Products are below 2 ** 25, so sums of 2 ** 38 documents fit."""
    whole = F.sum
    n, q = F.col("n"), [F.col(f"q_{i}").cast("long") for i in range(p)]
    return {
        "n": F.sum("n"),
        **{f"a_{i}": whole(n * q[i]) for i in range(p)},
        **{f"b_{i}_{j}": whole(n * q[i] * q[j]) for i, j in pairs(p)},
    }


def estimated(p: int, n: Column, of: dict[str, Column], factor: float = 1.0) -> list[Column]:
    """Means m_i and covariances s_i_j from the sums `of`, with the floor on diagonals."""
    mean = [of[f"a_{i}"] / n for i in range(p)]
    floor = lambda i, j: F.lit((FLOOR * STEP) ** 2 if i == j else 0.0)
    cov = {(i, j): factor * (of[f"b_{i}_{j}"] / n - mean[i] * mean[j]) + floor(i, j) for i, j in pairs(p)}
    return [*[m.alias(f"m_{i}") for i, m in enumerate(mean)], *[c.alias(f"s_{i}_{j}") for (i, j), c in cov.items()]]


def stored_small(rows: DataFrame, what: str, smaller: int = 16) -> DataFrame:
    """A table of far fewer bytes than documents have, in as much fewer files than there are shuffle partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.sparkSession, rows.coalesce(max(1, parts // smaller)), what)


def starts(cells: DataFrame, p: int) -> DataFrame:
    """Three estimates per group, of shape only: `start`, m_i, s_i_j."""
    long = cells.select(*GROUP, "n", F.posexplode(F.array(*[f"q_{i}" for i in range(p)])).alias("at", "q"))
    steps = long.groupBy(*GROUP, "at", "q").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*GROUP, "at")
    ranked = steps.withColumn("_upto", F.sum("n").over(by.orderBy("q"))).withColumn("_all", F.sum("n").over(by))
    quartile = lambda k: F.min(F.when(4 * F.col("_upto") >= k * F.col("_all"), F.col("q")))
    marks = ranked.groupBy(*GROUP, "at").agg(
        quartile(2).alias("m"),
        F.greatest((quartile(3) - quartile(1)) / F.lit(1.349), F.lit(FLOOR * STEP)).alias("d"),
    )
    own = lambda c, i: F.max(F.when(F.col("at") == i, F.col(c).cast("double"))).alias(f"{c}_{i}")
    scales = stored_small(marks.groupBy(*GROUP).agg(*[own(c, i) for c in "md" for i in range(p)]), "scales")
    z = [(F.col(f"q_{i}") - F.col(f"m_{i}")) / F.col(f"d_{i}") for i in range(p)]
    scored = with_facts(cells, scales, GROUP, 32 + 16 * p)
    scored = scored.withColumn("_size", F.sqrt(sum((x * x for x in z), F.lit(0.0))))
    sign = [F.coalesce(F.try_divide(x, F.col("_size")), F.lit(0.0)) for x in z]
    scores = {1: sign, 2: [F.tanh(x) for x in z]}
    whole = lambda x: F.sum(F.col("n") * F.round(x * 65536).cast("long"))
    sums = [whole(y[i] * y[j]).alias(f"y{k}_{i}_{j}") for k, y in scores.items() for i, j in pairs(p)]
    means = [whole(y[i]).alias(f"u{k}_{i}") for k, y in scores.items() for i in range(p)]
    found = scored.groupBy(*GROUP).agg(F.sum("n").alias("_n"), *sums, *means)
    shapes = with_facts(found, scales, GROUP, 32 + 16 * p)

    def shape(k: int, i: int, j: int) -> Column:
        n, unit = F.col("_n"), F.lit(65536.0)
        if k == 0:
            scatter = F.lit(1.0 if i == j else 0.0)
        else:
            scatter = F.col(f"y{k}_{i}_{j}") / n / unit - F.col(f"u{k}_{i}") / n / unit * F.col(f"u{k}_{j}") / n / unit
            scatter = scatter + F.lit(0.01 if i == j else 0.0)  # of scores between -1 and 1
        return (scatter * F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"s_{i}_{j}")

    each = [F.struct(F.lit(k).alias("start"), *[F.col(f"m_{i}") for i in range(p)], *[shape(k, i, j) for i, j in pairs(p)]) for k in range(3)]
    return shapes.select(*GROUP, F.explode(F.array(*each)).alias("e")).select(*GROUP, "e.*")


def concentrated(cells: DataFrame, estimate: DataFrame, p: int, share: float) -> DataFrame:
    """The estimates from each group's nearest share under the given ones."""
    far = with_facts(cells, estimate, GROUP, 64 + 8 * (2 * p + p * p))
    bins = F.floor(16 * F.log2(F.least(distance(p), F.lit(2.0**40)) + 2.0**-6)).cast("int")
    sums = moments(p)
    binned = far.withColumn("bin", bins).groupBy(*GROUP, "start", "bin").agg(*[c.alias(k) for k, c in sums.items()])
    by = Window.partitionBy(*GROUP, "start")
    binned = binned.withColumn("_upto", F.sum("n").over(by.orderBy("bin"))).withColumn("_take", F.ceil(share * F.sum("n").over(by)))
    before = F.col("_upto") - F.col("n")
    inside, edge = F.col("_upto") <= F.col("_take"), (F.col("_upto") > F.col("_take")) & (before < F.col("_take"))
    parts = binned.groupBy(*GROUP, "start").agg(
        F.max("_take").cast("double").alias("_take"),
        F.coalesce(F.max(F.when(edge, (F.col("_take") - before) / F.col("n"))), F.lit(0.0)).alias("_share"),
        *[F.coalesce(F.sum(F.when(inside, F.col(k))), F.lit(0)).cast("double").alias(f"in_{k}") for k in sums],
        *[F.coalesce(F.sum(F.when(edge, F.col(k))), F.lit(0)).cast("double").alias(f"at_{k}") for k in sums],
    )
    of = {k: F.col(f"in_{k}") + F.col("_share") * F.col(f"at_{k}") for k in sums}
    return parts.select(*GROUP, "start", *estimated(p, F.col("_take"), of))


def estimates(cells: DataFrame, p: int) -> DataFrame:
    """One row per group: m_i, l_i_j and log_det of the reweighted estimate. A table."""
    now = stored_small(inverted(starts(cells, p), p), "starts")
    for _ in range(STEPS):
        last, now = now, stored_small(inverted(concentrated(cells, now, p, SUBSET), p), "step")
        dropped(last)
    least = F.min(F.struct("log_det", "start", *[c for c in now.columns if c not in [*GROUP, "log_det", "start"]])).alias("e")
    raw = stored_small(now.groupBy(*GROUP).agg(least).select(*GROUP, "e.*"), "raw")
    near = with_facts(cells, raw, GROUP, 64 + 8 * (2 * p + p * p)).where(distance(p) <= consistency(SUBSET, p) * chi_quantile(REWEIGHTED, p))
    sums = near.groupBy(*GROUP).agg(*[c.alias(k) for k, c in moments(p).items()])
    of = {k: F.col(k).cast("double") for k in moments(p)}
    out = stored_small(inverted(sums.select(*GROUP, *estimated(p, F.col("n").cast("double"), of, consistency(REWEIGHTED, p))), p), "estimates")
    dropped(now, raw)
    return out


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", share: float = KEPT) -> DataFrame:
    """One row per document: its id under its own name, lang, source, the counts, base_failed, distance (squared; null for those that failed) and kept."""
    spark, p = docs.sparkSession, len(transformed())
    plain = docs.select(F.col(key).alias("_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text"))
    counts = plain.select("_id", *GROUP, *[c.alias(k) for k, c in statistics(F.col("_text")).items()])
    counts = written(spark, counts, "statistics").withColumn("base_failed", failed())
    vectors = counts.withColumns({f"q_{i}": v for i, v in enumerate(transformed())})
    names = [f"q_{i}" for i in range(p)]
    cells = stored_small(vectors.where("not base_failed").groupBy(*GROUP, *names).agg(F.count("*").alias("n")), "vectors", 4)
    facts = estimates(cells, p)
    dropped(cells)
    result = [F.col("_id").alias(key), *GROUP, *BASE, "base_failed"]
    good = with_facts(vectors.where("not base_failed"), facts, GROUP, 64 + 8 * (2 * p + p * p))
    good = good.withColumn("distance", distance(p))
    bad = vectors.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return good.select(*result, "distance", (F.col("distance") <= chi_quantile(share, p)).alias("kept")).unionByName(bad.select(*result, "distance", F.lit(False).alias("kept")))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept", "distance")
