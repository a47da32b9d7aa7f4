"""Filter audit, robust outliers and centroid clustering against plain computations, with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilune.llm import centroids, filter_audit, outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 9000}" for i in range(60_000))


def audit_rows():
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(words, k=r.choice([5, 150, 199, 200, 260, 600]))) for _ in range(60)]
    texts = [t.upper() if r.random() < 0.2 else t + " $" if r.random() < 0.2 else t for t in texts]
    texts += texts[:25] + ["", None, "", None, "same", "same", "same", LONG, " \n\t", "é" * 50 + "AB"]
    r.shuffle(texts)
    rows = [(i, t, r.choice(["en", "fr", None, ""])) for i, t in enumerate(texts)]
    return rows + rows[:10] + [(None, "same", "en"), (None, None, None), (3, "another text of the id", "de")]


LABELS = [(i, i % 3 == 0, i % 4 == 0) for i in range(0, 90, 2)] + [(2, 1, 0), (2, 0, 0), (None, 1, 1), (999, 1, 1), (5, None, 1)]


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, g, _ in labels if g == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    told = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and t in least and i > least[t],
        }
        told.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = defaultdict(int)
    for part in {p for p, *_ in told}:
        own = [x for x in told if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for at, c in enumerate(order):
                before = set(order[:at])
                removed = [x for x in own if c in x[1] and not x[1] & before]
                out[part, order, at + 1] = [
                    sum(not x[1] & (before | {c}) for x in own),
                    len(removed),
                    sum(c in x[1] and bool(x[1] & before) for x in own),
                    sum(x[1] == {c} for x in own),
                    sum(x[2] for x in removed),
                    sum(x[3] for x in removed),
                ]
    shares = Counter()
    for (part, order, step), v in out.items():
        shares[part, order[step - 1]] += v[1]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(df):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in df.collect()}


def test_filter_audit_equals_a_plain_run_of_every_order(spark):
    rows = audit_rows()
    labels = [(i, None if g is None else int(g), int(x)) for i, g, x in LABELS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    wide = docs.select("*", *[F.lit("clash").alias(c) for c in ("_id", "_part", "_mask", "mask", "n", "part", "quality", "_text")])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    got = as_dict(filter_audit.audit(filter_audit.cells(wide, known), "ABCDE"))
    assert got == want and len(got) == 600 * len({r[2] or "" for r in rows})
    assert as_dict(filter_audit.audit(filter_audit.cells(docs, known.limit(0)), "ABCDE")).keys() == want.keys()
    assert filter_audit.audit(filter_audit.cells(docs.limit(0), known), "ABCDE").count() == 0


def test_filter_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa b", "x"), (2, "aa b", "x"), (3, "c", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = filter_audit.cells(docs, labels, filters={"P": lambda t: t.contains("aa")})
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(cells, "PE").collect()}
    assert got == {("PE", 1): (1, 2, 0, 3), ("PE", 2): (1, 0, 1, 1), ("EP", 1): (2, 1, 0, 1), ("EP", 2): (1, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "ABCDEFG")


def brute_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit)


def brute_vector(n, chars, symbols, lines, repeats):
    n = max(n, 1)
    values = [math.log2(n), 2 * math.log2((1 + chars) / n), math.log2(1 + 50 * symbols / n), math.log2(1 + 50 * lines / n), math.log2(1 + 10 * repeats / n)]
    return [math.floor(v * 16 + 0.5) for v in values]


def brute_distances(x):
    """Squared distances of the vectors under their group's estimate: the steps of the operator, one vector at a time."""
    n, p = x.shape
    floor = np.eye(p) * 64.0
    quartile = lambda k: np.array([np.sort(x[:, i])[math.ceil(k * n / 4) - 1] for i in range(p)])
    m, d = quartile(2), np.maximum((quartile(3) - quartile(1)) / 1.349, 8)
    z = (x - m) / d
    size = np.sqrt((z * z).sum(axis=1))
    sign = np.divide(z, size[:, None], out=np.zeros_like(z), where=size[:, None] > 0)
    shapes = [np.eye(p)]
    for y in (sign, np.tanh(z)):
        u = np.round(y * 65536).mean(axis=0) / 65536
        outer = np.round(y[:, :, None] * y[:, None, :] * 65536).mean(axis=0) / 65536
        shapes.append(outer - u[:, None] * u + 0.01 * np.eye(p))
    far = lambda c, s: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
    found = []
    for shape in shapes:
        centre, scatter = m.astype(float), shape * d[:, None] * d
        for _ in range(outliers.STEPS):
            bins = np.floor(16 * np.log2(np.minimum(far(centre, scatter), 2.0**40) + 2.0**-6))
            take, weight, left = math.ceil(0.75 * n), np.zeros(n), math.ceil(0.75 * n)
            for b in np.unique(bins):
                own = bins == b
                weight[own] = min(1.0, max(0.0, left / own.sum()))
                left -= own.sum()
            centre = weight @ x / take
            scatter = (weight[:, None] * x).T @ x / take - np.outer(centre, centre) + floor
        found.append((np.linalg.slogdet(scatter)[1], centre, scatter))
    _, centre, scatter = min(found, key=lambda f: round(f[0], 9))
    near = x[far(centre, scatter) <= outliers.consistency(0.75, p) * outliers.chi_quantile(0.975, p)]
    centre = near.mean(axis=0)
    return far(centre, outliers.consistency(0.975, p) * (near.T @ near / len(near) - np.outer(centre, centre)) + floor)


def outlier_rows():
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(500)]
    text = lambda n, tail="": "\n".join(" ".join(w + tail for w in r.choices(words, k=12)) for _ in range(n // 12))
    rows = [(text(r.randint(60, 600)), r.choice(["en", "fr", None]), r.choice(["a", None])) for _ in range(260)]
    rows += [(text(r.randint(60, 600), "$$%"), "en", "a") for _ in range(12)]  # planted
    rows += [(text(240).replace("\n", " ") + "\nfooter line\n" * 40, "fr", None) for _ in range(4)]
    rows += [(None, "en", "a"), ("", None, None), ("one two", "en", "a"), ("x " * 500, "en", "a"), (LONG, "fr", "a"), (text(120), "alone", "a")]
    rows += rows[:40] + rows[260:262]
    return [(i, *row) for i, row in enumerate(rows)] + [(None, *rows[3]), (7, *rows[3])]


def test_outliers_equal_a_plain_computation(spark):
    rows = outlier_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    wide = docs.select("*", *[F.lit("clash").alias(c) for c in ("n_words", "kept", "q_0", "bin", "start", "n", "_id", "base_failed")])
    got = outliers.judged(wide).collect()
    base, groups = [], defaultdict(list)
    for i, t, lang, source in rows:
        s = brute_statistics(t)
        bad = s[0] < 20 or 100 * s[4] > 30 * s[0]
        base.append((i, lang, source, *s, bad))
        if not bad:
            groups[lang, source].append((i, *s))
    key = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
    show = lambda r: (r.doc_id, r.lang or "", r.source or "", *[r[c] for c in outliers.BASE], r.base_failed)
    assert sorted(map(show, got), key=key) == sorted(((i, a or "", b or "", *x) for i, a, b, *x in base), key=key)
    cutoff = outliers.chi_quantile(outliers.KEPT, 5)
    for (lang, source), own in groups.items():
        want = brute_distances(np.array([brute_vector(*s) for _, *s in own], float))
        mine = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words), r.distance, r.kept) for r in got if (r.lang, r.source) == (lang, source) and not r.base_failed)
        plain = sorted(((i is None, i or 0, s[0]), w) for (i, *s), w in zip(own, want, strict=True))
        assert [k for k, *_ in mine] == [k for k, _ in plain]
        assert [d for _, d, _ in mine] == pytest.approx([w for _, w in plain], rel=1e-6, abs=1e-6)
        assert [k for *_, k in mine] == [w <= cutoff for _, w in plain]
    assert not any(r.kept for r in got if r.base_failed) and all(r.distance is None for r in got if r.base_failed)
    planted = [r for r in got if r.doc_id is not None and 260 <= r.doc_id < 276]
    assert len(planted) == 16 and not any(r.kept for r in planted)
    clean = [r.kept for r in got if r.doc_id is not None and r.doc_id < 260]
    assert np.mean(clean) > 0.97
    again = outliers.judged(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert outliers.judged(docs.limit(0)).collect() == []


def test_outliers_constants():
    assert outliers.chi_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3) and outliers.chi_square(5.385, 4) == pytest.approx(0.75, abs=1e-3)
    r = np.random.default_rng(0).normal(size=(200_000, 5))
    near = r[(r * r).sum(axis=1) <= outliers.chi_quantile(0.75, 5)]
    assert outliers.consistency(0.75, 5) * near.var(axis=0).mean() == pytest.approx(1, abs=0.02)


def test_outliers_keep_labelled_quality(spark, data):
    got = outliers.query(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    assert got[(got.quality == 1) & ~got.base_failed].kept.mean() >= 0.97


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(64 * x) if abs(x) < 1e300 else int(math.copysign(1 << 27, x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    cs = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in kept:
            own[near(q)[1]].append(q)
        cs = [[sum(x) // len(x) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(cs)]
    out = [(i, n, d, cs[n]) for i, q in kept for d, n in [near(q)]]
    return [(i, n, d, sum(x[2] for x in out if x[1] == n), sum(x[2] for x in out), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, n, d, c in out]


def cluster_rows(n=300):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 64)) * r.choice([0.1, 1, 3], (n, 1))
    x[20:60] = x[20]
    x[60:80] = -x[60]  # ties between opposite centroids
    odd = [(900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [float("inf")] * 64), (904, [None] * 64), (905, [])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    return rows + [(None, x[5].tolist()), (7, x[8].tolist()), (7, x[7].tolist()), (907, [1e300] + [0.0] * 63), (908, [0.0] * 64)]


@pytest.mark.parametrize("n", [300, 0, 5, 16])
def test_centroids_equal_a_plain_run(spark, tmp_path, n):
    rows = cluster_rows() if n == 300 else [(i, v) for i, v in cluster_rows()[:n]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    v.select("*", F.lit("clash").alias("cluster"), F.lit("x").alias("id")).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = centroids.query(spark, f"file://{tmp_path}").collect()
    show = lambda row: tuple((x is None, x if x is not None else 0) for x in row)
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(show(r[c] for c in names) for r in got) == sorted(map(show, brute_clusters(rows)))


def test_annulus_leaves_no_nearest_out():
    r = np.random.default_rng(5)
    for scale in (1, 50, 1 << 20):
        x = r.integers(-scale, scale + 1, (500, 64)) * r.integers(0, 3, (500, 1))
        c = np.concatenate([x[:10], x[:3], np.zeros((1, 64), np.int64), -x[:4]])
        which, best = centroids.nearest(x, c)
        far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (best == far.min(axis=1)).all() and (which == far.argmin(axis=1)).all()
