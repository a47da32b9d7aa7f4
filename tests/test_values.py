"""Queries without SQL against plain computations over the same tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilune import catalog
from trilune.functions import patterns as P
from trilune.operators import extract as X
from trilune.plans import align as A
from trilune.plans import demonstration, stores
from trilune.plans.lexicon import graph

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def words(spark, data):
    e, r = graph(spark, data)
    return e.orderBy("ord").collect(), r.orderBy("ord").collect()


def vectors(spark, data):
    return {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}


def test_ivf_finds_most_of_the_nearest(spark, data):
    def by_query(name):
        out = defaultdict(set)
        for r in QUERIES[name](spark, data).collect():
            out[r.query_id].add(r.doc_id)
        return out

    exact, found = by_query("dense_topk"), by_query("dense_ivf")
    assert set(found) == set(exact)
    assert sum(len(exact[q] & found[q]) for q in exact) >= 0.9 * sum(map(len, exact.values()))


def test_one_to_one_is_greedy(spark, data):
    pairs = sorted(((-r.confidence, r.e1, r.e2) for r in A.pairs(spark, data).collect()))
    left, right, want = set(), set(), set()
    for _, a, b in pairs:
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b))
    assert {(r.e1, r.e2) for r in QUERIES["align_one_to_one"](spark, data).collect()} == want


def test_linear_map_is_the_least_squares_fit(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    x = [(r.label, np.array(r.embedding, float)) for r in rows if r.vec_id % 2 == 1]
    y = [(r.label, np.array(r.embedding, float)) for r in rows if r.vec_id % 2 == 0]
    both = [(a, b) for la, a in x for lb, b in y if la == lb]
    m = np.linalg.lstsq(np.array([a for a, _ in both]), np.array([b for _, b in both]), rcond=None)[0]
    first = lambda rows: {label: v for label, v in reversed(rows)}
    want = {label: np.linalg.norm(v @ m - first(y)[label]) for label, v in first(x).items() if label in first(y)}
    got = {r.label: r.distance for r in QUERIES["align_linear_map"](spark, data).collect()}
    assert got == {k: pytest.approx(v, abs=1e-3) for k, v in want.items()}


def test_propagated_is_the_mean_of_neighbourhoods(spark, data, words):
    e, r = words
    x = {n.id: np.array([1.0 if n.r % 8 == i else 0.0 for i in range(8)]) for n in e}
    near = defaultdict(set)
    for edge in r:
        near[edge.src].add(edge.dst)
        near[edge.dst].add(edge.src)
    for _ in range(2):
        x = {i: np.mean([v] + [x[j] for j in near[i]], axis=0) for i, v in x.items()}
    got = {n.id: np.array(n.x.split(), float) for n in QUERIES["kg_propagated"](spark, data).collect()}
    assert set(got) == set(x)
    assert all(np.allclose(got[i], v / np.linalg.norm(v), atol=2e-4) for i, v in x.items())


def test_embeddings_put_heads_and_relations_near_tails(spark, data, words):
    from trilune.operators import align as O

    e, r = words
    language = {n.id: n.language for n in e}
    triples = [(language[t.src], t.src, t.rel, t.dst) for t in r]
    got = O.trans_e(spark.createDataFrame(triples, "language string, h string, r string, t string"), "language").collect()
    x = {(n.language, n.name): np.array(n.x) for n in got}
    assert all(len(v) == 16 and np.linalg.norm(v) <= 1 + 1e-9 for v in x.values())
    assert {k for a, h, _, t in triples for k in ((a, h), (a, t))} == set(x)
    near = np.mean([np.linalg.norm(x[a, h] - x[a, t]) for a, h, _, t in triples])
    ids = sorted(x)
    mixed = np.random.default_rng(0).permutation(len(triples))
    far = np.mean(
        [np.linalg.norm(x[a, h] - x[ids[k % len(ids)]]) for (a, h, _, _), k in zip(triples, mixed, strict=True)],
    )
    assert near < far


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_fused_words_and_their_relations(spark, data, words):
    e, r = words
    plain = [n for n in e if n.name.isascii()]
    root = {n.id: n.id for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(plain):
        for b in plain[:i]:
            if a.type == b.type and 1 - edit_distance(a.name, b.name) / max(len(a.name), len(b.name)) >= 0.75:
                x, y = find(a.id), find(b.id)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for n in e:
        groups[find(n.id)].append(n)
    new = {n.id: max(g, key=lambda m: (m.confidence, -m.ord)).id for g in groups.values() for n in g}
    kept = {(new[t.src], new[t.dst], t.rel) for t in r}
    got = {t.rel: (t.n, t.sources, t.entities) for t in QUERIES["kg_fused"](spark, data).collect()}
    counts = Counter(rel for _, _, rel in kept)
    assert got == {rel: (n, len({s for s, _, x in kept if x == rel}), len(groups)) for rel, n in counts.items()}


def test_relations_in_sentences(spark, data):
    count, chars = Counter(), Counter()
    for d in spark.read.parquet(f"{data}/documents.parquet").collect():
        for language, rel, pattern in P.RELATIONS:
            if d.lang == language:
                for m in re.finditer(pattern, d.text or ""):
                    count[language, rel] += 1
                    chars[language, rel] += len(m.group(1).strip(" "))
    got = {(r.language, r.rel): (r.n, r.left_chars) for r in QUERIES["relation_sentences"](spark, data).collect()}
    assert got == {k: (n, chars[k]) for k, n in count.items()}


def test_made_up_corpus_is_found(spark, data):
    got = {r.metric: r.value for r in demonstration.FIXTURES["demo_evaluation"](spark, data).collect()}
    assert set(got) == {"mrr@10", "recall@10", "precision@5"} and got["mrr@10"] > 0.3 and 0 < got["recall@10"] <= 1


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in (demonstration, stores) for n in m.FIXTURE_SQL])
def test_fixtures_are_what_they_were(spark, duck, data, module, name):
    from conftest import rows_of

    got, want = module.FIXTURES[name](spark, data).toPandas(), duck.execute(module.FIXTURE_SQL[name]).df()
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def test_relations_of_long_lines(spark):
    """Lines of many words without a relation, which took time with the square of their length."""
    import time

    long = " ".join(f"word{i % 977}" for i in range(60_000))
    cases = [
        (1, f"{long}\nA part of the whole, and of\n of that; x\n\nthis one needs no\nmore. is a. a of b", "en"),
        (2, "of x of y\n of z. of\nq\r\ntail of  many   things it requires\n\n a lot of it", "en"),
        (3, f"le chat de la mère, {long}\net de\nla nuit. Il exige  tout; soit rien", "fr"),
        (4, "", "en"),
        (5, None, "fr"),
        (6, "水是生命的基础。\n书 的 页 属于 我，对应 你", "zh"),
    ]
    texts = spark.createDataFrame(cases, "doc int, text string, language string")
    start = time.time()
    got = Counter((r.doc, r.rel, r.left, r.right) for r in X.relation_spans(texts).collect())
    took = time.time() - start
    want = Counter()
    for doc, text, lang in cases:
        text = (text or "").replace(long, "word0 word1")
        for language, rel, pattern in P.RELATIONS:
            if language == lang:
                for m in re.finditer(pattern.replace(".+?", r"[^\n\r\x85\u2028\u2029]+?").replace("$", r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"), text, re.ASCII):
                    want[doc, rel, m[1].strip(" "), m[2].strip(" ")] += 1
    assert {(d, r, a.replace(long, "word0 word1"), b.replace(long, "word0 word1")): n for (d, r, a, b), n in got.items()} == want
    assert took < 60


def test_stretches_of_long_texts(spark):
    """Stretches of a text took time with the square of its length."""
    import time

    long = "".join(chr(97 + (i * i * 7 + i // 26) % 26) for i in range(300_000))
    texts = [(1, "añb😀c\nd"), (2, "ab"), (3, long)]
    frame = spark.createDataFrame(texts, "id int, text string")
    start = time.time()
    got = {r.id: r.g for r in frame.select("id", X._grams(F.col("text"), [2, 3]).alias("g")).collect()}
    assert time.time() - start < 60
    for i, t in texts:
        want = {t[k : k + n] for n in (2, 3) for k in range(max(len(t) - n + 1, 1))}
        assert len(got[i]) == len(set(got[i])) and set(got[i]) == want
