"""Tagger, dictionary and encoder against plain computations."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilune.operators import dictionary as D
from trilune.operators import tagger as G
from trilune.plans import learned as L

PATTERNS = [("DATE", r"\b\d{4}-\d{2}-\d{2}\b"), ("MAIL", r"[a-z0-9.]+@[a-z]+\.[a-z]+")]


def mixed_texts(n, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(r.randint(4, 14))]
        for _ in range(r.choice([0, 0, 1, 2])):
            mail = f"{word()}.{r.randint(1, 99)}@{word()}.{r.choice(['com', 'org'])}"
            w[r.randrange(len(w))] = r.choice([mail, f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", str(r.randint(1, 99999))])
        out.append(" ".join(w) + r.choice([".", "!", "", ".\n"]))
    return [" ".join(out[i : i + 3]) for i in range(0, n, 3)]


def test_decoding_equals_every_sequence_tried():
    r = np.random.default_rng(1)
    t = G.Tagger(["X"], r.normal(size=(1 << G.BITS, 3)), r.normal(size=(4, 3)))
    first = np.array([0, 4, 5, 5, 11])
    scores = r.normal(size=(11, 3))
    got = t.decode(scores, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        def value(tags, a=a):
            return sum(scores[a + i, y] + t.step[tags[i - 1] if i else 3, y] for i, y in enumerate(tags))

        if b > a:
            best = max(itertools.product(range(3), repeat=b - a), key=value)
            assert value(tuple(got[a:b])) == pytest.approx(value(best))
    assert t.decode(np.zeros((0, 3)), np.array([0])).tolist() == []


def test_tokens_sentences_and_features():
    t = G.tokenized(["Ab c. D-e!\nf", None, "", "  ", "g\n\nh"])
    assert [("Ab c. D-e!\nf" if i == 0 else "g\n\nh")[a:b] for i, a, b in zip(t.text, t.start, t.end, strict=True)] == ["Ab", "c", ".", "D", "-", "e", "!", "f", "g", "h"]
    assert np.diff(t.first).tolist() == [3, 4, 1, 1, 1]
    again = G.tokenized(["g\n\nh"])
    assert (again.features == t.features[-2:]).all() and t.features.max() < 1 << G.BITS
    assert G.shape("Abcdef12345678!") == "Xxxx99999!"
    assert G.matched("2020-01-01x 2020-01-01", [("D", re.compile(r"\d{4}-\d\d-\d\d"))]) == [(0, 10, "D"), (12, 22, "D")]


def gold(rows):
    patterns = [(k, re.compile(p)) for k, p in PATTERNS]
    return {(i, kind, t[a:b], a) for i, t in rows if t for a, b, kind in G.matched(t, patterns)}


def test_tagger_learns_the_catalogue_on_held_out_texts(spark):
    rows = list(enumerate(mixed_texts(900)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = G.train(docs.where("doc_id % 3 <> 0"), PATTERNS, most=600)
    assert model.types == ["DATE", "MAIL"]
    want = gold([r for r in rows if r[0] % 3 == 0])
    got = {tuple(r) for r in G.tagged(docs.where("doc_id % 3 = 0"), model).collect()}
    assert len(want) > 50 and 2 * len(want & got) / (len(want) + len(got)) > 0.95
    same = G.train(docs.where("doc_id % 3 <> 0").repartition(2), PATTERNS, most=600)
    assert np.array_equal(same.emit, model.emit) and np.array_equal(same.step, model.step)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, rows[0][1]), (3, rows[0][1])], "doc_id long, text string")
    assert G.tagged(odd, model).where("doc_id < 3").count() == 0
    assert G.tagged(odd.limit(0), model).count() == 0
    empty = G.train(docs.limit(0), PATTERNS)
    assert G.tagged(odd, empty).count() == 0


def test_tagged_entities_query_reaches_the_catalogue(spark):
    data = "/root/testdata/sf0.01"  # the smallest table with enough matches
    rows = [(r.doc_id, r.text) for r in L.texts(spark, data).where(L.held_out()).collect()]
    patterns = [(k, re.compile(p)) for k, p in L.CATALOGUE]
    want = {(i, kind, t[a:b], a) for i, t in rows if t for a, b, kind in G.matched(t, patterns)}
    ids = {i for i, _ in rows}
    got = {tuple(r) for r in L.tagged_entities(spark, data).collect() if r.doc_id in ids}
    f1 = 2 * len(want & got) / max(1, len(want) + len(got))
    assert f1 > 0.8, (f1, len(want), len(got))
    both = L.extracted_entities(spark, data).collect()
    assert len({(r.name.lower(), r.type, r.language) for r in both}) == len(both)
    sure = {r.name.lower() for r in both if r.confidence == 0.95}
    assert {n.strip().lower() for *_, n, _ in want} <= sure


def brute_mentions(texts, names, whole):
    out = []
    inside = lambda c: c.isalnum() or c == "_"
    for i, t in texts:
        t = (t or "").lower()
        for n in {n.lower() for n in names if n}:
            at = t.find(n)
            while at >= 0:
                end = at + len(n)
                cut = (at > 0 and inside(t[at - 1]) and inside(t[at])) or (end < len(t) and inside(t[end]) and inside(n[-1]))
                if not (whole and cut):
                    out.append((i, n, at, end))
                at = t.find(n, at + 1)
    return sorted(out)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("most", [200_000, 12])
def test_mentions_equal_a_plain_search(spark, whole, most):
    r = random.Random(3)
    names = ["he", "She", "his", "hers", "his hers", "a b", "é", "词典", "词", "aaaa", "aa", "a-b", None, "", "he", "𝒳y"]
    texts = [(i, "".join(r.choices(["he", "sh", "hers", " ", "a", "b", "-", "é", "词典", "é_", "𝒳y", "İ"], k=r.randint(0, 60)))) for i in range(60)]
    texts += [(100, None), (101, "x" * 3000 + "hers" + "a" * 700), (102, "ushers his hers")]
    df = spark.createDataFrame(texts, "key long, text string").repartition(3)
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted(tuple(x) for x in D.mentions(df.withColumn("found", F.lit(1)), "text", known, whole=whole, most_chars=most, keep=["key"]).collect())
    low = [(i, None if t is None else t.replace("İ", "i̇")) for i, t in texts]
    assert got == brute_mentions(low, names, whole)


def test_longest_match_wins_from_the_left(spark):
    texts = spark.createDataFrame([(1, "The New York times, new yorkers: NEW"), (1, "york"), (2, None), (3, "")], "q long, text string")
    pairs = [("new", "neuf"), ("new york", "la ville"), ("york times", "le journal"), ("york", "york-fr"), ("york", "aaa"), ("x", None), (None, "y")]
    known = spark.createDataFrame(pairs, "name string, target string")
    for most in (200_000, 5):
        got = sorted(D.translated(texts, "q", "text", known, most).collect(), key=lambda r: (r.q, r.translated or ""))
        assert [tuple(r) for r in got] == [(1, "aaa", 1), (1, "the la ville times, neuf yorkers: neuf", 3), (2, None, 0), (3, "", 0)]
    assert [r.translated for r in D.translated(texts.where("q = 1"), "q", "text", known.limit(0)).orderBy("translated").collect()] == ["the new york times, new yorkers: new", "york"]


def test_automaton_states_follow_suffixes():
    a = D.Automaton.of(["abab", "bab", "b"])
    start, end = a.found(D.codes("ababab"))
    assert sorted(zip(start.tolist(), end.tolist(), strict=True)) == [(0, 4), (1, 2), (1, 4), (2, 6), (3, 4), (3, 6), (5, 6)]
    assert D.Automaton.of([]).found(D.codes("abc"))[0].tolist() == []


def plain_matrix(spark, docs):
    from trilune.operators.retrieval import terms

    rows = terms(docs, "doc_id", "text").collect()
    ids, names = sorted({r.doc_id for r in docs.select("doc_id").collect()}), sorted({r.term for r in rows})
    at, to = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(names)}
    a = np.zeros((len(ids), len(names)))
    for r in rows:
        a[at[r.doc_id], to[r.term]] = 1 + np.log(r.tf)
    idf = 1 + np.log((1 + len(ids)) / (1 + (a > 0).sum(axis=0)))
    return ids, names, idf, a * idf


def test_encoder_equals_a_plain_decomposition(spark, data):
    from trilune.operators import encoder as N

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    ids, names, idf, a = plain_matrix(spark, docs)
    values, right = np.linalg.svd(a, full_matrices=False)[1:]
    e = N.fit(docs, size=12, extra=28, power=4)
    assert e.values == pytest.approx(values[:12], rel=0.01)
    got = {r.id: np.array(r.x) for r in e.encoded().collect()}
    assert set(got) == set(ids) and all(abs(np.linalg.norm(v) - 1) < 1e-9 or not v.any() for v in got.values())
    # Vectors may be turned within the directions; similarities may not change.
    plain = a @ right[:12].T
    plain /= np.maximum(np.linalg.norm(plain, axis=1, keepdims=True), 1e-12)
    mine = np.array([got[i] for i in ids])
    assert np.abs(plain @ plain.T - mine @ mine.T).mean() < 0.02
    # A text that the encoder was fitted on gets its own vector when it is encoded.
    some = docs.where("doc_id % 20 = 0")
    again = {r.id: np.array(r.x) for r in e.encode(some, "doc_id", "text").collect()}
    assert again and all(np.allclose(again[i], got[i]) for i in again)
    odd = spark.createDataFrame([(1, None), (2, "qqqq zzzz")], "doc_id long, text string")
    assert all(not any(r.x) for r in e.encode(odd, "doc_id", "text").collect())


def test_encoder_of_little(spark):
    from trilune.operators import encoder as N

    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (3, "cc"), (4, None), (None, "dd"), (3, "cc")], "doc_id long, text string")
    e = N.fit(docs, size=8)
    assert len(e.values) == 2  # as many as the matrix has
    got = {r.id: np.array(r.x) for r in e.encoded().collect()}
    assert set(got) == {1, 2, 3, 4} and np.allclose(got[1], got[2]) and abs(got[1] @ got[3]) < 1e-9 and not got[4].any()
    none = N.fit(docs.limit(0))
    assert len(none.values) == 0 and none.encoded().count() == 0


def test_tokens_are_those_of_the_expression_without_it(monkeypatch):
    expression = G.TOKEN
    monkeypatch.setattr(G, "TOKEN", None)  # no text is searched token by token
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("abÉß9_文٣ .!?。\n\t\x1c\x85@/\r\U0001f600"), r.integers(0, 80))) for _ in range(300)]
    texts += [None, "", " \n", "Ab. cd\n\nE f", "..  !", "".join(map(chr, range(0x250))) + "ǅx Ab ABCDEF ªª"]
    t = G.tokenized(texts)
    monkeypatch.undo()
    assert G.TOKEN is expression
    breaks = set(t.first.tolist())
    at = 0
    for i, text in enumerate(texts):
        ends, last = [m.end() for m in re.finditer(G.SENTENCE_ENDS, text or "")], None
        for m in G.TOKEN.finditer(text or ""):
            assert (t.text[at], t.start[at], t.end[at]) == (i, *m.span())
            new = last is None or any(last < e <= m.start() for e in ends)
            assert (at in breaks) == new
            last, at = m.start(), at + 1
    assert at == len(t.start) == t.first[-1]
    for token in {x[a:b] for x in texts if x for a, b in [m.span() for m in G.TOKEN.finditer(x)]}:
        plain = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token)
        assert G.shape(token) == re.sub(r"9{6,}", "99999", re.sub(r"([^9])\1{3,}", r"\1\1\1", plain))


def test_names_of_a_text_are_found_once_and_by_a_whole_table(monkeypatch):
    from trilune.operators import dictionary as D

    r = np.random.default_rng(9)
    names = sorted({"".join(r.choice(list("abcß文"), r.integers(1, 6))) for _ in range(60)})
    texts = [None, "", *("".join(r.choice(list("abcß文 .x"), r.integers(1, 1500))) for _ in range(40))]
    made = D.Automaton.of(names)
    want = [D.occurrences_in(texts, made, whole) for whole in (False, True)]
    for whole in (False, True):
        for t, places in zip(texts, D.names_in(texts, made, whole), strict=True):
            assert sorted(t[a:b] for a, b in places) == sorted({t[a:b] for a, b in want[whole][texts.index(t)]} if t else [])
    monkeypatch.setattr(D, "MOST_CELLS", 0)  # by edges and fail links
    assert want == [D.occurrences_in(texts, D.Automaton.of(names), whole) for whole in (False, True)]
    for t, places in zip(texts, want[0], strict=True):
        assert {t[a:b] for a, b in places} == {n for n in names if n in (t or "")} if t else not places


def test_text_mentions_search_a_text_for_its_own_language_only(spark, data, monkeypatch):
    asked, real = [], L.D.mentions
    monkeypatch.setattr(L.D, "mentions", lambda texts, text, names, *a, **k: asked.append((texts, names)) or real(texts, text, names, *a, **k))
    L.kg_text_mentions(spark, data).count()
    assert len(asked) > 1
    for texts, names in asked:
        assert {r.lang for r in texts.select("lang").distinct().collect()} <= {r.language for r in names.select("language").distinct().collect()}


def test_encoder_exchanges_terms_of_parts_not_postings(spark, monkeypatch):
    from trilune.operators import encoder as N

    r = np.random.default_rng(5)
    words = [f"w{i:03d}" for i in range(60)]
    rows = [(i, "en" if i % 2 else "fr", " ".join([*r.choice(words, 30), f"only{i}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    seen, real = [], N.product
    monkeypatch.setattr(N, "product", lambda *a, **k: seen.append(N.stored(real(*a, **k), "seen")) or seen[-1])
    one = N.fit(docs, size=6, extra=40)
    made = len(seen)
    assert made == 3 and all(f.where("term is not null").count() <= len(words) for f in seen)  # one part, 400 x 25 postings
    monkeypatch.setattr(N, "parts_of", lambda d, key, text, together: (d.select(key, N.F.col(text).alias("text"), (N.F.col(key) % 5).alias("part")), 5))
    many = N.fit(docs, size=6, extra=40, together="lang")
    assert all(f.where("term is not null").count() <= 5 * len(words) for f in seen[made:])
    assert np.allclose(one.values, many.values)
    a, b = ({v.id: v.x for v in e.encoded().collect()} for e in (one, many))
    x, y = (np.array([v[i] for i in range(400)]) for v in (a, b))
    assert np.allclose(x @ x.T, y @ y.T)
    again = N.fit(docs.unionByName(spark.createDataFrame([(7, "de", "w001 w002")], docs.schema)), size=6, together="lang")
    assert {v.id for v in again.encoded().collect()} == set(range(400))  # rows of one key are one document


def test_encoder_multiplies_chunk_by_chunk(spark, monkeypatch):
    """A task holds a few documents' postings at a time, in order of terms, whatever its part's size."""
    from trilune.operators import encoder as N

    r = np.random.default_rng(6)
    words = np.array([f"w{i:03d}" for i in range(80)])
    rows = [(i, " ".join(words[np.minimum(r.pareto(0.8, 25).astype(int), 79)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    whole = N.fit(docs, size=6, extra=40).values
    monkeypatch.setattr(N, "CHUNK_TOKENS", 100)
    made = N.packed(*(lambda d: (d, "doc_id", "fr", 1))(docs.withColumn("part", N.F.lit(0).cast("long")))).where("keys is not null").toArrow()
    held = list(N.chunks(made))
    assert len(held) >= 40 and max(c.tf.sum() for c in held) <= 150 and sum(c.size for c in held) == 200
    assert np.allclose(N.fit(docs, size=6, extra=40).values, whole)
    for c in held[:3]:
        a = np.zeros((c.size, c.terms.max() + 1))
        a[c.docs, np.repeat(c.terms, c.counts)] = c.tf
        q, use = r.random((4, a.shape[1])), np.arange(len(c.terms)) % 3 > 0
        a[:, np.setdiff1d(np.arange(a.shape[1]), c.terms[use])] = 0
        forth, back = c.times(c.tf.astype(float), use)
        y, z = forth(lambda some, c=c: q[:, c.terms[some]]), np.zeros(q.shape)
        for some, sums in back(y):
            z[:, c.terms[some]] += sums
        assert np.allclose(y, q @ a.T) and np.allclose(z, y @ a)


def test_encoded_topk_finds_the_source_of_a_passage(spark, data):
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(40).collect())]
    from trilune.operators import encoder as N
    from trilune.operators import retrieval as R

    e = N.fit(spark.createDataFrame(rows, "doc_id long, text string"), size=24)
    asked = spark.createDataFrame([(i, t[: len(t) // 2]) for i, t in rows], "q long, text string")
    found = R.dense_search(e.encode(asked, "q", "text"), e.encoded(), 1).collect()
    assert sum(r.query_id == r.doc_id for r in found) >= 30


def test_gradient_of_the_network_is_that_of_its_loss():
    from trilune.operators.graph_network import Network

    r = np.random.default_rng(2)
    block, share = r.normal(size=(8, 3, 5)), np.full((8, 3), 1 / 3)
    net = Network(r.normal(size=(5, 6)), r.normal(size=(6, 4)))
    loss, first, second = net.gradient(block, share, 4, 1.0)
    for w, g in ((net.first, first), (net.second, second)):
        for at in [(0, 0), (2, 3), (4, 1)]:
            w[at] += 1e-6
            up = net.gradient(block, share, 4, 1.0)[0]
            w[at] -= 2e-6
            down = net.gradient(block, share, 4, 1.0)[0]
            w[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_network_is_applied_to_whole_neighbourhoods(spark):
    from trilune.operators import graph_network as W

    r = np.random.default_rng(3)
    x = r.normal(size=(9, 4))
    edges = [(0, 1), (1, 2), (2, 0), (3, 1), (1, 3), (4, 4), (5, 6), (5, 6), (7, 8), (8, 99)]
    net = W.Network(r.normal(size=(4, 5)), r.normal(size=(5, 3)))
    near = {i: {i} | {b for a, b in edges + [(b, a) for a, b in edges] if a == i and b < 9} for i in range(9)}
    mean = lambda v: np.array([v[sorted(near[i])].mean(axis=0) for i in range(9)])
    want = mean(np.maximum(mean(x) @ net.first, 0)) @ net.second
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50, None)], "id long, x array<double>")
    got = {n.id: n.x for n in W.encoded(nodes, spark.createDataFrame(edges, "src long, dst long"), net).collect()}
    assert set(got) == set(range(9)) and all(np.allclose(got[i], want[i]) for i in got)
    assert W.sampled(spark.createDataFrame([(1, i) for i in range(4000)], "src long, dst long"), 100).count() in range(60, 140)


def hits(z, e, seeds):
    ids = [n.id for n in e if n.language == "fr"]
    right = np.array([z[i] for i in ids])
    return np.mean([ids[int((right @ z[a]).argmax())] == b for a, b in seeds])


def test_trained_convolution_beats_plain_averages_on_held_out_seeds(spark, data):
    from trilune.operators import align as A
    from trilune.operators import graph_network as W

    e, r, x, edges, net = L.trained_words(spark, data)
    words, held = e.collect(), [(s.e1, s.e2) for s in L.word_seeds(r, False).collect()]
    plain = {n.id: np.array(n.x) for n in A.propagated(x, edges).collect()}
    after = {n.id: np.array(n.x) for n in W.encoded(x, edges, net).collect()}
    assert len(held) > 10 and hits(after, words, held) > hits(plain, words, held) + 0.2
    partners = L.align_gcn_trained(spark, data).collect()
    best = {}
    for p in partners:
        best[p.e1] = max(best.get(p.e1, (0, "")), (p.confidence, p.e2))
    assert np.mean([best.get(a, (0, ""))[1] == b for a, b in held]) > hits(plain, words, held)


def test_tournament_meets_each_pair_once():
    from trilune.operators.translation import tournament

    for n in (2, 4, 8):
        rounds = tournament(n)
        assert all(sorted(x for pair in pairs for x in pair) == list(range(n)) for pairs in rounds)
        assert sorted(pair for pairs in rounds for pair in pairs) == list(itertools.combinations(range(n), 2))
    assert tournament(1) == [[(0, 0)]]


def ring_triples(n=60):
    rows = [("a", f"n{i}", "next", f"n{(i + 1) % n}") for i in range(n)] + [("a", f"n{i}", "far", f"n{(i + 7) % n}") for i in range(n)]
    return rows + [("b", f"n{i}", "next", f"n{i + 1}") for i in range(20)]


def test_buckets_reach_the_loss_of_one_group(spark):
    from trilune.operators import translation as T

    rows = ring_triples()
    odd = [("a", "n1", "next", "n2"), ("a", None, "next", "n2"), (None, "x", "y", "z")]
    t = spark.createDataFrame(rows + odd, "language string, h string, r string, t string").repartition(3)
    losses = {}
    for buckets in (1, 4):
        vectors, relations = T.embedded(t, "language", buckets=buckets, sweeps=60)
        got = {(v.language, v.name): np.array(v.x) for v in vectors.collect()}
        assert set(got) == {(g, n) for g, h, _, x in rows for n in (h, x)} and set(relations) == {(g, r) for g, _, r, _ in rows}
        far = {(d.language, d.h, d.r, d.t): d.distance for d in T.distances(t.dropna().distinct(), "language", vectors, relations).collect()}
        assert far == {(g, h, r, x): pytest.approx(np.linalg.norm(got[g, h] + relations[g, r] - got[g, x])) for g, h, r, x in rows}
        mixed = np.random.default_rng(0).permutation(len(rows))
        other = [np.linalg.norm(got[g, h] + relations[g, r] - got.get((g, rows[k][3]), got[g, x])) for (g, h, r, x), k in zip(rows, mixed, strict=True)]
        losses[buckets] = (np.mean(list(far.values())), np.mean(np.maximum(0, 1 + np.array([far[x] for x in rows]) - other)))
        again = T.embedded(t.repartition(2), "language", buckets=buckets, sweeps=60)[0].collect()
        assert sorted((v.language, v.name, v.x) for v in again) == sorted((g, n, x.tolist()) for (g, n), x in got.items())
    assert losses[4][1] < losses[1][1] * 1.3 + 0.05
    assert T.embedded(t.limit(0), "language")[0].count() == 0


def test_embeddings_query_is_near_its_triples(spark, data):
    from trilune.plans import align as P

    rows = P.kg_embeddings(spark, data).collect()
    heads = {(r.language, r.h) for r in P.triples(spark, data).select("language", "h").distinct().collect()}
    assert {(r.language, r.name) for r in rows} == heads
    assert np.average([r.distance for r in rows], weights=[r.n for r in rows]) < 1.0


def test_mapped_embeddings_find_more_than_chance(spark, data):
    from trilune.plans.lexicon import graph

    found = {(r.e1, r.e2) for r in L.align_mtranse(spark, data).collect()}
    _, r = graph(spark, data)
    held = [(s.e1, s.e2) for s in L.word_seeds(r, False).collect()]
    assert np.mean([x in found for x in held]) > 10 / 50


def test_lemmas_of_a_small_language(spark):
    from trilune.operators import lemmas as M

    stems = ["walk", "talk", "jump", "play", "work", "look"]
    rows = [("en", s + e, 2) for s in stems for e in ("", "s", "ing", "ed")] + [("en", "bring", 5), ("en", "sing", 1), ("en", "ab", 1), (None, "walking", 1)]
    words = spark.createDataFrame(rows, "language string, word string, n long")
    rules = M.rules(words, least=4)
    assert {(r.language, r.ending, r.into) for r in rules.collect()} >= {("en", "s", ""), ("en", "ing", ""), ("en", "ed", "")}
    got = {(r.language, r.word): r.lemma for r in M.lemmas(words, rules).collect()}
    assert all(got["en", s + e] == s for s in stems for e in ("", "s", "ing", "ed")) and len(got) == len(rows)
    assert got["en", "bring"] == "bring" and got["en", "ab"] == "ab" and got[None, "walking"] == "walking"
    known = {r.ending: r.into for r in rules.where("language = 'en'").collect()}
    new = spark.createDataFrame([("climbing",), ("mends",), ("ing",), (None,)], "w string").select(M.rewritten(F.col("w"), known).alias("l"))
    assert [r.l for r in new.collect()] == ["climb", "mend", "ing", None]
    assert M.rules(words.limit(0)).count() == 0
