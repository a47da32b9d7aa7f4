"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from trilune.llm import contamination, jaccard_join, language_id, lattice, lm_scoring, mixing, nearest, registry, substring_dedup, token_counts, toxicity, warc
from trilune.llm import words as W

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(3)
    doc = lambda n: [r.choice("abcdefghij") + str(r.randint(0, 30)) for _ in range(n)]
    base, passage, texts = doc(60), doc(30), []
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
        texts.append(" ".join(w))
    texts += [" ".join(doc(r.randint(3, 20)) + passage + doc(r.randint(3, 20))) for _ in range(20)]
    texts += [
        "",
        None,
        "one two",
        "One  TWO",
        "a b c d",
        "a b c d",
        "a b c d e",
        " \n ",
        "x " * 500,
        "x " * 700,
        "é ü\tÉ\x0bz",
        " ".join(doc(9000)),
    ]
    ids = [i * 7 % 1009 for i in range(len(texts))]
    return [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None, 0) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, duck, data, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), duck.execute(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_words_equal_a_plain_split():
    texts = ["", "a", "  A b\tc\x0b\x0cd\r\ne ", "É x y", "z" * 10, " ", "q"]
    w = W.split(texts, lower=True)
    plain = [t.encode().lower().split() for t in texts]
    assert [bytes(w.buffer[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [x for p in plain for x in p]
    assert w.counts().tolist() == list(map(len, plain))
    assert len(set(w.hash.tolist())) == len({x for p in plain for x in p})


def test_warc_round_trip(spark):
    big = "p" * 1200
    rows = [
        (1, "http://a\r\nX: y", big),
        (5, None, big),
        (5, None, big),
        (None, "u", big),
        (2, "u", "small"),
        (3, "u", "small"),
        (4, "u", None),
        (6, "", "é" * 700),
    ]
    index = warc.write(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2),
        roll_bytes=400,
    )
    got = warc.read(index, gap_bytes=10).collect()
    assert all(r.intact for r in got) and len(got) == len(rows)
    kinds = Counter((r.id, r.record_type, r.refers_to) for r in got)
    assert kinds[("1", "revisit", "5")] == 1 and kinds[("5", "response", None)] == 2 and kinds[(None, "revisit", "5")] == 1 and kinds[("3", "response", None)] == 1
    assert {r.url for r in got if r.id == "1"} == {"http://a\r\nX: y"}
    assert {bytes(r.payload) for r in got if r.id == "6"} == {("é" * 700).encode()}
    some = warc.read(index.where("id = '2'")).collect()
    assert [(r.id, bytes(r.payload)) for r in some] == [("2", b"small")]
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_components(rows):
    sets, inverted = {}, defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("short", "block"), [(100, 2048), (2, 5)])
def test_jaccard_components(docs, rows, short, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(docs).collect()}
    assert got == brute_components([r[:2] for r in rows])


def test_jaccard_nulls_and_nothing(spark, empty):
    assert jaccard_join.linked_components(empty).collect() == []
    got = jaccard_join.linked_components(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (4, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (3, 3), (3, 3), (4, 4)]


def test_components_fail_aloud_at_a_cap(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "x long, y long")
    with pytest.raises(RuntimeError):
        jaccard_join.components(spark, links, 1, at_once=0)
    for at_once in (0, 1000):
        assert {(r.id, r.component) for r in jaccard_join.components(spark, links, at_once=at_once).collect()} == {(i, 0) for i in range(41)}
    mixed = spark.createDataFrame([(i * 7 % 50, i * i % 50) for i in range(30)], "x long, y long")
    found = [
        {(r.id, r.component) for r in jaccard_join.components(spark, mixed, at_once=n).collect()}
        for n in (0, 1000)
    ]
    assert found[0] == found[1]


def test_tokens_equal_the_library(docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, MODEL).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in rows}
    r, t = random.Random(1), token_counts.transducer(MODEL)
    for _ in range(2000):
        x = "".join(r.choice("ab cdeT \n\t  ▁é中文字\0<s>😀the 　ﬁ") for _ in range(r.randint(0, 40)))
        assert {t.count(x, c) for c in (1, 7, 1 << 20)} == {len(sp.encode(x))}
    assert token_counts.token_counts(empty, MODEL).collect() == []


def test_mixing_reaches_targets(spark, docs, empty):
    got = mixing.mixed(docs.withColumn("rate", F.lit("clash"))).collect()
    assert len(got) == docs.count()
    total = sum(
        (
            {(r.source, r.source_size) for r in got and [r for r in got]}
            and [s for _, s in {(r.source, r.source_size) for r in got}]
        ),
    )
    targets = {(r.source, r.target, r.source_size) for r in got}
    assert sum(t for _, t, _ in targets) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-6 for _, t, s in targets)
    assert all(r.copies <= 2 for r in got)
    assert [r.copies for r in mixing.mixed(docs).orderBy("doc_id").collect()] == [r.copies for r in mixing.mixed(docs.repartition(7)).orderBy("doc_id").collect()]
    assert mixing.emitted(docs).count() == sum(r.copies for r in got)
    assert mixing.mixed(empty).collect() == []


def brute_dedup(rows, size=13):
    first, out = {}, {}
    split = lambda t: (t or "").encode().split()
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (
            len(w),
            sum(gone),
            hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest(),
        )
    return out


@pytest.mark.parametrize(("slice_bytes", "group"), [(4 << 20, 200_000), (300, 3)])
def test_substring_dedup(docs, rows, slice_bytes, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    got = {
        r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
        for r in substring_dedup.deduplicated(docs, slice_bytes=slice_bytes).collect()
    }
    assert got == brute_dedup([r[:2] for r in rows])


def test_substring_dedup_edges(spark, empty):
    assert substring_dedup.deduplicated(empty).collect() == []
    t = " ".join(map(str, range(15)))
    got = substring_dedup.deduplicated(spark.createDataFrame([(None, t, "k"), (2, t, "k"), (2, t, "k"), (9, t, None)], "doc_id long, text string, n_words string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (2, 0), (2, 0), (9, 15)]


@pytest.mark.parametrize("slices", [1, 2])
@pytest.mark.parametrize("whole", [False, True])
def test_substring_dedup_rows_with_one_id(spark, slices, whole):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    passage = words("p", 15)
    twice = [(5, f"{words('a', 6)} {passage}"), (5, f"{words('a' if whole else 'b', 6)} {passage}")]
    rows = [(2, f"{passage} {words('c', 4)}"), *twice]
    parts = [rows[:1], twice] if slices == 1 else [rows[:1], twice[:1], twice[1:]]
    docs = spark.createDataFrame(
        spark.sparkContext.parallelize(parts, len(parts)).flatMap(list),
        "doc_id long, text string",
    )
    assert docs.rdd.getNumPartitions() == len(parts)  # each is a slice
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.deduplicated(docs).collect()]
    assert sorted(got) == [(2, 19, 0), (5, 21, 15), (5, 21, 15)]


def brute_contamination(docs, items, size=13):
    terms = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
        "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")),
    )
    held, out = defaultdict(set), {}
    for i, t in items:
        w = terms(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            held[tuple(w[k : k + n])].add(i)
    for d, t in docs:
        w, found = terms(t), set()
        hit = [0] * len(w)
        for n in {len(k) for k in held}:
            for k in range(len(w) - n + 1):
                if x := held.get(tuple(w[k : k + n])):
                    found |= x
                    hit[k : k + n] = [1] * n
        names = sorted(map(str, found))
        out[d] = (
            len(w),
            sum(hit),
            len(names),
            hashlib.sha256(",".join(names).encode()).hexdigest(),
            sum(hit) > 0 and 20 * sum(hit) >= len(w),
        )
    return out


def test_contamination(spark, docs, rows, empty):
    items = [(1, rows[45][1]), (2, rows[0][1].upper()), (3, "one-two"), (4, None), (5, "!!"), (10, "a b, c"), (11, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {
        r.doc_id: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
        for r in contamination.contamination(docs, bench).collect()
    }
    assert got == brute_contamination([r[:2] for r in rows], items)
    again = {r.doc_id: r.items_sha256 for r in contamination.contamination(docs, bench, most_terms=30).collect()}
    assert again == {d: v[3] for d, v in got.items()}
    assert contamination.contamination(empty, bench).collect() == []
    none = contamination.contamination(docs, bench.where("item_id is null")).collect()
    assert not any(r.contaminated for r in none) and len(none) == len(rows)
    near = spark.createDataFrame([(1, "alpha mid beta gamma"), (2, "alpha beta gamma")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert {r.doc_id: r.n_items for r in contamination.contamination(near, item, slop=1).collect()} == {1: 1, 2: 1}


def test_lattice_sums_all_segmentations():
    lat = lattice.lattice(MODEL)
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(lat.size))).reshape(-1, 1)
    place = {p: i for i, p in reversed(list(enumerate(lat.pieces)))}
    words = [b"therefore", "études".encode(), b"", b"x" * 40, b"zq"]
    for w, got in zip(words, lat.run(*lattice.spelled(words), logp)[:, 0], strict=True):
        b, total = b" " + w, [0.0]
        for i in range(1, len(b) + 1):
            total.append(np.logaddexp.reduce([total[j] + logp[place[b[j:i]], 0] for j in range(i) if b[j:i] in place]))
        assert got == pytest.approx(total[-1])


def test_language_id(spark, data, empty):
    out = (
        language_id.query(spark, data)
        .join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
        .where("held_out")
        .toPandas()
    )
    assert (out.lang == out.lang_pred).mean() > 0.9
    model = (["en", "fr"], np.full((lattice.lattice(MODEL).size, 2), -10.0))
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, "a"), (3, "a"), (None, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.lang_pred) for r in language_id.languages(odd, model, MODEL).collect()) == [(0, "und"), (1, "und"), (2, "und"), (3, "en"), (3, "en")]
    assert language_id.languages(empty, ([], model[1][:, :0]), MODEL).collect() == []
    assert {r.lang_pred for r in language_id.languages(odd, ([], model[1][:, :0]), MODEL).collect()} == {"und"}


def test_lm_scores(docs, rows, empty):
    train = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, train, MODEL).collect()}
    split = lambda t: (t or "").encode().lower().split()
    c = Counter(w for i, t, *_ in rows if i % 3 for w in split(t))
    e = sum(1 for r in rows if r[0] % 3)
    n, v = sum(c.values()) + e, len(c) + 1
    for i, t, *_ in rows:
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)) + math.log10((e + 1) / (n + v + 1))
        assert got[i].base_score == pytest.approx(want)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(split(t)) + 1, sum(c[w] > 0 for w in split(t)) + 1, n)
        assert got[i].score < 0
    assert lm_scoring.lm_scores(empty, train, MODEL).collect() == []
    assert len(lm_scoring.lm_scores(docs, F.lit(False), MODEL).collect()) == len(rows)


def test_toxicity(spark, data, docs, empty):
    out = (
        toxicity.query(spark, data)
        .join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
        .where("held_out")
        .toPandas()
    )
    assert out.score.between(0, 1).all()
    assert ((out.score >= 0.7).astype(int) == out.predicted).all()
    assert {(r.score, r.predicted) for r in toxicity.scored(docs, None).collect()} == {(0.0, 0)}
    assert toxicity.fit(docs, spark.createDataFrame([(7, 1)], "doc_id long, toxic int")) is None
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(0, 500, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, epochs=1)
    assert toxicity.scored(empty, model).collect() == []
    assert toxicity.scored(docs.withColumn("score", F.lit("clash")), model).count() == docs.count()


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:200] = x[100]
    rows = (
        [(i, v.tolist()) for i, v in enumerate(x)]
        + [
            (5000, None),
            (5001, [0.0] * 16),
            (5002, [float("nan")] * 16),
            (5003, [1.0, None] + [0.0] * 14),
            (None, x[0].tolist()),
            (5004, [1.0]),
        ]
    )
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(v, F.col("vec_id") % 20 == 0, parts=8, block=300).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        order = np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:20]
        hits += len(set(order) & set(g.vec_id))
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(g) + 1))
        assert np.allclose(g.score, x[g.vec_id] @ x[q])
    assert set(got.query_id) == set(range(0, 1200, 20)) and hits / (60 * 20) >= 0.85
    assert nearest.nearest(v.where("vec_id > 4999"), F.lit(True)).count() == 0
    few = nearest.nearest(v.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6


def exact_nearest(x, q, k=20):
    s = x @ x[q]
    s[q] = -9
    return np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:k]


def test_nearest_goes_on_until_k_rows(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(400, 4))
    x[:, 0] = -np.abs(x[:, 0])
    x[:5, 0] *= -1  # the first part holds five rows
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = np.zeros((4, 2))
    w[0] = 1, -1
    router = nearest.Router(np.zeros(4), w, np.zeros(2), np.eye(2), np.zeros(2))
    monkeypatch.setattr(nearest, "learned", lambda *a: router)
    rows = [(i, a.tolist(), i < 5) for i, a in enumerate(x)] + [(2, x[2].tolist(), False)] * 30  # own rows do not count
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, asks boolean")
    got = nearest.nearest(v, F.col("asks") & (F.col("vec_id") == 2)).toPandas()
    assert list(got.sort_values("rank").vec_id) == exact_nearest(x, 2).tolist()
    got = nearest.nearest(v.distinct().where("vec_id <> 2 or asks"), F.col("asks")).toPandas()
    for q in range(5):
        assert list(got[got.query_id == q].sort_values("rank").vec_id) == exact_nearest(x, q).tolist()


def test_nearest_of_few_distinct_vectors(spark):
    few = np.random.default_rng(2).normal(size=(6, 8))
    few /= np.linalg.norm(few, axis=1)[:, None]
    assert nearest.learned(few, 4).probes == 4
    x = few[np.append(np.arange(1800) % 5, [5] * 3)]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(v, F.col("vec_id") >= 1800, parts=4).toPandas()
    for q in range(1800, 1803):
        assert list(got[got.query_id == q].sort_values("rank").vec_id) == exact_nearest(x, q).tolist()


def test_nearest_query_reaches_the_recall(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {q: set(g.vec_id) for q, g in nearest.query(spark, data).toPandas().groupby("query_id")}
    want = {int(ids[q]): set(ids[exact_nearest(x, q)].tolist()) for q in np.flatnonzero(ids % 20 == 0)}
    assert all(len(got[q]) == 20 for q in want)
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 20 * len(want)


def test_fold_is_the_contract(spark):
    from trilune.llm.common import fold

    ids = [*range(200), 10**12, -5, None]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for parts, keep in ((3, 1), (4, 2), (7, 2)):
        got = {r.doc_id: r.held for r in docs.select("doc_id", fold(F.col("doc_id"), parts, keep).alias("held")).collect()}
        assert got == {i: i is not None and zlib.crc32(str(i).encode()) % parts == keep for i in ids}


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.trained(spark, docs, data)
    rows = [(r.doc_id, r.text, r.source) for r in toxicity.scored(docs, model).where("predicted = 0").collect()]
    group = brute_components([r[:2] for r in rows])
    rows = [r for r in rows if group[r[0]][1] == r[0]]
    first = {}
    for i, t, _ in sorted(rows):
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    left = []
    for i, t, s in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(x.decode() for x in w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        if any(gone):
            t = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
            if not t:
                continue
        left.append((i, t, s))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bad = brute_contamination([r[:2] for r in left], bench)
    left = [r for r in left if not bad[r[0]][4]]
    want = mixing.emitted(spark.createDataFrame(left, "doc_id long, text string, source string")).collect()
    got = p.run(spark, data).collect()
    key = lambda r: (r.doc_id, r.copy, r.text)
    assert sorted(map(key, got)) == sorted(map(key, want))
