"""Operators against plain computations: words built to collide, very long words, clashing columns, models by hand."""

import hashlib
import math
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_contamination, brute_dedup, exact_nearest

from trilune.llm import contamination, jaccard_join, language_id, lattice, lm_scoring, mixing, nearest, substring_dedup, token_counts, toxicity, warc
from trilune.llm import words as W

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def thue_morse(n, turned=False):
    return "".join("ab"[(bin(i).count("1") + turned) % 2] for i in range(n))


TWINS = [thue_morse(n, t) for n in (1024, 2048, 4096) for t in (False, True)]


def twin_rows():
    """Texts that differ in one word only, of which the one's polynomial equals the other's modulo every power of two."""
    rest = " ".join(f"w{i}" for i in range(20))
    return (
        [(i, f"{rest[:40]} {t} {rest[41:]}") for i, t in enumerate(TWINS)]
        + [(i + 10, " ".join([t] * 15)) for i, t in enumerate(TWINS)]
    )


def test_words_of_thue_and_morse_differ(spark):
    w = W.split(TWINS)
    assert len(set(w.hash.tolist())) == len(TWINS) and W.numbered(w).tolist() == list(range(len(TWINS)))
    rows = twin_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(docs).collect()} == brute_components(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicated(docs).collect()}
    assert got == brute_dedup(rows)
    items = [(1, TWINS[0]), (2, rows[2][1]), (3, rows[-1][1])]
    got = {
        r.doc_id: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
        for r in contamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    assert got == brute_contamination(rows, items)
    known = {
        r.doc_id: r.n_known
        for r in lm_scoring.lm_scores(docs, F.col("doc_id").isin(0, 2, 10), MODEL, rounds=0).collect()
    }
    seen = {x for i, t in rows if i in (0, 2, 10) for x in t.split()}
    assert known == {i: sum(x in seen for x in t.split()) + 1 for i, t in rows}


def test_equal_fingerprints_are_settled_by_words(spark, monkeypatch):
    rows = [(i, " ".join(f"{'x' if k != 5 else 'abc'[i % 3]}{k}" for k in range(13))) for i in range(4)]
    plain = brute_dedup(rows)
    monkeypatch.setattr(W, "grams", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    w, ids = W.split([t for _, t in rows]), np.arange(4)
    at, _, repeated, _ = substring_dedup.settled(w, ids, np.zeros(0, int), 13)
    assert [bool(r) for r in repeated] == [plain[i][1] > 0 for i in range(4)]


def test_shards_compare_terms_as_text(monkeypatch):
    monkeypatch.setattr(W, "fingerprints", lambda buffer, start, end: np.zeros(len(start), np.uint64))
    found = contamination.block([(0, "a", "one two"), (1, "b", "three")], 13)
    w = W.split(["three one", "two"], W.NOT_TERM)
    order = np.argsort(W.numbered(w), kind="stable")
    shard = contamination.Shard(
        w.first.astype(np.uint32).tobytes(),
        np.zeros(3, np.uint64).tobytes(),
        W.packed(w, order),
        np.arange(1, 4, dtype=np.uint32).tobytes(),
        (np.arange(3) + w.doc)[order].astype(np.uint32).tobytes(),
    )
    starts, lengths, items = shard.search(found, 0)
    assert items == [(0, 1, "b")] and starts.tolist() == [0] and lengths.tolist() == [1]


def test_a_word_of_a_megabyte_ends_in_seconds(spark):
    r = np.random.default_rng(0)
    big = "".join(map(chr, r.integers(97, 123, 1_000_000)))
    lat = lattice.lattice(MODEL)
    logp = np.full((lat.size, 1), -math.log(lat.size))
    began = time.perf_counter()
    lat.run(*lattice.spelled([big.encode()]), logp)
    assert time.perf_counter() - began < 60
    words, weight = [b"there" * 30, b"q", b"the" * 20], np.array([2.0, 1.0, 3.0])
    logp = np.log(r.dirichlet(np.ones(lat.size))).reshape(-1, 1)
    want = lat.run(*lattice.spelled(words), logp, weight)
    lattice.LONG, old = 4, lattice.LONG
    try:
        got = lat.run(*lattice.spelled(words), logp, weight)
    finally:
        lattice.LONG = old
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    import sentencepiece

    began = time.perf_counter()
    assert token_counts.transducer(MODEL).count(big[:200_000], 1 << 14) == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(big[:200_000]))
    assert time.perf_counter() - began < 60
    docs = spark.createDataFrame([(1, big), (2, big), (3, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.linked_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sum(r.n_removed for r in substring_dedup.deduplicated(docs).collect()) == 0


CLASH = [
    "size",
    "copies",
    "copy",
    "rate",
    "_rate",
    "_source",
    "target",
    "source_size",
    "_text_hash",
    "score",
    "id",
    "part",
    "mark",
    "slice",
    "bucket",
    "kind",
    "n",
    "c0",
    "text_",
    "_size",
    "_copies",
]


def test_columns_that_clash_are_kept(spark, data):
    rows = [(i, f"word{i % 3} and more of it {i}", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASH])
    out = mixing.emitted(wide)
    assert out.columns == [*wide.columns, "copy_"]
    want = Counter((r.doc_id, r.copy) for r in mixing.emitted(docs).collect())
    assert Counter((r.doc_id, r["copy_"]) for r in out.collect()) == want
    assert all(r[c] == f"{c}-{r.doc_id}" for r in out.collect() for c in CLASH)
    for stage in (contamination.stage, jaccard_join.stage, substring_dedup.stage):
        kept = stage(spark, wide, data)
        assert kept.columns == wide.columns
        assert all(r[c] == f"{c}-{r.doc_id}" for r in kept.collect() for c in CLASH)
    for got in (jaccard_join.linked_components(wide), token_counts.token_counts(wide, MODEL), contamination.contamination(wide, docs.select(F.col("doc_id").alias("item_id"), "text")), lm_scoring.lm_scores(wide, F.lit(True), MODEL)):
        assert got.count() == 12
    assert language_id.languages(wide, ([], np.zeros((lattice.lattice(MODEL).size, 0))), MODEL).count() == 12
    pages = wide.select(
        F.col("doc_id").alias("page_id"),
        F.lit("u").alias("url"),
        F.col("text").alias("html"),
        F.lit(1).alias("_digest"),
        F.lit(2).alias("archive"),
        F.lit("x").alias("_key"),
    )
    assert warc.read(warc.write(pages)).where("intact").count() == 12


def test_warc_holds_long_payloads_and_reads_in_many_tasks(spark):
    long = "<p>é</p>" * 200_000
    pages = spark.createDataFrame(
        [(1, "u", long), (2, "u", long), (3, "u", None)] + [(i, "u", "x" * i) for i in range(4, 30)],
        "page_id long, url string, html string",
    )
    index = warc.write(pages)
    got = {r.id: r for r in warc.read(index, task_bytes=100).collect()}
    assert warc.read(index, task_bytes=100).rdd.getNumPartitions() > 4
    assert got["2"].payload_digest == hashlib.sha1(long.encode()).hexdigest() and bytes(got["2"].payload).decode() == long
    assert (got["1"].record_type, got["1"].refers_to, got["1"].payload) == ("revisit", "2", None) and all(r.intact for r in got.values())


def test_warc_without_a_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame(
        [(i, "u", "y" * (900 + 200 * (i % 3))) for i in range(20)] + [(None, "u", "z" * 1500), (99, None, "z" * 1500)],
        "page_id long, url string, html string",
    )
    rows = lambda: sorted(
        (r.id or "", r.record_type, r.refers_to or "")
        for r in warc.read(warc.write(pages)).collect()
    )
    want = rows()
    monkeypatch.setattr(warc, "SENT_BYTES", -1)
    assert rows() == want


def test_mixing_by_salt_and_near_targets(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    key = lambda r: (r.doc_id, r.size, r.target, r.copies)
    want = sorted(map(key, mixing.mixed(docs).collect()))
    taken, target, largest = Counter(), {}, Counter()
    for r in mixing.mixed(docs).collect():
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    sizes = {
        r.source: r["sum(q)"]
        for r in mixing.mixed(docs).selectExpr("source", "size * size as q").groupBy("source").sum("q").collect()
    }
    for s, t in target.items():
        assert abs(taken[s] - t) <= 4 * 0.5 * math.sqrt(sizes[s]) + 1  # four standard deviations of the fractional copies
    monkeypatch.setattr(mixing, "SENT_BYTES", -1)
    assert sorted(map(key, mixing.mixed(docs).collect())) == want


def test_documents_without_ids_draw_apart(spark):
    docs = spark.createDataFrame(
        [(None, f"a b c {i}", "s" if i % 2 else "t") for i in range(400)],
        "doc_id long, text string, source string",
    )
    copies = Counter((r.source, r.copies) for r in mixing.mixed(docs).collect())
    assert all(sum(n for (s, _), n in copies.items() if s == x) == 200 for x in "st")
    taken = {x: sum(c * n * 4 for (s, c), n in copies.items() if s == x) for x in "st"}
    target = {r.source: r.target for r in mixing.mixed(docs).select("source", "target").distinct().collect()}
    assert all(abs(taken[x] - target[x]) < 0.15 * target[x] for x in "st")


def brute_pieces(lat, counts, logp):
    """Expected uses of pieces over all segmentations of the counted words, by plain sums of probabilities."""
    place = {p: i for i, p in reversed(list(enumerate(lat.pieces)))}
    used, scores = np.zeros(lat.size), {}
    for w, n in counts.items():
        b = b" " + w
        there, back = [1.0] + [0.0] * len(b), [0.0] * len(b) + [1.0]
        edges = [(i, j, place[b[i:j]]) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if b[i:j] in place]
        for i, j, p in sorted(edges, key=lambda e: e[1]):
            there[j] += there[i] * math.exp(logp[p])
        for i, j, p in sorted(edges, key=lambda e: -e[0]):
            back[i] += back[j] * math.exp(logp[p])
        scores[w] = math.log(there[-1])
        for i, j, p in edges:
            used[p] += n * there[i] * math.exp(logp[p]) * back[j] / there[-1]
    return used, scores


@pytest.mark.parametrize("edge", [True, False])
def test_lm_score_by_hand(spark, edge):
    import sentencepiece

    texts = [
        "the cat sat on the mat",
        "The cat ate",
        "a dog sat",
        "the dog and the bird fly",
        None,
        "",
        "unseen words here",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {
        r.doc_id: r.score
        for r in lm_scoring.lm_scores(docs, F.col("doc_id") < 4, MODEL, rounds=1, word_edge=edge).collect()
    }
    lat, sp = lattice.lattice(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counts = Counter(w for t in texts[:4] for w in t.lower().encode().split())
    place = {p: i for i, p in reversed(list(enumerate(lat.pieces)))}
    used = np.zeros(lat.size)
    for w, n in counts.items():
        for p in sp.encode(w.decode(), out_type=str):
            if p.replace("▁", " ").encode() in place:
                used[place[p.replace("▁", " ").encode()]] += n
    logp = np.log((used + 0.1) / (used + 0.1).sum())
    used, _ = brute_pieces(lat, counts, logp)
    logp = np.log((used + 0.1) / (used + 0.1).sum())
    n, ends = sum(counts.values()), 4
    end = (ends + 0.1) / (n + ends + 0.2)
    new = (sum(c == 1 for c in counts.values()) + 1) / (n + 2)
    for i, t in enumerate(texts):
        own = Counter((t or "").lower().encode().split())
        _, score = brute_pieces(lat, own, logp)
        want = math.log10(end)
        for w, k in own.items():
            p = math.exp(score[w])
            p = new * p + (1 - new) * counts[w] / n if edge else p
            want += k * math.log10(p * (1 - end))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_language_score_by_hand(spark):
    lat = lattice.lattice(MODEL)
    r = np.random.default_rng(4)
    logp = np.log(r.dirichlet(np.full(lat.size, 0.5), 3)).T
    names, texts = ["de", "en", "fr"], ["The cat sat", "x", "études d'été 12", "12 !", "", None, "the the the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.languages(docs, (names, logp), MODEL).collect()}
    for i, t in enumerate(texts):
        words = [w.lower() for w in (t or "").encode().split()]
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        total = np.array([sum(brute_pieces(lat, {w: 1}, logp[:, j])[1][w] for w in words) for j in range(3)])
        mean = np.exp((total - total.max()) / len(words))
        assert got[i][0] == names[int(total.argmax())] and got[i][1] == pytest.approx(float((mean / mean.sum())[total.argmax()]))


def test_convolution_by_hand(spark):
    m = toxicity.Model()
    m.start(3)
    m.weights["e"][:-1] = np.random.default_rng(1).normal(size=(m.rows, m.size))
    m.languages, m.thresholds = ["en"], np.array([0.3])
    texts = ["one two three four", "one", "", None, "!!", "two one two one two"]
    w = W.split(texts, W.NOT_TERM, lower=True)
    rows, z = m.features(w), m.logits(w)[0]
    for i in range(len(texts)):
        own = rows[w.first[i] : w.first[i + 1]]
        x = np.concatenate([m.weights["e"][own].sum(axis=1).reshape(-1, m.size), np.zeros((max(m.widths), m.size))])
        tops = []
        for k in m.widths:
            responses = [
                sum(x[p + j] @ m.weights[f"w{k}"][j] for j in range(k))
                for p in range(len(own) + max(m.widths) - k + 1)
            ]
            tops.append(np.max(responses, axis=0) + m.weights[f"b{k}"])
        assert z[i] == pytest.approx(float(np.tanh(np.concatenate(tops)) @ m.weights["out"] + m.weights["bias"][0]), abs=1e-4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, m).collect()}
    assert scores[2] == scores[3] == scores[4] and all(0 <= s <= 1 for s in scores.values())


def test_toxicity_held_out_accuracy(spark, data):
    big = data.replace("sf0.001", "sf0.1")  # smaller tables have too few toxic texts to learn from
    labels = spark.read.parquet(f"{big}/labels.parquet")
    out = toxicity.query(spark, big).join(labels, "doc_id").where("held_out").toPandas()
    toxic = out.toxic == 1
    assert (out.predicted[toxic] == 1).mean() >= 0.9 and (out.predicted[~toxic] == 0).mean() >= 0.97


def test_toxicity_fits_within_its_bytes(spark):
    docs = spark.createDataFrame(
        [(i, f"{'bad' if i % 2 else 'good'} text {i} " * 20, "en") for i in range(200)],
        "doc_id long, text string, lang string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most_bytes=8000)
    got = toxicity.scored(docs, model).groupBy(F.col("doc_id") % 2).agg(F.avg("predicted")).collect()
    assert {r[0]: r[1] for r in got} == {0: 0.0, 1: 1.0}


def test_toxicity_learns_from_all_rows_and_judges_all(spark, monkeypatch):
    # Each bad word is in eight texts only, so what is seen of some kilobytes lacks most of them.
    rows = [(i, f"the text {i % 37} " * 8 + (f"bad{i // 2 % 50:02}x" if i % 2 else f"fine{i // 2 % 50:02}") + " is here" * 5, "en") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int")
    found, judged = toxicity.best_threshold, []

    def best(z, *kinds):
        judged.append([int(k.sum()) for k in kinds])
        return found(z, *kinds)

    monkeypatch.setattr(toxicity, "best_threshold", best)
    model = toxicity.fit(docs, labels, most_bytes=40_000)
    assert judged == [[400, 400], [400, 400]]  # all languages, then the only one
    got = toxicity.scored(docs, model).groupBy(F.col("doc_id") % 2).agg(F.avg("predicted")).collect()
    assert {r[0]: r[1] for r in got} == {0: 0.0, 1: 1.0}


def test_toxicity_by_shards_does_not_depend_on_partitions(spark):
    rows = [(i, f"{'bad' if i % 3 else 'good'} text {i} " * (i % 7), ["en", "fr", "de", None][i % 4]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, toxic int")
    a, b = (toxicity.fit(d, labels, epochs=2, most_bytes=3000, most_langs=2) for d in (docs, docs.repartition(7)))
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)
    assert np.array_equal(a.thresholds, b.thresholds) and np.array_equal(a.guess, b.guess)
    assert a.languages == ["", "de", None]


def test_networks_side_by_side_and_places_in_blocks(monkeypatch):
    models = [toxicity.Model() for _ in range(3)]
    for i, m in enumerate(models):
        m.start(i)
    w = W.split(["one two three four five " * 9, "one", "", "two one " * 5], W.NOT_TERM, lower=True)
    want = np.mean([m.logits(w)[0] for m in models], axis=0)
    assert toxicity.side_by_side(models).logits(w)[0] == pytest.approx(want, abs=1e-5)
    at, begin = models[0].padded(w.counts(), w.hash)
    x = np.random.default_rng(5).normal(size=(len(w.hash) + 1, 8)).astype(np.float32)
    whole = models[0].pooled(x, at, begin, where=True)
    monkeypatch.setattr(toxicity, "BLOCK", 5)
    assert all(np.array_equal(p, q) for p, q in zip(whole, models[0].pooled(x, at, begin, where=True), strict=True))


@pytest.mark.parametrize(("n", "sample", "parts"), [(3000, 10_000, None), (6000, 1200, 160)])
def test_nearest_recall_at_two_sizes_and_levels(spark, n, sample, parts):
    r = np.random.default_rng(n)
    centres = r.normal(size=(40, 24))
    x = centres[r.integers(0, 40, n)] + 0.5 * r.normal(size=(n, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())]  # a repeated id
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {
        q: g.sort_values("rank")
        for q, g in nearest.nearest(v, F.col("vec_id") % 100 == 0, sample=sample, parts=parts).toPandas().groupby("query_id")
    }
    hits = 0
    for q in range(0, n, 100):
        want = exact_nearest(x, q)
        found = list(dict.fromkeys(got[q].vec_id))
        assert len(got[q]) >= 20
        hits += len(set(want.tolist()) & set(found))
    assert hits >= 0.9 * 20 * (n // 100)
