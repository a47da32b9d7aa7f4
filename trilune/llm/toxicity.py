"""Toxicity by a convolutional text classifier, trained on all labelled rows in rounds of Spark tasks.

A term's embedding is the sum of hashed rows for the whole term and its first bytes.
Filters of several widths run over the embeddings, each filter's largest response in
the whole text is kept, and a logistic layer weighs these. A linear guess of the text's language
from its own hashed terms picks the threshold, calibrated per language; scores are shifted so
that each language's threshold becomes `cut`. Languages with few labelled rows take the threshold of all.

Every labelled row trains and every one judges: rows are dealt to folds, and for each fold a network learns from all rows
of the other folds. The thresholds are those with the fewest errors on all rows, each judged by the network that has
not seen it. The networks are laid side by side as one, whose logit is the mean of theirs. Rows are dealt to
shards, too. In each round every shard goes over all its rows from the common weights, and what it changed is averaged,
for an embedding over the shards that met it. Changes are summed as whole numbers, so that no order of tasks
matters. Logits are counted in steps of 1 / STEPS; the thresholds are exact for these counts.

Only the text decides a score. Texts without words, null and empty ones among them, get the score of no response at
all, the same for each. Ties need no rule: equal texts have equal scores. Rows repeat and ids may be null; each row is scored. Without labelled rows of
both kinds every score is 0. Labels that contradict each other for an id count as toxic.
Very long texts are scored and learnt from whole, in slices of documents of about two megabytes and of
BLOCK places; the driver sees weights and counts of logits only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilune.llm import words as W
from trilune.llm.common import apart, dropped, fold, small_batches, table, with_facts, written

PREFIXES = (4, 5, 6)
#: Places whose responses are held at once, as fit a processor's cache; words that are judged at once.
BLOCK, MANY = 1 << 12, 1 << 18
#: Cells of logits per unit, and the logits that the outermost cells stand for.
STEPS, FAR = 256, 64
#: Changes of weights are summed in multiples of 1 / UNIT.
UNIT = float(1 << 32)
#: Embeddings that are summed up together.
SPAN = 1 << 11
#: Bytes of a term's rows.
TERM = 2 * (1 + len(PREFIXES))


@dataclass
class Model:
    rows: int = 1 << 15
    size: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    cut: float = 0.7
    weights: dict = field(default_factory=dict)
    languages: list = field(default_factory=list)
    guess: np.ndarray | None = None  # language x row log weights
    thresholds: np.ndarray | None = None

    def start(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.weights = {
            "e": r.normal(0, 0.05, (self.rows + 1, self.size)).astype(np.float32),
            "out": r.normal(0, 0.3, len(self.widths) * self.filters),
            "bias": np.zeros(1),
        }
        self.weights["e"][-1] = 0  # the blank around texts
        for k in self.widths:
            self.weights[f"w{k}"] = r.normal(0, 0.5 / np.sqrt(k), (k, self.size, self.filters))
            self.weights[f"b{k}"] = np.zeros(self.filters)

    def features(self, w: W.Words) -> np.ndarray:
        m = np.uint64(self.rows)
        return np.stack([w.hash % m, *(w.prefix(n) % m for n in PREFIXES)], axis=1).astype(np.int32)

    def padded(self, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers with blanks after each text for the widest filter, and where texts begin."""
        gap = max(self.widths)
        begin = np.cumsum(counts + gap) - counts - gap
        out = np.full(int((counts + gap).sum()) + gap, len(rows), np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        out[np.arange(int(counts.sum())) + gap * text] = np.arange(int(counts.sum()))
        return out, begin

    def pooled(self, x: np.ndarray, at: np.ndarray, begin: np.ndarray, where: bool = False):
        """Largest response of each filter in each text, narrow filters first, and `where` asked its first place: over the distinct terms' embeddings x, at their places."""
        n, most = len(at) - max(self.widths), max(self.widths)
        ends = np.append(begin[1:], n)
        wider = [[k for k in self.widths if k > j] for j in range(most)]  # widths ascend
        parts = [x @ np.concatenate([self.weights[f"w{k}"][j] for k in wider[j]], axis=1).astype(np.float32) for j in range(most)]
        skip = [(len(self.widths) - len(k)) * self.filters for k in wider]
        top = np.full((len(begin), len(self.widths) * self.filters), -np.inf, np.float32)
        found = np.full(top.shape, n, np.int64)
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            z = parts[0].take(at[lo:hi], axis=0)
            for j in range(1, most):
                z[:, skip[j] :] += parts[j].take(at[lo + j : hi + j], axis=0)
            for j in range(1, most):
                out = ends - j  # these would reach into the next text
                z[out[(out >= lo) & (out < hi)] - lo, skip[j] :] = -np.inf
            a, b = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi)
            first = np.maximum(begin[a:b], lo) - lo
            best = np.maximum.reduceat(z, first, axis=0)
            if where:
                last = np.append(first[1:], hi - lo)
                place = np.stack([z[i:j].argmax(axis=0) + i + lo for i, j in zip(first, last, strict=True)])
                found[a:b] = np.where(best > top[a:b], place, found[a:b])
            top[a:b] = np.maximum(top[a:b], best)
        return (top, found) if where else top

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        e = self.weights["e"]
        out = np.zeros((len(rows) + 1, self.size), np.float32)
        for r in rows.T:
            out[:-1] += e.take(r, axis=0)
        return out

    def dense(self) -> list[str]:
        return ["out", "bias"] + [f"{c}{k}" for k in self.widths for c in "wb"]

    def fresh(self) -> dict:
        """What the rounds hand on besides the weights: of embeddings the sum of squares, of others two moments and the steps."""
        size = sum(self.weights[k].size for k in self.dense())
        return {"e2": np.full(self.rows + 1, 1e-8), "m1": np.zeros(size), "m2": np.zeros(size), "step": np.zeros(1)}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in self.dense()])

    def unflat(self, values: np.ndarray) -> dict:
        out, at = {}, 0
        for k in self.dense():
            w = self.weights[k]
            out[k] = values[at : at + w.size].reshape(w.shape).copy()
            at += w.size
        return out

    def learn(
        self,
        state: dict,
        rows: np.ndarray,
        number: np.ndarray,
        counts: np.ndarray,
        y: np.ndarray,
        order: np.ndarray,
        batch: int = 32,
        rate: float = 0.02,
        decay: float = 1e-5,
    ) -> tuple[np.ndarray, float]:
        """Goes once over the texts in the given order, and changes weights and state; which embeddings it met, and the sum of losses.

        There are the distinct terms' rows, and the number of each word's term among these.
        """
        p = self.weights
        m1, m2, e2, step = self.unflat(state["m1"]), self.unflat(state["m2"]), state["e2"], int(state["step"][0])
        met, seen, place = np.zeros(self.rows + 1, bool), np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        first, loss = np.append(0, np.cumsum(counts)), 0.0
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            ids = np.concatenate([number[first[i] : first[i + 1]] for i in some])
            if not len(ids):
                continue
            seen[ids] = True
            here = np.flatnonzero(seen)
            seen[here] = False
            place[here] = np.arange(len(here))
            own = rows.take(here, axis=0)
            at, begin = self.padded(counts[some], ids)
            at = np.append(place.take(ids), len(own)).take(at)
            x = self.embedded(own)
            tops, places = self.pooled(x, at, begin, where=True)
            h = np.tanh(tops + np.concatenate([p[f"b{k}"] for k in self.widths]))
            chance = 1 / (1 + np.exp(-np.clip(h @ p["out"] + p["bias"][0], -500, 500)))
            loss -= np.log(np.maximum(np.where(y[some] == 1, chance, 1 - chance), 1e-9)).sum()
            g = (chance - y[some]) / len(some)
            grads = {"out": h.T @ g + decay * p["out"], "bias": np.array([g.sum()])}
            back = np.outer(g, p["out"]) * (1 - h * h)
            rows_hit, rows_grad = [], []
            for i, k in enumerate(self.widths):
                gk = back[:, i * self.filters : (i + 1) * self.filters]
                grads[f"b{k}"] = gk.sum(axis=0)
                grads[f"w{k}"] = decay * p[f"w{k}"]
                t, f = np.divmod(np.arange(gk.size), self.filters)
                spot = places[:, i * self.filters : (i + 1) * self.filters].ravel()
                for j in range(k):
                    term = at[spot + j]
                    grads[f"w{k}"][j] += np.einsum("tfs,tf->sf", x[term].reshape(*gk.shape, self.size), gk)
                    real = term < len(own)
                    rows_hit.append(own[term[real]])
                    rows_grad.append(gk[t[real], f[real]][:, None] * p[f"w{k}"][j].T[f[real]])
            hit = np.concatenate(rows_hit)
            grad = np.repeat(np.concatenate(rows_grad), hit.shape[1], axis=0)
            u, inverse = np.unique(hit.ravel(), return_inverse=True)
            total = np.stack([np.bincount(inverse, g, len(u)) for g in grad.T], axis=1)
            met[u] = True
            e2[u] += (total**2).mean(axis=1)
            p["e"][u] -= 5 * rate * total / np.sqrt(e2[u])[:, None]
            step += 1
            for k, q in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * q
                m2[k] = 0.99 * m2[k] + 0.01 * q * q
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        for name, m in (("m1", m1), ("m2", m2)):
            state[name] = np.concatenate([m[k].ravel() for k in self.dense()])
        state["step"] = np.array([float(step)])
        return met, loss

    def judged(self, rows: np.ndarray, number: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Logit of each text, of distinct terms' rows and the number of each word's term among these."""
        at, begin = self.padded(counts, number)
        at = np.append(number, len(rows)).take(at)
        tops = self.pooled(self.embedded(rows), at, begin)
        h = np.tanh(tops + np.concatenate([self.weights[f"b{k}"] for k in self.widths]))
        return h @ self.weights["out"] + self.weights["bias"][0]

    def guessed(self, first: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Language of each text, of each word's own row and text; 0 if none is known."""
        if self.guess is None or len(self.languages) < 2:
            return np.zeros(texts, int)
        return np.argmax([np.bincount(text, g[first], texts) for g in self.guess], axis=0)

    def logits(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language (0 if none is known) of each text."""
        _, pick, number = np.unique(w.hash, return_index=True, return_inverse=True)
        rows = self.features(W.Words(w.buffer, w.start[pick], w.end[pick], w.doc, w.first, w.hash[pick]))
        return self.judged(rows, number, w.counts()), self.guessed(rows[number, 0], w.doc, len(w.counts()))

    def scores(self, w: W.Words) -> np.ndarray:
        z, language = self.logits(w)
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds[language] + np.log(self.cut / (1 - self.cut)), -500, 500)))


def best_threshold(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The point with fewest errors, in the middle of its gap, for logits z in ascending order and the rows of either kind there."""
    errors = np.append(0, np.cumsum(toxic)) + np.append(np.cumsum(clean[::-1])[::-1], 0)
    low = np.flatnonzero(errors == errors.min())
    at = low[len(low) // 2]
    left, right = z[max(at - 1, 0)], z[min(at, len(z) - 1)]
    return float((left + right) / 2)


def side_by_side(models: list[Model]) -> Model:
    """The network whose logit is the mean of the networks' logits."""
    one, n = models[0], len(models)
    both = Model(one.rows, one.size * n, one.filters * n, one.widths, one.cut)
    w = [m.weights for m in models]
    out = [x["out"].reshape(len(one.widths), -1) for x in w]
    both.weights = {
        "e": np.concatenate([x["e"] for x in w], axis=1),
        "out": np.concatenate(out, axis=1).ravel() / n,
        "bias": sum(x["bias"] for x in w) / n,
    }
    for k in one.widths:
        wide = np.zeros((k, both.size, both.filters))
        for i, x in enumerate(w):
            wide[:, i * one.size : (i + 1) * one.size, i * one.filters : (i + 1) * one.filters] = x[f"w{k}"]
        both.weights |= {f"w{k}": wide, f"b{k}": np.concatenate([x[f"b{k}"] for x in w])}
    return both


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, label: str) -> DataFrame:
    """A written row per labelled id that has a document: hash, label, language, bytes and the terms. Of several rows of one id the least by text and language counts."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = written(spark, known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_y")), "labels")
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    rows = with_facts(plain.where("_key is not null"), known, ["_key"], 12)
    rows = rows.groupBy("_key", "_y").agg(F.min(F.struct("_text", "_lang")).alias("_row"))
    rows = rows.select(
        F.xxhash64(F.lit("fit"), "_key").alias("hash"),
        F.col("_y").alias("y"),
        F.coalesce("_row._lang", F.lit("")).alias("lang"),
        F.coalesce(F.octet_length("_row._text"), F.lit(0)).cast("long").alias("bytes"),
        F.col("_row._text").alias("_text"),
    )
    small_batches(spark)

    def terms(batches):
        import pyarrow as pa

        m = Model()
        for batch in batches:
            own, words, count = [], [], []
            for a, b, w in W.chunks(batch.column(4), W.NOT_TERM, lower=True, most_bytes=2 << 20):
                for i in range(b - a):
                    part = slice(w.first[i], w.first[i + 1])
                    _, pick, number = np.unique(w.hash[part], return_index=True, return_inverse=True)
                    pick = pick + w.first[i]
                    distinct = W.Words(w.buffer, w.start[pick], w.end[pick], w.doc, w.first, w.hash[pick])
                    own.append(m.features(distinct).astype(np.uint16).tobytes())
                    words.append(number.astype(np.uint16 if len(pick) <= 1 << 16 else np.uint32).tobytes())
                    count.append(len(number))
            added = [pa.array(own, pa.binary()), pa.array(words, pa.binary()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *added], names=["hash", "y", "lang", "bytes", "terms", "words", "count"])

    schema = "hash long, y int, lang string, bytes long, terms binary, words binary, count long"
    out = written(spark, rows.mapInArrow(terms, schema), "examples")
    dropped(known)
    return out


def in_shards(found: DataFrame, folds: int, shards: int, names: list[str]) -> DataFrame:
    """A written row per shard, with all its texts in order of their hashes. A language that names lack is one beyond them."""

    def pack(pdf):
        import pandas as pd

        pdf = pdf.sort_values("hash")
        place = {n: i for i, n in enumerate(names)}
        sizes = pdf["terms"].str.len().to_numpy(np.int64) // TERM
        words = [np.frombuffer(w, f"u{len(w) // max(n, 1) or 2}") for w, n in zip(pdf["words"], pdf["count"], strict=True)]
        words = [w.astype(np.uint32) + np.uint32(i) for w, i in zip(words, np.cumsum(sizes) - sizes, strict=True)]
        # Terms with the same rows are one: they have one embedding.
        rows, number = np.unique(np.frombuffer(b"".join(pdf["terms"]), np.uint64), return_inverse=True)
        columns = {
            "rows": rows.tobytes(),
            "number": number.astype(np.uint32)[np.concatenate(words)].tobytes(),
            "counts": pdf["count"].to_numpy(np.int64).tobytes(),
            "y": pdf["y"].to_numpy(np.float64).tobytes(),
            "lang": np.array([place.get(x, len(names)) for x in pdf["lang"]], np.int64).tobytes(),
            "fold": pdf["fold"].to_numpy(np.int64).tobytes(),
        }
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy()} | {k: [v] for k, v in columns.items()})

    dealt = found.withColumn("fold", F.pmod("hash", F.lit(folds))).withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)))
    schema = "shard long, rows binary, number binary, counts binary, y binary, lang binary, fold binary"
    return written(found.sparkSession, dealt.groupBy("shard").applyInPandas(pack, schema), "shards")


def shards_of(batches):
    """Shard, terms' rows, number of each word's term, and of each text the count of words, label, language and fold."""
    kinds = (np.uint16, np.uint32, np.int64, np.float64, np.int64, np.int64)
    for batch in batches:
        for i in range(len(batch)):
            shard, *data = (batch.column(c)[i] for c in range(7))
            rows, *rest = (np.frombuffer(d.as_buffer(), t) for d, t in zip(data, kinds, strict=True))
            yield shard.as_py(), rows.reshape(-1, 1 + len(PREFIXES)).astype(np.int32), *rest


def summed(parts: DataFrame) -> dict:
    """Sums of whole numbers by network and block, of rows as SUMS."""

    def add(pdf):
        import pandas as pd

        total = np.sum([np.frombuffer(v, np.int64) for v in pdf["sums"]], axis=0)
        return pd.DataFrame({"net": pdf["net"].iloc[:1].to_numpy(), "block": pdf["block"].iloc[:1].to_numpy(), "sums": [total.tobytes()]})

    return {(r.net, r.block): np.frombuffer(r.sums, np.int64) for r in parts.groupBy("net", "block").applyInPandas(add, SUMS).collect()}


#: What a task of a round gives: sums for a network's embeddings from block * SPAN on, or in block -1 for all its other weights.
SUMS = "net int, block int, sums binary"


def sums_batch(found: dict):
    import pyarrow as pa

    columns = [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["net", "block", "sums"])


def one_round(shards: DataFrame, models: list[Model], states: list[dict], turn: int, seed: int) -> float:
    """Every shard learns from the common weights; these become the means of what the shards made of them. The mean loss of a row, before each step."""
    sc = shards.sparkSession.sparkContext
    sent = sc.broadcast((models, states))  # of a fixed size

    def learn(batches):
        import copy

        total = {}
        for shard, rows, number, counts, y, _, fold_of in shards_of(batches):
            for net, (before, old) in enumerate(zip(*sent.value, strict=True)):
                m, state = copy.deepcopy(before), copy.deepcopy(old)
                others = np.flatnonzero(fold_of != net) if len(sent.value[0]) > 1 else np.arange(len(y))
                order = np.random.default_rng([seed, turn, shard, net]).permutation(others)
                met, loss = m.learn(state, rows, number, counts, y, order)
                change = np.column_stack([m.weights["e"] - before.weights["e"], state["e2"] - old["e2"]])
                change = np.column_stack([np.rint(change * UNIT).astype(np.int64), met.astype(np.int64)])
                rest = np.concatenate([m.flat() - before.flat(), *(state[k] - old[k] for k in ("m1", "m2", "step"))])
                parts = {(net, -1): np.append(np.rint(np.append(rest, loss) * UNIT).astype(np.int64), [int(len(order) > 0), len(order)])}
                parts |= {(net, i): change[i * SPAN : (i + 1) * SPAN].ravel() for i in range(-(-len(change) // SPAN))}
                for k, v in parts.items():
                    total[k] = total[k] + v if k in total else v
        if total:
            yield sums_batch(total)

    found = summed(shards.mapInArrow(learn, SUMS))
    losses = np.zeros(len(models))
    for net, (m, state) in enumerate(zip(models, states, strict=True)):
        width = m.size + 2
        change = np.concatenate([found[net, i].reshape(-1, width) for i in range(-(-(m.rows + 1) // SPAN))])
        mean = change[:, :-1] / np.maximum(change[:, -1:], 1) / UNIT
        m.weights["e"] = m.weights["e"] + mean[:, : m.size]
        state["e2"] = state["e2"] + mean[:, m.size]
        *others, lost, with_rows, rows = found[net, -1]
        others, losses[net] = np.array(others) / max(with_rows, 1) / UNIT, lost / UNIT / max(rows, 1)
        size = len(state["m1"])
        m.weights |= m.unflat(m.flat() + others[:size])
        state["m1"], state["m2"] = state["m1"] + others[size : 2 * size], np.maximum(state["m2"] + others[2 * size : 3 * size], 0)
        state["step"] = np.rint(state["step"] + others[3 * size :])
    sent.destroy()
    return float(losses.mean())


def language_weights(shards: DataFrame, languages: int, rows: int) -> np.ndarray:
    """Language x row log weights, from the words of all texts."""

    def count(batches):
        total = {}
        for _, own, number, counts, _, lang, _ in shards_of(batches):
            first, of = own[number, 0], np.repeat(lang, counts)
            for i in np.unique(lang):
                total[0, int(i)] = total.get((0, int(i)), 0) + np.bincount(first[of == i], minlength=rows)
        if total:
            yield sums_batch(total)

    found = summed(shards.mapInArrow(count, SUMS))
    use = np.stack([found.get((0, i), np.zeros(rows)) for i in range(languages)]) + 0.05
    return np.log(use / use.sum(axis=1, keepdims=True))


def thresholds(shards: DataFrame, models: list[Model]) -> np.ndarray:
    """Of each language the point with fewest errors on all rows, each judged by the network of its fold."""
    sc = shards.sparkSession.sparkContext
    sent = sc.broadcast(models)  # of a fixed size

    def judge(batches):
        import pyarrow as pa

        for _, rows, number, counts, y, _, fold_of in shards_of(batches):
            first = np.append(0, np.cumsum(counts))
            for a, b in W.slices(first, MANY):
                here, at = np.unique(number[first[a] : first[b]], return_inverse=True)
                own = rows[here]
                z = np.stack([m.judged(own, at, counts[a:b]) for m in sent.value])[fold_of[a:b], np.arange(b - a)]
                cell = np.rint(np.clip(z, -FAR, FAR) * STEPS).astype(np.int64)
                language = sent.value[0].guessed(own[at, 0], np.repeat(np.arange(b - a), counts[a:b]), b - a)
                columns = [language, cell, (y[a:b] == 0).astype(np.int64), (y[a:b] == 1).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["language", "cell", "clean", "toxic"])

    found = shards.mapInArrow(judge, "language long, cell long, clean long, toxic long")
    found = found.groupBy("language", "cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Languages x cells at most, whatever the rows.
    language, cell, clean, toxic = (np.asarray(c) for c in found.orderBy("cell").toArrow().columns)
    sent.destroy()
    cells, inverse = np.unique(cell, return_inverse=True)
    overall = best_threshold(cells / STEPS, *(np.bincount(inverse, x, len(cells)) for x in (clean, toxic)))
    out = np.full(len(models[0].languages), overall)
    for i in range(len(out)):
        own = language == i
        if min(clean[own].sum(), toxic[own].sum()) >= 20:
            out[i] = best_threshold(cell[own] / STEPS, clean[own], toxic[own])
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
    cut: float = 0.7,
    epochs: int = 8,
    enough: float = 0.002,
    most_bytes: int = 16 << 20,
    most_langs: int = 64,
    folds: int = 4,
    seed: int = 7,
) -> Model | None:
    """A model from all labelled rows; None without both kinds. Labels other than 0 and 1 and null ids teach nothing.

    There are `epochs` rounds at most, each over all rows; none follows one whose mean loss of a row, before it was learnt from in that round, was below `enough`.
    A shard has texts of about `most_bytes`, and one text at least. The `most_langs` languages with the most rows are told apart, all others are one more.
    """
    found = examples(docs, labels, key, text, lang, label)
    part = F.pmod("hash", F.lit(folds))
    facts = found.groupBy(part.alias("part"), "y").agg(F.sum("bytes").alias("bytes")).collect()  # folds x 2 rows at most
    if len({r.y for r in facts}) < 2:
        dropped(found)
        return None
    if len(facts) < 2 * folds:
        folds = 1  # a fold lacks a kind: one network learns from all rows and is judged on them
    by_lang = found.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs + 1)
    names = [r.lang for r in by_lang.collect()]
    rest, names = len(names) > most_langs, sorted(names[:most_langs])
    shards = in_shards(found, folds, max(1, -(-sum(r.bytes for r in facts) // most_bytes)), names)
    dropped(found)
    models = [Model(cut=cut, languages=names + [None] * rest) for _ in range(folds)]
    for m in models:
        m.start(seed)
    states = [m.fresh() for m in models]
    for turn in range(epochs):
        if one_round(shards, models, states, turn, seed) < enough:
            break
    guess = language_weights(shards, len(models[0].languages), models[0].rows)
    for m in models:
        m.guess = guess
    out = side_by_side(models)
    out.languages, out.guess, out.thresholds = models[0].languages, guess, thresholds(shards, models)
    dropped(shards)
    return out


def scored(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of each row of docs, then score and predicted, which replace columns of these names. No shuffle."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    cut = F.lit(0.7 if model is None else model.cut)
    if model is None:
        return docs.select(*kept).withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def judge(batches):
        import pyarrow as pa

        m = sent.value
        for batch in batches:
            score = np.empty(len(batch))
            for a, b, w in W.chunks(batch.column(len(kept)), W.NOT_TERM, lower=True, most_bytes=2 << 20):
                score[a:b] = m.scores(w)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(score)], names=[*kept, "score"])

    rows = docs.select(*kept, F.col(text).alias("_text"))
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(judge, schema).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model | None:
    """The model of the contract: labels of ids whose crc32 mod 3 is 1 are never seen."""
    return fit(docs, table(spark, sf_dir, "labels").where(~fold(F.col("doc_id"), 3, 1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(spark, docs, sf_dir), keep=["doc_id"]).select(
        "doc_id",
        fold(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        "predicted",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected."""
    model = trained(spark, docs, sf_dir)
    return apart(docs, lambda own: scored(own, model).where("predicted = 0"), "doc_id", "text")
