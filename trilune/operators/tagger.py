"""A sequence tagger for entities, learned from what a pattern catalogue matches and decoded by Viterbi.

Tokens are runs of word characters and single other characters; a sentence ends at a line's end or at closing
punctuation before white space. Tags are O and, per type, B (first token) and I (further ones). A token's score for a tag
is the sum of the weights of its features: words and shapes of the token and its neighbours, and whether
it is glued to them; a tag's score also depends on the tag before it. Features are numbered by hash, so a model has a fixed size.

Weights come from a structured perceptron by iterated parameter mixing: the training sentences, a sample of bounded size, are
dealt to shards; in each round every shard goes once over its sentences from the common weights, in a task of its own,
and the common weights become the mean of all shards' averaged ones.

Null texts have no entities. Rows with the same key are each tagged. Equal scores go to the earlier tag.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.operators.kg import best_entities
from trilune.sources.tables import stored

TOKEN = re.compile(r"\w+|[^\w\s]")
SENTENCE_ENDS = r"(?<=[.!?。！？])\s+|\n+"
BITS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CLOSING = np.array([ord(c) for c in ".!?。！？"], np.uint32)
_KINDS = np.full(0x110000, -1, np.int8)  # of characters met so far


@dataclass
class Tagger:
    """Types in order, weights of features by tag, and of a tag by the one before it (the last row: at the start)."""

    types: list[str]
    emit: np.ndarray
    step: np.ndarray = field(repr=False)

    @classmethod
    def empty(cls, types: list[str]) -> Tagger:
        n = 1 + 2 * len(types)
        return cls(types, np.zeros((1 << BITS, n)), np.zeros((n + 1, n)))

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Tag scores of each token, from the numbers of its features."""
        out = np.zeros((len(features), self.emit.shape[1]))
        for column in features.T:
            out += self.emit[column]
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of sentences first[i] .. first[i + 1], all sentences at once, token after token."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        back = np.zeros(scores.shape, np.int16)
        best = np.zeros((len(size), scores.shape[1]))
        for at in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -at, "left"))  # sentences with a token here
            if at == 0:
                best[:n] = self.step[-1] + scores[start[:n]]
                continue
            if n < 64:  # fewer calls
                through = best[:n, :, None] + self.step[None, :-1]
                back[start[:n] + at] = through.argmax(axis=1)
                best[:n] = through.max(axis=1) + scores[start[:n] + at]
                continue
            top, by = best[:n, :1] + self.step[0], np.zeros((n, scores.shape[1]), np.int16)
            for tag in range(1, scores.shape[1]):  # equal scores: the earlier tag
                through = best[:n, tag : tag + 1] + self.step[tag]
                by[through > top] = tag
                np.maximum(top, through, out=top)
            back[start[:n] + at] = by
            best[:n] = top + scores[start[:n] + at]
        tags = np.zeros(len(scores), np.int16)
        now, live = best.argmax(axis=1), 0
        for at in range(int(size.max(initial=0)) - 1, -1, -1):
            n = int(np.searchsorted(-size, -at, "left"))  # those from `live` on end here
            where = start[:n] + at
            now[:live] = back[where[:live] + 1, now[:live]]
            tags[where] = now[:n]
            live = n
        return tags


@dataclass
class Tokens:
    """Tokens of some texts: places, sentences and features."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text each is of
    first: np.ndarray  # first[i] .. first[i + 1] are sentence i's
    features: np.ndarray


def shape(token: str) -> str:
    """Letters as x or X, digits as 9; of letters' runs the first three count, of digits' the first five."""
    if token.isalpha():  # most tokens: no capitals, or one at the beginning
        if token.islower():
            return "x" * min(len(token), 3)
        if token[0].isupper() and token[1:].islower():
            return "X" + "x" * min(len(token) - 1, 3)
    out = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token)
    return re.sub(r"9{6,}", "99999", re.sub(r"([^9])\1{3,}", r"\1\1\1", out))


def parts(token: str) -> tuple[int, int, int, int]:
    """Numbers of a token's word, shape, beginning and end."""
    low = token.lower()
    return _number(low), _number("shape " + shape(token)), _number("begins " + low[:2]), _number("ends " + low[-3:])


def _number(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) + 1


def character_kinds(text: np.ndarray) -> np.ndarray:
    """1 for word characters, 0 for white space, 2 for others, as TOKEN has them."""
    new = np.unique(text[_KINDS[text] < 0])
    _KINDS[new] = [1 if re.match(r"\w", chr(c)) else 0 if re.match(r"\s", chr(c)) else 2 for c in new.tolist()]
    return _KINDS[text]


def tokenized(texts: list[str | None], seen: dict | None = None) -> Tokens:
    """seen keeps the numbers of tokens from call to call; it is emptied when it has grown large.

    All texts' characters are one array, a line's end between them: what lies between two tokens is white space, and a sentence
    ends there if it holds a line's end or follows closing punctuation.
    """
    seen = {} if seen is None else seen
    if len(seen) > 200_000:
        seen.clear()
    joined = "\n".join(t or "" for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = character_kinds(code)
    word = np.concatenate([[False], kind == 1, [False]])
    other = np.concatenate([kind == 2, [False]])
    start = np.flatnonzero((word[1:] & ~word[:-1]) | other)
    end = np.where(other[start], start + 1, 0)
    end[~other[start]] = np.flatnonzero(word[:-1] & ~word[1:])
    tokens = [joined[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    place = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    for t in place:
        if t not in seen:
            seen[t] = parts(t)
    numbers = np.array([seen[t] for t in place], np.uint64).reshape(-1, 4)
    kinds = numbers[np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))]
    lines = np.concatenate([[0], np.cumsum(code == 10)])
    begins = np.ones(len(start), bool)
    gap = start[1:] > end[:-1]
    begins[1:] = (lines[start[1:]] > lines[end[:-1]]) | (gap & np.isin(code[end[:-1] - 1], _CLOSING))
    first = np.append(np.flatnonzero(begins), len(start)) if len(start) else np.array([0])
    offset = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    of = np.searchsorted(offset, start, "right") - 1
    return Tokens(start - offset[of], end - offset[of], of, first, features(kinds, start, end, first))


def features(kinds: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of each token's features; what lies outside its sentence counts as 0."""
    n = len(kinds)
    word, form, begins, ends = (np.ascontiguousarray(c) for c in kinds.T)
    sentence = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def beside(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        at = np.arange(max(0, -by), min(n, n - by))
        same = sentence[at] == sentence[at + by]
        out[at[same]] = x[at[same] + by]
        return out

    glued = np.zeros(n, np.uint64)
    glued[1:] = (start[1:] == end[:-1]) & (sentence[1:] == sentence[:-1])
    right = beside(glued, 1)
    both = np.uint64(2) * glued + right
    columns = [np.full(n, 1, np.uint64), word, form, form * np.uint64(4) + both, begins, ends, begins * np.uint64(7) + form]
    columns += [beside(word, by) for by in (-1, 1)] + [beside(form, by) for by in (-4, -3, -2, -1, 1, 2, 3, 4)]
    columns += [beside(form, -1) * np.uint64(3) + form, form * np.uint64(3) + beside(form, 1), beside(form, -1) * np.uint64(5) + beside(form, 1)]
    mixed = [(x * np.uint64(31) + np.uint64(slot + 1)) * _ODD for slot, x in enumerate(columns)]
    return np.stack([((x ^ (x >> np.uint64(29))) * _ODD >> np.uint64(64 - BITS)).astype(np.int32) for x in mixed], axis=1)


def matched(text: str, catalogue: list[tuple[str, re.Pattern]]) -> list[tuple[int, int, str]]:
    """Spans of the catalogue's matches: from the left, the longer first, none inside another."""
    found = sorted((m.start(), -m.end(), kind) for kind, p in catalogue for m in p.finditer(text) if m.end() > m.start())
    out, upto = [], 0
    for a, b, kind in found:
        if a >= upto:
            out.append((a, -b, kind))
            upto = -b
    return out


def gold_tags(tokens: Tokens, texts: list[str], types: list[str], catalogue: list[tuple[str, re.Pattern]]) -> np.ndarray:
    """Tags of tokens that overlap a match."""
    tags = np.zeros(len(tokens.start), np.int16)
    edge = np.searchsorted(tokens.text, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        a, b = edge[i], edge[i + 1]
        for low, high, kind in matched(text or "", catalogue):
            own = np.flatnonzero((tokens.end[a:b] > low) & (tokens.start[a:b] < high)) + a
            if len(own):
                tags[own] = 2 + 2 * types.index(kind)
                tags[own[0]] = 1 + 2 * types.index(kind)
    return tags


def spans(tags: np.ndarray, tokens: Tokens) -> list[tuple[int, int, int, int]]:
    """(text, start, end, type) of the tagged stretches; an I that continues no entity of its type begins one."""
    out: list[list[int]] = []
    first = np.zeros(len(tags) + 1, bool)
    first[tokens.first] = True
    last = -1
    for i in np.flatnonzero(tags):
        kind, begins = (int(tags[i]) - 1) // 2, int(tags[i]) % 2 == 1
        if begins or first[i] or last != i - 1 or out[-1][3] != kind:
            out.append([int(tokens.text[i]), int(tokens.start[i]), int(tokens.end[i]), kind])
        else:
            out[-1][2] = int(tokens.end[i])
        last = i
    return [tuple(x) for x in out]


def learn(tagger: Tagger, tokens: Tokens, gold: np.ndarray, rounds: int = 1) -> Tagger:
    """The averaged weights of a perceptron that goes over the sentences from the given ones."""
    now = Tagger(tagger.types, tagger.emit.copy(), tagger.step.copy())
    emit, step, turn = np.zeros_like(now.emit), np.zeros_like(now.step), 1
    n_tags = now.emit.shape[1]
    for _ in range(rounds):
        for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True):
            x, y = tokens.features[a:b], gold[a:b]
            z = now.decode(now.scores(x), np.array([0, b - a]))
            for at in np.flatnonzero(y != z):
                for tag, by in ((y[at], 1.0), (z[at], -1.0)):
                    np.add.at(now.emit[:, tag], x[at], by)
                    np.add.at(emit[:, tag], x[at], by * turn)
            if (y != z).any():
                for tags, by in ((y, 1.0), (z, -1.0)):
                    before = np.append(n_tags, tags[:-1])
                    np.add.at(now.step, (before, tags), by)
                    np.add.at(step, (before, tags), by * turn)
            turn += 1
    return Tagger(now.types, now.emit - emit / turn, now.step - step / turn)


def sentences_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, sentence)"""
    return docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), SENTENCE_ENDS)).alias("at", "sentence")).where("sentence <> ''")


def train(
    docs: DataFrame,
    catalogue: list[tuple[str, str]],
    key: str = "doc_id",
    text: str = "text",
    most: int = 4000,
    shards: int = 4,
    rounds: int = 8,
) -> Tagger:
    """A tagger from the matches of (type, pattern) in docs.

    It learns from about `most` sentences with a match and as many without, chosen by a hash of key and place.
    """
    types = sorted({kind for kind, _ in catalogue})
    hit = F.lit(False)
    for _, pattern in catalogue:
        hit = hit | F.col("sentence").rlike(pattern)
    rows = sentences_of(docs, key, text).withColumn("hit", hit).withColumn("h", F.xxhash64(F.lit("tagger"), "key", "at", "sentence"))
    n = {r.hit: r.n for r in rows.groupBy("hit").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("hit"), F.lit(min(1.0, most / max(1, n.get(True, 0))))).otherwise(F.lit(min(1.0, most / max(1, n.get(False, 0)))))
    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).orderBy("h").limit(4 * most)
    dealt = stored(chosen.select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "sentence"), "tagger")
    dealt = dealt.repartition(4 * shards, "shard")  # a stated number: small parts are not put together into one task
    patterns = [(kind, re.compile(p)) for kind, p in catalogue]

    def over(sent):
        def one(pdf):
            import pandas as pd

            texts = pdf.sort_values(["h", "sentence"])["sentence"].tolist()
            tokens = tokenized(texts)
            out = learn(sent.value, tokens, gold_tags(tokens, texts, types, patterns))
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "emit": [out.emit.tobytes()], "step": [out.step.tobytes()]})

        return one

    tagger = Tagger.empty(types)
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(tagger)  # of a fixed size

        found = sorted(dealt.groupBy("shard").applyInPandas(over(sent), "shard long, emit binary, step binary").collect())
        sent.destroy()
        if not found:
            break
        mean = lambda c, like: np.mean([np.frombuffer(r[c]).reshape(like.shape) for r in found], axis=0)
        tagger = Tagger(types, mean("emit", tagger.emit), mean("step", tagger.step))
    return tagger


def tagged(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, type, name, start) of the entities in each text; start counts characters from 0. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = docs.schema[key].dataType.simpleString()

    def tag(batches):
        import pyarrow as pa

        seen: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, own = part.column(1).to_pylist(), part.column(0)
                tokens = tokenized(texts, seen)
                tags = sent.value.decode(sent.value.scores(tokens.features), tokens.first)
                found = spans(tags, tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([sent.value.types[f[3]] for f in found], pa.string()),
                        pa.array([texts[f[0]][f[1] : f[2]] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.int32()),
                    ],
                    ["key", "type", "name", "start"],
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(tag, f"key {kind}, type string, name string, start int").withColumnRenamed("key", key)


def extracted(rules: DataFrame, found: DataFrame, stop: dict[str, list[str]], least: int = 2) -> DataFrame:
    """Entities by rules and by a tagger (both: doc, language, type, name), filtered alike; of one name, type and language the more certain, rules before tags."""
    from trilune.operators.extract import worthy

    both = rules.withColumn("confidence", F.lit(0.95)).unionByName(found.withColumn("confidence", F.lit(0.8)))
    return best_entities(worthy(both, stop, least).withColumn("ord", F.col("doc")))
