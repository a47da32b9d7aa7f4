"""Names found in texts by an Aho-Corasick automaton, and texts translated by a dictionary of names.

Names are dealt by hash to as many groups as keep each one's automaton below `most_chars` characters; every automaton is
built in a task of its own and kept as a row of a table. The texts are passed once for each automaton, which is
sent alone, so neither driver nor tasks ever hold the whole dictionary. In a pass, a batch's characters
are one array, cut into lanes that are walked abreast: a lane starts as many characters early as the longest name
has, so that it is in the right state where it begins.

Names and texts are compared in lower case. With `whole`, a match begins and ends where words do. Null and empty names match
nothing, null texts hold nothing. Several ids of one name are all found. Rows with the same key are each searched.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilune.sources.tables import stored

#: Characters of names in one automaton, and characters that a lane walks.
MOST_CHARS, LANE = 200_000, 512
#: Cells of an automaton's whole table of transitions; larger ones are walked by edges and fail links.
MOST_CELLS = 16_000_000
_GAP = 0x10FFFF + 1  # stands between texts; no character


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Automaton:
    """Edges as sorted numbers state * width + class with their targets; fail links; per state the length of the name that ends there, and the next state on the fail path where one does."""

    chars: np.ndarray
    width: int
    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    length: np.ndarray
    ending: np.ndarray

    @classmethod
    def of(cls, names: list[str]) -> Automaton:
        chars = np.unique(np.concatenate([codes(n) for n in names if n] or [np.zeros(0, np.uint32)]))
        width = len(chars) + 1
        children: list[dict[int, int]] = [{}]
        length = [0]
        for name in names:
            at = 0
            for c in (np.searchsorted(chars, codes(name)) + 1).tolist() if name else []:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    length.append(0)
                at = children[at][c]
            if at:
                length[at] = len(codes(name))
        fail, ending = [0] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for state in level:
                for c, child in children[state].items():
                    if state:
                        back = fail[state]
                        while back and c not in children[back]:
                            back = fail[back]
                        fail[child] = children[back].get(c, 0)
                    ending[child] = child if length[child] else ending[fail[child]]
                    below.append(child)
            level = below
        edges = sorted((state * width + c, child) for state, own in enumerate(children) for c, child in own.items())
        keys, targets = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        return cls(chars, width, keys, targets, *(np.array(x, np.int64) for x in (fail, length, ending)))

    def walk(self, text: np.ndarray) -> np.ndarray:
        """The state after each character."""
        out = np.zeros(len(text), np.int64)
        if not len(text) or not len(self.keys):
            return out
        kind = self.kinds(text)
        table = self.table() if len(self.fail) * self.width <= MOST_CELLS else None
        early = int(self.length.max()) - 1
        begin = np.arange(0, len(text), LANE)
        state = np.zeros(len(begin), np.int64)
        for by in range(-early, LANE):
            at = begin + by
            live = np.flatnonzero((at >= 0) & (at < len(text)))
            state[live] = self.after(state[live], kind[at[live]]) if table is None else table[state[live] * self.width + kind[at[live]]]
            if by >= 0:
                out[at[live]] = state[live]
        return out

    def kinds(self, text: np.ndarray) -> np.ndarray:
        """The class of each character, 0 for those that no name has."""
        if (of := self.__dict__.get("_kinds")) is None:
            of = np.zeros(_GAP + 1, np.int32)
            of[self.chars] = np.arange(1, len(self.chars) + 1)
            self.__dict__["_kinds"] = of
        return of[text]

    def table(self) -> np.ndarray:
        """The state after each state and class, fail links followed; made once in a process."""
        if (out := self.__dict__.get("_table")) is None:
            out = np.zeros((len(self.fail), self.width), np.int32)
            source, kind = np.divmod(self.keys, self.width)
            order = np.argsort(source, kind="stable")
            first = np.searchsorted(source[order], np.arange(len(self.fail) + 1))
            level = np.zeros(1, np.int64)
            while len(level):
                out[level] = out[self.fail[level]]
                n = first[level + 1] - first[level]
                own = order[np.repeat(first[level] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                out[source[own], kind[own]] = self.targets[own]
                level = self.targets[own]
            self.__dict__["_table"] = out = out.ravel()
        return out

    def after(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        todo = np.flatnonzero(kind > 0)
        now = state[todo]
        while len(todo):
            key = now * self.width + kind[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            has = self.keys[at] == key
            out[todo[has]] = self.targets[at[has]]
            on = ~has & (now > 0)
            todo, now = todo[on], self.fail[now[on]]
        return out

    def found(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all occurrences of names."""
        state = self.ending[self.walk(text)]
        end = np.flatnonzero(state) + 1
        state = state[end - 1]
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(end):
            starts.append(end - self.length[state])
            ends.append(end)
            state = self.ending[self.fail[state]]
            end, state = end[state > 0], state[state > 0]
        return np.concatenate(starts), np.concatenate(ends)


    def held(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each name that texts first[i] .. first[i + 1] hold, once for a text: the texts, and a start and an end of one occurrence."""
        state = self.ending[self.walk(text)]
        end = np.flatnonzero(state) + 1
        of, state = np.searchsorted(first, end - 1, "right") - 1, state[end - 1]
        seen = np.zeros(0, np.int64)
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        while len(end):
            both, at = np.unique(of * len(self.fail) + state, return_index=True)
            at = at[~np.isin(both, seen, assume_unique=True)]
            of, state, end = of[at], state[at], end[at]
            seen = np.concatenate([seen, of * len(self.fail) + state])
            for o, x in zip(out, (of, end - self.length[state], end), strict=True):
                o.append(x)
            state = self.ending[self.fail[state]]
            on = state > 0
            of, state, end = of[on], state[on], end[on]
        return tuple(np.concatenate(o) for o in out)


def word_characters(text: np.ndarray) -> np.ndarray:
    """Letters, digits and underscores."""
    kinds, at = np.unique(text, return_inverse=True)
    return np.array([c < _GAP and (chr(c).isalnum() or c == 95) for c in kinds.tolist()], bool)[at]


def occurrences_in(texts: list[str | None], automaton: Automaton, whole: bool) -> list[list[tuple[int, int]]]:
    """For each text, the places of names in order: from the left, the longer first."""
    parts = [codes(t or "") for t in texts]
    gap = np.array([_GAP], np.uint32)
    joined = np.concatenate([x for p in parts for x in (p, gap)] or [gap])
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    start, end = automaton.found(joined)
    if whole:
        inside = word_characters(joined)
        open_ = (start > 0) & inside[np.maximum(start - 1, 0)] & inside[start]
        shut = inside[np.minimum(end, len(inside) - 1)] & inside[end - 1]
        start, end = start[~(open_ | shut)], end[~(open_ | shut)]
    order = np.lexsort((-end, start))
    start, end = start[order], end[order]
    of = np.searchsorted(first, start, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, a, b in zip(of.tolist(), start.tolist(), end.tolist(), strict=True):
        out[i].append((a - int(first[i]), b - int(first[i])))
    return out


def names_in(texts: list[str | None], automaton: Automaton, whole: bool) -> list[list[tuple[int, int]]]:
    """For each text, a place of each name that it holds."""
    if whole:
        places = occurrences_in(texts, automaton, whole)
        return [list({(t or "")[a:b]: (a, b) for a, b in p}.values()) for t, p in zip(texts, places, strict=True)]
    parts = [codes(t or "") for t in texts]
    gap = np.array([_GAP], np.uint32)
    joined = np.concatenate([x for p in parts for x in (p, gap)] or [gap])
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    of, start, end = automaton.held(joined, first)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, a, b in zip(of.tolist(), (start - first[of]).tolist(), (end - first[of]).tolist(), strict=True):
        out[i].append((a, b))
    return out


def automata(names: DataFrame, name: str = "name", most_chars: int = MOST_CHARS) -> DataFrame:
    """(part, automaton): a table with one row per group of names."""
    distinct = names.select(F.lower(name).alias("name")).where("name <> ''").distinct()
    distinct = stored(distinct, "names")
    total = distinct.agg(F.sum(F.length("name"))).first()[0] or 0
    parts = max(1, -(-int(total) // most_chars))

    def build(pdf):
        import pandas as pd

        made = Automaton.of(sorted(pdf["name"]))
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "automaton": [pickle.dumps(made)]})

    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    return stored(dealt.groupBy("part").applyInPandas(build, "part long, automaton binary"), "automata")


def mentions(
    texts: DataFrame,
    text: str,
    names: DataFrame,
    name: str = "name",
    whole: bool = True,
    most_chars: int = MOST_CHARS,
    keep: list[str] | None = None,
    once: bool = False,
) -> DataFrame:
    """(the columns `keep` of texts (all), found, start, end): every occurrence of a name; the name in lower case, places in characters from 0. With `once`, one occurrence of each name in a text."""
    made = automata(names, name, most_chars)
    kept = texts.columns if keep is None else keep
    rows = texts.select(*kept, F.lower(text).alias("_lower"))
    schema = texts.select(*kept).withColumns({"found": F.lit(""), "start": F.lit(0), "end": F.lit(0)}).schema
    out = None
    for part in [r.part for r in made.select("part").orderBy("part").collect()]:  # one number per automaton
        one = pickle.loads(made.where(F.col("part") == part).first().automaton)
        sent = texts.sparkSession.sparkContext.broadcast(one)

        def search(batches, sent=sent):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    lower = piece.column(len(kept)).to_pylist()
                    places = (names_in if once else occurrences_in)(lower, sent.value, whole)
                    take = pa.array([i for i, p in enumerate(places) for _ in p], pa.int64())
                    spans = [(lower[i][a:b], a, b) for i, p in enumerate(places) for a, b in p]
                    columns = [piece.column(i).take(take) for i in range(len(kept))]
                    ends = [pa.array([s[i] for s in spans], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*columns, *ends], schema.names)

        found = stored(rows.mapInArrow(search, schema), "mentions")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def longest(found: DataFrame, row: str) -> DataFrame:
    """Of the occurrences in a row, from the left the longest that begins after the last one's end. Streams sorted rows: nothing is held."""
    sorted_ = found.repartition(row).sortWithinPartitions(row, "start", F.desc("end"))
    at = {c: i for i, c in enumerate(found.columns)}

    def leftmost(batches):
        import pyarrow as pa

        now, upto = None, 0
        for batch in batches:
            keep = []
            columns = [batch.column(at[c]).to_pylist() for c in (row, "start", "end")]
            for i, (key, start, end) in enumerate(zip(*columns, strict=True)):
                if key != now:
                    now, upto = key, 0
                if start >= upto:
                    keep.append(i)
                    upto = end
            yield batch.take(pa.array(keep, pa.int64()))

    return sorted_.mapInArrow(leftmost, found.schema)


def translated(
    texts: DataFrame,
    key: str,
    text: str,
    pairs: DataFrame,
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """(key, translated, n_translated): the text in lower case, each name of `pairs` (name, target) in it by its target, the longest from the left; what has none stays.

    Of several targets of a name the first in order of text counts. A null text stays null.
    """
    pairs = pairs.select(F.lower("name").alias("found"), "target").where("found <> '' and target is not null")
    best = stored(pairs.groupBy("found").agg(F.min("target").alias("target")), "pairs")
    rows = stored(texts.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()), "texts")
    places = longest(mentions(rows, "_text", best, "found", True, most_chars, ["_row"]), "_row")
    told = places.join(best, "found").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "target"))).alias("_at"))
    both = rows.join(told, "_row", "left")
    # What lies between the names, and their targets, from the left.
    begin = F.concat(F.array(F.lit(0)), F.transform("_at", lambda p: p["end"]))
    stop = F.concat(F.transform("_at", lambda p: p["start"]), F.array(F.length("_text")))
    between = F.zip_with(begin, stop, lambda a, b: F.substring(F.col("_text"), a + 1, b - a))
    pieces = F.zip_with(between, F.concat(F.transform("_at", lambda p: p["target"]), F.array(F.lit(""))), lambda x, y: F.concat(x, y))
    return both.select(
        F.col("_key").alias(key),
        F.when(F.col("_at").isNull(), F.col("_text")).otherwise(F.array_join(pieces, "")).alias("translated"),
        F.coalesce(F.size("_at"), F.lit(0)).cast("long").alias("n_translated"),
    )
