"""Segmentation lattices of words over a fixed public piece vocabulary.

A word is read as one blank byte and its UTF-8 bytes. Every vocabulary piece that
spells a stretch of it is an edge, and every byte is an edge of its own, so each word
has a segmentation. Pieces never reach over a blank inside a text, so a text's
probability, summed over all its segmentations, is the product of those of its words.
Forward and backward sums run in log space over many distinct words at once, layer by layer;
words longer than LONG bytes, such as texts without blanks, are walked one by one, so that a
long word costs in proportion to its length.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from trilune.llm import words as W

LONG = 2000


class Lattice:
    """Pieces of a sentencepiece model file as byte strings; edge e has a weight per model."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, int] = {}
        for i in range(m.get_piece_size()):
            if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
                continue
            b = m.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in b[1:] and len(b) > 1:
                found.setdefault(b, len(found))
        self.pieces = [bytes([b]) for b in range(256)] + list(found)
        self.size = len(self.pieces)
        self.by_length = {}
        long = self.pieces[256:]
        h = W.split_buffer(np.frombuffer(b"".join(long), np.uint8), np.cumsum([0, *map(len, long)]), separators=b"").hash
        sizes = np.array([len(p) for p in long])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            order = at[np.argsort(h[at])]
            seen = np.zeros(1 << 20, bool)
            seen[(h[order] >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[int(n)] = (h[order], (order + 256).astype(np.int32), seen)

    def edges(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """For a buffer of words one after the other: {length: (from positions, piece numbers)}, longest last."""
        n = len(buffer)
        room = np.repeat(starts + sizes, sizes) - np.arange(n)  # bytes to the word's end
        out = {1: (np.arange(n), buffer.astype(np.int32))}
        byte = buffer.astype(np.uint64) + np.uint64(1)
        ups = W.powers(max(self.by_length, default=1))
        at, sums = np.arange(n), [byte.copy() for _ in ups]
        for length in range(2, max(self.by_length, default=1) + 1):
            keep = room[at] >= length
            at = at[keep]
            if not len(at):
                break
            sums = [s[keep] + byte[at + length - 1] * up[length - 1] for s, up in zip(sums, ups, strict=True)]
            if length not in self.by_length:
                continue
            known, number, seen = self.by_length[length]
            h = W.joined(sums, np.full(len(at), length))
            maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            j = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            hit = known[j] == h[maybe]
            out[length] = (at[maybe[hit]], number[j[hit]])
        return out

    def blocks(self, sizes: np.ndarray, most: int = 400_000):
        """Word ranges of about `most` bytes."""
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield at, to
            at = to

    def run(self, buffer, starts, sizes, logp: np.ndarray, weight: np.ndarray | None = None):
        """Log probability of each word under each model (logp: piece x model).

        With weights, also the expected number of uses of each piece (one model only).
        """
        models = logp.shape[1]
        out = np.empty((len(sizes), models))
        used = np.zeros(self.size) if weight is not None else None
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            for i in long:
                out[i], uses = self.walked(buffer[starts[i] : starts[i] + sizes[i]], logp, used is not None)
                if used is not None:
                    used += weight[i] * uses
            short = np.flatnonzero(sizes <= LONG)
            own = (
                np.repeat(starts[short] - (np.cumsum(sizes[short]) - sizes[short]), sizes[short])
                + np.arange(int(sizes[short].sum()))
            )
            rest = self.run(
                buffer[own],
                np.cumsum(sizes[short]) - sizes[short],
                sizes[short],
                logp,
                None if used is None else weight[short],
            )
            out[short] = rest if used is None else rest[0]
            return out if used is None else (out, used + rest[1])
        for a, b in self.blocks(sizes):
            lo, hi = starts[a], starts[b - 1] + sizes[b - 1]
            s, n = starts[a:b] - lo, sizes[a:b]
            edges = self.edges(buffer[lo:hi], s, n)
            nodes = np.full((hi - lo + (b - a), models), -np.inf)
            word = np.repeat(np.arange(b - a), n)
            first = s + np.arange(b - a)
            nodes[first] = 0.0
            source = np.concatenate([e[0] for e in edges.values()])
            piece = np.concatenate([e[1] for e in edges.values()])
            length = np.repeat(list(edges), [len(e[0]) for e in edges.values()])
            tail, offset = source + word[source], source - s[word[source]]
            head = tail + length
            for step in _layers(offset + length):
                _logsum(nodes, head[step], nodes[tail[step]] + logp[piece[step]])
            last = first + n
            out[a:b] = nodes[last]
            if used is not None:
                back = np.full((len(nodes), 1), -np.inf)
                back[last] = 0.0
                for step in _layers(n[word[source]] - offset):
                    _logsum(back, tail[step], back[head[step]] + logp[piece[step]])
                share = nodes[tail, 0] + logp[piece, 0] + back[head, 0] - nodes[last, 0][word[source]]
                used += np.bincount(piece, np.exp(share) * weight[a:b][word[source]], self.size)
        return out if used is None else (out, used)

    def walked(self, word: np.ndarray, logp: np.ndarray, uses: bool):
        """Log probabilities of one word under each model, and the expected uses of the pieces (under the first)."""
        n = len(word)
        found = self.edges(word, np.zeros(1, np.int64), np.array([n]))
        tail, piece = (np.concatenate([e[i] for e in found.values()]) for i in (0, 1))
        head = tail + np.repeat(list(found), [len(e[0]) for e in found.values()])
        there = [_path_sums(tail, head, logp[piece, m], n) for m in range(logp.shape[1])]
        used = np.zeros(self.size)
        if uses:
            back = _path_sums(n - head, n - tail, logp[piece, 0], n)[::-1]
            used = np.bincount(piece, np.exp(there[0][tail] + logp[piece, 0] + back[head] - there[0][n]), self.size)
        return np.array([t[n] for t in there]), used


def _path_sums(tail: np.ndarray, head: np.ndarray, logp: np.ndarray, n: int, low: float = 1e-150) -> np.ndarray:
    """Log of the sum over all paths from node 0 to each node; scaled sums, since a word may have a million nodes."""
    order = np.argsort(head, kind="stable")
    tails, chance, cut = tail[order].tolist(), np.exp(logp[order]).tolist(), np.searchsorted(head[order], np.arange(1, n + 2)).tolist()
    reach = int((head - tail).max())
    sums, out, moved = [0.0] * (n + 1), [0.0] * (n + 1), 0.0
    sums[0] = 1.0
    for i in range(1, n + 1):
        total = 0.0
        for e in range(cut[i - 1], cut[i]):
            total += sums[tails[e]] * chance[e]
        if total < low:
            for j in range(max(0, i - reach), i):
                sums[j] /= low
            moved += math.log(low)
            total /= low
        sums[i] = total
        out[i] = math.log(total) + moved
    return np.array(out)


def _layers(at: np.ndarray):
    """Edge numbers by the layer that they lead to, in order of layers."""
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return np.split(order, cuts) if len(order) else []


def _logsum(nodes, target, values) -> None:
    """nodes[t] = log of the sum of exp over the values for t; no target has a value yet."""
    order = np.argsort(target, kind="stable")
    t, v = target[order], values[order]
    cut = np.append(0, np.flatnonzero(np.diff(t)) + 1)
    top = np.maximum.reduceat(v, cut)
    sums = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(cut, len(t))), axis=0)), cut)
    nodes[t[cut]] = top + np.log(sums)


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def spelled(words: list[bytes]):
    """Buffer, starts and sizes of words, each with the blank before it."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    return np.frombuffer(b"".join(b" " + w for w in words), np.uint8), np.cumsum(sizes) - sizes, sizes


def fitted(
    lat: Lattice,
    words: list[bytes],
    counts: np.ndarray,
    rounds: int = 3,
    start: np.ndarray | None = None,
    add: float = 0.1,
) -> np.ndarray:
    """Log probabilities of the pieces that make the counted words likely, by expectation maximisation."""
    logp = np.full((lat.size, 1), -np.log(lat.size)) if start is None else start.reshape(-1, 1)
    if len(words):
        spell = spelled(words)
        for _ in range(rounds):
            _, used = lat.run(*spell, logp, np.asarray(counts, float))
            logp = np.log((used + add) / (used + add).sum()).reshape(-1, 1)
    return logp[:, 0]


class Table:
    """Word scores by fingerprint, kept from batch to batch up to `most` words."""

    def __init__(self, lat: Lattice, logp: np.ndarray, most: int = 400_000):
        self.lat, self.logp, self.most = lat, logp, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, logp.shape[1]))

    def scores(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the batch's distinct words, number of the distinct word of each word)."""
        keys, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
        out = np.empty((len(keys), self.logp.shape[1]))
        at = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        if len(self.keys):
            old = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
            out[old] = self.values[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            start, end = w.start[first[new]], w.end[first[new]]
            n = end - start + 1
            to = np.cumsum(n) - n
            text = np.full(n.sum(), 32, np.uint8)
            inner = np.ones(len(text), bool)
            inner[to] = False
            text[inner] = w.buffer[np.repeat(start - (to - np.arange(len(to))), n - 1) + np.arange(len(text) - len(to))]
            out[new] = self.lat.run(text, to, n, self.logp)
            if len(self.keys) + len(new) > self.most:
                self.keys, self.values = self.keys[:0], self.values[:0]
                at = np.zeros(len(keys), np.int64)
            self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], out[new], axis=0)
        return out, number
