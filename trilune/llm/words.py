"""Vectorised word splitting and fingerprints over batches of whole texts.

A batch of texts becomes one byte buffer; words are the runs of bytes that are
not separators. Every separator used by the operators is an ASCII byte, and no
byte of a multi-byte UTF-8 character is ASCII, so splitting bytes equals
splitting characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: \x20 and \x09-\x0D separate words.
BLANKS = bytes([9, 10, 11, 12, 13, 32])
#: Everything in ASCII but digits and lower-case letters separates terms.
NOT_TERM = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Fingerprints are polynomials over the field of this prime, at two points; unlike sums modulo a power
#: of two they differ for words built to a rule, such as those of Thue and Morse.
_PRIME = (1 << 31) - 1
_POINTS = (1_270_463_929, 1_845_330_731)
_RNG = np.random.default_rng(20240101)
_LANE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**63."""
    p, shift = np.uint64(_PRIME), np.uint64(31)
    for _ in range(2):
        x = (x & p) + (x >> shift)
    return np.where(x >= p, x - p, x)


def powers(n: int) -> list[np.ndarray]:
    """For each point, its powers 0 to n - 1 and more."""
    if not _POWERS:
        _POWERS[:] = [np.ones(1, np.uint64) for _ in _POINTS]
    while len(_POWERS[0]) < n:
        size = len(_POWERS[0])
        _POWERS[:] = [
            np.append(u, folded(u * np.uint64(pow(x, size, _PRIME))))
            for u, x in zip(_POWERS, _POINTS, strict=True)
        ]
    return _POWERS


def joined(sums: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """A fingerprint from the sums at both points and the length."""
    one, two = map(folded, sums)
    return mix(((one << np.uint64(31)) | two) + size.astype(np.uint64) * _LANE[0])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of a batch, in order: byte spans, document index and fingerprint."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first[d] .. first[d + 1] are document d's words
    hash: np.ndarray | None

    def prefix(self, n: int) -> np.ndarray:
        """Fingerprint of each word's first n bytes; of all of them, where it has fewer."""
        size = np.minimum(self.end - self.start, n)
        sums = [np.zeros(len(size), np.uint64) for _ in _POINTS]
        for i in range(n):
            has = np.flatnonzero(size > i)
            byte = self.buffer[self.start[has] + i].astype(np.uint64) + np.uint64(1)
            for total, up in zip(sums, powers(n), strict=True):
                total[has] += byte * up[i]
        return joined(sums, size)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def encode(texts) -> tuple[np.ndarray, np.ndarray]:
    """Texts (None: empty) as one byte buffer and the offsets of each."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def split(texts, separators: bytes = BLANKS, lower: bool = False, hashes: bool = True) -> Words:
    """Words of each text; `lower` maps A-Z first."""
    buffer, offsets = encode(texts)
    return split_buffer(buffer, offsets, separators, lower, hashes)


def split_buffer(buffer, offsets, separators: bytes = BLANKS, lower: bool = False, hashes: bool = True) -> Words:
    if lower:
        buffer = np.frombuffer(buffer.tobytes().translate(LOWER), np.uint8)
    table = np.ones(256, bool)
    table[list(separators)] = False
    n = len(buffer)
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[buffer]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    ends = inside[:n] & ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buffer, start, end, doc, first, fingerprints(buffer, start, end) if hashes else None)


def fingerprints(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, short: int = 40) -> np.ndarray:
    """Of the words [start, end), which are in order and do not overlap: byte by byte for all short ones at once, word by word for others."""
    size = end - start
    out = np.zeros(len(size), np.uint64)
    order = np.argsort(np.minimum(size, short + 1).astype(np.uint8), kind="stable")[::-1]
    long = int(np.count_nonzero(size > short))
    for i in order[:long]:
        byte = buffer[start[i] : end[i]].astype(np.uint64) + np.uint64(1)
        parts = [folded(up[: len(byte)] * byte).sum(dtype=np.uint64) for up in powers(len(byte))]
        out[i] = joined([np.array([p]) for p in parts], size[i : i + 1])[0]
    order = order[long:]
    at, room = start[order], size[order]
    sums = [np.zeros(len(order), np.uint64) for _ in _POINTS]
    ends = len(room) - np.searchsorted(room[::-1], np.arange(short), "right")  # words with a byte at each place
    for i, n in enumerate(ends):
        if not n:
            break
        byte = buffer[at[:n] + i].astype(np.uint64)
        byte += np.uint64(1)
        for total, up in zip(sums, powers(short), strict=True):
            total[:n] += byte * up[i]
    out[order] = joined(sums, room)
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the n words from each position on; the last n - 1 positions have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out += h[i : i + m] * _LANE[i % 64] + np.uint64(i // 64)
    return mix(out)


def inside_one(doc: np.ndarray, n: int) -> np.ndarray:
    """For each position that has n words from it on: whether one document holds them."""
    m = len(doc) - n + 1
    return np.zeros(0, bool) if m <= 0 else doc[:m] == doc[n - 1 :]


def packed(w: Words, of: np.ndarray) -> bytes:
    """The words with the given numbers, each followed by a blank."""
    size = w.end[of] - w.start[of] + 1
    to = np.cumsum(size) - size
    text = np.full(int(size.sum()), 32, np.uint8)
    inner = np.ones(len(text), bool)
    inner[to + size - 1] = False
    if len(of):
        text[inner] = w.buffer[np.repeat(w.start[of] - (to - np.arange(len(to))), size - 1) + np.arange(len(text) - len(to))]
    return text.tobytes()


def numbered(w: Words) -> np.ndarray:
    """A number for each word, equal for equal words and for no others."""
    import pyarrow as pa

    if not len(w.end):
        return np.zeros(0, np.int32)
    edges = np.stack([w.start, w.end], axis=1).ravel().astype(np.int64)
    both = pa.Array.from_buffers(
        pa.large_binary(),
        len(edges) - 1,
        [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(w.buffer))],
    )
    return np.asarray(both.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode().indices)


def from_arrow(column) -> tuple[np.ndarray, np.ndarray]:
    """The byte buffer and offsets of an Arrow string column, nulls as empty texts, without making Python strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[o[0] : o[-1]], o - o[0]


def returned() -> None:
    """Gives what Arrow and the C library keep of freed memory back to the system; Python workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(offsets: np.ndarray, most_bytes: int = 4 << 20):
    """(from, to) document ranges of a batch, each about most_bytes long and at least one document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def chunks(column, separators: bytes = BLANKS, lower: bool = False, hashes: bool = True, most_bytes: int = 2 << 20):
    """For each slice of an Arrow text column: the first document's index, and its words."""
    buffer, offsets = from_arrow(column)
    for a, b in slices(offsets, most_bytes):
        part = offsets[a : b + 1]
        yield a, b, split_buffer(buffer[part[0] : part[-1]], part - part[0], separators, lower, hashes)
        returned()
