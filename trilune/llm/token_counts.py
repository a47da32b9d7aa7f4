"""Token counts by a deterministic transducer compiled from a merge vocabulary.

The tokenizer merges neighbouring symbols, the best-ranked piece first, from the left. Of such a
tokenization three things are known: a stretch of its tokens is the tokenization of what they
spell; tokens of which each two neighbours are the tokenization of the two together are that of the
whole; and no merge reaches over two characters that no piece has side by side. The last token
of every prefix of a text is therefore determined by the last tokens of shorter prefixes: it is the one
piece that ends there and goes with the last token before it.

This makes a transducer that reads characters:

* A state is the last token of what was read, and for each earlier point from which some piece may still
  grow: its place in the tree of pieces, the last token before that point, and by how many tokens that
  point is behind. Points before two characters that no piece joins are forgotten, so states are
  finite in number and the one after such a point depends on the next character alone.
* A transition is annotated with the tokens that the text read has more by it; the number is negative where
  a character lets pieces grow together. Characters outside the vocabulary emit their UTF-8 bytes.

Merge ranks are compiled: which two tokens may stand side by side is found by merging their characters by
rank, once per token, and undoing these merges from the later one on. States are made when first met
and kept up to a bound, and so are the tokens that whole words between forgotten points emit. The tokenizer
library only reads the vocabulary file; no text is passed to it.

A chunk of a text has a state map: the head, up to the first point where the state is forgotten,
and after it a constant, the tokens emitted and the state at the end. Maps compose associatively, by
reading the right one's head from the left one's end, so that chunks of a long text are mapped
independently and composed pairwise, as in a parallel prefix scan.

Null and empty texts have 0 bytes and tokens. Other columns of the input are not used, whatever their
names; rows with equal ids are counted each. An empty table gives an empty one.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from trilune.llm.common import small_batches, table

BLANK = "▁"
RESULT = "n_bytes long, n_tokens long, over_limit boolean"


class State:
    """What is open after a text: its last token and the points (place in the tree, last token before it, tokens behind)."""

    __slots__ = ("last", "next", "points")

    def __init__(self, last: str | None, points: tuple):
        self.last, self.points, self.next = last, points, {}


class Transducer:
    """Compiled from a sentencepiece BPE model; `most` bounds the states that are kept."""

    def __init__(self, path: str, most: int = 200_000):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.rank = {m.id_to_piece(i): -m.get_score(i) for i in pieces}
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.root: dict = {}  # places in the tree are dicts by character; "" holds the piece that ends there
        for p in self.rank:
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.most, self.states, self.halves, self.emits = most, {}, {}, {}
        self.start = State(None, ())
        # Blanks begin a word, where no piece has them behind something else.
        apart = not any(p[1] == BLANK != p[0] for p in self.pairs)
        self.words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if apart else ".+", re.S).findall

    def made(self, token: str) -> tuple[float, str, str] | None:
        """Rank and halves of the merge that makes a token of its characters (-1 for one character); None if none does."""
        found = self.halves.get(token, ())
        if found != ():
            return found
        tokens, last = list(token), (-1.0, token, token)
        while len(tokens) > 1:
            ranks = [self.rank.get(a + b, float("inf")) for a, b in zip(tokens, tokens[1:], strict=False)]
            best = min(ranks)
            if best == float("inf"):
                break
            i = ranks.index(best)
            last = best, tokens[i], tokens[i + 1]
            tokens[i : i + 2] = [last[1] + last[2]]
        if len(self.halves) >= 4 * self.most:
            self.halves.clear()
        found = self.halves[token] = last if len(tokens) == 1 else None
        return found

    def goes(self, before: str | None, token: str) -> bool:
        """Whether the token may stand after this one, or at all if there is none: no merge over the point between comes before theirs."""
        right = self.made(token)
        if right is None or before is None:
            return right is not None
        left, until = self.made(before), float("inf")
        while True:
            if self.rank.get(before + token, float("inf")) < until:
                return False
            if left[0] > right[0]:  # the left one is made later: back to its right half
                until, before = left[0], left[2]
                left = self.made(before)
            elif right[0] >= 0:  # of equal merges, the one further left comes first
                until, token = right[0] + 0.5, right[1]
                right = self.made(token)
            else:
                return True

    def cost(self, token: str) -> int:
        return 1 if token in self.rank else len(token.encode("utf-8", "surrogatepass"))

    def step(self, state: State, c: str) -> tuple[int, State]:
        """The tokens that one more character adds, and the state after it."""
        if state.last is None or state.last[-1] + c not in self.pairs:
            points = ((self.root, None, 0),)
        else:
            points = (*state.points, (self.root, state.last, 0))
        grown, last, emitted = [], c, self.cost(c)
        found = False
        for node, before, behind in points:
            node = node.get(c)
            if node is None:
                continue
            grown.append((node, before, behind))
            token = node.get("")
            if token is not None and not found and self.goes(before, token):
                last, emitted, found = token, behind + self.cost(token), True
        points = tuple((n, b, k - emitted) for n, b, k in grown if len(n) > ("" in n))
        key = (last, tuple((id(n), b, k) for n, b, k in points))
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= self.most:
                self.states.clear()
                self.start.next.clear()
            to = self.states[key] = State(last, points)
        state.next[c] = emitted, to
        return emitted, to

    def read(self, text: str, state: State) -> tuple[int, State]:
        """Tokens that a text adds after a state, and the state at its end."""
        total = 0
        for c in text:
            known = state.next.get(c)
            if known is None:
                known = self.step(state, c)
            total += known[0]
            state = known[1]
        return total, state

    def body(self, text: str) -> tuple[int, State]:
        """As `read` from the start, word by word; tokens of short words are kept."""
        words, total = self.words(text), 0
        known = self.emits.get
        for w in words[:-1]:
            n = known(w)
            if n is None:
                n = self.read(w, self.start)[0]
                if len(w) <= 40:
                    if len(self.emits) >= 2 * self.most:
                        self.emits.clear()
                    self.emits[w] = n
            total += n
        last, state = self.read(words[-1] if words else "", self.start)
        return total + last, state

    def state_map(self, chunk: str, first: bool) -> tuple[str, int, State | None]:
        """(head, emitted after it, state at the end); None for the state: all is head."""
        at = 0
        if not first:
            at = next((i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.pairs), len(chunk))
            if at == len(chunk):
                return chunk, 0, None
        return chunk[:at], *self.body(chunk[at:])

    def compose(self, a, b):
        """The map of a text from those of its left and right part."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        more, state = self.read(b[0], a[2])
        return (a[0], a[1] + more, state) if b[2] is None else (a[0], a[1] + more + b[1], b[2])

    def count(self, text: str, chunk: int = 1 << 20) -> int:
        if not text:
            return 0
        text = (" " + text).replace(" ", BLANK)  # as the tokenizer writes blanks, one before every text
        maps = [self.state_map(text[i : i + chunk], i == 0) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][1]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    gc.set_threshold(100_000, 50, 1000)  # states are many and live long; looking through them often costs a third of the time
    return Transducer(path)


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: key, UTF-8 bytes, tokens of the whole text, and whether they exceed the limit. One pass, no shuffle."""
    small_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        t = transducer(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [0 if x is None else t.count(x) for x in texts]
            size = [0 if x is None else len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"{key} {kind}, {RESULT}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
