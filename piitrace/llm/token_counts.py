"""Token counts by a deterministic transducer compiled from a merge vocabulary.

The transducer reads the byte letters of a word, the last one as a letter of its own (the
vocabulary marks word ends), and every transition is annotated with the tokens it emits. Emission
is the change of the number of tokens of what has been read, so it may be negative, and the
emissions of a path add up to the token count of its word. At a word's end the transducer is back in its
first state.

A byte-pair encoding of a prefix is the encoding of a shorter prefix and one last token. All
that what follows can depend on are therefore the places from which a longer token may still
grow: for each the node of the vocabulary's trie that its letters lead to, the last token before it, and
how many tokens lie between it and the end. There are finitely many such lists, as tokens are
bounded; each is a state. States and transitions are compiled when first reached, into
arrays that all words of a batch walk at once, and forgotten together when there are too many.

Chunks of a text compose by their state maps. White space brings the transducer back to its first
state whatever state it was in, so the map of a chunk is: the letters before its first white space
(still to be read from the state before), the tokens between, and the letters after its last, which stand for
the state it leaves. Chunks cut at spaces enter in the first state and leave in it: their maps are
numbers, and a prefix sum composes them. Texts longer than ``SLICE`` are cut anywhere, their slices are
dealt over the cluster, and their maps compose pairwise, in a tree.

Defined results: null is an empty text of no bytes; strings of special tokens in a text count
one, as the library has it; repeated rows and null or equal keys are rows of their own; an empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piitrace.llm.encode import PART, SPACE, Encoder, encoder

#: Letters of a text that one task counts by itself; longer texts are cut into slices of this length.
SLICE = 1 << 16
#: States a Python worker keeps.
STATES = 120_000
#: White space that no normal form moves or merges, so that slices may be told apart there.
GAPS = " \t\n\r\x0b\x0c"
#: Words that are walked one by one when fewer are left.
FEW = 12
#: Distinct chunks whose counts a worker keeps.
MEMO_CHUNKS = 400_000
#: Rank of a merge that never comes.
NEVER = 1 << 60
START = 0
#: Marks an emission that is not compiled.
UNKNOWN = -128


class Transducer:
    """Counts the tokens of words; states are numbers, ``START`` the one between words."""

    def __init__(self, vocabulary: dict[str, int], merges: list, byte_of: dict[str, int], suffix: str):
        self._suffix = suffix
        self._byte_of = byte_of
        self._rank: dict[tuple, int] = {}
        self._made: dict[tuple, tuple] = {}
        self._letters: dict[str, tuple[int, ...]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self._rank.setdefault((left, right), rank)
            self._made.setdefault(left + right, (left, right, rank))
        #: The trie of all entries: node -> letter -> node, and the entry that ends in a node.
        self._child: list[dict[int, int]] = [{}]
        self._entry: list[str | None] = [None]
        for name in vocabulary:
            if (letters := self.letters(name)) is not None:
                node = 0
                for x in letters:
                    nxt = self._child[node].get(x)
                    if nxt is None:
                        nxt = self._child[node][x] = len(self._child)
                        self._child.append({})
                        self._entry.append(None)
                    node = nxt
                self._entry[node] = name
        self._alone: dict[str, bool] = {}
        self._edges: dict[tuple[str, int], tuple] = {}
        self._seams: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Start anew with the first state only."""
        self._states: list[tuple] = [((0, "", 0),)]
        self._number: dict[tuple, int] = {self._states[0]: START}
        #: Column of each byte met so far, and the arrays: state and column -> next state, and tokens
        #: emitted within a word and at its end.
        self._column = np.full(256, -1, np.int64)
        self._byte: list[int] = []
        self._room(1 << 12, 32)

    def _room(self, states: int, width: int) -> None:
        """Arrays for so many states and bytes, with what the present ones hold."""
        kept = [self._next, self._inner, self._final] if len(self._states) > 1 or self._byte else []
        self._next = np.full((states, width), -1, np.int32)
        self._inner = np.zeros((states, width), np.int8)
        self._final = np.full((states, width), UNKNOWN, np.int8)
        for old, new in zip(kept, (self._next, self._inner, self._final), strict=False):
            new[:old.shape[0], :old.shape[1]] = old

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The columns of bytes."""
        out = self._column[data]
        if (out < 0).any():
            for byte in np.unique(data[out < 0]).tolist():
                self._column[byte] = len(self._byte)
                self._byte.append(byte)
            if len(self._byte) > self._next.shape[1]:
                self._room(len(self._next), 1 << (len(self._byte) - 1).bit_length())
            out = self._column[data]
        return out

    def _restart(self, states: np.ndarray) -> np.ndarray:
        """Forgets all but the given states; returns their new numbers."""
        keys = [self._states[q] for q in states.tolist()]
        columns, byte = self._column, self._byte
        width = self._next.shape[1]
        self.forget()
        self._column, self._byte = columns, byte
        self._room(1 << 12, width)
        return np.fromiter(map(self._state, keys), np.int64, len(keys))

    def _state(self, key: tuple) -> int:
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self._states)
            self._states.append(key)
            if number >= len(self._next):
                self._room(2 * len(self._next), self._next.shape[1])
        return number

    def letters(self, name: str) -> tuple[int, ...] | None:
        """A vocabulary entry as letters; None for special tokens."""
        ends = name.endswith(self._suffix)
        body = name.removesuffix(self._suffix) if ends else name
        try:
            out = [self._byte_of[x] for x in body]
        except KeyError:
            return None
        if not out:
            return None
        if ends:
            out[-1] += 256
        return tuple(out)

    def _stands_alone(self, name: str) -> bool:
        """Whether an entry's own letters are merged to it."""
        found = self._alone.get(name)
        if found is None:
            body = name.removesuffix(self._suffix)
            parts = list(body)
            if name.endswith(self._suffix):
                parts[-1] += self._suffix
            while len(parts) > 1:
                rank, at = min((self._rank.get(p, NEVER), i)
                               for i, p in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            found = self._alone[name] = parts == [name]
        return found

    def _edge(self, name: str, side: int) -> tuple[tuple[str, int], ...]:
        """The entries that touched this side of ``name`` while it was built, and when each was taken up."""
        key = (name, side)
        if key not in self._edges:
            out, until = [], NEVER
            while True:
                out.append((name, until))
                if name not in self._made:
                    break
                until, name = self._made[name][2], self._made[name][side]
            self._edges[key] = tuple(out)
        return self._edges[key]

    def _may_follow(self, left: str, right: str) -> bool:
        """Whether both stay as they are when their letters are merged together."""
        found = self._seams.get((left, right))
        if found is None:
            if len(self._seams) > 1_000_000:
                self._seams.clear()
            found = not any(
                (r := self._rank.get((a, b))) is not None and r < taken_a and r <= taken_b
                for a, taken_a in self._edge(left, 1) for b, taken_b in self._edge(right, 0))
            self._seams[left, right] = found
        return found

    def _compile(self, state: int, column: int, final: bool) -> None:
        """Adds a transition, within a word or at its end."""
        grown, last, emitted = [], "", 0
        letter = self._byte[column] + 256 * final
        for node, before, back in self._states[state]:
            to = self._child[node].get(letter)
            if to is None:
                continue
            name = self._entry[to]
            if not last and name is not None and self._stands_alone(name) and (
                    not before or self._may_follow(before, name)):
                last, emitted = name, 1 - back
            if self._child[to]:
                grown.append((to, before, back))
        if final:
            self._final[state, column] = emitted
            return
        to = self._state((*((n, u, back + emitted) for n, u, back in grown), (0, last, 0)))
        self._next[state, column] = to
        self._inner[state, column] = emitted

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (of one byte at least), all words walking side by side."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = self._columns(np.frombuffer(b"".join([words[i] for i in order]), np.uint8))
        begin = np.cumsum(size) - size
        state = np.zeros(len(words), np.int64)
        total = np.zeros(len(words), np.int64)
        at, inner, n = 0, 0, len(words)
        while n:
            if len(self._states) > STATES:
                state[:n] = self._restart(state[:n])
            if n <= FEW:
                break
            inner = int(np.searchsorted(-size, -at - 1, "left"))  # words longer than ``at`` + 1
            q, x = state[:n], data[begin[:n] + at]
            ends = self._final[q[inner:], x[inner:]]
            if (ends == UNKNOWN).any():
                for a, b in {*zip(q[inner:][ends == UNKNOWN].tolist(), x[inner:][ends == UNKNOWN].tolist(),
                                  strict=True)}:
                    self._compile(a, b, True)
                ends = self._final[q[inner:], x[inner:]]
            total[inner:n] += ends
            q, x = q[:inner], x[:inner]
            to = self._next[q, x]
            if (to < 0).any():
                for a, b in {*zip(q[to < 0].tolist(), x[to < 0].tolist(), strict=True)}:
                    self._compile(a, b, False)
                to = self._next[q, x]
            total[:inner] += self._inner[q, x]
            state[:inner] = to
            at, n = at + 1, inner
        for i in range(n):
            q, emitted = int(state[i]), 0
            letters = data[begin[i] + at:begin[i] + size[i]].tolist()
            for x in letters[:-1]:
                if self._next[q, x] < 0:
                    self._compile(q, x, False)
                emitted += int(self._inner[q, x])
                q = int(self._next[q, x])
                if len(self._states) > STATES + FEW:
                    state[i] = q
                    state[i:n] = self._restart(state[i:n])
                    q = int(state[i])
            if self._final[q, letters[-1]] == UNKNOWN:
                self._compile(q, letters[-1], True)
            total[i] += emitted + int(self._final[q, letters[-1]])
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


class Counter(Encoder):
    """Counts of whole texts for vocabularies that mark word ends and drop white space."""

    def __init__(self, path: str):
        super().__init__(path)
        if self.spaced:
            raise ValueError("the transducer needs a vocabulary that marks the ends of words")
        self.transducer = Transducer(self.vocabulary, self.merges, self.byte_of,
                                     self._model.end_of_word_suffix)
        self._apart = re.compile("|".join(map(re.escape, self.special)))
        self._counts: dict[str, int] = {}

    def chunk_counts(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk, read from the first state to the first state."""
        known = self._counts
        out = np.fromiter((known.get(x, -1) for x in chunks), np.int64, len(chunks))
        rest = np.flatnonzero(out < 0)
        if not len(rest):
            return out
        words: list[str] = []
        of: list[int] = []
        fixed = np.zeros(len(rest), np.int64)
        for i, at in enumerate(rest.tolist()):
            chunk = chunks[at]
            if not self.foreign(chunk):
                split = self.words(chunk)
            else:  # special tokens count one; letters unknown to Python are the library's
                parts = self._apart.split(chunk)
                plain = [p for p in parts if p.isascii() or self._unassigned(p) is None]
                fixed[i] = len(parts) - 1 + sum(len(self.text_ids(p)) for p in parts if p not in plain)
                split = [w for p in plain for w in self.words(p)]
            words += split
            of += [i] * len(split)
        seen: dict[str, int] = {}
        number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        if seen:
            counts = self.transducer.count([w.encode("utf-8") for w in seen])
            fixed += np.bincount(of, weights=counts[number], minlength=len(rest)).astype(np.int64)
        out[rest] = fixed
        if len(known) + len(rest) > MEMO_CHUNKS:
            known.clear()
        if len(rest) <= MEMO_CHUNKS:
            known.update(zip([chunks[i] for i in rest.tolist()], fixed.tolist(), strict=True))
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow array without nulls."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        out, begin = np.zeros(len(texts), np.int64), 0
        while begin < len(texts):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + PART, "right")))
            pieces = pc.split_pattern(texts.slice(begin, stop - begin), " ")
            bounds = pieces.offsets.to_numpy().astype(np.int64)
            coded = pieces.flatten().dictionary_encode()
            each = self.chunk_counts(coded.dictionary.to_pylist())
            scan = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
            out[begin:stop] = np.diff(scan[bounds - bounds[0]])
            begin = stop
        return out


#: The state map of a slice: letters before its first gap, tokens after it, letters after its last gap.
#: A slice without a gap has only a head, and no tail.
Map = tuple[str, int, str | None]


def slice_maps(counter: Counter, texts: list[str]) -> list[Map]:
    gap = re.compile(f"[{GAPS}]")
    inner, out = [], []
    for text in texts:
        if (found := gap.search(text)) is None:
            inner.append("")
            out.append((text, None))
            continue
        first, last = found.start(), max(text.rfind(x) for x in GAPS)
        inner.append(text[first:last])
        out.append((text[:first], text[last + 1:]))
    counts = counter.counts(pa.array(inner, pa.string())).tolist()
    return [(head, n, tail) for (head, tail), n in zip(out, counts, strict=True)]


def compose(counter: Counter, maps: list[Map]) -> int:
    """Tokens of the text whose slices have these maps, composed pairwise in a tree."""
    def joined(one: Map, two: Map) -> tuple[Map, str]:
        if one[2] is None:
            return (one[0] + two[0], two[1], two[2]), ""
        if two[2] is None:
            return (one[0], one[1], one[2] + two[0]), ""
        return (one[0], one[1] + two[1], two[2]), one[2] + two[0]

    met = []
    while len(maps) > 1:
        pairs = [joined(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        met += [word for _, word in pairs if word]
        maps = [m for m, _ in pairs] + maps[len(maps) - len(maps) % 2:]
    head, n, tail = maps[0]
    met += [head, tail or ""]
    return n + int(counter.counts(pa.array(met, pa.string())).sum())


def count(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` and ``n_tokens`` of every text."""
    kind = docs.schema[key].dataType.simpleString()
    c = F.col
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= SLICE)
    long = rows.where(F.length("text") > SLICE).select(F.monotonically_increasing_id().alias("row"), "key",
                                                       "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(tokenizer, Counter)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counter.counts(texts))],
                names=["key", "n_bytes", "n_tokens"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(tokenizer, Counter)
        for batch in batches:
            maps = slice_maps(counter, batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pc.cast(pc.binary_length(batch.column(3)), pa.int64()),
                 pa.array([h for h, _, _ in maps], pa.string()), pa.array([n for _, n, _ in maps], pa.int64()),
                 pa.array([t for _, _, t in maps], pa.string())],
                names=["row", "key", "place", "n_bytes", "head", "n", "tail"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(tokenizer, Counter)
        for batch in batches:
            totals = [compose(counter, [(m["head"], m["n"], m["tail"]) for m in maps])
                      for maps in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64())],
                                             names=["key", "n_bytes", "n_tokens"])

    schema = f"key {kind}, n_bytes long, n_tokens long"
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.lit(SLICE)).cast("int"))
    slices = long.select("row", "key", "text", F.explode(starts).alias("place")).select(
        "row", "key", "place", F.substring("text", c("place") * SLICE + 1, F.lit(SLICE)).alias("slice"))
    maps = slices.repartition("row", "place").mapInArrow(
        mapped, f"row long, key {kind}, place int, n_bytes long, head string, n long, tail string")
    listed = maps.groupBy("row").agg(
        F.first("key").alias("key"), F.sum("n_bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.struct("place", "head", "n", "tail"))).alias("maps"))
    return short.mapInArrow(whole, schema).unionByName(
        listed.select("key", "n_bytes", "maps").mapInArrow(scanned, schema)).withColumnRenamed("key", key)
