"""Text likelihood under a unigram model of subwords, summed over all segmentations.

The pieces are those of an existing vocabulary. Its scores give every piece a starting
weight; rounds of expectation over all distinct training words turn them into probabilities.
A text is its words in order, then one end. Pieces never cross a word's edge, so the
probability of a text over all segmentations is the product of those of its words; a word's
is found by the forward recursion in log space. Letters that no piece covers are spelt with
byte pieces, so every text has a probability above zero. The distinct words of a batch are a prefix
tree in arrays, and recursion and expectation run over all of it at once.

The lattice of a word that training saw has one more edge from its first letter to its
last, the word itself with its relative frequency. The share of training words that were seen
once is the weight of all other segmentations: what a new word may expect.

A word is scored once for the whole corpus:

1. ``count_words`` counts words per batch and then sums them: one row per distinct word.
2. ``learn`` sums expected piece counts, at most one row per piece and task.
3. ``score_words`` adds the log probability to each distinct word.
4. ``score_texts`` looks words up. The frequent ones, at most ``HEAD`` of them, are sent to
   every task; the others leave the task as rows and meet their scores in a join.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

Defined results: null and empty texts are one end; repeated rows and null or equal keys are texts of
their own; rows whose ``train`` is null or false are not learnt from; with nothing to learn
from, pieces keep their starting weights and an end has the probability 1/2; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piitrace.session import cut

#: Most words whose scores are sent to every task, and the bytes of the longest of them.
HEAD, HEAD_BYTES = 1 << 18, 128
#: Rounds of expectation over the distinct training words.
ROUNDS = 2
#: Letters from which a word is worked off by itself.
LONG = 48
#: Added to every expected piece count.
SMOOTH = 0.1
_LN10 = math.log(10)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch as a dictionary array, and the number of the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    full = pc.not_equal(flat, "")
    return flat.filter(full).dictionary_encode(), of[full.to_numpy(zero_copy_only=False)]


class Pieces:
    """The pieces of a sentencepiece vocabulary and their log probabilities."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes = [-1] * 256
        scores = np.full(model.get_piece_size(), -np.inf)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
            else:
                continue
            scores[i] = model.get_score(i)
        self.longest = max(map(len, self.ids))
        self._read_backwards()
        # Scores of merge vocabularies are falling ranks: the weight of rank r is 1 / (r + 1).
        # Scores that are log probabilities are taken as they are.
        known = np.isfinite(scores)
        ranks = scores[known].min() < -100
        scores[known] = -np.log1p(-scores[known]) if ranks else scores[known]
        self.ranked = scores - math.log(np.exp(scores[known]).sum())

    def _read_backwards(self) -> None:
        """The trie of the pieces' letters from last to first: sorted (node, letter) keys, the node each
        leads to, and the piece that ends in a node."""
        child: dict[tuple[int, int], int] = {}
        piece = [-1]
        for name, i in self.ids.items():
            node = 0
            for letter in reversed(name):
                node = child.setdefault((node, ord(letter)), len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = i
        keys = np.array([n << 21 | x for n, x in child], np.int64)
        order = np.argsort(keys)
        self.steps, self.nodes = keys[order], np.array(list(child.values()), np.int64)[order]
        self.piece = np.array(piece, np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that letters lead to, or -1."""
        key = node << 21 | letter
        at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
        return np.where(self.steps[at] == key, self.nodes[at], -1)

    def edges(self, word: str, at: int, logp: list[float]) -> list[tuple[int, int, float]]:
        """Pieces that end behind letter ``at - 1`` of ``word``: (start, piece, log probability)."""
        ids, out = self.ids, []
        for begin in range(max(0, at - self.longest), at):
            i = ids.get(word[begin:at])
            if i is not None:
                out.append((begin, i, logp[i]))
        if ids.get(word[at - 1]) is None:
            spelt = [self.bytes[b] for b in word[at - 1].encode("utf-8", "surrogatepass")]
            out.append((at - 1, -1, sum(logp[b] for b in spelt)))
        return out


def _sum_logs(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    if len(values) == 2:
        return top + math.log1p(math.exp(min(values) - top))
    return top + math.log(sum([math.exp(v - top) for v in values]))


def word_logs(pieces: Pieces, logp: list[float], words: list[str]) -> list[float]:
    """Natural log of each word's probability over all segmentations.

    In sorted order a word keeps the forward states of the prefix it shares with the last.
    """
    out = [0.0] * len(words)
    path, forward, get, longest = "", [0.0], pieces.ids.get, pieces.longest
    for at in sorted(range(len(words)), key=words.__getitem__):
        word = "▁" + words[at]
        shared = 0
        for x, y in zip(path, word):  # noqa: B905  one is longer
            if x != y:
                break
            shared += 1
        del forward[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            terms = []
            for begin in range(max(0, end - longest), end):
                i = get(word[begin:end])
                if i is not None:
                    terms.append(forward[begin] + logp[i])
            if i is None:  # the last letter by itself is no piece
                terms.append(forward[end - 1] + pieces.edges(word, end, logp)[-1][2])
            forward.append(_sum_logs(terms))
        path = word
        out[at] = forward[-1]
    return out


class Lattice:
    """The prefix tree of distinct words as arrays, and the pieces that lead from prefix to prefix.

    States are the distinct prefixes, by length; an edge is a piece that ends a prefix. All words of
    a batch are worked off together, one length after the other.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces = pieces
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = int(size.max())
        letters = np.array(["▁" + w for w in words], f"U{width}").view(np.uint32).reshape(-1, width)
        order = np.lexsort(letters.T[::-1])
        letters, size = letters[order].astype(np.int64), size[order]
        differ = np.ones(letters.shape, bool)
        differ[1:] = letters[1:] != letters[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[1:] = np.minimum(shared[1:], size[:-1])
        shared[0] = 0
        #: For each length the letter that ends its states, the state each grows from, and the number of its first.
        self.letter, self.parent, self.base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0, 1]
        of = np.zeros(len(words), np.int64)  # each word's state at the length at hand
        end = np.zeros(len(words), np.int64)
        for d in range(1, width + 1):
            here = size >= d
            new = here & (shared < d)
            rows = np.flatnonzero(new)
            self.letter.append(letters[rows, d - 1])
            self.parent.append(of[rows])
            number = np.cumsum(new) - 1
            of = np.where(here, number, of)
            last = np.flatnonzero(size == d)
            end[last] = self.base[d] + of[last]
            self.base.append(self.base[d] + len(rows))
        #: The state of each word, in the order given.
        self.end = np.empty(len(words), np.int64)
        self.end[order] = end
        self._find_edges()

    def _find_edges(self) -> None:
        """For each length the edges into its states: (state, state it leads from, piece), or the letter of
        a state that no piece spells, as -1 - letter."""
        pieces, self.edges = self.pieces, []
        for d in range(1, len(self.letter)):
            n = len(self.letter[d])
            act = at = np.arange(n)
            node = np.zeros(n, np.int64)
            states, sources, names = [], [], []
            for e in range(d, max(0, d - pieces.longest), -1):
                node = pieces.step(node, self.letter[e][at])
                keep = node >= 0
                act, node, at = act[keep], node[keep], self.parent[e][at[keep]]
                piece = pieces.piece[node]
                found = piece >= 0
                states.append(act[found])
                sources.append(self.base[e - 1] + at[found])
                names.append(piece[found])
                if e == d:
                    spelt = np.ones(n, bool)
                    spelt[act[found]] = False
                    spelt = np.flatnonzero(spelt)
                    states.append(spelt)
                    sources.append(self.base[d - 1] + self.parent[d][spelt])
                    names.append(-1 - self.letter[d][spelt])
                if not len(act):
                    break
            self.edges.append((self.base[d] + np.concatenate(states), np.concatenate(sources),
                               np.concatenate(names)))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Natural log of each prefix's probability over all segmentations; fills the edges' weights."""
        out = np.zeros(self.base[-1])
        self.weights = []
        bytes_of = self.pieces.bytes
        spelt: dict[int, float] = {}
        for d, (state, source, name) in enumerate(self.edges, 1):
            weight = logp[np.maximum(name, 0)]
            for letter in np.unique(name[name < 0]).tolist():
                if letter not in spelt:
                    spelt[letter] = sum(logp[bytes_of[b]] for b in chr(-1 - letter).encode("utf-8", "surrogatepass"))
                weight[name == letter] = spelt[letter]
            value = out[source] + weight
            low, high = self.base[d], self.base[d + 1]
            top = np.full(high - low, -np.inf)
            np.maximum.at(top, state - low, value)
            total = np.bincount(state - low, np.exp(value - top[state - low]), high - low)
            out[low:high] = top + np.log(total)
            self.weights.append(value)
        return out

    def expected(self, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in all segmentations of the words: the posterior of reaching a
        prefix is shared among the edges into it, from the longest prefix down."""
        forward = self.forward(logp)
        reach = np.bincount(self.end, minlength=len(forward)).astype(float)
        out = np.zeros(len(logp))
        for (state, source, name), value in zip(reversed(self.edges), reversed(self.weights), strict=True):
            part = reach[state] * np.exp(value - forward[state])
            reach += np.bincount(source, part, len(reach))
            out += np.bincount(name[name >= 0], part[name >= 0], len(out))
            rest = name < 0
            for letter, mass in zip((-1 - name[rest]).tolist(), part[rest].tolist(), strict=True):
                for byte in chr(letter).encode("utf-8", "surrogatepass"):
                    out[self.pieces.bytes[byte]] += mass
        return out


def batches_of_words(words: list[str]) -> tuple[list[str], list[str]]:
    """Words that are worked off as a lattice of all, and those that are too long for one."""
    return [w for w in words if len(w) < LONG], [w for w in words if len(w) >= LONG]


def expected_counts_of(pieces: Pieces, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Expected uses of each piece in all segmentations of the words."""
    short, long = batches_of_words(words)
    total = Lattice(pieces, short).expected(logp) if short else np.zeros(len(logp))
    return total + expected_counts(pieces, logp.tolist(), long) if long else total


def word_logs_of(pieces: Pieces, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log of each word's probability over all segmentations."""
    out = np.empty(len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    short, long = np.flatnonzero(size < LONG), np.flatnonzero(size >= LONG)
    if len(short):
        lattice = Lattice(pieces, [words[i] for i in short])
        out[short] = lattice.forward(logp)[lattice.end]
    if len(long):
        out[long] = word_logs(pieces, logp.tolist(), [words[i] for i in long])
    return out


def expected_counts(pieces: Pieces, logp: list[float], words: list[str]) -> np.ndarray:
    """Expected uses of each piece in all segmentations of the words.

    In sorted order a word keeps the forward states and edges of the prefix it shares with the last.
    """
    total = [0.0] * len(logp)
    exp, log1p, get, longest = math.exp, math.log1p, pieces.ids.get, pieces.longest
    path, forward, edges = "", [0.0], [[]]
    for word in sorted(words):
        word = "▁" + word
        shared = 0
        for x, y in zip(path, word):  # noqa: B905  one is longer
            if x != y:
                break
            shared += 1
        del forward[shared + 1:], edges[shared + 1:]
        path, size = word, len(word)
        for end in range(shared + 1, size + 1):
            here, value = [], None
            for begin in range(max(0, end - longest), end):
                i = get(word[begin:end])
                if i is not None:
                    v = forward[begin] + logp[i]
                    here.append((begin, i, v))
                    if value is None:
                        value = v
                    elif v > value:
                        value = v + log1p(exp(value - v))
                    else:
                        value += log1p(exp(v - value))
            if i is None:  # the last letter by itself is no piece
                v = forward[end - 1] + pieces.edges(word, end, logp)[-1][2]
                here.append((end - 1, -1, v))
                value = v if value is None else _sum_logs([value, v])
            edges.append(here)
            forward.append(value)
        # Backward: the posterior of reaching a letter is shared among the edges into it.
        reach = [0.0] * size + [1.0]
        for end in range(size, 0, -1):
            mass = reach[end]
            if mass == 0.0:
                continue
            here, base = edges[end], forward[end]
            for b, i, v in here:
                part = mass if len(here) == 1 else mass * exp(v - base)
                reach[b] += part
                if i >= 0:
                    total[i] += part
                else:
                    for byte in word[b].encode("utf-8", "surrogatepass"):
                        total[pieces.bytes[byte]] += part
    return np.array(total)


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def count_words(docs: DataFrame, text: str, train: str) -> DataFrame:
    """``word``, its ``count`` in training texts and its ``uses`` in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, of = split_words(batch.column(0))
            n = len(coded.dictionary)
            index = coded.indices.to_numpy()
            learnt = pc.fill_null(batch.column(1), False).to_numpy(zero_copy_only=False)[of]
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(np.bincount(index[learnt], minlength=n)),
                 pa.array(np.bincount(index, minlength=n))], names=["word", "count", "uses"])

    per_batch = docs.select(docs[text].alias("text"), docs[train].alias("train")).mapInArrow(
        run, "word string, count long, uses long")
    return per_batch.groupBy("word").agg(F.sum("count").alias("count"), F.sum("uses").alias("uses"))


def learn(words: DataFrame, model: str) -> np.ndarray:
    """Log probability of each piece from the training words among ``words``, each once."""
    logp = pieces_of(model).ranked
    for _ in range(ROUNDS):
        logp = _round(words, model, logp)
    return logp


def _round(words: DataFrame, model: str, start: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logp = pieces_of(model), shared.value
        total = np.zeros(len(logp))
        for batch in batches:
            total += expected_counts_of(pieces, logp, batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    sums = words.where("count > 0").select("word").mapInArrow(
        run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    rows = sums.collect()  # at most one row per piece of the vocabulary
    if not rows:
        return start
    total = np.where(np.isfinite(start), SMOOTH, 0.0)
    for r in rows:
        total[r.piece] += r.n
    return np.log(total / total.sum(), out=np.full(len(total), -np.inf), where=total > 0)


def score_words(words: DataFrame, model: str, logp: np.ndarray, tokens: int, once: int, ends: int
                ) -> DataFrame:
    """``words`` with ``log10p``, the log10 probability of each word. ``tokens`` counts training
    words, ``once`` those seen once, ``ends`` the training texts."""
    shared = words.sparkSession.sparkContext.broadcast(logp)
    new = max(once, 1) / tokens if tokens else 1.0
    inside = math.log(tokens / (tokens + ends)) if tokens else math.log(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, values = pieces_of(model), shared.value
        for batch in batches:
            logs = word_logs_of(pieces, values, batch.column(0).to_pylist()) + math.log(new)
            count = batch.column(1).to_numpy()
            with np.errstate(divide="ignore"):
                whole = np.log((1 - new) * count / max(tokens, 1))
            logs = (np.logaddexp(logs, whole) + inside) / _LN10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())],
                                             names=["word", "count", "uses", "log10p"])

    return words.select("word", "count", "uses").mapInArrow(
        run, "word string, count long, uses long, log10p double")


def _head(words: DataFrame) -> pa.Table:
    """The most used words, no more than ``HEAD``: all with at least so many uses and no longer than
    ``HEAD_BYTES``."""
    words = words.where(F.octet_length("word") <= HEAD_BYTES)
    least, n = 1, 0
    steps = words.groupBy(F.floor(F.log2("uses") * 4).alias("step")).count().orderBy(F.desc("step"))
    for r in steps.collect():  # four rows for each doubling of the largest count
        n += r["count"]
        if n > HEAD:
            least = r.step + 1
            break
        least = r.step
    frequent = words.where(F.floor(F.log2("uses") * 4) >= int(least))
    return frequent.select("word", "count", "log10p").toArrow()


def score_texts(docs: DataFrame, words: DataFrame, key: str, text: str, train_tokens: int,
                distinct: int, ends: int, end_log10p: float) -> DataFrame:
    """Per text: ``key``, ``n_tokens``, ``n_known``, ``base_score`` and ``score``."""
    spark = docs.sparkSession
    sink = pa.BufferOutputStream()
    head = _head(words).combine_chunks()
    with pa.ipc.new_stream(sink, head.schema) as writer:
        writer.write_table(head)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    whole = train_tokens + distinct + 1
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        names = known["word"].combine_chunks() if known.num_rows else pa.array([], pa.string())
        count = np.append(known["count"].to_numpy(), 0)
        logs = np.append(known["log10p"].to_numpy(), 0.0)
        for batch in batches:
            n = batch.num_rows
            coded, of = split_words(batch.column(2))
            place = pc.fill_null(pc.index_in(coded.dictionary, names), len(names)).to_numpy()
            index = coded.indices.to_numpy()
            token = place[index]
            here = token < len(names)
            base = np.where(np.arange(len(count)) < len(names), np.log10((count + 1) / whole), 0.0)
            sums = [np.bincount(of, minlength=n), np.bincount(of, count[token] > 0, n),
                    np.bincount(of, base[token], n), np.bincount(of, logs[token], n)]
            pair, times = np.unique(of[~here] * max(1, len(coded.dictionary)) + index[~here],
                                    return_counts=True)
            row, word = np.divmod(pair, max(1, len(coded.dictionary)))
            bounds = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sums[0].astype(np.int64)),
                 pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(float)),
                 pa.array(sums[3].astype(float)),
                 pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(word))),
                 pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64)))],
                names=["row", "key", "n", "known", "base", "score", "words", "times"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"),
                           docs[text].alias("text"))
    first = cut(numbered.mapInArrow(
        run, f"row long, key {kind}, n long, known long, base double, score double, "
             "words array<string>, times array<long>"), "lm-texts")
    c = F.col
    rare = (first.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
            .select("row", c("w.words").alias("word"), c("w.times").alias("times"))
            .join(words.select("word", "count", "log10p"), "word"))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(c("count") > 0, c("times")).otherwise(0)).alias("known2"),
        F.sum(c("times") * F.log10((c("count") + 1) / F.lit(float(whole)))).alias("base2"),
        F.sum(c("times") * c("log10p")).alias("score2"))
    add = lambda a, b: c(a) + F.coalesce(c(b), F.lit(0))
    return first.drop("words", "times").join(rare, "row", "left").select(
        c("key").alias(key), (c("n") + 1).alias("n_tokens"),
        (add("known", "known2") + (1 if ends else 0)).alias("n_known"),
        (add("base", "base2") + math.log10((ends + 1) / whole)).alias("base_score"),
        (add("score", "score2") + end_log10p).alias("score"))


def score(docs: DataFrame, model: str, train: str, key: str = "doc_id", text: str = "text"
          ) -> DataFrame:
    """Per text of ``docs``: ``key``, ``n_tokens`` and ``n_known`` (the end included),
    ``train_tokens``, ``base_score`` (add-one unigram words) and ``score`` (log10 probability of
    the text over all its segmentations). The boolean column ``train`` says what to learn from."""
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"),
                       docs[train].alias("train"))
    counted = cut(count_words(docs, "text", "train"), "lm-counts")
    seen = F.col("count") > 0
    tokens, distinct, once = (x or 0 for x in counted.agg(
        F.sum("count"), F.sum(seen.cast("long")), F.sum((F.col("count") == 1).cast("long"))).first())
    ends = docs.where("train").count()
    words = cut(score_words(counted, model, learn(counted, model), tokens, once, ends), "lm-words")
    end_log10p = math.log10(ends / (tokens + ends)) if ends else math.log10(0.5)
    scored = score_texts(docs, words, "key", "text", tokens + ends, distinct + (1 if ends else 0),
                         ends, end_log10p)
    return scored.withColumn("train_tokens", F.lit(int(tokens + ends)).cast("long")
                             ).withColumnRenamed("key", key)
