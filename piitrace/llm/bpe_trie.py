"""Byte-pair encoding of distinct words by one walk through their prefix trie, and decoding.

Byte-pair encodings have a property that makes prefixes share work: the encoding of a
prefix is the encoding of a shorter prefix followed by one last token. A state of the
trie therefore needs only that last token. For a new letter the last token is the only
vocabulary entry ending there that may stand after the last token of the prefix it
leaves; two tokens may stand side by side if no merge across their seam would have come
before the merges that built them.

The distinct new words of an Arrow batch, in byte order, are their trie in depth-first
order: the states on the path to a word are a stack, of which the next word keeps as
much as the prefix it shares. Every shared prefix is encoded once. Following last tokens
back from the end of a word gives its ids. Words are found, and ids of texts put
together, as in ``encode``.

Defined results: null is an empty text and has no ids; repeated rows and null or equal keys are
rows of their own; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from piitrace.llm.encode import Encoder, encoder

#: Seams between two tokens that a Python worker remembers.
MEMO_SEAMS = 300_000
#: Rank of a merge that never comes.
NEVER = 1 << 60


class TrieEncoder(Encoder):
    """An encoder of byte-level vocabularies whose word ids come from the trie walk."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.spaced:
            raise ValueError("the trie walk needs a byte-level vocabulary")
        vocabulary = self.vocabulary
        as_bytes = {i: bytes(self.byte_of[c] for c in name) for name, i in vocabulary.items()}
        #: (left, right) -> rank, and token -> (left, right, rank) of the merge that makes it.
        self._rank, self._made = {}, {}
        for rank, pair in enumerate(self.merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ids = (vocabulary[left], vocabulary[right])
            self._rank[ids] = rank
            self._made[vocabulary[left + right]] = (*ids, rank)
        # Entries that their own letters do not encode to can never be a last token.
        self._token = {b: i for i, b in as_bytes.items()
                       if len(b) == 1 or self._stands_alone(i)}
        self._longest = max(map(len, self._token))
        self._size = {i: len(b) for b, i in self._token.items()}
        self._seams: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, int], tuple] = {}
        top = max([*as_bytes, *self.special.values()])
        self._bytes = [as_bytes.get(i, b"") for i in range(top + 1)]
        for name, i in self.special.items():
            self._bytes[i] = name.encode("utf-8")

    def _stands_alone(self, token: int) -> bool:
        name = self._model.id_to_token(token)
        return [t.id for t in self._model.tokenize(name)] == [token]

    def _edge(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The tokens that touched this side of ``token`` while it was built, each with the
        rank of the merge that took it up."""
        key = (token, side)
        if key not in self._edges:
            out, until = [], NEVER
            while True:
                out.append((token, until))
                if token not in self._made:
                    break
                until = self._made[token][2]
                token = self._made[token][side]
            self._edges[key] = tuple(out)
        return self._edges[key]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are when their letters are encoded together.

        A merge across the seam comes first if its rank is below the ranks at which its
        two parts are taken up; of equal ranks the merge further left comes first.
        """
        rank = self._rank.get
        for a, taken_a in self._edge(left, 1):
            for b, taken_b in self._edge(right, 0):
                r = rank((a, b))
                if r is not None and r < taken_a and r <= taken_b:
                    return False
        return True

    def new_words(self, words: list[str]) -> list[bytes]:
        token, size, longest = self._token.get, self._size, self._longest
        seams = self._seams
        coded = [w.encode("utf-8") for w in words]
        out: list[bytes] = [b""] * len(words)
        last = [-1]  # last[d]: the last token of the first d letters of the path
        path = b""
        for at in sorted(range(len(coded)), key=coded.__getitem__):
            word = coded[at]
            shared = 0
            for x, y in zip(path, word):  # noqa: B905  one is longer
                if x != y:
                    break
                shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest), end):
                    t = token(word[begin:end])
                    if t is None:
                        continue
                    u = last[begin]
                    if u < 0:
                        break
                    fits = seams.get((u, t))
                    if fits is None:
                        if len(seams) >= MEMO_SEAMS:
                            seams.clear()
                        fits = seams[u, t] = self.may_follow(u, t)
                    if fits:
                        break
                last.append(t)
            path = word
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[last[end]]
            ids.reverse()
            out[at] = np.array(ids, "<u4").tobytes()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
           decoded: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every text, special tokens written out in a text
    included; if asked for, also what the ids decode to, without another pass over them."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, TrieEncoder)
        for batch in batches:
            at, held, count = 0, [], 0
            for ids in enc.batch(batch.column(1)):
                held.append(ids)
                count += len(ids)
                if count > 1 << 19:
                    yield rows(batch.column(0).slice(at, len(held)), held)
                    at, held, count = at + len(held), [], 0
            if held:
                yield rows(batch.column(0).slice(at, len(held)), held)

    def rows(keys: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
        out = _lists(keys, held)
        if not decoded:
            return out
        texts = map(encoder(tokenizer, TrieEncoder).decode, (ids.tolist() for ids in held))
        return out.append_column("decoded", pa.array(texts, pa.string()))

    chosen = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = f"key {kind}, ids array<int>" + ", decoded string" * decoded
    return chosen.mapInArrow(run, schema).withColumnRenamed("key", key)


def _lists(keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_arrays([keys, lists], names=["key", "ids"])


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and the ``decoded`` text of every row; null ids are none."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, TrieEncoder)
        for batch in batches:
            lists = batch.column(1)
            step = 512
            for at in range(0, len(lists), step):
                part = lists.slice(at, step)
                texts = [enc.decode(x or []) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, step), part, pa.array(texts, pa.string())],
                    names=["key", "ids", "decoded"])

    chosen = encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids"))
    return chosen.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed(
        "key", key)
