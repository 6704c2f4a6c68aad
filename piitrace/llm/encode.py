"""Whole-text encoding with vocabularies of the ``tokenizers`` library, one Arrow batch at a time.

A corpus repeats its words, so a batch is cut into chunks, every distinct chunk is
encoded once, and the ids of a text are gathered by chunk number. Two kinds of
vocabulary are known, cut at single spaces and at ASCII white space:

``spaced``  byte-level BPE whose pre-tokenizer keeps a space in front of a word;
``dropped`` word BPE that lower-cases and drops white space.

Texts in which a cut at a space would change the result (runs of white space around a
space, strings of special tokens) go through the library as a whole. Null is empty.
"""

from __future__ import annotations

import gc
import json
import re
import string
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words and chunks whose ids a Python worker remembers; beyond it they are encoded anew.
MEMO = 500_000
#: Marks that the split patterns keep together, and apart from a word before them.
MARKS = string.punctuation
#: Bytes of text whose chunks are told apart at a time; a longer text is a part of its own.
PART = 8 << 20
#: Chunks whose ids are gathered at a time.
GATHER = 400_000

#: White space as the regex engine of the pre-tokenizers has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The split patterns of the two pre-tokenizers. L letters, N numbers, S white space.
SPACED = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
DROPPED = "'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^SLN]+"


@cache
def _categories() -> np.ndarray:
    """The two letters of every code point's general category."""
    return np.array([unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)], "U2").view(
        np.uint32).reshape(-1, 2)


def _ranges(kind: str) -> str:
    """All code points of a general category, or of all that begin so, as ranges of a character class."""
    inside = (_categories()[:, :len(kind)] == [ord(x) for x in kind]).all(axis=1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))).tolist()
    return "".join(f"{re.escape(chr(x))}-{re.escape(chr(y - 1))}" for x, y in zip(edge[::2], edge[1::2], strict=True))


def split_pattern(pattern: str) -> re.Pattern:
    classes = {"L": _ranges("L"), "N": _ranges("N"), "S": SPACE}
    return re.compile(re.sub(r"(?<![a-z'])[LNS](?=[LNS\]])", lambda m: classes[m[0]], pattern))


def byte_letters() -> dict[int, str]:
    """Byte -> printable letter of byte-level vocabularies: printable bytes stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def lower_each(text: str) -> str:
    """Lower case letter by letter, without rules that look at neighbours."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.merges = spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spaced = not spec["model"].get("end_of_word_suffix")
        self._split = split_pattern(SPACED if self.spaced else DROPPED).findall
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self._letters = str.maketrans({chr(b): c for b, c in letters.items()})
        self._space = letters[0x20]
        #: Code points that Python's tables do not know; the library's may.
        self._unassigned = re.compile(f"[{_ranges('Cn')}]").search
        self._model = self.tok.model
        #: Ids by word or normal chunk. A string that is both has the same ids as either.
        self._memo: dict[str, bytes] = {}
        gap = f"[{SPACE}]"
        self.whole = "|".join([f"{gap} | {gap}", *map(re.escape, self.special)])

    def forget(self) -> None:
        """Give the memory of remembered words and chunks back."""
        self._memo.clear()
        pa.default_memory_pool().release_unused()

    def foreign(self, chunk: str) -> bool:
        """Whether a chunk has to go through the library: strings of special tokens, unknown code points."""
        return ("<|" in chunk and any(s in chunk for s in self.special)
                or not chunk.isascii() and not chunk.isprintable()  # no unassigned one is printable
                and self._unassigned(chunk) is not None)

    def normal(self, text: str) -> str:
        """What the vocabulary's split pattern is applied to, but for white space."""
        if self.spaced:
            return text
        return lower_each(text if text.isascii() else unicodedata.normalize("NFC", text))

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        return self._words(self.normal(chunk))

    def _words(self, chunk: str) -> list[str]:
        """The pre-tokens of a normal chunk. Plain words, also with marks behind them, need no pattern."""
        body = chunk.rstrip(MARKS)
        if (body[1:] if self.spaced and body[:1] == " " else body).isalpha():
            return [body, chunk[len(body):]] if len(body) < len(chunk) else [body]
        return self._split(chunk)

    def word_ids(self, word: str) -> bytes:
        """Ids of one pre-token from the library's model, as unsigned 32-bit numbers."""
        if word.isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            if word[0] == " ":
                word = self._space + word[1:]
        elif not (word.isascii() and word.isalpha()):
            word = word.encode("utf-8").decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def new_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not remembered."""
        return list(map(self.word_ids, words))

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Distinct unknown words are encoded once."""
        memo, normal, words = self._memo, chunks, self._words
        together = " ".join(chunks)
        strange = ()
        if "<|" in together or not together.isprintable():
            strange = [i for i, c in enumerate(chunks) if self.foreign(c)]
        if not self.spaced:  # no chunk has a space, and none is made, moved or merged
            normal = self.normal(together).split(" ")
        del together
        out = list(map(memo.get, normal))
        for i in strange:  # not remembered: their normal forms may be those of others
            out[i] = self.text_ids(chunks[i]).tobytes()
        rest = [i for i, b in enumerate(out) if b is None]
        if not rest:
            return out
        # A chunk is one word or a list of words.
        split = [n if n.isalpha() or n[:1] == " " and n[1:].isalpha() else words(n)
                 for n in map(normal.__getitem__, rest)]
        fresh = {w for w in split if w.__class__ is str and w not in memo}
        fresh.update(w for ws in split if ws.__class__ is list for w in ws if w not in memo)
        found = dict(zip(fresh, self.new_words(list(fresh)), strict=True))
        known = memo
        if len(memo) + len(found) <= MEMO:
            memo.update(found)
        elif found:
            known = _Both(memo, found)
        get, room = known.__getitem__, MEMO - len(memo)
        for i, ws in zip(rest, split, strict=True):
            if ws.__class__ is str:
                out[i] = get(ws)
                continue
            ids = get(ws[0]) + get(ws[1]) if len(ws) == 2 else b"".join(map(get, ws))
            out[i] = ids
            if room > 0:
                memo[normal[i]] = ids
                room -= 1
        return out

    def text_ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        begin = 0
        while begin < len(texts):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + PART, "right")))
            yield from self._part(pc.fill_null(texts.slice(begin, stop - begin), ""))
            begin = stop

    def _part(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = {}
        if self.spaced:
            mask = pc.match_substring_regex(texts, self.whole)
            if pc.any(mask).as_py():
                at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
                odd = {int(i): self.text_ids(texts[int(i)].as_py()) for i in at}
                texts = pc.if_else(mask, "", texts)
        pieces = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = pieces.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        key = coded.indices.to_numpy()
        if self.spaced:  # all but the first chunk of a text have a space before them
            names, key = chunks, key.astype(np.int64)
            first = np.zeros(len(key), bool)
            first[bounds[:-1]] = True
            key = key + len(names) * ~first
            present = np.zeros(2 * len(names), bool)
            present[key] = True
            chunks = [names[k] if k < len(names) else " " + names[k - len(names)]
                      for k in np.flatnonzero(present).tolist()]
            key = (np.cumsum(present) - 1)[key]
            del names
        collecting = gc.isenabled()
        gc.disable()  # millions of small lists, none of them in a cycle
        try:
            ids = pa.array(self.chunk_ids(chunks), pa.large_binary())
        finally:
            if collecting:
                gc.enable()
        del pieces, coded, chunks
        n, i = len(texts), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + GATHER, "right")) - 1)
            part = ids.take(pa.array(key[bounds[i]:bounds[j]]))
            _, ends, data = part.buffers()
            ends = np.frombuffer(ends, np.int64, len(part) + 1) // 4
            flat = np.frombuffer(data or b"", "<u4", int(ends[-1]))
            cut = ends[bounds[i:j + 1] - bounds[i]].tolist()
            for k in range(i, j):
                yield odd[k] if k in odd else flat[cut[k - i]:cut[k - i + 1]]
            i = j


class _Both:
    """Looks a word up in two dictionaries."""

    def __init__(self, one: dict, two: dict):
        self.one, self.two = one, two

    def __getitem__(self, word: str) -> bytes:
        got = self.one.get(word)
        return self.two[word] if got is None else got


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: Callable[[str], Encoder] = Encoder) -> Encoder:
    """The process's encoder for a vocabulary file; workers keep it from task to task."""
    key = (path, kind)
    if key not in _encoders:
        _encoders[key] = kind(path)
    return _encoders[key]
