"""Word hashes of whole texts, computed on the bytes of an Arrow batch at once.

A word's number is a polynomial of its bytes modulo 2**64, scrambled with its length.
Differences of prefix sums give all words of a batch without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer text is handled by itself.
SLICE = 1 << 19
_R = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size, found = max(SLICE + 1, n + 1), []
        for r in (_R, pow(_R, -1, 1 << 64)):
            steps = np.full(size + 1, r, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps))
        _powers[:] = found
    return _powers[0], _powers[1]


def byte_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """For every byte whether it belongs to a word: all but the given ranges."""
    out = np.ones(256, bool)
    for low, high in outside:
        out[low:high + 1] = False
    return out


#: ``[^\x20\x09-\x0D]+``
UNSPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALPHANUMERIC = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Everything but the line feed.
LINES = byte_class([(0x0A, 0x0A)])


def scan(texts: pa.Array, inside: np.ndarray, lower: bool = True
         ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole texts: the first text, how many, and for each word its text (counted from the
    first), its 64-bit number, and its first byte and the byte behind it in its text.

    Null is empty; A-Z are lower-cased unless ``lower`` is off.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    if texts.offset:
        texts = pa.concat_arrays([texts])
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1).astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(bounds, bounds[begin] + SLICE, "right")) - 1
        end = min(len(texts), max(begin + 1, end))
        part = data[bounds[begin]:bounds[end]]
        edge = bounds[begin:end + 1] - bounds[begin]
        word = inside[part]
        size = len(part)
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        fresh = edge[:-1][edge[:-1] < size]
        starts[fresh] = word[fresh]
        stops = np.zeros(size + 1, bool)
        stops[1:] = word
        stops[:-1] &= ~word
        stops[edge[1:]] |= np.concatenate([[False], word])[edge[1:]]
        first, last = np.flatnonzero(starts), np.flatnonzero(stops)
        up, down = _power(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        length = (last - first).astype(np.uint64)
        number = mix((sums[last] - sums[first]) * down[first] + length * np.uint64(_R))
        of = np.searchsorted(edge, first, "right") - 1
        yield begin, end - begin, of, number, first - edge[of], last - edge[of]
        begin = end


#: Odd multipliers that tell the places of a word window apart.
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(number: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all windows of k words within one text, and where each begins."""
    n = len(number) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += number[j:j + n] * _PLACE[j]
    at = np.flatnonzero(of[:n] == of[k - 1:])
    return mix(total[at] + np.uint64(k)), at
