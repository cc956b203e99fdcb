"""Words of many texts at once: NumPy arrays over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


#: Of each byte, a random value; letters A-Z have those of a-z.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE[65:91] = BYTE[97:123]
_WEIGHTS = np.zeros(0, np.uint64)


def weights(n: int) -> np.ndarray:
    """Random odd weights of the first n places in a word. They are no powers of one number: words of a regular build would have equal sums."""
    global _WEIGHTS
    if len(_WEIGHTS) < n:
        _WEIGHTS = mix(np.arange(1, max(n, 2 * len(_WEIGHTS), 256) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return _WEIGHTS


def pieces(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of a string column of at most limit bytes, or of one row. Null is an empty text."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_class(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(i) for i in range(256)])


#: [^\x20\x09-\x0D]
NOT_SPACE = word_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], once A-Z are a-z
ALNUM = word_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: letters, once other characters beyond ASCII are taken out
LETTERS = word_class(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes of the class within a text, and the number of its text."""
    inside = kind[data]
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[1:n] = ~inside[:-1] if n else False
    begins[offsets] = True
    starts = np.flatnonzero(begins[:n] & inside)
    after = np.zeros(n + 1, bool)
    after[1:] = inside
    stops = np.ones(n + 1, bool)
    stops[:n] = ~inside
    stops[offsets] = True
    ends = np.flatnonzero(after & stops)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word, without regard to the case of A-Z; it depends on the word's bytes only.

    With prefixes, a row for the whole words and one for each of these numbers of leading bytes; 0 for words that are no
    longer.
    """
    if not len(starts):
        return np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64)
    n = int(ends[-1])
    at = np.zeros(n, np.int64)
    at[starts] = starts
    at = np.arange(n) - np.maximum.accumulate(at)
    lengths = ends - starts
    weight = weights(int(at.max()) + 1)[at]
    weight *= BYTE[data[:n]]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(weight, out=total[1:])
    whole = mix((total[ends] - total[starts]) ^ (lengths.astype(np.uint64) << np.uint64(48)))
    if not prefixes:
        return whole
    out = [whole]
    for m in prefixes:
        part = mix((total[np.minimum(starts + m, n)] - total[starts]) ^ np.uint64((m << 48) + (1 << 60)))
        out.append(np.where(lengths > m, part, np.uint64(0)))
    return np.stack(out)


def lowered(column: pa.Array) -> pa.Array:
    """Lower-case texts in which what is neither ASCII nor a letter is a space."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\x00-\x7F\p{L}\p{M}]+", " ")
