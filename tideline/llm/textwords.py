"""Words of many texts at once, as numpy arrays of hashes.

A word is a maximal run of digits, ASCII letters and non-ASCII characters; A-Z count as a-z. In
UTF-8 every byte of a non-ASCII character is 0x80 or more, so the bytes of a text decide alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Bytes that one numpy pass handles; longer only where a single word is longer.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(33)
    return x


def _hash_chunk(data: np.ndarray, breaks: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in bytes; breaks: positions where a text begins."""
    word = is_word[data]
    edge = np.empty(len(word) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    inner = np.unique(breaks[(breaks > 0) & (breaks < len(word))])  # an empty text begins where the next does
    inner = inner[word[inner] & word[inner - 1]]  # two texts that touch: a word ends and one begins
    at = np.flatnonzero(edge)
    if len(inner):
        at = np.sort(np.concatenate([at, inner, inner]))
    starts, ends = at[0::2], at[1::2]
    power, inverse = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins and ends (null: empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, is_word: np.ndarray = IS_WORD):
    """(lower-cased bytes, row ends, starts, ends, hashes, first): word k of row i is first[i] + k.

    is_word: which bytes words are made of, if not those of the module's words.
    """
    data, offsets = column_bytes(column)
    data = LOWER[data]
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data) and is_word[data[end]] and is_word[data[end - 1]]:  # not within a word
            gaps = np.flatnonzero(~is_word[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(~is_word[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        s, e, h = _hash_chunk(data[at:end], inside, is_word)
        parts.append((s + at, e + at, h))
        at = end
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    else:
        starts, ends, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (also across rows; the caller leaves those out)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    last = len(hashes) - n + 1
    out = hashes[:last].copy()
    for k in range(1, n):
        out *= np.uint64(0xD1342543DE82EF95)
        out += hashes[k : k + last]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Cut a batch so that each part's texts have about ``most`` bytes, one text at least."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
