"""Hashes of the words and shingles of whole Arrow batches, in numpy.

A word is a run of bytes other than white space (space, 9 to 13), with A-Z taken as a-z where asked. Its hash is a polynomial in a
fixed odd base over random 64-bit values of its bytes, finished by a mixing step; a word of over LONG bytes is hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_IS_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LONG = 4096
#: Bytes that are worked on at once: about 30 times as much memory is in use meanwhile.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.full(2 * SLICE, _BASE, dtype=np.uint64), dtype=np.uint64)
_INVERSE = np.cumprod(np.full(2 * SLICE, pow(_BASE, -1, 1 << 64), dtype=np.uint64), dtype=np.uint64)
#: One odd multiplier for each place in a shingle.
_PLACE = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (one more at the end); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most SLICE bytes together; a longer text is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield first, last
        first = last


def _hashes(data: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; a word also ends at each of `breaks`."""
    if lower:
        data = _LOWER[data]
    solid = ~_IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = breaks[breaks < len(data)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    h = mixed(np.add.reduceat(_BYTE[data] * _POWER[: len(data)], starts) * _INVERSE[starts])
    limits = np.append(starts[1:], len(data))
    for k in np.flatnonzero(limits - starts > LONG):
        word = data[starts[k] : limits[k]]
        word = word[: int(np.argmin(solid[starts[k] : limits[k]]))] if not solid[starts[k] : limits[k]].all() else word
        if len(word) > LONG:
            h[k] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    return h, starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of these texts in order, and the place of each text's first word among them (one more at the end)."""
    offsets = offsets - offsets[0]
    if len(data) <= 2 * SLICE:
        h, starts = _hashes(data, offsets, lower)
        return h, np.searchsorted(starts, offsets)
    # One long text: cut at white space; a word without any for over a slice is hashed by itself.
    parts, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
        if end < len(data) and len(spaces):
            end = at + int(spaces[-1]) + 1
        elif end < len(data):
            while end < len(data):
                block = np.flatnonzero(_IS_SPACE[data[end : end + SLICE]])
                end += int(block[0]) if len(block) else min(SLICE, len(data) - end)
                if len(block):
                    break
            word = _LOWER[data[at:end]] if lower else data[at:end]
            parts.append(np.array([int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")], dtype=np.uint64))
            at = end
            continue
        parts.append(_hashes(data[at:end], np.zeros(1, np.int64), lower)[0])
        at = end
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return h, np.array([0, len(h)])


#: Classes of bytes: 0 white space, 1 letters, digits and all beyond ASCII, 2 the rest.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[_IS_SPACE] = 0


def token_hashes(data: np.ndarray, offsets: np.ndarray, slice_bytes: int = 2 * SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits and the runs of other signs, case kept, and the text (0 on) that each belongs to.

    Taken in parts of `slice_bytes`; a run that lies across parts, however long, is one: its polynomial goes on in the next part.
    """
    parts, texts = [], []
    offsets = offsets - offsets[0]
    open_sum, open_length, open_kind, open_text = 0, 0, 0, 0

    def close() -> None:
        nonlocal open_length
        if open_length:
            parts.append(mixed(np.array([open_sum], dtype=np.uint64)))
            texts.append(np.array([open_text], dtype=np.int64))
            open_length = 0

    for at in range(0, len(data), slice_bytes):
        part = data[at : at + slice_bytes]
        kind = _KIND[part]
        begins = kind != 0
        begins[1:] &= kind[1:] != kind[:-1]
        inner = offsets[(offsets >= at) & (offsets < at + len(part))] - at
        begins[inner] = kind[inner] != 0
        starts = np.flatnonzero(begins)
        if not len(starts):
            close()
            continue
        sums = np.add.reduceat(_BYTE[part] * _POWER[: len(part)], starts) * _INVERSE[starts]
        of_text = np.searchsorted(offsets, starts + at, "right") - 1
        goes_on = bool(open_length) and starts[0] == 0 and kind[0] == open_kind and not (len(inner) and inner[0] == 0)
        if goes_on:
            first = int(starts[1]) if len(starts) > 1 else len(part)
            spaces = np.flatnonzero(kind[:first] == 0)
            open_sum = (open_sum + pow(_BASE, open_length, 1 << 64) * int(sums[0])) % (1 << 64)
            open_length += int(spaces[0]) if len(spaces) else first
            if len(starts) == 1 and not len(spaces):
                continue
            close()
            starts, sums, of_text = starts[1:], sums[1:], of_text[1:]
        close()
        if len(starts) and kind[-1] != 0:
            open_sum, open_length, open_kind, open_text = int(sums[-1]), len(part) - int(starts[-1]), int(kind[-1]), int(of_text[-1])
            sums, of_text = sums[:-1], of_text[:-1]
        parts.append(mixed(sums))
        texts.append(of_text)
    close()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(texts)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - n + 1] * _PLACE[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * _PLACE[k]
    return mixed(total + np.uint64(n))


def shingle_set(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text; a text of fewer words is one shingle, one of no words none."""
    return np.unique(grams(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)


def texts_as_words(column: pa.Array, lower: bool = True) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        h, places = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1], lower)
        for k in range(last - first):
            yield h[places[k] : places[k + 1]]
