"""Words of a batch of texts as 64-bit hashes, found with array operations alone."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
#: A random odd base, its inverse modulo 2**64, and a random value per byte: a word's hash is a polynomial over them.
BASE = np.uint64(int(_rng.integers(1 << 62, 1 << 63)) | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {int(BASE): np.ones(1, np.uint64), int(INVERSE): np.ones(1, np.uint64)}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Also splits at ASCII punctuation; used where wording counts and typography does not.
PUNCTUATED = WHITE.copy()
PUNCTUATED[[c for c in range(128) if not chr(c).isalnum()]] = True


#: First bytes of letters of scripts without spaces (kana and Han; Thai and Lao; Burmese and Khmer), with the second bytes that go with them.
_EACH = {b: range(0x80, 0xC0) for b in range(0xE3, 0xEA)} | {0xE0: range(0xB8, 0xBC), 0xE1: (0x80, 0x81, 0x82, 0x9E, 0x9F)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; what an earlier call computed is used again."""
    have = _powers[int(base)]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        if size <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case, byte for byte."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if len(data) > 1:
        tail = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[tail] += 0x20
    return out


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the index of its first word (one more: their number)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def letters_alone(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Where letters of scripts without spaces start, and where what they part goes on; None if there are none."""
    if not len(data) or not np.isin(data, list(_EACH)).any():
        return None
    lead = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] <= 0xE9)) if len(data) > 2 else np.zeros(0, np.int64)
    second = data[lead + 1]
    own = np.zeros(len(lead), bool)
    for first, seconds in _EACH.items():
        own |= (data[lead] == first) & np.isin(second, list(seconds))
    lead = lead[own & ~((data[lead] == 0xE3) & (second == 0x80))]  # not the punctuation before kana
    return lead, lead + 3


def spans_and_letters(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = PUNCTUATED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `spans`, but every letter of a script without spaces is a word of its own."""
    found = letters_alone(data, breaks)
    if found is None or not len(found[0]):
        return spans(data, offsets, breaks)
    starts, ends, _ = spans(data, offsets, breaks)
    cuts = np.concatenate(found)
    inside = cuts[(np.searchsorted(starts, cuts, "right") - 1 >= 0)]
    at = np.searchsorted(starts, inside, "right") - 1
    inside = np.unique(inside[(inside > starts[at]) & (inside < ends[at])])
    starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
    return starts, ends, np.searchsorted(starts, offsets)


def running_sums(data: np.ndarray) -> np.ndarray:
    """What `hashes` needs of the bytes; for several calls on the same ones it is made once."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:], dtype=np.uint64)
    return sums


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, which depends on its bytes alone."""
    sums = running_sums(data) if sums is None else sums
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts])


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row: entry i covers words i to i+k-1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:], dtype=np.uint64)
    return mixed((sums[k:] - sums[:-k]) * powers(INVERSE, n))
