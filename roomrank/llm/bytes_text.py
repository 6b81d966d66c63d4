"""Numpy kernels over whole Arrow batches of texts: flat UTF-8 bytes, words, rolling fingerprints.

Every kernel works on the concatenated bytes of some consecutive rows (`slices`), so a task never
holds more than a slice of about a megabyte (or one longer text) in 64-bit arrays. Fingerprints are
polynomial hashes modulo 2**64 taken from one running sum, finished with a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_A = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_B = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xD6E8FEB86659FD93
STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_LETTER = np.ones(256, bool)  # ASCII signs, digits and white space; other bytes are letters
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept per worker up to a few slices' length."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the result depends on every bit of h. Works in place on a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column one after another, and the n + 1 starts; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[starts[0]:starts[-1]]
    return data, starts - starts[0]


def slices(col: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, starts) of consecutive rows with about `most` bytes; a longer text is a slice of its own."""
    data, starts = flat(col)
    n, lo = len(starts) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, data[starts[lo]:starts[hi]], starts[lo:hi + 1] - starts[lo]
        lo = hi


def prefix_sums(data: np.ndarray, table: np.ndarray = BYTE_A, base: int = BASE_A) -> np.ndarray:
    """Running sums S with S[e] - S[s] = base**s * fingerprint of data[s:e]."""
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    v = table[data]
    v *= powers(base, len(data) + 1)[0][:len(data)]
    np.cumsum(v, out=s[1:])
    return s


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """Fingerprints of data[start:end] from `prefix_sums`."""
    h = sums[end] - sums[start]
    h *= powers(base, len(sums))[1][start]
    return mix(h)


def words(data: np.ndarray, starts: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes outside `gaps`, ASCII white space), and per text the first word's place (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    solid = ~gaps[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    ws = np.flatnonzero(first)
    return ws, np.flatnonzero(last) + 1, np.searchsorted(ws, starts)


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray, lower: bool = True) -> np.ndarray:
    """Fingerprint of each word, A-Z lower-cased if asked."""
    return spans(prefix_sums(LOWER[data] if lower else data), ws, we)


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capital letters U+00C0 to U+00DE in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    return out


def runs_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of each run of `width` consecutive word hashes (over text borders too; callers mask those)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j:j + n] * STEP[j]
    return mix(out)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of the distinct shingles of each text, ascending by both.

    A text with fewer words than `width` has its whole sequence as the one shingle; one without words has none.
    """
    counts = np.diff(bounds)
    row_of_word = np.repeat(np.arange(len(counts)), counts)
    full = runs_of(hashes, width)
    at = np.flatnonzero(row_of_word[:len(full)] == row_of_word[width - 1:]) if len(full) else np.zeros(0, np.int64)
    rows, prints = [row_of_word[at]], [full[at]]
    for short in np.flatnonzero((counts > 0) & (counts < width)):
        h = hashes[bounds[short]:bounds[short + 1]]
        rows.append(np.array([short]))
        prints.append(mix((h * STEP[:len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))))
    row, fp = np.concatenate(rows), np.concatenate(prints)
    order = np.lexsort((fp, row))
    row, fp = row[order], fp[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (fp[1:] != fp[:-1])
    return row[keep], fp[keep]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+lengths[0]-1, starts[1].., one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
