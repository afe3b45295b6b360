"""Rolling hashes over sequences of 64-bit word hashes, many documents at a time."""

import numpy as np

SLAB_WORDS = 1 << 20
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(values):
    """A bijective mix of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base, n):
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def sequence_hashes(words, size, which=0):
    """Hash of every ``size`` consecutive words; depends on the words alone, not on where they stand.

    With prefix sums of w[i] * b^i, the sum over a window times b^-i is its polynomial (b is odd, so
    it has an inverse modulo 2^64).
    """
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    base = _ODD[which]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    terms = mixed(words + base) * _powers(base, len(words))[:-1]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
    return mixed((sums[size:] - sums[:-size]) * _powers(inverse, len(words))[: len(words) - size + 1])


def sliding_min(values, size):
    """Minimum of every ``size`` consecutive values."""
    span, low = 1, values
    while span * 2 <= size:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return low if span == size else np.minimum(low[: len(values) - size + 1], low[size - span :][: len(values) - size + 1])


def row_slabs(column, most=SLAB_WORDS):
    """(first row, words, row edges) of groups of rows of a list column, of bounded total size."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        edges = offsets[row : stop + 1] - offsets[row]
        yield row, flat[offsets[row] : offsets[stop]], edges
        row = stop


def inside(edges, n_starts, size):
    """Row of each start position, -1 where ``size`` words do not fit into the row."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:n_starts]
    return np.where(np.arange(n_starts) + size <= edges[owner + 1], owner, -1)


_GAP = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURNS = (np.arange(1, 129, dtype=np.uint64) * _ODD[0]) | np.uint64(1)
SLAB_BYTES = 1 << 20


def word_slabs(texts, most=SLAB_BYTES):
    """(first row, word hashes, row edges) of groups of rows of a string column without NULLs."""
    for row, hashes, edges, *_ in byte_slabs(texts, most):
        yield row, hashes, edges


def byte_slabs(texts, most=SLAB_BYTES):
    """As ``word_slabs``, with the lower-cased bytes and where in them each word begins and ends.

    Works on the UTF-8 bytes: A-Z count as a-z, words end at ASCII white space.
    """
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row, n = 0, len(texts)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        starts = offsets[row : stop + 1] - offsets[row]
        points = _LOWER[data[offsets[row] : offsets[stop]]]
        word = ~_GAP[points]
        fresh = np.ones(len(points), dtype=bool)
        fresh[1:] = ~word[:-1]
        fresh[starts[:-1][starts[:-1] < len(points)]] = True
        begins = np.flatnonzero(word & fresh)
        place = np.flatnonzero(word)
        to = np.searchsorted(place, begins)
        at = np.arange(len(place)) - np.repeat(to, np.diff(np.append(to, len(place))))
        terms = (points[place].astype(np.uint64) + np.uint64(7)) * _TURNS[at & 127] + (at >> 7).astype(np.uint64)
        terms = (terms ^ (terms >> np.uint64(29))) * _MIX
        hashes = mixed(np.add.reduceat(terms, to)) if len(to) else np.zeros(0, dtype=np.uint64)
        ends = place[np.append(to[1:], len(place)) - 1] + 1 if len(to) else begins
        yield row, hashes, np.searchsorted(begins, starts), points, begins, ends
        row = stop


def shingle_sets(words, edges, size):
    """Distinct shingle hashes of each row, ascending, and their row edges.

    A row with fewer words than a shingle has its whole sequence as one; a row without words none.
    """
    grams = sequence_hashes(words, size)
    owner = inside(edges, len(grams), size) if len(grams) else np.zeros(0, dtype=np.int64)
    values, owner = grams[owner >= 0], owner[owner >= 0]
    counts = np.diff(edges)
    for short in range(1, size):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            values = np.concatenate([values, mixed(sequence_hashes(words, short)[edges[rows]] + np.uint64(short))])
            owner = np.concatenate([owner, rows])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(edges)))
