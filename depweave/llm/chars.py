"""Texts as numpy arrays of code points, in slabs of bounded size."""

import numpy as np
import pyarrow.compute as pc

SLAB_CHARS = 1 << 20
SPACE = 32
_TESTS = {"letter": str.isalpha, "upper": str.isupper, "digit": str.isdigit, "gap": lambda c: c in " \t\n\v\f\r"}
_KINDS = {}


def kind(name):
    """Table over the basic plane: ``letter``, ``upper``, ``digit`` or ``gap`` (ASCII white space)."""
    if not _KINDS:
        plane = [chr(c) for c in range(0x10000)]
        for each, test in _TESTS.items():
            _KINDS[each] = np.array([test(c) for c in plane])
    return _KINDS[name]


def is_kind(codes, name):
    """Whether each code point is of a kind; the distinct ones beyond the basic plane are asked for one by one."""
    found = kind(name)[np.minimum(codes, 0xFFFF)]
    beyond = np.flatnonzero(codes > 0xFFFF)
    if len(beyond):
        points, which = np.unique(codes[beyond], return_inverse=True)
        found[beyond] = np.array([_TESTS[name](chr(c)) for c in points])[which]
    return found


def codes(texts):
    """Code points of all texts, each followed by one space, and where each text starts."""
    whole = " ".join(texts) + " "
    points = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


def slabs(texts, most=SLAB_CHARS):
    """Consecutive (first, texts) groups of at most ``most`` characters, or of one longer text."""
    first, size, group = 0, 0, []
    for i, text in enumerate(texts):
        if group and size + len(text) > most:
            yield first, group
            first, size, group = i, 0, []
        group.append(text)
        size += len(text) + 1
    if group:
        yield first, group


def column_slabs(column, most=SLAB_CHARS):
    """Consecutive (first, texts) groups of an Arrow column's texts, NULL as None, of at most ``most`` bytes or of one longer text.

    Only one group at a time is made into Python strings, however large the column.
    """
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if i > first and size + n > most:
            yield first, column.slice(first, i - first).to_pylist()
            first, size = i, 0
        size += n + 1
    if first < len(column):
        yield first, column.slice(first).to_pylist()
