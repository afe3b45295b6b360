"""Small shared expressions of the corpus operators."""

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import functions as F

# A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text="text"):
    """The whole text; a NULL text is an empty one."""
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, UPPER.lower())


def split_words(column):
    """Array of the words of a text; empty for a text without words."""
    return F.filter(F.split(column, GAP), lambda w: w != "")


def fold(doc_id, parts):
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def tidied(run):
    """A mapInArrow function that gives its freed memory back to the system when its task ends.

    Workers are used again by later tasks and stages, and would otherwise keep the most they ever held.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return wrapped
