"""A worker holds a slab of a batch, not all of it, as Python strings or results."""

import os
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from depweave.llm import chars, personal, pieces
from depweave.llm.queries import PIECE_MODEL

# 24 MB of text in one batch.
TEXTS = [f"{i} call +1 555 010 9999 " + "one two " * 6_250 for i in range(480)]


def function_of(monkeypatch, make, columns):
    """The function that ``make`` gives to mapInArrow."""
    got = []
    kind = lambda name: SimpleNamespace(name=name, dataType=SimpleNamespace(simpleString=lambda: "string"))
    docs = SimpleNamespace(columns=columns, schema=[kind(c) for c in columns])
    docs.select = lambda *names: docs
    docs.mapInArrow = lambda run, schema: got.append(run) or docs
    docs.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))
    monkeypatch.setattr("pyspark.sql.functions.col", lambda name: SimpleNamespace(alias=lambda to: to))
    make(docs)
    return got[0]


def peak_mb(run, column):
    batch = pa.record_batch({"doc_id": pa.array(range(len(TEXTS))), column: pa.array(TEXTS)})
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, most


def test_masking_holds_a_slab(monkeypatch):
    model = personal.SpanClassifier([], [])
    rows, most = peak_mb(function_of(monkeypatch, lambda docs: personal.mask(docs, model), ["text"]), "text")
    assert rows == len(TEXTS) and most < 12


@pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no vocabulary file")
def test_pieces_hold_a_slab(monkeypatch):
    pieces.model_of(PIECE_MODEL)
    rows, most = peak_mb(function_of(monkeypatch, lambda docs: pieces.encode(docs, PIECE_MODEL), ["doc_id"]), "_whole")
    assert rows == len(TEXTS) and most < 40


def test_column_slabs_keep_every_row():
    texts = ["", None, "é" * 7, "a", None, "b" * 30, "c", ""]
    column = pa.array(["x", *texts]).slice(1)
    found = list(chars.column_slabs(column, 10))
    assert [t for _, group in found for t in group] == texts
    assert [first for first, _ in found] == [sum(len(g) for _, g in found[:i]) for i in range(len(found))]
    assert list(chars.column_slabs(column.slice(0, 0))) == []
