import random
import zlib

import numpy as np
import pytest
from conftest import sentence
from tokenizers import Tokenizer

from depweave.llm import packing
from depweave.llm.queries import BYTE_VOCABULARY


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTE_VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    with open(BYTE_VOCABULARY, encoding="utf-8") as file:
        return packing.ByteEncoder(file.read())


def same_ids(encoder, tokenizer, texts):
    for text, expected in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == expected.ids, repr(text[:80])


def test_ids_are_those_of_the_tokenizers_library(encoder, tokenizer):
    draw = random.Random(3)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n \nb", "a \n", "\n a", "it's  we'll", "x<|endoftext|> y <|endoftext|>", "\x1fa \x85 b  c"]
    texts += ["".join(draw.choice(" \n\tabé1'.,　日😀") for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    texts += [c * 5000 for c in "x \né."]
    same_ids(encoder, tokenizer, texts)


def test_every_code_point_in_context(encoder, tokenizer):
    """All 1.1 million code points, 64 to a text, each between letters, digits, marks and white space."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b1{c}2 !{c}? {c} \n{c}\n  {c}x" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    same_ids(encoder, tokenizer, texts)


def test_long_texts_in_parts(encoder, tokenizer, monkeypatch):
    draw = random.Random(8)
    monkeypatch.setattr(packing, "PART_CHARS", 20)
    texts = ["".join(draw.choice("ab1 \n.'é") for _ in range(draw.randint(1, 300))) for _ in range(500)]
    assert all("".join(packing.parts(t)) == t for t in texts) and any(len(list(packing.parts(t))) > 3 for t in texts)
    same_ids(encoder, tokenizer, texts)


def test_tree_places_as_a_scan_of_all_bins():
    draw = random.Random(5)
    for _ in range(200):
        capacity = draw.randint(1, 40)
        sizes = [draw.randint(1, capacity) for _ in range(draw.randint(0, 60))]
        bins, left = [], []
        for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            for k, room in enumerate(left):
                if room >= sizes[item]:
                    break
            else:
                k = len(left)
                bins.append([])
                left.append(capacity)
            bins[k].append(item)
            left[k] -= sizes[item]
        assert packing.first_fit_decreasing(sizes, capacity) == bins


def test_closed_sequences_hold_everything_once_and_need_no_padding():
    draw = random.Random(6)
    for _ in range(200):
        capacity = 1 << draw.randint(0, 6)
        sizes = [draw.randint(1, capacity) for _ in range(draw.randint(0, 60))]
        sequences = packing.close_gaps(packing.first_fit_decreasing(sizes, capacity), sizes, capacity)
        held = sorted((item, at) for pieces in sequences for item, start, n in pieces for at in range(start, start + n))
        assert held == [(i, at) for i, n in enumerate(sizes) for at in range(n)]
        lengths = [sum(n for *_, n in pieces) for pieces in sequences]
        assert all(n == capacity or n & (n - 1) == 0 for n in lengths)
        assert len(lengths) <= sum(sizes) // capacity + capacity.bit_length()


def pieces_of(spark, docs, **options):
    return packing.pack(docs, BYTE_VOCABULARY, **options).toPandas()


def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(spark, table_of, awkward, tokenizer):
    docs = table_of(awkward)
    found = pieces_of(spark, docs, keep=("doc_id", "text"), group_docs=16, with_ids=True)
    expected = [(i, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")) for i, text, *_ in awkward]
    whole = sorted((-1 if i is None else i, ids.tobytes()) for i, ids in expected)
    for piece in found.itertuples():
        assert piece.ids_crc32 == zlib.crc32(np.array(piece.ids, "<u4").tobytes()) and piece.length == len(piece.ids)
    got = []
    for (doc, text), rows in found.fillna({"doc_id": -1, "text": ""}).groupby(["doc_id", "text"]):
        # Repeated rows have one document's pieces several times over; no piece of one starts inside another's.
        times = sum(1 for i, t, *_ in awkward if (-1 if i is None else i) == doc and (t or "") == text)
        ids = {}
        for piece in rows.itertuples():
            for k, value in enumerate(piece.ids):
                ids.setdefault(piece.start + k, []).append(value)
        assert set(ids) == set(range(rows.doc_tokens.iloc[0])) and all(len(v) == times and len(set(v)) == 1 for v in ids.values())
        got += [(int(doc), np.array([ids[k][0] for k in range(len(ids))], "<u4").tobytes())] * times
    assert sorted(got) == whole
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]]
        total = rows.length.sum()
        assert total == packing.LENGTH or total & (total - 1) == 0


def test_padding_of_real_documents_and_the_same_pieces_without_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found, bare = pieces_of(spark, docs, with_ids=True), pieces_of(spark, docs)
    key = ["doc_id", "start"]
    assert found.drop(columns="ids").sort_values(key, ignore_index=True).equals(bare.sort_values(key, ignore_index=True))
    assert (bare.groupby("doc_id").length.sum() == bare.groupby("doc_id").doc_tokens.first()).all()
    lengths = bare.groupby("sequence_id").length.sum()
    assert all(n & (n - 1) == 0 for n in lengths) and len(lengths) < lengths.sum() / packing.LENGTH + 12


def test_padding_column(spark):
    rows = spark.createDataFrame([(1,), (2047,), (2048,), (1024,), (3,)], "n long")
    assert [r[0] for r in rows.select(packing.padding("n")).collect()] == [0, 1, 0, 0, 2045]


def test_empty_table(spark, table_of):
    assert packing.pack(table_of([]), BYTE_VOCABULARY).count() == 0


def test_hostile_lengths_and_one_repeated_row(spark, table_of):
    draw = random.Random(9)
    rows = [(None, None, None, None)] * 400 + [(7, "one two", "en", "a")] * 300 + [(8, sentence(draw, 20_000), "en", "a")]
    found = pieces_of(spark, table_of(rows), group_docs=64)
    assert found.length.sum() == 400 + 300 * 3 + found[found.doc_id == 8].doc_tokens.iloc[0]
    assert found.sequence_id.map(lambda n: n >> 32).nunique() == -(-701 // 64)
