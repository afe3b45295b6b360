import hashlib
import re

import pytest
from depweave.llm import personal
from hypothesis import given, settings
from hypothesis import strategies as st

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                12 <= len(digits) <= 19 and personal.luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab1@.. -+()2900%_é"), max_size=50) | st.text(st.sampled_from("0123456789 -.+"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert personal.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000, "@" * 200_000, "1.2.3." * 50_000, "+1 " * 50_000, "a.b" * 50_000 + "@"):
        personal.spans_and_candidates(text)


def test_luhn():
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")


def test_reliable_labelers_are_found():
    """One labeler contradicts the others at random: it gets little weight."""
    said, counts = [], []
    for good in (0, 1):
        for noise in (personal.AGAINST, personal.FOR):
            vote = personal.FOR if good else personal.AGAINST
            said.append([personal.NO_VOTE, vote, vote, vote, noise, vote])
            counts.append(100)
    import numpy as np

    truth, rates = personal.reliabilities(np.array(said), np.array(counts, dtype=float))
    assert truth.round(2).tolist() == [0, 0, 1, 1]
    assert abs(rates["context"][0][2] - rates["context"][1][2]) < 0.05 < abs(rates["check"][0][2] - rates["check"][1][2])


def test_rows_and_masks(spark, table_of, awkward):
    extra = [
        (200, "call +1 (212) 555-0199 or write joe.x@mail.example.com now 10.20.30.40, card 4111 1111 1111 1111.", "en", "a"),
        (201, "bad 300.1.2.3 and 1234567890123456 and +12", "en", "a"),
        (202, "reach me: ann (at) site (dot) org or phone (212) 555-0143", "en", "a"),
    ]
    rows = awkward + extra * 5
    docs = table_of(rows)
    model = personal.learn(docs)
    got = personal.find(docs, model).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, text, *_ in rows:
        texts.setdefault(i, set()).add(text or "")
    for r in got:
        base = [plain_spans(t) for t in texts[r.doc_id]]
        match = [b for b in base if hashlib.sha256(personal.spelled(b).encode()).hexdigest() == r.base_sha256]
        assert match and set(personal.spelled(match[0]).split(",")) <= set(r.spans.split(",")) | {""}
    first = next(r for r in got if r.doc_id == 200)
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 1, 1)
    masked = {r.doc_id: r for r in personal.mask(docs, model).where("doc_id >= 200").collect()}
    assert masked[200].text == "call [phone] or write [email] now [ip], card [card]."
    assert masked[200].n_chars == len(masked[200].text)


def test_empty_table(table_of):
    docs = table_of([])
    assert personal.find(docs, personal.learn(docs)).count() == 0


@pytest.mark.parametrize("patterns", [[], [[0, 2, 2, 2, 2, 0, 2, 3]]])
def test_classifier_of_few_patterns(patterns):
    model = personal.SpanClassifier(patterns, [3] * len(patterns))
    assert len(model.accepts([[0, 0, 2, 2, 2, 0, 2, 3]])) == 1
