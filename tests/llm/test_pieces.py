import os
import random
from functools import lru_cache

import pytest
from depweave.llm import pieces
from depweave.llm.queries import PIECE_MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    return pieces.model_of(PIECE_MODEL)


def brute(model, text, most):
    """All segmentations of the whole text, best first."""
    marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""

    @lru_cache(None)
    def rest(i):
        if i == len(marked):
            return [(0.0, ())]
        out = []
        for j in range(i + 1, min(len(marked), i + model.longest) + 1):
            k = model.ids.get(marked[i:j])
            if k is None and j > i + 1:
                continue
            ids = (k,) if k is not None else tuple(int(model.bytes[b]) for b in marked[i].encode())
            score = float(model.scores[k]) if k is not None else model.unknown_score
            out += [(score + s, ids + p) for s, p in rest(j)]
        return sorted(out, reverse=True)[: 4 * most]

    return rest(0)


@pytest.mark.parametrize("seed", range(6))
def test_equals_all_segmentations(model, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choice("aeinst \n.é日") for _ in range(draw.randint(0, 24))) for _ in range(40)]
    for text, found in zip(texts, model.encode(texts, 4)):
        want = brute(model, text, 4)
        assert [s for s, _ in found] == pytest.approx([s for s, _ in want[:4]])
        scores = dict((p, s) for s, p in want)
        paths = [tuple(ids.tolist()) for _, ids in found]
        assert len(set(paths)) == len(paths) == min(4, len(brute(model, text, 40)))
        for (score, _), path in zip(found, paths):
            assert scores.get(path, score) == pytest.approx(score)
        assert all(model.decode(ids) == text for _, ids in found)


def test_awkward_rows(spark, table_of, awkward):
    docs = table_of(awkward)
    rows = pieces.round_trips(docs, PIECE_MODEL).collect()
    assert len(rows) == len(awkward) and all(r.round_trip for r in rows)
    empty = [r for r in rows if r.doc_id in (84, 85)]
    assert [(r.n_paths, list(r.scores), list(r.n_pieces)) for r in empty] == [(1, [0.0], [0])] * 2
    assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in rows)
    encoded = pieces.encode(docs, PIECE_MODEL, keep=("doc_id", "text", "block")).selectExpr("doc_id", "text", "paths[0].ids AS ids")
    decoded = pieces.decode(encoded, PIECE_MODEL, keep=("doc_id", "text")).collect()
    assert all(r.decoded == (r.text or "") for r in decoded)
    assert pieces.round_trips(docs.limit(0), PIECE_MODEL).count() == 0


def test_word_marks_become_spaces(model):
    (path,) = model.encode(["a▁b"], 1)[0]
    assert model.decode(path[1]) == "a b"


def test_search_yields_paths_in_order():
    ends = {1: [(0, -1.0, "a"), (0, -3.0, "b")], 2: [(1, -1.0, "c"), (0, -2.5, "d"), (1, -1.5, "e")]}
    paths = pieces.best_paths([0.0, -1.0, -2.0], lambda n: ends[n], 2, 9)
    assert paths == [(-2.0, ["a", "c"]), (-2.5, ["a", "e"]), (-2.5, ["d"]), (-4.0, ["b", "c"]), (-4.5, ["b", "e"])] or [p[0] for p in paths] == [-2.0, -2.5, -2.5, -4.0, -4.5]
