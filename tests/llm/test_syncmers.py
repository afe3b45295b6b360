import hashlib
import re
from collections import Counter

from depweave.llm import syncmers
from pyspark.sql import functions as F


def test_edited_texts_and_likeness(spark, table_of, awkward, monkeypatch):
    monkeypatch.setattr(syncmers, "CELL_ROWS", 16)
    rows = [r for r in awkward if r[0] is not None]
    got = syncmers.compare_with_edits(table_of(awkward)).collect()
    assert len(got) == len(awkward)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-r[0], r[1])) + [(None, r[1] or "") for r in awkward if r[0] is None]
    want = {}
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.setdefault(i, set()).add((len(text), hashlib.sha256(edited.encode()).hexdigest()))
    for r in got:
        assert (r.n_chars, r.edited_sha256) in want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    texts = {(i, len(t)): t for i, t in order}
    for r in got:
        prints.setdefault(texts[r.doc_id, r.n_chars], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got if r.n_chars > 300 and r.doc_id is not None]
    assert sum(r.near_edited for r in long) / len(long) > 0.35


def anchors_of(spark, text):
    rows = spark.createDataFrame([(text,)], "text string").withColumn("w", syncmers.word_hashes(F.col("text")))
    rows = syncmers.anchors(rows, "w", "a")
    return rows.select("w", "a").first()


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{i * i % 37}" for i in range(60))
    w, a = anchors_of(spark, text)
    k = syncmers.K
    want = [i for i in range(len(w) - k + 1) if min(w[i : i + k]) in (w[i], w[i + k - 1])]
    assert [x["at"] for x in a] == want
    moved = anchors_of(spark, "new start " + text)[1]
    assert {(x["at"] - 2, x["hash"]) for x in moved} >= {(x["at"], x["hash"]) for x in a}


def test_aligned_positions(spark):
    body = " ".join(f"v{i}" for i in range(40))
    left, right = anchors_of(spark, body)[1], anchors_of(spark, "a b c " + body)[1]
    pairs = spark.createDataFrame([(1, left, right)], "pair int, left array<struct<at:int,hash:long>>, right array<struct<at:int,hash:long>>")
    best = max(syncmers.aligned(pairs).collect(), key=lambda r: r.matches)
    assert best.offset == 3 and best.matches == len(left)


def test_one_document_and_none(spark, table_of):
    one = syncmers.compare_with_edits(table_of([(5, "a b c d", "en", "a")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest() or re.fullmatch("[0-9a-f]{64}", one.edited_sha256)
    assert one.near_next == 1
    assert syncmers.compare_with_edits(table_of([])).count() == 0


def parsed(fingerprint):
    """(at, hash) of every anchor of a fingerprint."""
    count, _, rest = fingerprint.partition(":")
    at, out = 0, []
    for part in rest.split(","):
        mark, gap = part.split("+")
        at += int(gap)
        out.append((at, mark))
    assert len(out) == int(count)
    return out


def dice(left, right):
    def links(anchors):
        return Counter((h, *((anchors[i + 1][0] - at, anchors[i + 1][1]) if i + 1 < len(anchors) else (0, ""))) for i, (at, h) in enumerate(anchors))

    return 2 * (links(left) & links(right)).total() / (len(left) + len(right))


def test_fingerprints_hold_all_anchors_in_order_and_give_the_likeness(spark, table_of):
    words = [f"w{i * i % 977}" for i in range(3000)]
    one, moved = list(words), words[1500:] + words[:1500]
    one[2000] = "edit"
    rows = [(4, " ".join(words), "en", "a"), (3, " ".join(one), "en", "a"), (2, " ".join(moved), "en", "a"), (1, "a b a b a b " * 50, "en", "a"), (0, "a b", "en", "a")]
    got = {r.doc_id: r for r in syncmers.compare_with_edits(table_of(rows)).collect()}
    assert len({r.fingerprint for r in got.values()}) == 5
    prints = {i: parsed(r.fingerprint) for i, r in got.items()}
    assert [at for at, _ in prints[4]] == [x["at"] for x in anchors_of(spark, rows[0][1])[1]]
    for i, r in got.items():
        assert r.near_edited == dice(prints[i], parsed(r.edited_fingerprint))
        assert r.near_next == dice(prints[i], prints[(i - 1) % 5])
    assert 0.99 < got[4].near_next < 1
