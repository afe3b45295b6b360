import hashlib
import random
import re
import zlib

import pytest

from depweave.llm import prefix_trie
from depweave.llm.queries import op13_prefix_trie

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows):
    """Rows of (conv_id, turn, role, text) to the sorted results of the query."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [(r[2], r[3]) for r in sorted(found)] for c, found in convs.items()}
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole = turns.get(base, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, len(whole) == d))
    low = {prefix: min(found)[0] for prefix, found in members.items()}
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    for prefix, found in members.items():
        words = len(WORD.findall(prefix[-1][1].decode())) if prefix else 0
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += children[prefix] == 0
            saved[prefix[:d]] += (len(found) - 1) * words
    out = []
    for prefix, found in members.items():
        ends = ",".join(str(c) for c, ended in sorted(found) if ended)
        parent = low[prefix[:-1]] if prefix else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((low[prefix], len(prefix), parent, len(found), children[prefix], leaves[prefix], saved[prefix], sha))
    return sorted(out, key=str)


@pytest.fixture
def trie_rows(spark, tmp_path):
    def run(rows):
        full = [(*r, "x", "x", "x") for r in rows]
        folder = str(tmp_path / f"rows{len(rows)}")
        frame = spark.createDataFrame(full, "conv_id long, turn int, role string, text string, block string, position string, base string")
        frame.write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
        return sorted([tuple(r) for r in op13_prefix_trie(spark, folder).collect()], key=str)

    return run


def conversations(n, draw, deepest=12):
    rows = []
    for _ in range(n):
        conv = draw.choice([draw.randint(0, 90), draw.randint(-60, 0), draw.randint(10**15, 10**15 + 45)])
        for turn in range(draw.randint(1, deepest)):
            rows.append((conv, draw.choice([None, turn, turn]), draw.choice(["user", "assistant", None, ""]), draw.choice(["hi there", "", None, "ok\x0bthen é", "a b c"])))
    return rows


@pytest.fixture(params=[(11, 256), (1, 2), (3, 5)])
def shard_size(request, monkeypatch):
    width, band = request.param
    monkeypatch.setattr(prefix_trie, "WIDTH_BITS", width)
    monkeypatch.setattr(prefix_trie, "WIDTH", 1 << width)
    monkeypatch.setattr(prefix_trie, "BAND", band)


def test_equals_plain_trie(trie_rows, shard_size):
    rows = conversations(120, random.Random(4))
    rows += [(None, 1, "user", "hi there"), (500, 0, "user", "alone"), (503, 0, None, None), (500, 0, "user", "alone")]
    assert trie_rows(rows) == plain(rows)


def test_many_copies_and_one_long_conversation(trie_rows, shard_size):
    copies = [(c, t, "user", f"turn {t}") for c in range(1000, 1060) for t in range(4)]
    long_one = [(2000, t, "user", f"turn {t}") for t in range(300)] + [(2020, t, "user", f"turn {min(t, 40)}") for t in range(45)]
    rows = copies + long_one
    assert trie_rows(rows) == plain(rows)


def test_empty_table(trie_rows):
    assert trie_rows([]) == []
    assert trie_rows([(None, 1, "user", "x")]) == []
