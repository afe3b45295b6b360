import hashlib
import zlib

import pytest

from depweave.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, at):
    steps = []
    for level in levels[:-1]:
        first = at // 3 * 3
        steps.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return steps


def plain(rows):
    """Rows of (doc_id, source, lang, n_chars, text) to the sorted results of the query."""
    sources = {}
    for row in rows:
        now = row
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
            now = (*row[:4], row[4].replace("\n", ""))
        sources.setdefault(row[1], []).append((row[0], plain_leaf(row), plain_leaf(now)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = plain_levels([leaf for _, leaf, _ in sources[name]])
    tops = plain_levels([trees[name][-1][0] for name in names])
    found = []
    for k, name in enumerate(names):
        for i, (doc, leaf, now) in enumerate(sources[name]):
            steps = plain_path(trees[name], i) + plain_path(tops, k)
            folded = now
            for left, right in steps:
                folded = h(left, folded, right)
            root = tops[-1][0]
            found.append((doc, leaf, trees[name][-1][0], root, h(*(a + b for a, b in steps)), folded, folded == root))
    return sorted(found, key=str)


@pytest.fixture(params=[1, 2, 7])
def levels_per_block(request, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", request.param)
    monkeypatch.setattr(manifest, "BLOCK", 3**request.param)


def documents(table_of, rows):
    return table_of([(i, text, lang, source) for i, source, lang, _, text in rows])


def fixture_rows(awkward):
    rows = [(i, source, lang, len(text) if text is not None else None, text) for i, text, lang, source in awkward]
    rows += [(1000 + i, "many", "en", 5, f"a\nb{i}"[:5]) for i in range(100)]
    rows = [(i, s, lang, None if t is None else len(t), t) for i, s, lang, _, t in rows]
    return [*rows, (5000, "alone", None, 3, "x\ny"), (5001, "", "en", 0, ""), (5002, "ÿ", "en", 1, "é")]


def test_equals_plain_trees(spark, table_of, awkward, levels_per_block):
    rows = fixture_rows(awkward)
    found = manifest.Manifest(manifest.line_breaks_removed(documents(table_of, rows))).verify()
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain(rows)


def test_versions_share_all_but_the_ancestors(spark, table_of, awkward):
    rows = fixture_rows(awkward)
    tree = manifest.Manifest(manifest.line_breaks_removed(documents(table_of, rows)))
    proofs = {(r.doc_id, r.leaf): r for r in tree.proofs().collect()}
    changed = tree.versions().collect()
    assert len(changed) == sum(1 for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0)
    by_id = {r.doc_id: r for r in proofs.values()}
    for version in changed:
        node, steps = version.copied[0], by_id[version.doc_id].siblings
        assert len(version.copied) == len(steps) + 1
        for above, step in zip(version.copied[1:], steps):
            node = h(step.left, node, step.right)
            assert above == node


@pytest.mark.parametrize("n", [1, 3, 28])
def test_single_sources_of_all_shapes(spark, table_of, levels_per_block, n):
    rows = [(i * 10**15, "s", "en", 3, "a\nb") for i in range(n)]
    found = manifest.Manifest(manifest.line_breaks_removed(documents(table_of, rows))).verify()
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain(rows)


def test_empty_table(spark, table_of):
    assert manifest.Manifest(manifest.line_breaks_removed(table_of([]))).verify().count() == 0
