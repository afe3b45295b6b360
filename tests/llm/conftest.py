import random

import pytest

# Further columns whose names the operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size string, key string, words string, cell string, score string, row string, _whole string, block string, component string"
)


@pytest.fixture(scope="session")
def table_of(spark):
    """A documents table with columns of clashing names, from (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(*r, len(r[1]) if r[1] is not None else None, *["x"] * 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


def sentence(draw, n, letters="abcdefgh"):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Rows with every defect: NULLs, empty, blank and very long texts, repeated rows, copies, near copies."""
    draw = random.Random(7)
    rows = []
    for i in range(60):
        rows.append((i, sentence(draw, draw.randint(1, 160)), draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", None])))
    passage = sentence(draw, 70)
    for i in range(60, 72):
        rows.append((i, f"{sentence(draw, 20)}  {passage}\n{sentence(draw, 15)}", "en", "a"))
    for i in range(72, 84):
        words = passage.split(" ") + sentence(random.Random(1), 130).split(" ")
        words[draw.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words).upper() if i % 2 else "\t".join(words), "de", "a"))
    rows += [(84, None, "en", "a"), (85, "", "en", None), (86, " \n\t ", None, "b"), (87, "12 34 !!", "en", "b")]
    rows += [(88, sentence(draw, 30_000), "en", "a"), (89, "one two three", "de", "z"), (90, "One TWO three", "de", "z")]
    rows += [(91, rows[5][1], "en", "a"), (92, rows[5][1], "en", "b"), rows[3], rows[3], (None, rows[6][1], "en", "a")]
    rows += [(93, "ÄÖ ü x \x1c y\x0bz 日本語 mail: ann@site.org", "de", "a"), (94, "x" * 5000, "en", "a")]
    return rows
