import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, node int, found string, word string, block int"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 3000


def rows():
    """Null and empty texts, null ids and other columns, ties, repeated rows, a very long text and a long word without spaces."""
    texts = {
        1: "The quick brown fox jumps over the lazy dog near the quiet river bank while twelve birds watch from above. Mail me@example.com now.",
        2: None,
        3: "",
        4: "The quick brown fox jumps over the lazy dog near the quiet river bank while twelve birds watch from above. Mail me@example.com now.",
        5: LONG,
        6: "word",
        7: " \n\t ",
        8: "x" * 50_000,
        9: "Ünïcode ñandú, 漢字 and \U0001f600 smile. Call +1 (555) 010-9999 or 10.0.0.1 today!",
    }
    out = [(i, t, "en", f"src{i % 2}", len(t or ""), "k", "s", 1, "f", "w", 2) for i, t in texts.items()]
    out += [out[0], out[0], (None, "The quick brown fox jumps over the lazy dog", None, None, None, None, None, None, None, None, None), (10, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
