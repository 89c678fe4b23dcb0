import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, size long"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak near the river bank at dusk"


def rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names (kind, size)."""
    long_text = " ".join(f"word{i % 700} tail{i % 13}" for i in range(20_000))
    texts = [
        BASE, BASE, BASE + " again", BASE.replace("owls", "cats"), None, "", "   \t\n", "one", "two words", "!!! *** 12345 %%%",
        long_text, long_text + " end", "Ein Satz über die Brücke und das Haus am Fluss", "La maison est très belle et le jardin aussi",
        "a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b a b", "  lead  double   spaces \n\n and\ttabs ",
        "émoji 😀 😀 and   odd　spaces", "x" * 5000, "you are an idiot and a moron", "mail jane@site.org or JANE@SITE.ORG from 10.1.2.3",
    ]
    langs = ["en"] * 12 + ["de", "fr"] + ["en"] * 6
    out = [(i, t, langs[i] if i != 7 else None, ["s1", "s2", None, ""][i % 4], None if t is None else len(t), "k", i) for i, t in enumerate(texts)]
    out.append(out[0])
    return out


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def listed():
    return rows()
