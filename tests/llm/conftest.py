import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, grade int, marks int, tail boolean, size string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, copies, ties, and columns named like results."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    base = " ".join(f"alpha{i}" for i in range(60))
    near = base.replace("alpha59", "omega")
    texts = [base, near, base, "  " + base, None, "", " ", "\t\n ", "one", "one two three", "ONE two three", long, long + " end", "x" * 50_000, "日本語 のテキスト 😀 é", base + "\n" + base, "12 34", "stupid idiot", base.replace(" ", "\n")]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), "k", None, i, None, True, "big") for i, t in enumerate(texts)]
    rows.append((None, "no id at all", None, None, None, None, None, None, None, None, None))
    rows.append((3, "  " + base, "en", "s0", 1, None, None, None, None, None, None))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
