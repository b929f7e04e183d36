import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, "
    "spans string, key string, found string, row_key string, rejected string, toxicity string"
)
EXTRA = (None, "own", "own", "own", "own", "own", "own", "own")


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, special strings, other scripts, odd white space."""
    long_text = "Word and wörd 12ab. " * 12_000 + "é" * 30_000 + " end"
    rows = [
        (1, "Hello world, it's a TEST of the whole thing", "en"),
        (1, "Hello world, it's a TEST of the whole thing", "en"),
        (2, None, None),
        (None, "no id here but words enough to make a shingle", "en"),
        (None, None, None),
        (3, "", "de"),
        (4, "  \n\t ", "de"),
        (5, long_text, "de"),
        (6, "a <|endoftext|> b<|startoftext|>c  d <|endoftext|>", "en"),
        (7, "漢字かな交じり文。 Ελληνικά ΣΑΣ İstanbul ́x  y \x1c z", "xx"),
        (8, "Hello world, it's a TEST of the whole thing", "en"),
        (9, "12 34 ... !!", None),
        (10, "one", " "),
        (12, "a  b\n\nc \n d\te", "en"),
        (11, "user = admin1 host: db.example.com then key 9fQ2Zx81LmPq7Rt5Vw3Yab end", "en"),
    ]
    return [(i, t, lang, "src", len(t) if t else None, *EXTRA) for i, t, lang in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    """Sorted (doc_id, text) with empty texts for nulls."""
    return sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
