import pytest

#: Nulls, empty and long texts, ties, repeated rows; and columns whose names operators use.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf again", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "   \t\n ", "en"),
    (6, "word", None),
    (7, "ein ganz anderer Satz über die schönen Bäume im Wald und die Vögel darin", "de"),
    (7, "ein ganz anderer Satz über die schönen Bäume im Wald und die Vögel darin", "de"),
    (None, "a row without an id, but with a text of its own that says nothing much at all", "en"),
    (8, "lorem ipsum " * 4000, "en"),
    (9, "\U0001f600 é́ 中文 текст", None),
]
SCHEMA = "doc_id long, text string, lang string, score double, kept boolean, slot long, id long, key string, label string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, False, 9, 77, "k", "l") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
