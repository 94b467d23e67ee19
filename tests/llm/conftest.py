import pytest
from pyspark.sql import types as T

LONG = "the quick brown fox jumps over the lazy dog and runs away from 17 wolves. " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns named as operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, rep long, kept boolean, tokens string, length int, place long, part int"
    more = (1, 0.5, 2, True, "t", 3, 4, 5)
    rows = [
        (1, "the cat sat on the mat and the dog lay on the rug by the door", "en", "a", 61, *more),
        (1, "the cat sat on the mat and the dog lay on the rug by the door", "en", "a", 61, *more),
        (2, "the cat sat on the mat and the dog lay on the rug by the door", "en", "b", 61, *more),
        (3, None, "en", "a", None, *more),
        (None, "no id here but some words to read for all of us", None, None, 10, *more),
        (4, "", "en", None, 0, *more),
        (5, LONG, "en", "b", len(LONG), *more),
        (6, "word", None, "b", 4, *([None] * 8)),
        (7, " \n\t ", "en", "c", 4, *more),
        (None, None, None, None, None, *([None] * 8)),
    ]
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
