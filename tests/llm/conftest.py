import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""
    line = "All rights reserved by the same people here."
    rows = [(i, f"word{i} and some other words of text number {i}\n{line}\nend {i}", "en", f"s{i % 3}", 1, i, "x") for i in range(30)]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s0", 0, 1, "y"), (None, "a b c d e f", "en", None, 1, 2, "z"), (102, "same text same text", "en", "s1", 1, 3, "q"), (102, "same text same text", "en", "s1", 1, 3, "q"), (103, " \t\n\x0b\x0c\r\n", "en", "s1", 1, 4, "q"), (104, "é Ünï 漢字 😀 #$%", "fr", "s2", 1, 5, "q"), (105, "x" * 5000 + " " + "ab " * 4000, "en", "s2", 1, 6, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot long, N_words string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
