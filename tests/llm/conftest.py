import pytest

#: Texts that break careless code: null, empty, white space, controls, other scripts, very long runs, markers.
ODD = [None, "", " \t\n\x0b\x0c\r ", "hello\x1cworld foo\x1f bar", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
       "ΑΣ ΣΑΣ. İstanbul ǅ  x\u0085y z", "é ́a 's'tt I'LL 1234 ５", "日本語テキスト" * 400, "a" * 30_000,
       "😀😃 👨‍👩‍👧" * 100, "x​y", "\x00null \x00", "don't've !!!??? ...   ", " \n  \n word\n\n\n  x" * 300, "word " * 20_000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """ODD texts twice (repeated rows), a null id, and extra columns whose names clash with operators' own."""
    rows = [(i, t, "en", f"src{i}", 1, "x", True) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[7], (None, "text without an id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, row string, _marked boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
