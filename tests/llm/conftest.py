import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, items string, `key` long"


@pytest.fixture(scope="module")
def plain_odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    base = " ".join(f"w{i}" for i in range(260))
    texts = [
        (None, base, "a"), (1, None, "a"), (2, "", None), (3, "   \n\t", ""), (4, base, "b"), (5, base, "b"), (5, base, "b"), (6, base + " #", "a"), (7, "a b c", "c"), (8, "a b c", "c"),
        (9, "A▁B  日本 \U0001f600\n", "é"), (11, "same " * 30000, "z"), (12, "LOUD WORDS " * 150, "z"), (None, None, None), (13, "x\ny\nz", "\U0001f600"), (14, "x\ny", "￮"),
    ]
    rows = [(d, t, "l" if d and d % 2 else None, s, None if t is None else len(t), "clash", 1) for d, t, s in texts]
    clashing = KINDS + ", tree string, idx long, n long, level int, digest string, size long, rate double, copies long, part string, failed int, words string"
    return spark.createDataFrame([(*r, "t", 0, 0, 0, "d", 0, 0.0, 0, "p", 0, "w") for r in rows], clashing)
