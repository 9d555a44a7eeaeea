import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source) or (doc_id, text), with extra columns whose names clash with results."""

    def build(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("n_lines", "score", "fingerprint", "cell", "taken", "kept", "removed", "row_key", "fp", "items"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return build


ODD = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (None, "null id words here"), (5, "one"), (5, "one"), (6, "\n".join(["a line that is long enough to be counted as one"] * 3)), (7, "word " * 30000)]


@pytest.fixture(scope="session")
def odd():
    """Nulls, blanks, repeated rows, a null id, a very long text."""
    return ODD
