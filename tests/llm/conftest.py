import pytest

EDGE_TEXTS = [None, "", " ", "one", "two words", "the same five words here", "the same five words here", "éß漢字 😀 mixed", "x" * 30_000, "word " * 5000, "Call +1 (504) 555-2652 or mail a.b@c.org, 10.0.0.1\n4111 1111 1111 1111.", "a\tb\nc\rd\x0be", "<|endoftext|> special", "\x00 zero"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns whose names operators may use themselves."""
    rows = [(k if k != 4 else None, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t) if t else None, k, 1.0, "x", k, "y") for k, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, score double, grp string, node long, shard string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
