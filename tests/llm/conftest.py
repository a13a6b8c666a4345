import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept boolean, row_key string, c0 string, Text string, spans string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and blank texts, one very long, copies that differ in white space, near copies, repeated rows, ties."""
    a, b = prose(1, 80), prose(2, 120)
    near = b + " one more word at the end"
    texts = [
        (1, a), (2, a.replace(" ", "  ")), (3, a.replace(" ", "\n")), (4, b), (5, near), (5, near), (None, a), (6, None), (7, ""), (8, " \t\n"),
        (9, "one"), (10, "one two"), (11, prose(3, 60_000)), (12, "x" * 50_000), (13, 'é token = "abcdef0123456789abcdef0123456789"'), (14, "AKIA" + "Q" * 16 + " ünï"),
        (15, "<|endoftext|> 漢字    😀"), (16, b), (None, None), (9, "other text of the same id"), (17, "line\nshared line of text\nend"), (18, "shared line of text"),
    ]
    return [(i, t, "en" if k % 3 else None, f"s{k % 7}" if k % 5 else None, None if t is None else len(t), "f", None, "k", "z", "T", "s") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
