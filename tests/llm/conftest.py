"""Fixtures with nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""

import pytest

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def odd_rows():
    base = LOREM.split()
    long = " ".join(f"{w}{i}" for i in range(900) for w in base[:5])
    near = " ".join(base[:5] + ["changed"] + base[6:])
    texts = [
        LOREM, LOREM, near, None, "", " \n\t ", long, long + " tail", "one", "one", "Straße ÄÖ 🙂 <|endoftext|> it's  x\n\nLOREM ipsum\nLOREM ipsum",
        "\n".join([LOREM, "a b c d", "a b c d", LOREM.upper()]), "a\x00b \x1c c d", "!!! ### *** $$$ %%% &&& ||| <<< >>> ~~~", "x" * 5000,
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, LOREM + " more", None, None, None), (None, "loose text without an id", "en", "s1", 1), (-5, "negative id", "", "", 0)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case."""
    return spark.createDataFrame(odd_rows(), COLUMNS).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns that operators might use inside."""
    names = ["ids", "words", "body", "hashes", "size", "shard", "key", "node", "score", "bucket", "line", "line_no", "place", "group", "_words", "token", "host", "taken", "slot", "x", "label"]
    return odd.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet").cache()
