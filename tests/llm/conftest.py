import random

import pytest

WORDS = ["the", "and", "river", "Stone", "über", "été", "light", "43", "x-ray", "of", "in", "night", "wolf", "paper", "glass", "ñandú", "song", "cold"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty, blank and very long texts, exact and near copies, repeated rows."""
    rng = random.Random(5)
    out = []
    for k in range(60):
        out.append((k, prose(rng, rng.choice([3, 20, 80, 200])), rng.choice(["en", "de"]), f"src{k % 4}", 0))
    base = prose(rng, 300)
    out += [(100 + k, base, "en", "src0", 0) for k in range(8)]
    out += [(110 + k, base + f" tail{k}", "en", "src0", 0) for k in range(6)]
    out += [(200, None, "en", "src1", None), (201, "", None, "src1", 0), (202, " \t\n ", "en", None, 0), (203, "one", "en", "src2", 3), (204, "two words", "en", "src2", 9)]
    out += [(None, "nobody's text here", "en", "src3", 0), (5, out[5][1], "en", "src1", 0), (5, out[5][1], "en", "src1", 0)]
    out += [(300, prose(rng, 20_000), "en", "src3", 0), (301, "7" * 5000, "en", "src3", 0), (302, "a" * 30_000, "en", "src3", 0)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns, named as operators might name their own.
EXTRA = ["fp", "id", "size", "root", "keep", "label", "tree", "c0"]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(rows, SCHEMA)
    df.withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
