import pytest

#: Columns whose names operators use inside, to clash with them.
EXTRA = {"n_words": 1, "size": 2, "s": "x", "h": 3, "shard": "y", "score": 0.5, "kind": "z", "edge": None, "time": 4, "target": "t"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = " ".join(f"w{i}" for i in range(300))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, PROSE), (7, PROSE), (7, PROSE), (None, None), (None, PROSE + " tail"),
    (8, "é" * 5000), (9, "same " * 200), (10, PROSE.upper()), (11, "x" * 200_000), (12, "a b c d e\x0bf\x0cg\rh"), (13, "zero\x00byte 😀 日本"),
]


def documents(spark, rows, extra=False):
    sources = ["a", "b", None]
    df = spark.createDataFrame([(i, t, "en", sources[k % 3], len(t) if t is not None else None) for k, (i, t) in enumerate(rows)], SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name, value in EXTRA.items():
            df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="session")
def package(spark):
    from fedloom.plans.session import ship_package

    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd(package):
    return documents(package, ODD, extra=True)


@pytest.fixture(scope="session")
def none(package):
    return package.createDataFrame([], SCHEMA)
