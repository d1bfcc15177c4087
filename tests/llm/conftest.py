import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from texts; ids count up unless (id, text) pairs are given."""

    def make(texts, **more):
        rows = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", f"s{k % 3}", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
        for name, value in more.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make
