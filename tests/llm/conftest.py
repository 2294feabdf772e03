import pytest


@pytest.fixture()
def docs(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:  # clashing names of columns the operators make themselves
            df = df.selectExpr("*", "1 AS component", "'x' AS path", "2 AS score", "3 AS length", "4 AS n_chars")
        return df
    return make
