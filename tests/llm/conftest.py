import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs, with a clashing extra column if asked for."""

    def make(rows, extra=None):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in extra:
                df = df.withColumn(name, F.lit("mine"))
        return df

    return make
