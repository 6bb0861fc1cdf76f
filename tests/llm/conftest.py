import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text) rows."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return lambda rows: spark.createDataFrame(rows, schema)


sys.path.insert(0, str(Path(__file__).parent))
