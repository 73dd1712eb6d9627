from __future__ import annotations

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def make(*texts, extra=None):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in pairs]
        found = spark.createDataFrame(rows, DOC)
        return found.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in (extra or {}).items()}) if extra else found

    return make
