"""Citations of acts whose numbers have five digits or begin like another act's."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexspark import catalogue
from lexspark.operators import citations
from tests.compare import differences


@pytest.fixture(scope="module")
def long_numbers(spark, tmp_path_factory):
    """Line items whose citations are of 2016/679, 2016/6793, 2016/67, 2016/12345 and 1990/9999."""
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(k, part, 26 if part != 9999 else 0, k % 7 + 1, 5.0) for k, part in enumerate([679, 6793, 67, 12345, 9999, 67912])]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["ref_parse_backend", "citation_pills", "citation_refs", "citations_by_act"])
def test_numbers_of_any_length(spark, long_numbers, name):
    assert not differences(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], long_numbers)


def test_number_that_begins_like_another(spark):
    said = {"Article 6(1) of Regulation (EU) 2016/6793": "Art. 6(1) 2016/6793", "Article 6(1) of Regulation (EU) 2016/679, on": "Art. 6(1) GDPR", "Article 6(1) of Regulation (EU) No 2016/679/EU": "Art. 6(1) GDPR"}
    rows = spark.createDataFrame(list(said.items()), "c string, p string").select("p", citations.pill(F.col("c")).alias("got")).collect()
    assert all(r.p == r.got for r in rows), rows
