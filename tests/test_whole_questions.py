"""Questions are rewritten whole."""

from pyspark.sql import functions as F

from lexloom import plans
from tests.conftest import SMALL


def test_questions_are_rewritten_whole(spark):
    rows = plans.QUERIES["query_rewrite"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/benchmark.parquet"), "item_id")
    assert rows.count() and rows.where(F.length("text") > 80).count()
    assert rows.where(F.col("n") < F.length(F.trim("text"))).count() == 0
