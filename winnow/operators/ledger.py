"""Responses behind a ledger: a row's response can be read only after the row has been charged.

The ledger is a table of charged ids in a shared folder. Charging appends the new ids of a request before any response is
read; a request that was charged before, whole or in part, is not charged again, so a job that fails between
charging and reading, or runs twice, pays once. One job writes to a ledger at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.exposure import query_ledger
from winnow.plans.cut import cut

SCHEMA = "id bigint, request string"


class ResponseLedger:
    """Charges against a budget, and the only way to the responses."""

    def __init__(self, spark: SparkSession, path: str, budget: int):
        if budget < 1:
            raise ValueError(f"a query budget is at least 1, not {budget}")
        self.spark, self.path, self.budget = spark, path, budget

    def charged(self) -> DataFrame:
        """(id, request): every id with the request that first charged it."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy("id").agg(F.min("request").alias("request"))

    def charge(self, requests: DataFrame, pool: DataFrame, request: str = "") -> int:
        """Charge the ids of a request that are new; how many these are. An id asked for twice, or not in the pool, or a request
        beyond the budget, is refused as a whole, and nothing is charged."""
        status = cut(query_ledger(requests.select("id"), self.charged(), pool, self.budget))
        bad = status.filter(F.col("status").isin("duplicate", "unknown", "over_budget")).orderBy("status", "id").limit(1).collect()
        if bad:
            raise ValueError(f"request {request!r} refused: id {bad[0]['id']} is {bad[0]['status']}")
        new = status.filter("status = 'new'").select("id", F.lit(request).alias("request"))
        count = new.count()
        if count:
            new.write.mode("append").parquet(self.path)
        return count

    def responses(self, requests: DataFrame, responses: DataFrame, request: str = "") -> DataFrame:
        """The responses of a request's ids, after they have been charged."""
        self.charge(requests, responses.select("id"), request)
        paid = self.charged().select("id").join(requests.select("id"), "id", "left_semi")
        return responses.join(paid, "id", "left_semi")
