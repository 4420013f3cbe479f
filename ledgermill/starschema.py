"""Validated orders out of a star schema (orders, customer, nation, lineitem, part)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Splits up to which a table is dealt anew: some 2 GB.
FEW_SPLITS = 16


@dataclass(frozen=True)
class StarSchema:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy by row: one of a few splits, at most FEW_SPLITS, is dealt to more cores. A larger one is never shuffled for that."""
        rows, cores = self.table(name), self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else rows

    @cached_property
    def orders(self) -> DataFrame:
        """order_id, order_date, status, customer_id, city, payment_method, payment_status, total_amount."""
        # joined to customers first, a filter on the city thins them before the orders are met
        customers = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        rows = self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("order_date"), F.col("o_orderstatus").alias("status"),
            F.col("o_custkey").alias("customer_id"), F.col("n_name").alias("city"), F.col("o_orderpriority").alias("payment_method"),
            F.col("c_mktsegment").alias("payment_status"), F.col("o_totalprice").alias("total_amount"),
        )

    @cached_property
    def plain_orders(self) -> DataFrame:
        """Orders without what only the customer table knows, so that no join is needed."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("order_date"), F.col("o_orderstatus").alias("status"),
            F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("payment_method"), F.col("o_totalprice").alias("total_amount"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """order_id, sku, name, qty, total: the lines are a table of their own, so no array is built and exploded."""
        rows = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        return rows.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("total"))

    @cached_property
    def product_lines(self) -> DataFrame:
        """items summed by sku before the names are joined: one row for a sku, in the partitioning that a report by product needs."""
        sums = self.table("lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(*(F.sum(F.col(c).cast("decimal(18,2)")).alias(n) for c, n in (("l_quantity", "qty"), ("l_extendedprice", "total"))))
        return sums.join(self.table("part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name")), "sku", "left")
