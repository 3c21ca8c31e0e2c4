"""Invoices over orders and their lines. Money is summed as decimals; the formulas are this library's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"


def _parts() -> tuple:
    price, disc, tax = (F.col(c).cast("decimal(14,2)") for c in ("l_extendedprice", "l_discount", "l_tax"))
    discount = (price * disc).cast(MONEY)
    return price.cast(MONEY), discount, ((price - discount) * tax).cast(MONEY)


def invoice_totals(orders: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """An invoice for each order: customer, subtotal, discount, tax and total, to cents."""
    price, discount, tax = _parts()
    lines = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), price.alias("p"), discount.alias("d"), tax.alias("t")).groupBy("o_orderkey").agg(F.sum("p").alias("p"), F.sum("d").alias("d"), F.sum("t").alias("t"))
    joined = lines.join(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(customer.select("c_custkey", "c_name"), "c_custkey")
    cents = lambda c: F.round(c, 2).cast("double")
    return joined.select("o_orderkey", "c_name", cents("p").alias("subtotal"), cents("d").alias("discount"), cents("t").alias("tax"), cents(F.col("p") - F.col("d") + F.col("t")).alias("total"))


def tax_summary(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Net and tax by tax class and order status, with all totals."""
    price, discount, tax = _parts()
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_tax", "o_orderstatus", (price - discount).alias("net"), tax.alias("tax"))
    return joined.cube("l_tax", "o_orderstatus").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("lines"), F.round(F.sum("net"), 2).cast("double").alias("net"), F.round(F.sum("tax"), 2).cast("double").alias("tax"))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def invoice_pages(lineitem: DataFrame, per_page: int) -> DataFrame:
    """order, line, page and the total carried so far, with lines in a full order."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    line = F.row_number().over(w)
    carried = F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lineitem.select("l_orderkey", line.alias("line"), F.round(carried, 2).cast("double").alias("carried"))
    return rows.select("l_orderkey", "line", F.ceil(F.col("line") / per_page).cast("int").alias("page"), "carried")
