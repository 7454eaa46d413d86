"""Sales and returns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from shardline.functions.predicates import ORDER_STATUS, code_label, within
from shardline.functions.scalars import us_date

FBS = 4
FULFILLED = 2


def sales_and_returns(
    accounts: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    details: DataFrame,
    returns: DataFrame,
    start: dt.date,
    end: dt.date,
    account_id: int | None = None,
) -> DataFrame:
    """Shipped and returned quantities per seller item and order.

    The return date range belongs to the outer join, so lines returned outside it stay, with
    return date N/A; ``quantity_returned`` counts every line that was returned at all.
    """
    chosen = accounts.where(F.col("account_type_mask") == FBS)
    if account_id is not None:
        chosen = chosen.where(F.col("account_id") == account_id)
    sold = orders.where(F.col("program_type_mask") == FBS).join(
        chosen.select("account_id", "account_name"), "account_id"
    )
    shipped = lines.where(F.col("fulfillment_status_id") == FULFILLED).join(sold, ["purchase_order_id", "account_id"])
    dated = returns.where(within("return_date", start, end)).select("return_id", "account_id", "return_date")
    rows = shipped.join(details, ["purchase_order_id", "com_line_number"]).join(
        dated, ["return_id", "account_id"], "left"
    )
    return (
        rows.groupBy(
            "duns_number",
            "account_name",
            "external_product_id",
            "item_number",
            F.col("name").alias("item_name"),
            "po_number",
            us_date("po_date").alias("po_date"),
            code_label("po_status_id", ORDER_STATUS).alias("po_status"),
            us_date("sales_date").alias("sales_date"),
            "selling_price",
            F.coalesce(us_date("return_date"), F.lit("N/A")).alias("return_date"),
        )
        .agg(
            F.count("fulfillment_status_id").alias("quantity_shipped"),
            F.count("return_id").alias("quantity_returned"),
        )
        .orderBy("duns_number", "item_number")
    )
