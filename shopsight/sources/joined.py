"""The joined fact table (transactions left-joined to customers and products)."""

from __future__ import annotations

from pyspark.sql import DataFrame

def _check_no_collision(left: DataFrame, right: DataFrame, key: str) -> None:
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"column names appear on both join sides: {sorted(clash)}")


def join_facts(transactions: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """``transactions ⟕ customers ⟕ products`` on ``customer_id`` / ``product_id``.

    Left joins keep every transaction; unmatched dimension columns are null.  Nothing
    is counted or hinted here: Catalyst broadcasts a side whose estimated bytes are
    below ``spark.sql.autoBroadcastJoinThreshold``, AQE one whose measured bytes are,
    and else the sort-merge join runs with AQE skew splitting for hot customers.  A
    null fact key never matches (plain SQL equi-join semantics)."""
    _check_no_collision(transactions, customers, "customer_id")
    df = transactions.join(customers, "customer_id", "left")
    _check_no_collision(df, products, "product_id")
    df = df.join(products, "product_id", "left")
    order = transactions.columns + [c for c in customers.columns if c != "customer_id"] + \
        [c for c in products.columns if c != "product_id"]
    return df.select(*order)
