"""DuckDB oracle SQL for the registered queries.

``BASE`` rebuilds the stand-in tables, the joined table (``raw``) and the
cleaned table (``clean``) from the test tables with plain SQL; each query then
selects from them.  Double results are rounded the same way on both sides so
that summation order cannot change the value hash.
"""

from __future__ import annotations

# Integral columns that have gaps in the joined test data become DOUBLE after
# the median fill (pandas turns them into floats); the Spark side decides this
# from the data, the SQL side states it.
BASE = """
WITH transactions AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id,
         o_custkey AS customer_id,
         CASE WHEN (l_orderkey + l_linenumber) % 40 = 0 THEN NULL ELSE l_partkey END AS product_id,
         o_orderdate AS ts,
         l_quantity AS quantity,
         l_discount AS discount_applied,
         CASE WHEN (l_partkey + l_suppkey) % 50 = 0 THEN NULL
              WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN -l_extendedprice / 100
              ELSE l_extendedprice * (1 - l_discount) END AS gross_revenue,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_refunded,
         l_suppkey % 10 AS campaign_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), customers AS (
  SELECT c_custkey AS customer_id,
         CAST(DATE '1995-01-01' + CAST(c_custkey * 13 % 1800 AS INTEGER) AS TIMESTAMP) AS signup_date,
         n_name AS country,
         CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE 15 + (c_custkey * 7) % 90 END AS age,
         CASE WHEN c_custkey % 3 = 0 THEN 'Female' WHEN c_custkey % 3 = 1 THEN 'Male' ELSE 'Other' END AS gender,
         CASE WHEN c_acctbal < 4000 THEN 'Bronze' WHEN c_acctbal < 7000 THEN 'Silver'
              WHEN c_acctbal < 9000 THEN 'Gold' ELSE 'Platinum' END AS loyalty_tier,
         c_mktsegment AS acquisition_channel
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), products AS (
  SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand, p_retailprice AS base_price,
         CASE WHEN p_partkey % 23 = 0 THEN NULL
              ELSE CAST(DATE '1994-06-01' + p_size * 20 AS TIMESTAMP) END AS launch_date,
         CASE WHEN p_retailprice >= 980 THEN 1 ELSE 0 END AS is_premium
  FROM part
), raw AS (
  SELECT t.transaction_id, t.customer_id, t.product_id, t.ts, t.quantity, t.discount_applied, t.gross_revenue,
         t.is_refunded, t.campaign_id,
         c.signup_date, c.country, c.age, c.gender, c.loyalty_tier, c.acquisition_channel,
         p.category, p.brand, p.base_price, p.launch_date, p.is_premium
  FROM transactions t
  LEFT JOIN customers c ON t.customer_id = c.customer_id
  LEFT JOIN products p ON t.product_id = p.product_id
), stats AS (
  SELECT median(product_id) AS m_product_id, median(gross_revenue) AS m_gross_revenue, median(age) AS m_age,
         median(base_price) AS m_base_price, median(is_premium) AS m_is_premium, min(ts) AS min_ts
  FROM raw
), clean AS (
  SELECT transaction_id, customer_id,
         COALESCE(CAST(product_id AS DOUBLE), m_product_id) AS product_id,
         ts, quantity, discount_applied,
         COALESCE(gross_revenue, m_gross_revenue) AS gross_revenue,
         is_refunded, campaign_id, signup_date,
         COALESCE(country, 'Unknown') AS country,
         COALESCE(CAST(age AS DOUBLE), m_age) AS age,
         COALESCE(gender, 'Unknown') AS gender,
         COALESCE(loyalty_tier, 'Unknown') AS loyalty_tier,
         COALESCE(acquisition_channel, 'Unknown') AS acquisition_channel,
         COALESCE(category, 'Unknown') AS category,
         COALESCE(brand, 'Unknown') AS brand,
         COALESCE(base_price, m_base_price) AS base_price,
         COALESCE(launch_date, min_ts) AS launch_date,
         COALESCE(CAST(is_premium AS DOUBLE), m_is_premium) AS is_premium
  FROM raw CROSS JOIN stats
  WHERE COALESCE(gross_revenue, m_gross_revenue) > -1000
)
"""


def q(body: str) -> str:
    body = body.lstrip()
    if body[:4].upper() == "WITH":  # continue the base CTE list
        body = ", " + body[4:]
    return BASE + body


ORACLE: dict[str, str] = {}


def register(name: str, body: str) -> None:
    ORACLE[name] = q(body)
