"""SQL text of the ``ledger`` / ``ledger_dirty`` fixture views (ANSI; runs in DuckDB and Spark SQL).

Used as a CTE prefix by the oracle queries, since the oracle engine only has
the driver's base tables registered.
"""

from __future__ import annotations

from ..sources.coa import coa_rows


def _coa_values() -> str:
    rows = []
    for cat, idx, sub, head, exempt in coa_rows():
        rows.append("('%s',%d,'%s','%s',%d)" % (cat, idx, sub.replace("'", "''"), head.replace("'", "''"), exempt))
    return ",\n".join(rows)


LEDGER_SQL = f"""
WITH coa AS (SELECT * FROM (VALUES {_coa_values()}) AS t(category, idx, sub_category, s3_head, gst_exempt)),
base AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_tax,
         CAST(l.l_extendedprice AS DECIMAL(18,2))
           * CASE WHEN (l.l_partkey + l.l_suppkey) % 20 = 0 THEN 50 ELSE 1 END AS amt,
         (l.l_partkey * 7 + l.l_linenumber) % 10 AS cat_n, p.p_name, s.s_name, c.c_nationkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey),
cat AS (SELECT base.*,
               CAST(base.amt * CASE WHEN cat_n BETWEEN 5 AND 7 THEN
                      CASE c_nationkey % 5 WHEN 0 THEN 1.00 WHEN 1 THEN 1.70 WHEN 2 THEN 1.85 WHEN 3 THEN 2.50 ELSE 3.00 END
                    ELSE 1.00 END AS DECIMAL(18,2)) AS amt2,
               CASE WHEN cat_n < 5 THEN 'Expense' WHEN cat_n < 8 THEN 'Income'
                       WHEN cat_n = 8 THEN 'Asset' ELSE 'Liability' END AS category,
               (l_partkey + l_orderkey) % CASE WHEN cat_n < 5 THEN 23 WHEN cat_n < 8 THEN 9
                       WHEN cat_n = 8 THEN 18 ELSE 20 END AS idx
        FROM base),
j AS (SELECT cat.*, coa.sub_category, coa.s3_head,
             CASE WHEN coa.gst_exempt = 1 OR l_tax < 0.005 THEN 0 WHEN l_tax < 0.025 THEN 5
                  WHEN l_tax < 0.045 THEN 12 WHEN l_tax < 0.075 THEN 18 ELSE 28 END AS gst_pct
      FROM cat JOIN coa ON cat.category = coa.category AND cat.idx = coa.idx)
SELECT CONCAT('COMP_', LPAD(CAST(c_nationkey + 1 AS VARCHAR(10)), 3, '0')) AS Company_ID,
       CAST(l_shipdate AS DATE) AS Date,
       CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE CONCAT(sub_category, ' - ', p_name, '!') END AS Description,
       amt2 AS Amount,
       CASE WHEN category IN ('Expense','Asset') THEN 'Debit' ELSE 'Credit' END AS Transaction_Type,
       category AS Category, sub_category AS Sub_Category, s3_head AS Schedule_III_Head,
       gst_pct AS GST_Percentage,
       CAST(ROUND(amt2 * CAST(gst_pct AS DECIMAL(4,0)) * CAST('0.01' AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS GST_Amount,
       CASE WHEN l_partkey % 67 = 0 THEN NULL
            ELSE CASE (l_orderkey + l_linenumber) % 10 WHEN 0 THEN 'Cash' WHEN 1 THEN 'UPI' WHEN 2 THEN 'UPI'
                 WHEN 3 THEN 'Bank Transfer' WHEN 4 THEN 'Bank Transfer' WHEN 5 THEN 'Bank Transfer'
                 WHEN 6 THEN 'NEFT/RTGS' WHEN 7 THEN 'NEFT/RTGS' WHEN 8 THEN 'Cheque' ELSE 'Credit' END END AS Payment_Mode,
       s_name AS Vendor_Client_Name
FROM j
"""

LEDGER_DIRTY_SQL = """
WITH k AS (SELECT *, CAST(Amount * 100 AS BIGINT) AS k FROM ledger),
d AS (SELECT Company_ID, Date, Description,
             CASE WHEN k % 251 = 0 THEN -Amount WHEN k % 251 = 1 THEN CAST(0 AS DECIMAL(18,2))
                  WHEN k % 251 = 2 THEN NULL ELSE Amount END AS Amount,
             Transaction_Type,
             CASE WHEN k % 509 = 3 THEN 'Misc' WHEN k % 509 = 4 THEN NULL ELSE Category END AS Category,
             Sub_Category, Schedule_III_Head, GST_Percentage, GST_Amount, Payment_Mode, Vendor_Client_Name, k
      FROM k),
u AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE k % 127 = 5)
SELECT Company_ID, Date, Description, Amount, Transaction_Type, Category, Sub_Category, Schedule_III_Head,
       GST_Percentage, GST_Amount, Payment_Mode, Vendor_Client_Name
FROM u
"""


def with_ledger(sql: str, dirty: bool = False) -> str:
    """Prefix ``sql`` with the fixture views as CTEs (``ledger`` and optionally ``ledger_dirty``)."""
    ctes = [f"ledger AS ({LEDGER_SQL})"]
    if dirty:
        ctes.append(f"ledger_dirty AS ({LEDGER_DIRTY_SQL})")
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
