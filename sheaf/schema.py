"""Ledger schema: the columns a ledger file carries, with Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("Company_ID", T.StringType()),
        T.StructField("Date", T.DateType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Amount", MONEY),
        T.StructField("Transaction_Type", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Sub_Category", T.StringType()),
        T.StructField("Schedule_III_Head", T.StringType()),
        T.StructField("GST_Percentage", T.IntegerType()),
        T.StructField("GST_Amount", MONEY),
        T.StructField("Payment_Mode", T.StringType()),
        T.StructField("Vendor_Client_Name", T.StringType()),
    ]
)

LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]

# CSV files carry dates as text; they are parsed after reading (bad text -> null).
LEDGER_CSV_SCHEMA = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "Date" else f.dataType) for f in LEDGER_SCHEMA.fields]
)
