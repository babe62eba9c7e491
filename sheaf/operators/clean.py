"""Ledger cleaning: dedupe -> median impute -> drop negatives -> text defaults -> dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DESCRIPTION_DEFAULT, PAYMENT_MODE_DEFAULT, VENDOR_DEFAULT, DEFAULT, Thresholds
from ..functions.scalars import parse_date
from ..schema import MONEY
from .common import join_small, resolve_by
from .dedupe import drop_duplicates
from .quantiles import group_quantiles_paise


def group_median_amount(df: DataFrame, by: list[str], t: Thresholds = DEFAULT) -> DataFrame:
    """Median Amount per key (nulls ignored), to the paisa (a half-paisa median rounds up)."""
    g = group_quantiles_paise(df, by, (0.5,), ("_med_paise",), t.quantile_method, t.approx_accuracy)
    return g.select(*by, (F.col("_med_paise").cast("decimal(20,1)") / 100).cast(MONEY).alias("_median"))


def impute_amount_median(df: DataFrame, by: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """Fill a null Amount with the median of its key (computed on the rows given)."""
    if "Amount" not in df.columns:
        return df
    by = resolve_by(df, by)
    med = group_median_amount(df, by, t)
    cols = [c for c in df.columns]
    out = join_small(df, med, by, how="left")
    return out.select(*[F.coalesce(F.col("Amount"), F.col("_median")).alias("Amount") if c == "Amount" else F.col(c)
                        for c in cols])


def drop_negative_amounts(df: DataFrame) -> DataFrame:
    """Drop Amount < 0; zeros and nulls stay (a null comparison is false in pandas too)."""
    if "Amount" not in df.columns:
        return df
    return df.filter(~F.coalesce(F.col("Amount") < 0, F.lit(False)))


def fill_text_defaults(df: DataFrame) -> DataFrame:
    fills = {"Description": DESCRIPTION_DEFAULT, "Payment_Mode": PAYMENT_MODE_DEFAULT,
             "Vendor_Client_Name": VENDOR_DEFAULT}
    fills = {k: v for k, v in fills.items() if k in df.columns}
    return df.fillna(fills) if fills else df


def parse_dates(df: DataFrame) -> DataFrame:
    if "Date" not in df.columns:
        return df
    return df.withColumn("Date", parse_date("Date"))


def clean_ledger(df: DataFrame, by: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """The cleaning chain in the reference order; the median sees negative amounts."""
    by = resolve_by(df, by)
    # written once: the median and the rows both read it, the comparison is not repeated
    out = drop_duplicates(df, name="deduplicated")
    out = impute_amount_median(out, by, t)
    out = drop_negative_amounts(out)
    out = fill_text_defaults(out)
    return parse_dates(out)
