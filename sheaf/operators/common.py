"""Small shared helpers for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MONEY



def resolve_by(df: DataFrame, by: list[str] | None) -> list[str]:
    """Default grouping: one result per company when the ledger has a Company_ID."""
    if by is None:
        return ["Company_ID"] if "Company_ID" in df.columns else []
    return list(by)


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """pandas ``groupby`` drops rows whose key is null; do the same before grouping."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def dsum(value: Column, cond: Column | None = None) -> Column:
    """Sum that is 0 (not null) over no rows, like pandas."""
    v = value if cond is None else F.when(cond, value)
    return F.coalesce(F.sum(v), F.lit(0).cast(MONEY))


def money(c: Column | str) -> Column:
    """Money leaves the engine as DOUBLE (exact decimal sum, then one conversion)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision; null when b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def attach_row(big: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row result (a global statistic) to every row as typed literals.

    The single row is collected - a scalar result, not data - so no join or
    cross product is planned. With no row, the columns are null.
    """
    r = one_row.first()
    cols = [F.lit(r[f.name] if r is not None else None).cast(f.dataType).alias(f.name) for f in one_row.schema.fields]
    return big.select("*", *cols)


def join_small(big: DataFrame, small: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join a per-group result (one row per key) back onto rows.

    With ``by=[]`` the small side is one global row, attached as literals.
    Otherwise it is an equi-join on the keys; AQE broadcasts it only when its
    measured size allows, else it sort-merges with skew splitting.
    """
    if not by:
        return attach_row(big, small)
    return big.join(small, on=by, how=how)


def sql_str(text: str) -> str:
    """A Spark SQL string literal for ``text``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
