"""Ledger operators. Each is ``(df, *, by=None, cat_col="Category", ...) -> DataFrame``."""
