"""Thresholds and fixed values used by the operators.

Fixed values: these must equal the published ledger application's constants
for results to agree; they are stated here together, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values ---------------------------------------------------------
LABELS = ("Expense", "Income", "Asset", "Liability")  # class index = position
VALID_CATEGORIES = LABELS
PAYMENT_MODE_DEFAULT = "Bank Transfer"
DESCRIPTION_DEFAULT = "unknown transaction"
VENDOR_DEFAULT = "unknown"
TEXT_UNKNOWN = "unknown"
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    # fixed values (application constants)
    ml_confidence: float = 0.70
    margin_strong: float = 15.0
    margin_moderate: float = 5.0
    margin_weak: float = 0.0
    tax_rate_low: float = 0.20
    tax_rate_high: float = 0.30
    tax_rate_unrealistic_pct: float = 35.0
    gst_ratio_high: float = 0.15
    expense_ratio_high: float = 0.80
    iqr_factor: float = 3.0
    min_rows_for_anomaly: int = 10
    top_n_expense: int = 3
    critical_weight: int = 5
    warning_weight: int = 3
    tfidf_max_features: int = 500
    tfidf_min_df: int = 2
    test_fraction: float = 0.20
    train_iterations: int = 30  # the reference's epoch cap, used as the optimiser's iteration cap
    contamination: float = 0.05
    seed: int = 42
    # Large-amount cut-offs of the tax checks (rupees)
    cash_expense_limit: int = 10_000
    cash_receipt_limit: int = 200_000
    tax_audit_turnover: int = 10_000_000
    tds_professional_limit: int = 30_000
    tds_contract_limit: int = 100_000
    advance_tax_pbt: int = 40_000
    advance_tax_min: int = 10_000
    # Engine choice, not a reference value: how per-group quantiles are found.
    # 'exact' = sketch brackets, verified; 'radix' = exact digit by digit; 'sketch' = approximate.
    quantile_method: str = "exact"
    approx_accuracy: int = 100_000


DEFAULT = Thresholds()
