"""Text column functions, all built-in Spark expressions (whole-stage codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TEXT_UNKNOWN


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Lower-case, every run of characters outside ``[a-z0-9]`` becomes one space, trim.

    Null becomes ``"unknown"``. Equivalent to deleting punctuation first and
    then collapsing white space, because both turn into single spaces.
    """
    return F.coalesce(F.trim(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", " ")), F.lit(TEXT_UNKNOWN))


# ---- fixed values: code-point ranges removed by strip_emoji, in source order ----
EMOJI_RANGES = (
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF),
    (0x2702, 0x27B0), (0x24C2, 0x1F251), (0x1FA70, 0x1FAFF), (0x2500, 0x2BEF),
    (0x2300, 0x23FF), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x20D0, 0x20FF), (0x0300, 0x036F),
)
# White space removed at both ends (the characters Python's str.strip removes).
STRIP_SPACE = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# ---------------------------------------------------------------------------------


def _char_class(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a != b else f"\\x{{{a:X}}}" for a, b in ranges) + "]"


EMOJI_PATTERN = _char_class(EMOJI_RANGES) + "+"
EDGE_SPACE_PATTERN = "^" + _char_class(STRIP_SPACE) + "+|" + _char_class(STRIP_SPACE) + "+$"


def strip_emoji(c: Column | str) -> Column:
    """Delete emoji / symbol ranges (the wide U+24C2-U+1F251 range also removes CJK) and strip."""
    return F.regexp_replace(F.regexp_replace(_c(c), EMOJI_PATTERN, ""), EDGE_SPACE_PATTERN, "")


def inr_format(c: Column | str, symbol: bool = True) -> Column:
    """Indian lakh/crore grouping with 2 decimals: ``₹6,33,85,218.98``, ``₹-1,00,000.00``.

    Works on the exact decimal text (value rounded half-up to paise first):
    the last three integer digits stay together, the rest are grouped in
    pairs by reversing, inserting a comma after every two digits and
    reversing back (no look-ahead, so the same pattern runs in any engine).
    """
    v = _c(c).cast("decimal(20,2)")
    txt = F.abs(v).cast("string")
    int_part = F.substring_index(txt, ".", 1)
    dec_part = F.substring_index(txt, ".", -1)
    return _inr_assemble(int_part, dec_part, v, symbol)


def _inr_assemble(int_part: Column, dec_part: Column, v: Column, symbol: bool) -> Column:
    n = F.length(int_part)
    head = F.substring(int_part, F.lit(1), n - 3)
    grouped_head = F.reverse(F.regexp_replace(F.regexp_replace(F.reverse(head), r"(\d{2})", "$1,"), ",$", ""))
    body = F.when(n > 3, F.concat(grouped_head, F.lit(","), F.substring(int_part, -3, 3))).otherwise(int_part)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    prefix = F.lit("₹" if symbol else "")
    return F.when(v.isNotNull(), F.concat(prefix, sign, body, F.lit("."), dec_part))


def inr_plain(c: Column | str) -> Column:
    """PDF-safe variant: ``Rs. `` instead of the rupee sign."""
    return F.replace(inr_format(c), F.lit("₹"), F.lit("Rs. "))


# ---- fixed values: keyword rules (pattern, class), first match wins ------------
KEYWORD_RULES = (
    ("salary|payroll|wage|compensation|bonus|gratuity", "Expense"),
    ("rent|lease|electricity|power|internet|insurance", "Expense"),
    ("raw material|purchase|supplier|vendor|inventory", "Expense"),
    ("loan interest|bank charge|overdraft|finance cost", "Expense"),
    ("depreciation|amortis|capital consumable", "Expense"),
    ("sales|revenue|service income|client receipt", "Income"),
    ("other income|interest received|dividend", "Income"),
    ("plant|machinery|vehicle|equipment|furniture|land", "Asset"),
    ("software|patent|trademark|goodwill", "Asset"),
    ("trade receivable|debtor|advance paid", "Asset"),
    ("cash|bank balance|fixed deposit", "Asset"),
    ("loan taken|borrowing|debenture|term loan", "Liability"),
    ("creditor|payable|advance received", "Liability"),
    ("provision|tax payable|gst payable", "Liability"),
)
KEYWORD_DEFAULT_ASSET_ABOVE = 500_000
# -------------------------------------------------------------------------------


_REGEX_META = set(".^$*+?()[]{}\\")


def _matches(text: Column, pattern: str) -> Column:
    """``re.search(pattern, text)``; a pattern made only of literal alternatives becomes an OR of
    substring tests (byte search in generated code), anything else stays a regex."""
    if any(ch in _REGEX_META for ch in pattern):
        return text.rlike(pattern)
    out = None
    for word in pattern.split("|"):
        c = text.contains(word)
        out = c if out is None else out | c
    return out


def keyword_category(description: Column | str, amount: Column | str) -> Column:
    """Keyword fallback class of a raw description; no match: Asset above 5 lakh, else Expense."""
    # patterns are lower-case ASCII: lower-casing the text once replaces a case-insensitive match
    d = F.lower(F.coalesce(_c(description), F.lit("")))
    out = None
    for pattern, label in KEYWORD_RULES:
        cond = _matches(d, pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    default = F.when(_c(amount) > KEYWORD_DEFAULT_ASSET_ABOVE, F.lit("Asset")).otherwise(F.lit("Expense"))
    return out.otherwise(default)
