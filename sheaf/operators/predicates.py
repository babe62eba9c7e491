"""The predicate language of compliance rules: what a rule's condition may be, decided on its resolved expression tree.

A condition is one row's business: comparisons, logic, arithmetic, ``IN``, ``LIKE``, ``CASE`` and functions of text, numbers
and dates. Everything else is refused before any row is read: sub-queries, aggregates, windows, generators, calls whose
value differs from run to run or session to session, and calls out of SQL (reflection, user functions).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame

#: Nodes of a resolved expression that a condition may consist of, by what they do.
ALLOWED = frozenset(
    # values, logic and choice
    "Alias AttributeReference Literal TypedNullLiteral Cast And Or Not If CaseWhen Coalesce NullIf Nvl Nvl2 IfNull With CommonExpressionDef "
    "CommonExpressionRef "
    # comparison
    "EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual Between In InSet IsNull IsNotNull IsNaN "
    "Greatest Least "
    # numbers
    "Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive Abs Round BRound Floor Ceil "
    "FloorExpressionBuilder CeilExpressionBuilder Signum Sqrt Pow Log TryEval TryAdd TrySubtract TryMultiply TryDivide RoundFloor "
    "RoundCeil CheckOverflow PromotePrecision "
    # text
    "Like ILike LikeAll LikeAny NotLikeAll NotLikeAny RLike StartsWith EndsWith Contains Lower Upper StringTrim StringTrimLeft "
    "StringTrimRight StringTrimBoth Length Substring Left Right Concat ConcatWs StringInstr StringLocate StringReplace StringLPad "
    "StringRPad Reverse InitCap StringTranslate RegExpReplace RegExpExtract RegExpCount "
    # dates
    "Year Quarter Month DayOfMonth DayOfWeek WeekDay DayOfYear WeekOfYear LastDay DateAdd DateSub DateDiff AddMonths "
    "MonthsBetween TruncDate ParseToDate GetTimestamp".split())
#: The functions of the language, for sessions that do not show the resolved tree.
FUNCTIONS = frozenset(
    "and or not in like ilike rlike between case when then else if coalesce nullif nvl nvl2 ifnull isnull isnotnull isnan greatest "
    "least abs round bround floor ceil ceiling sign sqrt pow power ln mod pmod cast try_cast try_add try_subtract try_multiply "
    "try_divide startswith endswith contains lower lcase upper ucase trim ltrim rtrim btrim length char_length character_length "
    "substring substr left right concat concat_ws instr locate position replace lpad rpad reverse initcap translate "
    "regexp_replace regexp_extract regexp_count regexp_like year quarter month day dayofmonth dayofweek weekday dayofyear "
    "weekofyear last_day date_add date_sub datediff add_months months_between trunc to_date decimal int bigint double date".split())


def _nodes(tree):
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def refusal(df: DataFrame, condition: Column, text: str) -> str | None:
    """Why ``condition`` (its source is ``text``) is outside the language over the rows of ``df``; None if it is inside.

    Analysis errors are raised. No row is read.
    """
    plan = df.select(condition.alias("m"))
    kind = plan.schema["m"].dataType.simpleString()
    if kind != "boolean":
        return f"the condition is {kind}, not boolean"
    if not hasattr(plan, "_jdf"):  # a remote session: the names of the calls decide
        bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", text)
        calls = [c.lower() for c in re.findall(r"([A-Za-z_][A-Za-z0-9_.]*)\s*\(", bare)]
        words = {w.lower() for w in re.findall(r"[A-Za-z_]+", bare)}
        bad = [c for c in calls if c not in FUNCTIONS] + sorted(words & {"select", "over", "exists"})
        return f"{bad[0]} is not allowed in a condition" if bad else None
    tree = plan._jdf.queryExecution().analyzed()
    if tree.nodeName() != "Project" or not tree.children().apply(0).equals(df._jdf.queryExecution().analyzed()):
        return "aggregates, windows and generators are not allowed in a condition"
    root = tree.expressions().apply(0)
    for node in _nodes(root):
        name = node.getClass().getSimpleName()
        if name not in ALLOWED:
            return f"{node.prettyName()} is not allowed in a condition"
    return None if root.deterministic() else "the condition is not deterministic"
