r"""Chat formatting with a grammar round trip, in built-in functions.

A conversation is its turns in order, each a span between control strings:

    user       <s>[INST] text [/INST]
    assistant  <a> text </s>
    others     <<SYS>>role\n text <</SYS>>

Other roles are URL-encoded. A control string inside a text (after any number of backslashes) conflicts with the grammar
and gets one backslash more; the parser splits the output at bare control strings and takes that backslash away. So the
first escape already makes the recovered turns identical to the source: a text without control strings is unchanged, one
with them keeps no bare one, and the blank before a closing string keeps a text's own last backslash apart. Every
conversation is parsed and compared all the same (``identical``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

#: Opening and closing control strings.
USER, ASSISTANT, OTHER = ("<s>[INST]", "[/INST]"), ("<a>", "</s>"), ("<<SYS>>", "<</SYS>>")
_CONTROL = r"(?:<s>|</s>|<a>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)"
_ESCAPE = rf"(\\*{_CONTROL})"
_UNESCAPE = rf"\\(\\*{_CONTROL})"
#: A turn in the output: bare opening string, body, bare closing string.
_TURN = (r"(?s)(?:(?<!\\)<s>\[INST\] (.*?) (?<!\\)\[/INST\])|(?:(?<!\\)<a> (.*?) (?<!\\)</s>)|"
         r"(?:(?<!\\)<<SYS>>(.*?) (?<!\\)<</SYS>>)")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def rendered(role: Column, text: Column) -> Column:
    """One turn of the output."""
    body = escaped(text)
    return (F.when(role == "user", F.concat(F.lit(USER[0] + " "), body, F.lit(" " + USER[1])))
            .when(role == "assistant", F.concat(F.lit(ASSISTANT[0] + " "), body, F.lit(" " + ASSISTANT[1])))
            .otherwise(F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit("\n"), body, F.lit(" " + OTHER[1]))))


def parsed(output: Column) -> Column:
    """Turns (role, text) read back from the output."""
    spans = F.regexp_extract_all(output, F.lit(_TURN), F.lit(0))

    def turn(s):
        user, asst = s.startswith(USER[0]), s.startswith(ASSISTANT[0] + " ")
        cut = lambda a, b: F.substring(s, F.lit(len(a) + 1), F.length(s) - len(a) - len(b))
        inner = cut(OTHER[0], " " + OTHER[1])
        head = F.substring_index(inner, "\n", 1)
        role = F.when(user, "user").when(asst, "assistant").otherwise(F.url_decode(head))
        body = (F.when(user, cut(USER[0] + " ", " " + USER[1])).when(asst, cut(ASSISTANT[0] + " ", " " + ASSISTANT[1]))
                .otherwise(F.substring(inner, F.length(head) + 2, F.length(inner))))
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(spans, turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, turns (role, text; read back from ``formatted``) and identical.

    Rows with a null conv_id are one conversation. Turns follow ``turn`` (null first), then role and text, so ties and
    repeated rows have one order. Null texts and roles are empty. Other columns are ignored.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    out = talks.withColumn("formatted", F.array_join(F.transform("source", lambda t: rendered(t["role"], t["text"])), ""))
    out = out.withColumn("turns", parsed(F.col("formatted")))
    same = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("turns")
    return out.select("conv_id", "formatted", "turns", same.alias("identical"))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back; the loss mask covers assistant texts.

    Fails on a conversation whose turns did not come back identical.
    """
    formatted = formatted.withColumn("turns", F.when(F.col("identical"), F.col("turns")).otherwise(
        F.raise_error(F.lit("a conversation's turns did not come back identical"))))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings themselves."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(format_conversations(rows.unionByName(own)))


_ESC_SQL = r"""regexp_replace(text, '(\\*(?:<s>|</s>|<a>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>))', '\\\1', 'g')"""
OP9_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, CASE role WHEN 'user' THEN '<s>[INST] ' || {_ESC_SQL} || ' [/INST]'
                      WHEN 'assistant' THEN '<a> ' || {_ESC_SQL} || ' </s>'
                      ELSE '<<SYS>>' || role || chr(10) || {_ESC_SQL} || ' <</SYS>>' END AS out FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(out)) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
