"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Only built-in functions run. A candidate is a maximal run of key-like characters with a digit and a letter. Windows of
``WINDOW`` characters slide over its two character classes (runs of hex digits, and the whole run as base64 or URL-safe
text). The entropy of a window follows from the last one's: the counts of the entering and the leaving character change
by one, and the sum of c log2 c with them. A candidate with a window over its class's threshold is reported, unless an
allow-list pattern explains it or a pattern span covers a part of it already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
HEX_RUN = r"[0-9a-fA-F]{20,}+"

WINDOW = 20
HEX_BITS = 3.0
#: Of random base64 of 20 characters, the shortest candidate, 1.1 % stay under this (20,000 drawn).
BASE64_BITS = 3.65
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Parts of paths and slugs: lower-case words with at most one capital before them, or capitals, and few digits.
PART = r"(?:(?:[A-Z]?[a-z]+|[A-Z]{2,})\d{0,4}|[a-z]?\d{1,4})"
#: What high entropy does not make a secret, if it explains the whole value: UUIDs, integrity digests, alphabets and
#: sequences, stand-ins among words, single words, slugs and file paths. The group loops are possessive: the matcher then
#: repeats them in a loop and does not call itself for each part, so a value of any length is safe.
ALLOWED = (r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$|^(?i:sha(?:1|256|384|512))[-=]"
           r"|^(?i:(?:abcdef(?:gh[i-z]*)?|0?1234567[089]*)[-_+/=]*)++$"
           r"|^(?=(?i:(?:[a-z]+\d{0,4}|\d{1,8})[-_/+=]++)*+(?i:[a-z]+\d{0,4}|\d{1,8})?+$)"
           r"(?:.*[-_/+=])?(?i:example|sample|placeholder|dummy|changeme|your|x{6,})\d{0,4}(?:[-_/+=].*)?$"
           rf"|^[A-Z]?[a-z]+\d{{0,4}}$|^/?(?:{PART}[-_/=])++(?:{PART})?$")

KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
_NONE = "array<struct<start:bigint,ord:int,end:bigint>>"


def _long(x) -> Column:
    return x.cast("long")


def _spans(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """Places of a pattern's leftmost matches in code points: gaps between matches and matches, summed up."""
    def build():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        gaps = F.split(text, pattern, -1)
        sized = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(
            _long(F.length(g)).alias("gap"), _long(F.length(m)).alias("size"))), value,
            lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), v.alias("value")))
        shape = "struct<pos:bigint,out:array<struct<start:bigint,ord:int,end:bigint,value:string>>>"
        first = F.struct(F.lit(0).cast("long").alias("pos"), F.array().alias("out")).cast(shape)
        placed = F.aggregate(sized, first, lambda a, x: F.struct(
            (a["pos"] + x["gap"] + x["size"]).alias("pos"),
            F.concat(a["out"], F.array(F.struct(
                (a["pos"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("ord"),
                (a["pos"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))).alias("out")).cast(shape),
            lambda a: a["out"])
        kept = F.filter(placed, lambda s: keep(s["value"])) if keep else placed
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), build()).otherwise(F.array().cast(_NONE))


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of any window of a run, by incremental counts.

    Characters outside ``ALPHABET`` share one count. A run shorter than the window is one window. Empty or null: 0.
    """
    place = lambda text: F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # each step's entering character beside the one that leaves the window (-1: none yet)
    steps = F.zip_with(place(run), F.concat(F.array_repeat(F.lit(-1), window), place(run)),
                       lambda into, out: F.struct(into.alias("into"), out.alias("out")))
    shape = "struct<counts:array<int>,i:int,s:double,best:double>"
    first = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).alias("i"),
                     F.lit(0.0).alias("s"), F.lit(0.0).alias("best")).cast(shape)

    def slide(a, x):
        into, out = x["into"], x["out"]
        counts = F.transform(a["counts"], lambda c, k: c + (k == into).cast("int") - (k == out).cast("int"))
        c_in = F.element_at(a["counts"], into + 1)
        c_out = F.element_at(a["counts"], F.greatest(out, F.lit(0)) + 1) + (out == into).cast("int")
        s = (a["s"] + _clog(c_in + 1) - _clog(c_in)
             - F.when(out >= 0, _clog(c_out) - _clog(c_out - 1)).otherwise(0.0))
        best = F.when(a["i"] + 1 >= window, F.greatest(a["best"], F.log2(F.lit(float(window))) - s / window)
                      ).otherwise(a["best"])
        # the concatenation is longer than the run: its tail has no entering character
        return F.when(into.isNull(), a).otherwise(F.struct(
            counts.alias("counts"), (a["i"] + 1).alias("i"), s.alias("s"), best.alias("best")).cast(shape))

    end = lambda a: F.when(a["i"] >= window, a["best"]).otherwise(F.log2(a["i"].cast("double")) - a["s"] / a["i"])
    return F.when(F.length(run) > 0, F.aggregate(steps, first, slide, end)).otherwise(F.lit(0.0))


def _suspicious(value: Column, bits: float) -> Column:
    return ~value.rlike(ALLOWED) & (window_entropy(value) >= bits)


def secret_spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text (null: empty), ``found``: spans (start, ord, end) by start, then kind; and ``keep``.

    ``ord`` is the place in ``KINDS``; code points, end exclusive. Repeated rows are scanned each; columns that are not
    in ``keep`` are dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = ["doc_id", "text", *(keep or [])]
    out = docs.select("doc_id", text.alias("text"), *(keep or []))
    t = F.col("text")
    out = out.select(*own, _spans(t, ASSIGN, "assign", lambda v: F.length(v) >= 8, 2).alias("__a"),
                     _spans(t, ACCESS, "access", lambda v: F.length(v) >= 16).alias("__k"),
                     _spans(t, HEX, "hex").alias("__h"),
                     _spans(t, CANDIDATE, "entropy_base64", lambda v: _suspicious(v, BASE64_BITS)).alias("__b"),
                     _spans(t, HEX_RUN, "entropy_hex", lambda v: v.rlike("[0-9]") & v.rlike("[A-Fa-f]")
                            & _suspicious(v, HEX_BITS)).alias("__x"))
    apart = lambda seen: (lambda e: ~F.exists(seen, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    out = out.withColumn("__base", F.concat("__a", "__k", "__h"))
    out = out.withColumn("__x", F.filter("__x", apart(F.col("__base"))))
    out = out.withColumn("__b", F.filter("__b", apart(F.concat("__base", "__x"))))
    return out.select(*own, F.array_sort(F.concat("__base", "__x", "__b")).alias("found"))


def _written_out(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["ord"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start; overlapping ones together) replaced by ``mask``."""
    shape = "struct<pos:bigint,out:string>"
    first = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out")).cast(shape)
    body = F.aggregate(found, first, lambda a, s: F.struct(
        F.greatest(a["pos"], s["end"]).alias("pos"),
        F.when((s["start"] < a["pos"]) & (a["pos"] > 0), a["out"]).otherwise(F.concat(
            a["out"], F.substring(text, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")), F.lit(mask)))
        .alias("out")).cast(shape),
        lambda a: F.concat(a["out"], F.substring(text, (a["pos"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(found) == 0, text).otherwise(body)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    out = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["ord"] < 3)
    count = lambda k: _long(F.size(F.filter("found", lambda s: s["ord"] == k)))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(_written_out(base), 256).alias("base_sha256"), _written_out(F.col("found")).alias("spans"))
