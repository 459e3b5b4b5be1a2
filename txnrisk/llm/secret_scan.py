r"""Secret scans: fixed patterns, and windows of high entropy.

Patterns give the base spans (``assign``, ``access``, ``hex``).  Entropy adds
spans: every maximal run of key characters is a candidate; a window of
``WINDOW`` characters slides over it, and its Shannon entropy follows from
``sum(c * log2 c)`` over the counts ``c`` of its characters, of which a step
changes two.  The sum is kept in whole millionths, so that no rounding builds
up.  Windows at or over the limit of the candidate's character class join to a
span of that class.  Candidates on the allow list (UUIDs, documentation keys,
alphabets, paths, hyphened words) add none.  Base spans always stay.

All of it is Spark expressions.  Positions are code points, ends exclusive;
an ``assign`` span is the whole match, from the keyword to the value's end.

Defined cases: a null text is empty; an empty text has no span; repeated rows
are scanned each for itself; other columns are ignored; an empty table gives no
rows.  Cost is linear in the text's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.columns import once, prefix_sums

VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
          r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?(" + VALUE + ")")
ASSIGN_MIN = 12
# a run too short fails as a whole, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: character class of a candidate: (name, pattern of the whole candidate, entropy limit in bits)
CLASSES = (
    ("entropy_digits", r"^[0-9]+$", 3.21),
    ("entropy_hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.01),
    ("entropy_letters", r"^([a-z]+|[A-Z]?[a-z]+|[A-Z]+)$", 4.11),
    ("entropy_mixed", r"^.*$", 3.81),
)
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(EXAMPLE|example|SAMPLE|sample|placeholder|PLACEHOLDER)",
    r"(0123456789|abcdefghijklm|ABCDEFGHIJKLM)",
    r"^[A-Za-z]+([-_/][A-Za-z]+)+$",
)
KINDS = ("assign", "access", "hex", *[c[0] for c in CLASSES])


def sum_limit(bits: float, window: int = WINDOW) -> int:
    """Largest ``sum(c log2 c)`` (in millionths) of a window with that entropy:
    ``H = log2 w - sum / w``."""
    return math.floor(window * (math.log2(window) - bits) * 1e6)


def c_log_c(window: int = WINDOW) -> list[int]:
    return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(window + 1)]


def _starts(gaps: Column, found: Column) -> Column:
    """Starts of matches: each is after all gaps and matches before it."""
    long_len = lambda x: F.length(x).cast("long")
    before = prefix_sums(F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)),
                                    lambda m, g: long_len(m) + long_len(g)))
    return F.zip_with(before, F.slice(gaps, F.lit(1), F.size(found)), lambda b, g: b + long_len(g))


def _gaps(text: Column, pattern: str, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def _spans(kind: int, starts: Column, found: Column, keep: Column | None = None) -> Column:
    span = F.zip_with(starts, found, lambda s, m: F.struct(
        s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end")))
    if keep is None:
        return span
    kept = F.filter(F.zip_with(span, keep, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"])
    return F.transform(kept, lambda x: x["s"])


def _entropy_spans(cand: Column, start: Column, window: int = WINDOW) -> Column:
    """Spans of one candidate.  State: counts per character, their sum of
    c log2 c, the open span, and the closed ones."""
    codes = F.transform(F.split(cand, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    table = F.array(*[F.lit(x).cast("long") for x in c_log_c(window)])
    kind, limit = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (_, pattern, bits) in reversed([*enumerate(CLASSES)]):
        here = F.lit(True) if pattern == "^.*$" else F.rlike(cand, F.lit(pattern))
        kind = F.when(here, F.lit(len(KINDS) - len(CLASSES) + i)).otherwise(kind)
        limit = F.when(here, F.lit(sum_limit(bits, window)).cast("long")).otherwise(limit)
    span_type = "array<struct<start:bigint,kind:int,end:bigint>>"
    state = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"),
                     F.lit(-1).cast("long").alias("from"), F.lit(-1).cast("long").alias("to"),
                     F.array().cast(span_type).alias("spans"))
    cs = F.struct(codes.alias("codes"), kind.alias("kind"), limit.alias("limit"), start.alias("start"))

    def scan(c: Column) -> Column:
        def at(i: Column) -> Column:
            return F.get(c["codes"], i - 1)

        def step(s: Column, i: Column) -> Column:
            full = i > window
            out_n = F.when(full, F.get(s["counts"], at(i - window) - 1)).otherwise(F.lit(0))
            same = full & (at(i - window) == at(i))
            in_n = F.get(s["counts"], at(i) - 1) - F.when(same, 1).otherwise(0)
            total = (s["sum"] - F.get(table, out_n) + F.get(table, F.greatest(out_n - 1, F.lit(0)))
                     + F.get(table, in_n + 1) - F.get(table, in_n))
            counts = F.transform(s["counts"], lambda n, k: n + F.when(k + 1 == at(i), 1).otherwise(0)
                                 - F.when(full & (k + 1 == at(i - window)), 1).otherwise(0))
            hit = (i >= window) & (total <= c["limit"])
            fresh = hit & ((s["to"] < 0) | (i - window > s["to"]))
            return F.struct(
                counts.alias("counts"), total.alias("sum"),
                F.when(fresh, (i - window).cast("long")).otherwise(s["from"]).alias("from"),
                F.when(hit, i.cast("long")).otherwise(s["to"]).alias("to"),
                F.when(fresh & (s["to"] >= 0), F.array_append(s["spans"], F.struct(
                    (c["start"] + s["from"]).alias("start"), c["kind"].alias("kind"),
                    (c["start"] + s["to"]).alias("end")))).otherwise(s["spans"]).alias("spans"))

        return F.aggregate(
            F.sequence(F.lit(1), F.size(c["codes"])), state, step,
            lambda s: F.when(s["to"] >= 0, F.array_append(s["spans"], F.struct(
                (c["start"] + s["from"]).alias("start"), c["kind"].alias("kind"),
                (c["start"] + s["to"]).alias("end")))).otherwise(s["spans"]))

    return F.flatten(F.transform(F.array(cs), scan))


def allowed(cand: Column) -> Column:
    """Whether a candidate is on the allow list.  Java matches the repeated group of
    the last pattern by recursion, as deep as the text is long; three flat patterns say the same."""
    words = (F.rlike(cand, F.lit("^[A-Za-z][A-Za-z/_-]*[A-Za-z]$")) & F.rlike(cand, F.lit("[-_/]"))
             & ~F.rlike(cand, F.lit("[-_/][-_/]")))
    return F.rlike(cand, F.lit("|".join(ALLOW[:-1]))) | words


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, spans)`` for every document: ``spans`` is an array of
    ``(start, kind, end)`` in order of start, then kind; ``kind`` counts in
    ``KINDS``."""
    d = once(docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")),
             a=F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)),
             k=F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
             h=F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
             c=F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    col = F.col
    d = once(d, ga=_gaps(col("text"), ASSIGN, col("a")), gk=_gaps(col("text"), ACCESS, col("k")),
             gh=_gaps(col("text"), HEX, col("h")), gc=_gaps(col("text"), CANDIDATE, col("c")),
             av=F.when(F.size("a") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(col("a")))
    found = F.zip_with(_starts(col("gc"), col("c")), col("c"), lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    found = F.filter(found, lambda x: ~allowed(x["m"]))
    d = once(d, spans=F.sort_array(F.concat(
        _spans(0, _starts(col("ga"), col("a")), col("a"),
               F.transform("av", lambda v: F.length(v) >= ASSIGN_MIN)),
        _spans(1, _starts(col("gk"), col("k")), col("k")),
        _spans(2, _starts(col("gh"), col("h")), col("h")),
        F.flatten(F.transform(found, lambda x: _entropy_spans(x["m"], x["s"]))))))
    return d.select("doc_id", "text", "spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each maximal run of overlapping or touching spans replaced by ``mark``."""
    runs = F.aggregate(
        spans, F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))).otherwise(
            F.array_append(acc, F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    pieces = F.transform(F.array(runs), lambda r: F.concat(F.array_join(F.transform(r, lambda x, i: F.concat(
        F.substring(text, (F.coalesce(F.get(r, i - 1)["end"], F.lit(0)) + 1).cast("int"),
                    (x["start"] - F.coalesce(F.get(r, i - 1)["end"], F.lit(0))).cast("int")),
        F.lit(mark))), ""), F.substring(text, (F.element_at(r, -1)["end"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, F.get(pieces, F.lit(0))).otherwise(text)
