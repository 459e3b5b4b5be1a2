"""Chat formatting by relational operations only.

Turns are collected as structs and sorted, adjacent turns of one role are
merged into a block by array functions, and blocks are concatenated.  Python
never sees a row.

``<s>ROLE[INST]TEXT[SEP]TEXT</s>`` is one block: a role and the texts of its
adjacent turns.  Inside roles and texts a backslash becomes ``\\e`` and each
control string a backslash and a letter, so markers are never found inside a
text and reading back is exact.

Defined cases: a null text or role is empty; a null turn number sorts first;
turns of equal number are ordered by role, then text; repeated rows are turns
of their own; rows with a null conversation id form one conversation with a
null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.columns import once, prefix_sums

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Markers of a block and further strings that a tokenizer would take for
    markers.  No marker may hold a backslash, start inside another one, or be
    the start of another one."""

    block_open: str = "<s>"
    role_close: str = "[INST]"
    turn_sep: str = "[SEP]"
    block_close: str = "</s>"
    reserved: tuple[str, ...] = ("[/INST]", "<|im_start|>", "<|im_end|>")
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.block_open, self.role_close, self.turn_sep, self.block_close, *self.reserved)

    def escape(self, c: Column) -> Column:
        c = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "e"))
        for i, s in enumerate(self.controls):
            c = F.replace(c, F.lit(s), F.lit(ESCAPE + chr(ord("A") + i)))
        return c

    def unescape(self, c: Column) -> Column:
        for i, s in enumerate(self.controls):
            c = F.replace(c, F.lit(ESCAPE + chr(ord("A") + i)), F.lit(s))
        return F.replace(c, F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def format_conversations(turns: DataFrame, template: Template = Template(), conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: one row per conversation;
    ``loss_spans`` are code-point ranges (end exclusive) of ``formatted`` that
    hold the escaped texts of ``template.loss_roles``, in order."""
    t = template
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"),
                 t.escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
                 t.escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"))
    convs = once(rows.groupBy("conv_id").agg(F.collect_list("t").alias("ts")).select(
        "conv_id", F.sort_array("ts").alias("ts")))
    ts = F.col("ts")

    def piece(x: Column, i: Column) -> Column:
        new = (i == 0) | (F.get(ts, i - 1)["role"] != x["role"])
        last = (i == F.size(ts) - 1) | (F.get(ts, i + 1)["role"] != x["role"])
        head = F.when(new, F.concat(F.lit(t.block_open), x["role"], F.lit(t.role_close))).otherwise(
            F.lit(t.turn_sep))
        tail = F.when(last, F.lit(t.block_close)).otherwise(F.lit(""))
        return F.struct(head.alias("head"), x["text"].alias("body"), tail.alias("tail"),
                        x["role"].isin([*t.loss_roles]).alias("loss"))

    convs = once(convs, ps=F.transform(ts, piece)).select("conv_id", "ps")
    convs = once(convs, at=prefix_sums(F.transform("ps", lambda p: (
        F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long"))))
    spans = F.filter(
        F.zip_with("ps", "at", lambda p, a: F.struct(
            p["loss"].alias("loss"), (a + F.length(p["head"])).alias("start"),
            (a + F.length(p["head"]) + F.length(p["body"])).alias("end"))),
        lambda s: s["loss"])
    return convs.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])),
                     "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, formatted, turns, loss_text)`` from ``format_conversations``'
    output alone: the turns ``(role, text)`` in order and the unescaped text
    under the loss mask."""
    t = template

    def quoted(s: str) -> str:
        return "\\Q" + s + "\\E"

    def block(b: Column) -> Column:
        body = F.substring(b, F.lit(1), F.length(b) - len(t.block_close))
        parts = F.split(body, quoted(t.role_close), -1)
        role = t.unescape(F.get(parts, F.lit(0)))
        return F.transform(F.split(F.get(parts, F.lit(1)), quoted(t.turn_sep), -1),
                           lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    blocks = F.split("formatted", quoted(t.block_open), -1)
    return formatted.select(
        "conv_id", "formatted",
        F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), block)).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: t.unescape(F.substring(
            F.col("formatted"), (s["start"] + 1).cast("int"),
            (s["end"] - s["start"]).cast("int")))), "").alias("loss_text"))
