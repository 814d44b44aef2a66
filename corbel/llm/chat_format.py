"""Chat formatting with typed content parts (DataFrame functions only).

A message has content parts: text, image, audio, document. A visitor flattens them in order. A text part
contributes its escaped text; any other part contributes a placeholder `<|kind|>` and an attachment record
(ordinal within the conversation, kind, reference, expanded token count, offset in the formatted string).

Template of a turn: `<|turn|>` role `<|text|>` content `<|end|>`. Control strings inside role and text get one
backslash after their first character; a control string that already has backslashes there gets one more, so
taking one away is the exact inverse. Text parts that stand side by side are joined before they are escaped, so no
control string comes together from several. Matches never overlap, as no control string begins within another one, and
the formatted string splits at unescaped markers without doubt.

Defined results: null or unknown role: empty string; null text: empty; null parts: a turn without content; null
reference: kept as null; null or negative sizes: 0 tokens; unknown kinds: placeholder `<|unknown|>` of 1 token;
several rows of one turn: ordered by role and content; empty table: no rows; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template and of common chat templates, by shape, after their first character.
CONTROL_REST = r"\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?(?:start|end)_of_turn>|(?:bos|eos|pad|unk)>|/?[A-Z][A-Z_]*\]"
ESCAPE_FROM, ESCAPE_TO = rf"([<\[])(\\*)({CONTROL_REST})", r"$1\\$2$3"
UNESCAPE_FROM, UNESCAPE_TO = rf"([<\[])\\(\\*)({CONTROL_REST})", "$1$2$3"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Expanded tokens of a part: image patches of 14 x 14 pixels, audio frames of 40 ms, document pages of 256 tokens.
PATCH, FRAMES_PER_S, PAGE_TOKENS = 14, 25, 256

PARTS = "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(ESCAPE_FROM), F.lit(ESCAPE_TO))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(UNESCAPE_FROM), F.lit(UNESCAPE_TO))


def text_part(c: Column) -> Column:
    """One text part around a plain text column."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), c.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("width"),
            none.cast("bigint").alias("height"), none.cast("double").alias("seconds"), none.cast("bigint").alias("pages"),
        )
    )


def _tokens(p: Column) -> Column:
    size = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    return (
        F.when(p["kind"] == "image", F.ceil(size(p["width"]) / PATCH) * F.ceil(size(p["height"]) / PATCH))
        .when(p["kind"] == "audio", F.ceil(size(p["seconds"]) * FRAMES_PER_S))
        .when(p["kind"] == "document", size(p["pages"]) * PAGE_TOKENS)
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def _placeholder(p: Column) -> Column:
    return F.when(p["kind"].isin("image", "audio", "document"), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(F.lit("<|unknown|>"))


#: Parts of a message that one step of the offsets' sums takes.
CHUNK = 256
#: Stands for a part other than text while the texts around it are escaped; NUL characters of the texts stand aside.
NUL, ASIDE, OTHER = "\0", "\0a", "\0b"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _before(sizes: Column) -> Column:
    """For each entry the sum of all before it; two levels of sums keep the work near linear."""
    chunks = F.sequence(F.lit(0), F.floor(F.size(sizes) / CHUNK).cast("int"))

    def places(starts: Column) -> Column:
        at = lambda k: F.floor(k / CHUNK).cast("int")
        return F.transform(sizes, lambda _, k: F.get(starts, at(k)) + _total(F.slice(sizes, at(k) * CHUNK + 1, k % CHUNK)))

    sums = F.transform(chunks, lambda c: _total(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))))
    return _let(_let(sums, lambda x: F.transform(x, lambda _, c: _total(F.slice(x, F.lit(1), c)))), places)


def _runs(parts: Column, is_text) -> Column:
    """The escaped texts before, between and after the parts other than text: one more than there are of those."""
    raw = F.transform(parts, lambda p: F.when(is_text(p), F.replace(F.coalesce(p["text"], F.lit("")), F.lit(NUL), F.lit(ASIDE))).otherwise(F.lit(OTHER)))
    return F.transform(F.split(escape(F.array_join(raw, "")), r"\x00b", -1), lambda t: F.replace(t, F.lit(ASIDE), F.lit(NUL)))


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end: code points of the formatted string that
    count for the loss, one span per turn of loss_role), attachments.

    Offsets are running sums over the conversation, made before the turns are gathered, so work stays linear in the
    number of turns."""
    p0 = F.coalesce(F.col(parts), F.array().cast(PARTS))
    is_text = lambda p: F.coalesce(p["kind"], F.lit("")) == "text"
    flat = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        F.col(role).eqNullSafe(F.lit(loss_role)).alias("in_loss"), _runs(p0, is_text).alias("runs"), F.filter(p0, lambda p: ~is_text(p)).alias("others"),
    )
    holders = F.transform("others", _placeholder)
    flat = flat.withColumn("content", F.array_join(F.zip_with("runs", F.concat(holders, F.array(F.lit(""))), lambda r, h: F.concat(r, h)), ""))
    flat = flat.withColumn("head", F.concat(F.lit(TURN), F.col("role"), F.lit(TEXT)))
    flat = flat.withColumn("n", F.length("head") + F.length("content") + F.lit(len(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flat = (
        flat.withColumn("pos", F.row_number().over(order))
        .withColumn("upto", F.sum("n").over(so_far))
        .withColumn("others_before", F.sum(F.size("others")).over(so_far) - F.size("others"))
    )
    start = F.col("upto") - F.col("n") + F.length("head")
    # A part stands after all runs and placeholders before it and the run right before it.
    run_sizes = F.slice(F.transform("runs", F.length), F.lit(1), F.size("others"))
    sizes = F.zip_with(run_sizes, F.transform("others", lambda p: F.length(_placeholder(p))), lambda r, h: r + h)
    at = F.zip_with(_let(sizes, _before), run_sizes, lambda b, r: start + b + r)
    found = F.transform(
        F.arrays_zip(F.col("others").alias("part"), at.alias("at")),
        lambda x, i: F.struct(
            (F.col("others_before") + i).cast("bigint").alias("ordinal"), F.coalesce(x["part"]["kind"], F.lit("unknown")).alias("kind"),
            x["part"]["ref"].alias("ref"), _tokens(x["part"]).alias("tokens"), x["at"].cast("bigint").alias("at"),
        ),
    )
    flat = flat.select(
        "conv_id",
        F.struct(
            "pos", F.concat("head", "content", F.lit(END)).alias("seg"), F.when(F.size("others") > 0, found).otherwise(F.array().cast("array<struct<ordinal:bigint,kind:string,ref:string,tokens:bigint,at:bigint>>")).alias("found"),
            F.when(F.col("in_loss"), F.struct(start.cast("bigint").alias("start"), (start + F.length("content")).cast("bigint").alias("end"))).alias("loss"),
        ).alias("t"),
    )
    got = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["seg"]), "").alias("formatted"),
        F.filter(F.transform("ts", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: t["found"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The inverse for text turns: array of (role, text), unescaped."""
    segs = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda s: s.startswith(TURN))
    return F.transform(
        segs,
        lambda s: F.struct(
            unescape(F.substring_index(F.substring(s, len(TURN) + 1, 2**31 - 1), TEXT, 1)).alias("role"),
            unescape(F.substring(s, F.instr(s, TEXT) + len(TEXT), F.lit(2**31 - 1))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
