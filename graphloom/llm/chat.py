"""Operator 8: chat formatting, in DataFrame functions only.

Method: typed content parts.  A turn is a list of parts (text, image, audio, document); a
visitor flattens them into ordered placeholders, recording each attachment's reference and
the tokens it expands to.  The template is

    <|turn:ROLE|>CONTENT<|end|>

with ``<|KIND:N|>`` for the conversation's attachment N, and every ``&``, ``<``, ``[``, ``|``
of a role, kind or text becomes ``&amp;``, ``&lt;``, ``&#91;``, ``&#124;``, so no control
string can arise inside them and the original is restored exactly.

The visitor runs on rows, one per part, in the order of the conversation: numbers and places
are window sums, and a conversation is put together once, so its cost is linear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,units:bigint>"
#: fixed values: escapes in order of application, and tokens per unit of each attachment kind
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;")]
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
#: a text's tokens are estimated as its runs of letters and digits, and its other signs
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0D\x20]"
END = "<|end|>"


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def part(kind: Column, text: Column | None = None, ref: Column | None = None, units: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(kind.alias("kind"), (none if text is None else text).cast("string").alias("text"), (none if ref is None else ref).cast("string").alias("ref"), (none if units is None else units).cast("long").alias("units"))


def text_part(c: Column) -> Column:
    """A turn's content of one text part."""
    return F.array(part(F.lit("text"), F.coalesce(c, F.lit(""))))


def format_chat(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, loss_mask, attachments, expanded_tokens.

    Turns are ordered by turn (null first), ties by role and then content; turns equal in
    all stay two.  A null role is empty; null parts are no parts; a part without a kind is
    text, a null text is empty; an unknown kind is an attachment of 0 tokens, and a null
    unit count is 1.  Conversations with a null id form one conversation.  loss_spans lists
    (turn, part, start, length) in code points of every text part of ``learn`` turns,
    loss_mask whether each turn is one.  attachments lists n, turn, part, kind, ref, units
    and tokens in order of their placeholders.  expanded_tokens adds theirs to the texts'.
    A conversation of any length is one task and one string.  An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    every = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    flat = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), every.alias("parts"))
    content = F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit("")))
    talk = Window.partitionBy("conv_id")
    flat = flat.withColumn("n", F.row_number().over(talk.orderBy(F.col("t").asc_nulls_first(), "role", content, F.xxhash64("parts"))) - 1)
    rows = flat.select("conv_id", "n", "role", F.size("parts").alias("many"), F.posexplode_outer("parts").alias("k", "p")).withColumn("k", F.coalesce("k", F.lit(0)))
    kind = F.coalesce(F.col("p.kind"), F.lit("text"))
    before = talk.orderBy("n", "k").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    rows = rows.withColumn("other", kind != "text")
    rows = rows.withColumn("j", so_far(F.col("other").cast("int")))
    rows = rows.withColumn("body", F.when(F.col("other"), F.concat(F.lit("<|"), escape(kind), F.lit(":"), F.col("j").cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce("p.text", F.lit("")))))
    rows = rows.withColumn("head", F.when(F.col("k") == 0, F.concat(F.lit("<|turn:"), escape(F.col("role")), F.lit("|>"))).otherwise(""))
    rows = rows.withColumn("piece", F.concat("head", "body", F.when(F.col("k") >= F.col("many") - 1, END).otherwise("")))
    rows = rows.withColumn("start", so_far(F.length("piece")) + F.length("head"))
    rate = F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])
    tokens = F.when(F.col("other"), F.coalesce("p.units", F.lit(1)) * F.coalesce(F.try_element_at(rate, F.col("p.kind")), F.lit(0))).otherwise(F.regexp_count(F.coalesce("p.text", F.lit("")), F.lit(TOKEN)))
    one = F.struct("n", "k", "piece", "other", (F.col("role") == learn).alias("learn"), (F.col("many") > 0).alias("held"), "start", F.length("body").cast("long").alias("length"), "j", F.col("p.kind").alias("kind"), F.col("p.ref").alias("ref"), F.col("p.units").alias("units"), tokens.cast("long").alias("tokens"))
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    spans = F.transform(F.filter("all", lambda x: x["learn"] & x["held"] & ~x["other"]), lambda x: F.struct(x["n"].alias("turn"), x["k"].alias("part"), x["start"].alias("start"), x["length"].alias("length")))
    attached = F.transform(F.filter("all", lambda x: x["other"]), lambda x: F.struct(x["j"].alias("n"), x["n"].alias("turn"), x["k"].alias("part"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["units"].alias("units"), x["tokens"].alias("tokens")))
    return g.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.transform(F.filter("all", lambda x: x["k"] == 0), lambda x: x["learn"]).alias("loss_mask"),
        attached.alias("attachments"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Parses formatted conversations: adds turns (array of role, content, parts) and loss_text, unescaped.

    ``parts`` come back as they went in, but for empty texts, which vanish, and neighbouring
    texts, which are one; ``content`` is their text alone.  The text is cut once at the end
    marks, and a placeholder finds its attachment by number.  loss_text is the text of the
    masked turns; their length must be that of the spans.
    """
    raw = F.split(F.col("formatted"), r"<\|end\|>", -1)
    raw = F.slice(raw, 1, F.size(raw) - 1)
    cut = chats.withColumn("__raw", F.transform(raw, lambda x, n: F.struct(F.regexp_extract(x, r"(?s)^<\|turn:(.*?)\|>", 1).alias("role"), F.regexp_replace(x, r"(?s)^<\|turn:.*?\|>", "").alias("content"), F.get("loss_mask", n).alias("learn"))))
    holder = r"<\|[^|]*:(\d+)\|>"

    def parts(content: Column) -> Column:
        texts, numbers = F.split(content, holder, -1), F.regexp_extract_all(content, F.lit(holder), F.lit(1))
        at = lambda i: F.get("attachments", F.get(numbers, i).cast("int"))
        both = F.flatten(F.transform(texts, lambda s, i: F.array(part(F.lit("text"), unescape(s)), F.when(i < F.size(numbers), part(at(i)["kind"], None, at(i)["ref"], at(i)["units"])))))
        return F.filter(both, lambda p: p.isNotNull() & ~((p["kind"] == "text") & (p["text"] == "")))

    plain = lambda x: unescape(F.regexp_replace(x["content"], holder, ""))
    turns = F.transform("__raw", lambda x: F.struct(unescape(x["role"]).alias("role"), plain(x).alias("content"), parts(x["content"]).alias("parts")))
    learnt = F.filter("__raw", lambda x: x["learn"])
    loss = F.array_join(F.transform(learnt, plain), "")
    seen = F.aggregate(learnt, F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x["content"], holder, "")))
    said = F.aggregate("loss_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return cut.withColumn("turns", turns).withColumn("loss_text", F.when(seen == said, loss).otherwise(F.raise_error(F.lit("the loss spans do not cover the masked turns")))).drop("__raw")
