"""Chat formatting: typed content parts become one string a conversation, with its loss mask and attachments.

Every turn is `<|turn|>role<|says|>content<|end|>`. Content parts are visited in order: text is escaped, an image,
audio or document part becomes its placeholder, and its reference and expanded token count are recorded. Control strings
of this template and of common others begin with `<` or `[`. Escaping puts a backslash behind each of the two, and doubles
backslashes; so a `<` or `[` of a text is never followed by what stands next in the text, in the next part or in the
template, no text can pose as markup wherever parts meet, and everything can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Placeholder by part type, and the tokens that one unit (tile, second, page) of it expands to.
PLACEHOLDERS = {"image": ("<|image|>", 256), "audio": ("<|audio|>", 25), "document": ("<|document|>", 512)}
#: Characters that control strings begin with.
OPENERS = ("<", "[")
#: A row is a content part of a turn.
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in OPENERS:
        text = F.replace(text, F.lit(c), F.lit(f"{c}\\"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def text_part(text: Column) -> Column:
    """A turn's text as its only part."""
    none = F.lit(None).cast("string")
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), F.lit(None).cast("int").alias("units"))
    ).cast(PARTS)


def visit(parts: Column) -> Column:
    """The content string of a turn's parts. A part of unknown kind, or text that is null, adds nothing."""

    def one(part: Column) -> Column:
        out = F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
        for kind, (mark, _) in PLACEHOLDERS.items():
            out = out.when(part["kind"] == kind, F.lit(mark))
        return out.otherwise(F.lit(""))

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(PARTS)), one), "")


def attachments(turn: Column, parts: Column) -> Column:
    """The parts that aren't text: turn, position in the turn, kind, reference, expanded tokens."""

    def one(part: Column, i: Column) -> Column:
        tokens = F.lit(0)
        for kind, (_, each) in PLACEHOLDERS.items():
            tokens = F.when(part["kind"] == kind, F.coalesce(part["units"], F.lit(1)) * each).otherwise(tokens)
        return F.struct(turn.alias("turn"), i.alias("at"), part["kind"].alias("kind"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"))

    all_parts = F.transform(F.coalesce(parts, F.array().cast(PARTS)), one)
    return F.filter(all_parts, lambda x: x["kind"].isin(*PLACEHOLDERS))


def plain_text(parts: Column) -> Column:
    """The texts of the text parts, one after the other."""
    texts = F.transform(parts, lambda p: F.when(p["kind"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit("")))
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, attachment_tokens; a row for each conv_id of (conv_id, turn, role, text).

    Turns go by number, null first, ties by role and text as they are in the input, then by parts. A null text or role is
    empty; repeated rows stay repeated; other columns are left out. Rows with a null conv_id make one conversation.
    loss_spans: (start, length) in code points of each assistant text. A text may be of any length.
    """
    role = F.coalesce("role", F.lit("")).alias("role")
    if parts_col:
        parts = F.col(f"`{parts_col}`").cast(PARTS)
        row = F.struct(F.col("turn").alias("turn"), role, plain_text(parts).alias("text"), parts.alias("parts"))
        content, more = lambda r: visit(r["parts"]), F.flatten(F.transform("rows", lambda r: attachments(r["turn"], r["parts"])))
    else:
        row = F.struct(F.col("turn").alias("turn"), role, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        content, more = lambda r: escape(r["text"]), F.flatten(F.transform("rows", lambda r: attachments(r["turn"], F.array().cast(PARTS))))
    own = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    said = lambda r: F.struct((r["role"] == "assistant").alias("mine"), F.concat(F.lit(TURN), escape(r["role"]), F.lit(SAYS)).alias("head"), content(r).alias("content"))
    own = own.select("conv_id", F.transform("rows", said).alias("said"), more.alias("attachments"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, r: Column) -> Column:
        begins = acc["at"] + F.length(r["head"])
        ends = begins + F.length(r["content"])
        span = F.array(F.struct(begins.alias("start"), (ends - begins).alias("length")))
        mine = F.when(r["mine"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((ends + len(END)).alias("at"), mine.alias("spans"))

    return own.select(
        "conv_id",
        F.array_join(F.transform("said", lambda r: F.concat(r["head"], r["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate("said", start, step)["spans"].alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, parts) and loss_text, read from the formatted string and its loss spans.

    parts: (kind, text) in order, with the texts between placeholders; text: all of them, one after the other.
    """
    marks = r"<\|(" + "|".join(PLACEHOLDERS) + r")\|>"
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.lit(2**31 - 2))
    none = F.lit(None).cast("string")

    def one(piece: Column) -> Column:
        body = F.left(piece, F.length(piece) - len(END))
        content = F.split_part(body, F.lit(SAYS), F.lit(2))
        texts = F.transform(F.split(content, marks), unescape)
        kinds = F.concat(F.regexp_extract_all(content, F.lit(marks), F.lit(1)), F.array(none))
        both = F.flatten(F.zip_with(texts, kinds, lambda t, k: F.array(F.struct(F.lit("text").alias("kind"), t.alias("text")), F.struct(k.alias("kind"), none.alias("text")))))
        parts = F.filter(both, lambda p: p["kind"].isNotNull() & (F.coalesce(p["text"], F.lit("-")) != ""))
        return F.struct(unescape(F.split_part(body, F.lit(SAYS), F.lit(1))).alias("role"), F.array_join(texts, "").alias("text"), parts.alias("parts"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.transform(pieces, one).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them: counts and digests of turns and of the loss text."""
    back = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
