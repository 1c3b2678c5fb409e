"""Chat formatting with typed content parts.

A turn's content is a list of parts of kinds text, image, audio and document. A visitor has one method per kind and
turns a part into what is shown (escaped text or a placeholder), the attachment's reference, and the number of tokens
it expands to. Placeholders stand in the order of the parts; the attachments of a conversation are listed in the same
order, so the n-th placeholder belongs to the n-th attachment.

Template: every turn is ``<s>[INST]role[/INST]content</s>``. Control strings inside roles and texts are escaped by a
backslash after their first character, backslashes are doubled; ``unescaped`` undoes both. Loss spans are code point
ranges of the formatted string, one per assistant turn.

Turns are ordered by turn, then role and content; a null turn comes first. Null text or content is empty, a null role
is an empty role, a null conv_id is a conversation of its own. A part of another kind gets the placeholder ``<part>``.
A conversation is one output row, so it has to fit one row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Control strings of the template and the placeholders.
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>", "<part>")
PART = ("struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        text = F.replace(text, F.lit(word), F.lit(word[0] + "\\" + word[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


class PartVisitor:
    """One method per kind of part; each returns (shown, tokens). Subclass to change placeholders or token counts."""

    patch, audio_rate, page_tokens = 14, 25.0, 512

    def text(self, part: Column) -> tuple[Column, Column]:
        own = F.coalesce(part["text"], F.lit(""))
        return escaped(own), common.word_count(own)

    def image(self, part: Column) -> tuple[Column, Column]:
        def side(c):
            return F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / self.patch))
        return F.lit("<image>"), side(part["width"]) * side(part["height"])

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<audio>"), F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate))

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<document>"), F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(1))) * self.page_tokens

    def other(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<part>"), F.lit(1)

    def visit(self, part: Column) -> Column:
        """struct(kind, shown, ref, tokens) of one part."""
        shown, tokens = self.other(part)
        tokens = tokens.cast("long")
        for kind in ("text", "image", "audio", "document"):
            own, count = getattr(self, kind)(part)
            shown = F.when(part["kind"] == kind, own).otherwise(shown)
            tokens = F.when(part["kind"] == kind, count.cast("long")).otherwise(tokens)
        return F.struct(part["kind"].alias("kind"), shown.alias("shown"), part["ref"].alias("ref"), tokens.alias("tokens"))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    empty = {f: F.lit(None).cast(t) for f, t in (("ref", "string"), ("width", "int"), ("height", "int"),
                                                 ("seconds", "double"), ("pages", "int"))}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[v.alias(k) for k, v in empty.items()]))


def format_conversations(rows: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, expanded_tokens for ``rows`` of conv_id, turn, role, parts."""
    visitor = visitor or PartVisitor()
    flat = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce(F.transform("parts", visitor.visit), F.array().cast(
                           "array<struct<kind:string,shown:string,ref:string,tokens:bigint>>")).alias("parts"))
    flat = flat.select("conv_id", F.struct(
        "turn", "role", F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("content"),
        F.filter("parts", lambda p: ~p["kind"].eqNullSafe("text")).alias("attached"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens")).alias("t"))
    # turns that tie are ordered by their text as it was given, not as it is escaped
    given = lambda t: F.struct(t["turn"], t["role"], unescaped(t["content"]).alias("raw"), t["content"], t["attached"], t["tokens"])
    turns = flat.groupBy("conv_id").agg(F.array_sort(F.transform(F.collect_list("t"), given)).alias("turns"))
    turns = turns.withColumn("shown", F.transform("turns", lambda t: F.concat(
        F.lit(OPEN), escaped(t["role"]), F.lit(ROLE_END), t["content"], F.lit(CLOSE))))
    # where each turn's content ends in the formatted string
    spans = F.aggregate(
        F.arrays_zip("turns", "shown"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["shown"])).alias("at"),
            F.when(x["turns"]["role"] == LOSS_ROLE, F.array_append(a["spans"], F.struct(
                (a["at"] + F.char_length(x["shown"]) - len(CLOSE) - F.char_length(x["turns"]["content"])).alias("start"),
                (a["at"] + F.char_length(x["shown"]) - len(CLOSE)).alias("stop")))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    attachments = F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda p: F.struct(
        t["turn"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
    return turns.select("conv_id", F.array_join("shown", "").alias("formatted"), spans.alias("loss_spans"),
                        attachments.alias("attachments"),
                        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, content, unescaped) as parsed from the formatted string alone."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, len(OPEN) + 1, 2 ** 31 - 1), ROLE_END, 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, ROLE_END) + len(ROLE_END), F.lit(2 ** 31 - 1))).alias("content")))
    return formatted.withColumn("turns", turns)


def masked_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(
        F.col(formatted), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, read back from the formatted strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema))
    out = read_back(format_conversations(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    out = out.withColumn("masked", masked_text())
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(said).alias("turns_sha256"),
                      F.char_length("masked").cast("long").alias("loss_chars"), sha256(F.col("masked")).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")
