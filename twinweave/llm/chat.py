"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A conversation becomes one marked-up string.  Every assistant turn is an example of its
own: the text up to the end of that turn, of which only the reply is trained on.  An
example is kept as spans of the conversation's string, so all examples of a conversation
take room in proportion to it; ``example_texts`` cuts them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings, and what stands for them inside texts.
OPEN, CLOSE, COLON = "### ", "</turn>", ": "
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))
ASSISTANT = "assistant"
RUN = 64


def escape(text: Column, in_role: bool = False) -> Column:
    """Replace control strings; the colon only inside role names.

    Afterwards a backslash always starts a pair of ``\\b``, ``\\h``, ``\\e`` or ``\\c``.
    """
    for plain, coded in ESCAPES if in_role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Undo ``escape``; the backslash comes last, when no other pair is left."""
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, examples)``, one row per conversation.

    ``turns (conv_id, turn, role, text)`` come in the order of ``turn`` (null first, ties by
    role and text); null roles and texts are empty, a null ``conv_id`` is a conversation.
    Each turn is ``### <Role>: <text></turn>`` and a newline.  ``examples`` has for every
    assistant turn the length of its context and the span of its reply (from 1, in
    characters of ``formatted``).  Turns are joined in runs first, so a long conversation
    is not sorted turn by turn in one place.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    head = F.concat(F.lit(OPEN), escape(role, True), F.lit(COLON))
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.concat(head, body, F.lit(CLOSE + "\n")).alias("piece"),
        F.char_length(head).cast("bigint").alias("head"),
        F.char_length(body).cast("bigint").alias("body"),
    ).withColumn("run", F.floor(F.col("turn") / RUN))
    one = F.struct("turn", "role", "piece", "head", "body")
    runs = rows.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(one)).alias("t"))
    length = lambda x: F.char_length(x["piece"]).cast("bigint")
    runs = runs.select(
        "conv_id", "run", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        _spans(F.col("t"), length).alias("spans"),
    )
    whole = runs.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("run", "formatted", "spans"))).alias("r"))
    shifted = F.aggregate(
        "r", F.struct(F.lit(0).cast("bigint").alias("at"),
                      F.array().cast("array<struct<context:bigint,begin:bigint,length:bigint>>").alias("all")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["formatted"])).cast("bigint").alias("at"),
            F.concat(acc["all"], F.transform(x["spans"], lambda s: F.struct(
                (s["context"] + acc["at"]).alias("context"),
                (s["begin"] + acc["at"]).alias("begin"), s["length"].alias("length")))).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    return whole.select(
        "conv_id", F.array_join(F.transform("r", lambda x: x["formatted"]), "").alias("formatted"),
        shifted.alias("examples"),
    )


def _spans(t: Column, length) -> Column:
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array().cast("array<struct<context:bigint,begin:bigint,length:bigint>>").alias("all"))
    reply = lambda acc, x: F.array(F.struct(
        acc["at"].alias("context"), (acc["at"] + x["head"] + 1).alias("begin"),
        x["body"].alias("length")))
    return F.aggregate(t, start, lambda acc, x: F.struct(
        (acc["at"] + length(x)).alias("at"),
        F.when(x["role"] == ASSISTANT, F.concat(acc["all"], reply(acc, x)))
        .otherwise(acc["all"]).alias("all")), lambda acc: acc["all"])


def expand_examples(conversations: DataFrame, keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """``(conv_id, keep..., formatted, example, context, begin, length)``: a row per assistant turn.

    With ``outer`` a conversation without one has a row whose example is null.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    return conversations.select(
        "conv_id", *keep, "formatted", explode("examples").alias("example", "span")
    ).select("conv_id", *keep, "formatted", "example", "span.context", "span.begin", "span.length")


def example_texts(examples: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(conv_id, keep..., example, text, loss_begin, loss_length)``: each example written out."""
    end = F.col("begin") + F.col("length") - 1 + len(CLOSE) + 1
    return examples.select(
        "conv_id", *keep, "example",
        F.substring("formatted", F.lit(1), end.cast("int")).alias("text"),
        F.col("begin").alias("loss_begin"), F.col("length").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` parsed back from a formatted conversation."""
    pieces = F.array_compact(F.transform(
        F.split(formatted, r"\Q</turn>" + r"\E\n"), lambda p: F.when(p != "", p)))
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), COLON, 1)).alias("role"),
        unescape(F.substring(
            p, F.length(F.substring_index(p, COLON, 1)) + len(COLON) + 1, F.length(p))).alias("text"),
    ))


def chat_digest(turns: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read back from the written examples.

    Turns are read from the formatted conversation, replies from the text of each example
    under its loss mask.  ``examples`` counts them and ``example_chars`` is the length of their
    texts, contexts included.
    """
    all_turns = F.array_join(F.transform("t", lambda x: F.concat(
        x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = format_conversations(turns).withColumn("t", read_turns(F.col("formatted"))).select(
        "conv_id", "formatted", "examples", F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    whole = ("n_turns", "turns_sha256", "formatted_chars")
    written = example_texts(expand_examples(read, whole, outer=True), whole)
    reply = unescape(F.substring("text", F.col("loss_begin").cast("int"), F.col("loss_length").cast("int")))
    per = written.select(
        "conv_id", *whole, F.char_length("text").cast("bigint").alias("chars"),
        F.when(F.col("example").isNotNull(), F.struct("example", reply.alias("reply"))).alias("e"),
    ).groupBy("conv_id", *whole).agg(
        F.array_sort(F.collect_list("e")).alias("e"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("example_chars"))
    return per.withColumn("loss", F.array_join(F.transform("e", lambda x: x["reply"]), "")).select(
        "conv_id", "n_turns", "turns_sha256",
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
        F.size("e").cast("bigint").alias("examples"), "example_chars",
    )
