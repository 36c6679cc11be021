"""Chat formatting in Spark expressions only: one string and one loss mask for each conversation.

Turns are collected as structs, sorted, and adjacent turns of one role are merged to a block:

    <|turn|>ROLE<|text|>FIRST TEXT<|next|>SECOND TEXT<|end|>

Roles and texts are escaped: a tilde goes behind the first character of each control string of this template, and of
other common ones (<s>, </s>, [INST], [/INST]), also where tildes stand there already, so it can be taken out again.
The loss mask has a pair for each turn: code points to skip since the last text, code points that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
CONTROL = r"([<\[])(~*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])~(~*)(\||/?s>|/?INST\])"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss_mask array<struct<skip int, take int>>) for each conversation.

    Turns are ordered by turn, then role, then text (null turns first), so ties and repeated rows have one order and
    all stay. Null role or text: empty. Rows with a null conversation make one conversation. No rows: none. Other
    columns are not read. A conversation is one row of the result, so its turns meet in one task; they are collected
    as they are, without a window."""
    rows = turns.select(turns[conv].alias("conv"), F.struct(turns[turn].alias("turn"), F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text].cast("string"), F.lit("")).alias("text")).alias("t"))
    got = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    first = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    got = got.select("conv", "t", first.alias("first"))
    block = F.transform(
        "first",
        lambda at, k: F.struct(
            escape(F.get("t", at)["role"]).alias("role"), (F.get("t", at)["role"] == LEARNT).alias("learnt"),
            F.transform(F.slice("t", at + 1, F.coalesce(F.get("first", k + 1), F.size("t")) - at), lambda x: escape(x["text"])).alias("texts"),
        ),
    )
    got = got.select("conv", block.alias("b"))
    shown = F.transform("b", lambda b: F.concat(F.lit(START), b["role"], F.lit(BODY), F.array_join(b["texts"], NEXT), F.lit(END)))

    def masks(b: Column, k: Column) -> Column:
        lead = F.lit(len(START + BODY)) + F.length(b["role"]) + F.when(k > 0, len(END)).otherwise(0)
        gap = lambda i: F.when(i == 0, lead).otherwise(len(NEXT))
        return F.transform(b["texts"], lambda x, i: F.struct(F.when(b["learnt"], gap(i)).otherwise(gap(i) + F.length(x)).alias("skip"), F.when(b["learnt"], F.length(x)).otherwise(0).alias("take")))

    return got.select(F.col("conv").alias(conv), F.array_join(shown, "").alias("formatted"), F.flatten(F.transform("b", masks)).alias("loss_mask"))


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, formatted, turns array<struct<role, text>>, loss array<string>) from the formatted string and the mask.

    loss: the unescaped text under the mask, turn by turn, empty where nothing counts."""
    blocks = F.filter(F.split("formatted", quoted(END)), lambda b: b != "")
    got = chats.select(F.col(conv).alias("conv"), "formatted", "loss_mask", blocks.alias("b"))
    parts = F.flatten(
        F.transform(
            "b",
            lambda b: F.transform(
                F.split(F.element_at(F.split(b, quoted(BODY)), 2), quoted(NEXT)),
                lambda x: F.struct(unescape(F.element_at(F.split(F.element_at(F.split(b, quoted(BODY)), 1), quoted(START)), 2)).alias("role"), x.alias("raw")),
            ),
        )
    )
    got = got.select("conv", "formatted", "loss_mask", parts.alias("p"))
    turns = F.transform("p", lambda x: F.struct(x["role"].alias("role"), unescape(x["raw"]).alias("text")))
    loss = F.zip_with("p", "loss_mask", lambda x, m: unescape(F.substring(x["raw"], F.lit(1), m["take"])))
    return got.select(F.col("conv").alias(conv), "formatted", turns.alias("turns"), loss.alias("loss"))


def chat_digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted strings."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    got = read_back(format_chats(turns, conv), conv).select(conv, "formatted", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", line), "").alias("all"), F.array_join("loss", "").alias("learnt"))
    return got.select(conv, "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))

