"""Chat formatting by prefix-target expansion: one example for every assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

#: The template's marks: START role newline text STOP.
START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other templates, fixed values. In a text each is broken by a
#: backslash after its first character, and a backslash is doubled.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
REPLY_ROLE = "assistant"

_TAILS = "|".join("".join("\\" + c if not c.isalnum() else c for c in s[1:]) for s in CONTROL)
_FIRST = rf"([<\[])(?={_TAILS})"
#: Possessive, so that it is matched in a loop: roles of any length.
_TURN = r"(?s)<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """text without control strings; undone by unescape()."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _FIRST, r"$1\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end, last.

    Every assistant turn gives an example: all turns before it as context, and its own text, from
    loss_start to loss_end (code points), alone to be trained on. Turns after the last reply, or
    all turns where there is none, are kept by a further example without a loss span (both null).
    Turns are ordered by turn (null first), ties by role and text; repeated rows are repeated
    turns; null roles and texts count as empty; rows of a null conv_id are one conversation. A
    conversation is gathered into one row, as its longest example has to be; its examples hold
    their contexts, so with n replies of equal length they come to n / 2 times its text, as the
    method has it. They leave the task one by one. No rows, no examples; extra columns are ignored.
    """
    rows = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        escape_role(F.col("role")).alias("marked_role"),
        escape(F.col("text")).alias("marked"),
    )
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = F.transform("turns", lambda t: F.concat(F.lit(START), t["marked_role"], F.lit("\n"), t["marked"], F.lit(STOP)))
    place = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (F.get("turns", i)["role"] == REPLY_ROLE) | (i == F.size("turns") - 1),
    )
    held = held.select("conv_id", "turns", made.alias("made"), F.posexplode(place).alias("example", "at"))
    reply = F.get("turns", F.col("at"))
    text = F.array_join(F.slice("made", F.lit(1), F.col("at") + 1), "")
    held = held.select(
        "conv_id", "example", text.alias("formatted"), reply["role"].alias("role"),
        F.char_length(reply["marked"]).alias("n"), (F.col("at") == F.size("turns") - 1).alias("last"),
    )
    end = F.char_length("formatted") - len(STOP)
    is_reply = F.col("role") == REPLY_ROLE
    return held.select(
        "conv_id", "example", "formatted", F.when(is_reply, end - F.col("n")).alias("loss_start"),
        F.when(is_reply, end).alias("loss_end"), "last",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: turns (array of role, text, read off the last
    example), loss_text (the replies in order) and formatted_chars (of all examples). A conversation
    without replies has an empty loss_text; examples of a null conv_id are one conversation; no
    examples, no rows."""
    target = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    roles, texts = (F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(k)) for k in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    parsed = examples.select(
        "conv_id", "example", unescape(target).alias("target"), F.char_length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), turns).alias("turns"),
    )
    replies = F.filter(F.collect_list(F.struct("example", "target")), lambda e: e["target"].isNotNull())
    return parsed.groupBy("conv_id").agg(
        F.max("turns").alias("turns"),
        F.array_join(F.transform(F.sort_array(replies), lambda e: e["target"]), "").alias("loss_text"),
        F.sum("chars").alias("formatted_chars"),
    )


def op7_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    found = read_back(expand(rows.unionByName(extra)))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
