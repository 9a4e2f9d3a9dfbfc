"""Chat formatting whose output a deterministic parser reads back without loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: <s>HEADER text</s> for each turn; the header names the role.
OPEN, CLOSE, USER, ASSISTANT, ROLE, END_ROLE = "<s>", "</s>", "[INST] ", "[/INST] ", "[ROLE]", "[/ROLE] "
#: A control string, with any number of escapes inside.
CONTROL = r"([<\[])(\\*/?(?:s>|INST\]|ROLE\]))"
BARE = r"[<\[]/?(?:s>|INST\]|ROLE\])"


def escape(text: Column) -> Column:
    """One backslash more inside each control string."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    """One backslash less inside each escaped control string."""
    return F.regexp_replace(text, F.lit(r"([<\[])\\(\\*/?(?:s>|INST\]|ROLE\]))"), F.lit("$1$2"))


def _header(role: Column, mark) -> Column:
    return (F.when(role == "user", F.lit(USER)).when(role == "assistant", F.lit(ASSISTANT))
            .otherwise(F.concat(F.lit(ROLE), mark(role), F.lit(END_ROLE))))


def render(turns: Column, mark=lambda text: text) -> Column:
    """All turns as one text; ``mark`` is applied to what the data brings in."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), _header(t["role"], mark), mark(t["text"]), F.lit(CLOSE))))


def segments(text: Column) -> Column:
    """What stands between the marks of each turn."""
    return F.regexp_extract_all(text, F.lit(f"(?s){OPEN}(.*?){CLOSE}"), F.lit(1))


def _turn(segment: Column) -> Column:
    """A segment's header and body. Grammar: USER body | ASSISTANT body | ROLE role END_ROLE body."""
    end = F.locate(END_ROLE, segment)
    other = segment.startswith(ROLE) & (end > 0)
    head = (F.when(segment.startswith(USER), F.lit(len(USER))).when(segment.startswith(ASSISTANT), F.lit(len(ASSISTANT)))
            .when(other, end - 1 + len(END_ROLE)))
    role = (F.when(segment.startswith(USER), F.lit("user")).when(segment.startswith(ASSISTANT), F.lit("assistant"))
            .when(other, F.substring(segment, F.lit(len(ROLE) + 1), end - 1 - len(ROLE))))
    return F.struct(role.alias("role"), head.alias("head"), F.substring(segment, head + 1, F.length(segment)).alias("body"))


def parse(text: Column) -> Column:
    """The turns in a rendered text as (role, text); a turn that the grammar
    does not allow, such as one with a bare control string inside, is null."""
    def one(segment: Column) -> Column:
        t = _turn(segment)
        bad = t["head"].isNull() | t["body"].rlike(BARE) | t["role"].rlike(BARE)
        return F.when(~bad, F.struct(unescape(t["role"]).alias("role"), unescape(t["body"]).alias("text")))

    return F.transform(segments(text), one)


def chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, turns, formatted, level``.

    Turns come in the order of ``turn`` (null first), then role and text. Null
    roles and texts are empty; rows without an id make a conversation; rows that
    repeat are turns of their own. A conversation is rendered as it is (level 0),
    parsed, and compared with its source; where they differ, conflicting strings
    are escaped (level 1) and the comparison is made again. A conversation is
    one text and so one row, however long it is."""
    each = rows.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    grouped = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("sorted"))
    turns = F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    drawn = grouped.select("conv_id", turns.alias("turns")).select("conv_id", "turns", render(F.col("turns")).alias("plain"))
    tried = drawn.withColumn("escaped", F.when(~parse(F.col("plain")).eqNullSafe(F.col("turns")), render(F.col("turns"), escape)))
    fails = F.raise_error(F.lit("a rendered conversation cannot be read back"))
    formatted = (F.when(F.col("escaped").isNull(), F.col("plain"))
                 .when(parse(F.col("escaped")).eqNullSafe(F.col("turns")), F.col("escaped")).otherwise(fails.cast("string")))
    return tried.select("conv_id", "turns", formatted.alias("formatted"), F.col("escaped").isNotNull().cast("int").alias("level"))


def loss_spans(formatted: Column) -> Column:
    """Of each assistant turn: the turn's number from 0, and where in its segment
    (without the marks) the text under the loss starts (from 0) and how long it is."""
    def one(segment: Column, i: Column) -> Column:
        t = _turn(segment)
        return F.struct(t["role"].alias("role"), i.alias("turn"), t["head"].alias("start"), F.length(t["body"]).alias("length"))

    spans = F.filter(F.transform(segments(formatted), one), lambda s: s["role"] == "assistant")
    return F.transform(spans, lambda s: F.struct(s["turn"], s["start"], s["length"]))


def read_back(chat: DataFrame) -> DataFrame:
    """Per conversation, from ``formatted`` alone: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, level``."""
    back = chat.select("conv_id", "level", "formatted", parse(F.col("formatted")).alias("turns"),
                       segments(F.col("formatted")).alias("parts"), loss_spans(F.col("formatted")).alias("spans"))
    texts = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.transform("spans", lambda s: unescape(F.substring(F.get(F.col("parts"), s["turn"]), s["start"] + 1, s["length"])))
    back = back.select("conv_id", "level", "formatted", F.size("turns").cast("long").alias("n_turns"),
                       F.concat_ws("", texts).alias("said"), F.concat_ws("", under).alias("loss"))
    return back.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "level")
