"""Chat formatting: conversations rebuilt from an event log, rendered by a template, and read back.

The log is the source of truth: a message is streamed as deltas, may be edited, and may be generated
anew, which takes back all that began after it. The fold needs no state machine: the deltas of a message
are summed up from its last edit or regeneration on, and a message is taken back if a regeneration of an
earlier one came after its beginning, a running maximum over the conversation. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relspark.storage import numbered

#: Kinds of events. A delta adds to its message and begins it if it is new; an edit replaces its text; a regeneration
#: also takes back every message that began between the message's beginning and itself.
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"

#: The template. A turn stands between BEGIN and END; a user's text stands in INST, an assistant's stands plain, any other role is named.
BEGIN, END = "<s>", "</s>"
INST, INST_END = "[INST]", "[/INST]"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
USER, ASSISTANT = "user", "assistant"
#: A control string in a text, with the backslashes that escaping has put after its first character.
CONTROL = r"(/?s>|/?INST\]|/?ROLE\])"

#: Characters of a delta, where a whole turn is put into a log.
DELTA_CHARS = 256


def escape(text: Column) -> Column:
    """``text`` with a backslash more after the first character of everything that is a control string or an escaped one."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def turn_log(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, kind, message, role, text``: the log of ``turns(conv_id, turn, role, text)`` as it would have been streamed.

    Turns are in order of ``turn``, null first, then role and text; a repeated row is a turn of its own. Each is a
    message of deltas of DELTA_CHARS characters, at least one. Null roles and texts are empty; a null conv_id is one
    conversation; other columns are ignored. A conversation of any length is put in order by many tasks.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the place among all turns tells messages apart, and orders those of a conversation
    placed = numbered(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], "message")
    cuts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(DELTA_CHARS))
    each = placed.select("conv_id", "message", "role", "text", F.explode(cuts).alias("at"))
    piece = F.substring(F.col("text"), F.col("at") + 1, F.lit(DELTA_CHARS))
    return each.select("conv_id", F.struct(F.col("message").alias("place"), "at").alias("seq"), F.lit(DELTA).alias("kind"), "message", "role", piece.alias("text"))


def folded(log: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the messages that the log leaves, ``place`` (their first event's ``seq``) giving their order.

    ``log(conv_id, seq, kind, message, role, text)``: ``seq`` of any type that sorts; events of one seq are in order of
    kind, role and text. A message's role is the first that one of its events names, or empty; a null text adds nothing; an event of
    another kind is a delta. Events of a message that was taken back are void, but a regeneration among them takes back all the same.
    A null message is one message a conversation.
    """
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    each = log.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("events"))
    resets = F.transform("events", lambda e, i: F.when(e["kind"].isin(EDIT, REGENERATE), i))
    last = F.coalesce(F.array_max(resets), F.lit(0))
    messages = each.select(
        "conv_id",
        F.col("events")[0]["seq"].alias("place"),
        F.array_max(F.transform("events", lambda e: F.when(e["kind"] == REGENERATE, e["seq"]))).alias("again"),
        F.coalesce(F.try_element_at(F.filter("events.role", lambda r: r.isNotNull()), F.lit(1)), F.lit("")).alias("role"),
        F.array_join(F.slice(F.col("events.text"), last + 1, F.size("events")), "").alias("text"),
    )
    latest = F.max("again").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("taken_back", F.coalesce(latest > F.col("place"), F.lit(False))).filter("NOT taken_back").select("conv_id", "place", "role", "text")


def rendered(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, spans``: one text a conversation, and where each turn's escaped text lies in it.

    ``messages(conv_id, place, role, text)``. ``spans`` has, turn by turn, ``start, end`` (code points, end exclusive) and
    ``loss``: whether the text counts for training, as the assistants' do. A conversation is one row by nature; its messages
    meet in one task, folded and rendered.
    """
    role, text = F.col("role"), escape(F.col("text"))
    head = F.when(role == USER, F.lit(BEGIN + INST)).when(role == ASSISTANT, F.lit(BEGIN)).otherwise(F.concat(F.lit(BEGIN + ROLE), escape(role), F.lit(ROLE_END)))
    tail = F.when(role == USER, F.lit(INST_END + END)).otherwise(F.lit(END))
    parts = messages.select("conv_id", "place", "role", head.alias("head"), text.alias("body"), tail.alias("tail"))
    size = F.length("head") + F.length("body") + F.length("tail")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("head")
    placed = parts.select("conv_id", "place", F.concat("head", "body", "tail").alias("piece"), F.struct(start.alias("start"), (start + F.length("body")).alias("end"), (F.col("role") == ASSISTANT).alias("loss")).alias("span"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "span"))).alias("x"))
    return whole.select("conv_id", F.array_join("x.piece", "").alias("formatted"), F.col("x.span").alias("spans"))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text, as an array of ``role, text, body``: unescaped, and ``body`` as it stands. One pass, whatever the number of turns."""
    pieces = F.split(formatted, END, -1)

    def turn(p: Column) -> Column:
        inner = F.substring(p, F.lit(len(BEGIN) + 1), F.length(p))
        user, named = F.startswith(inner, F.lit(INST)), F.startswith(inner, F.lit(ROLE))
        stop = F.position(F.lit(ROLE_END), inner)
        role = F.when(user, F.lit(USER)).when(named, unescape(F.substring(inner, F.lit(len(ROLE) + 1), stop - len(ROLE) - 1))).otherwise(F.lit(ASSISTANT))
        body = (
            F.when(user, F.substring(inner, F.lit(len(INST) + 1), F.length(inner) - len(INST) - len(INST_END)))
            .when(named, F.substring(inner, stop + len(ROLE_END), F.length(inner)))
            .otherwise(inner)
        )
        return F.struct(role.alias("role"), unescape(body).alias("text"), body.alias("body"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def format_log(log: DataFrame) -> DataFrame:
    """``conv_id, formatted, spans`` of every conversation of the log; an empty log gives an empty result. See ``folded`` and ``rendered``."""
    return rendered(folded(log))


def loss_texts(turns: Column, spans: Column) -> Column:
    """The unescaped texts under the mask, in order. A span that isn't as long as the text that it marks is an error."""

    def marked(t: Column, s: Column) -> Column:
        fits = F.length(t["body"]) == s["end"] - s["start"]
        return F.struct(s["loss"].alias("loss"), F.when(fits, t["text"]).otherwise(F.raise_error(F.lit("a mask that is not of this text")).cast("string")).alias("text"))

    return F.transform(F.filter(F.zip_with(turns, spans, marked), lambda x: x["loss"]), lambda x: x["text"])
