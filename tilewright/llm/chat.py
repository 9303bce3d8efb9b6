"""Chats from event logs: final messages of each conversation, rendered for training with a loss mask.

A log is a table of events (conv_id, seq, message, kind, role, text). ``open`` starts a message, with what
it holds so far; ``delta`` appends; ``edit`` replaces the text; ``regenerate`` drops the text, for deltas to come,
and all messages that were opened between the message and the event, which answered what is gone. All columns
are Spark functions. A log is parted by conversation once, and everything else is done where its rows lie: events are
folded message by message, and a conversation's final messages meet in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("open", "delta", "edit", "regenerate")
#: Marks before and after a turn's text by role, and of any other role, whose name stands between the first two.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
#: A control string, with any number of backslashes after its first sign; escaping adds one there and unescaping takes one away.
CONTROL = r"([<\[])(\\*)(/?INST\]|/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)"
ESCAPED = r"([<\[])\\(\\*)(/?INST\]|/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)"
TURN = r"(?s)<<SYS>> .*? <</SYS>>|\[INST\] .*? \[/INST\]|<s>.*?</s>|<<ROLE>>.*?<</ROLE>>"
#: Role whose texts are trained on.
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """``text`` without control strings; ``unescape`` gives it back."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, opened, message, role, text): the final messages of a log.

    A message's events count in order of seq (ties: by kind, then text); an event that comes twice, in all
    columns, counts once. ``opened`` is its first event's seq. Its role is that of its last event that has one,
    or null. Text before its last ``open``, ``edit`` or ``regenerate`` is gone. Null texts are empty, events of unknown kinds
    append; a null seq comes first; null conversations and messages are ones of their own; an empty log has no messages; other columns
    are ignored; a text of any length is whole.
    """
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62)))
    rows = events.select("conv_id", "message", seq.alias("seq"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id")  # serves the messages, the window and the conversations: the only shuffle of texts
    event = F.struct("seq", F.when(F.col("kind").isin("open", "edit", "regenerate"), 0).otherwise(1).alias("appends"), "kind", "text")
    messages = rows.groupBy("conv_id", "message").agg(
        F.min("seq").alias("opened"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("rewound"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.sort_array(F.collect_set(event)).alias("log"),
    )
    # sorted, so that the last event that replaces is the greatest
    from_there = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["appends"] == 0, i))), F.lit(0))
    left = F.slice("log", from_there + 1, F.greatest(F.size("log"), F.lit(1)))
    text = F.array_join(F.transform(left, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    messages = messages.select("conv_id", "opened", "message", "rewound", "role", text.alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("opened").rangeBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("gone", F.coalesce(F.max("rewound").over(earlier) > F.col("opened"), F.lit(False)))
    return messages.filter(~F.col("gone")).select("conv_id", "opened", "message", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>) of final messages, in order of ``opened``, then role, text and message.

    The segments, joined, are the formatted conversation; those under the loss mask are the trained role's texts, escaped.
    A null role is the empty one. A conversation is one training row and must fit in one.
    """
    role = F.coalesce("role", F.lit(""))
    head, tail = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (before, after) in MARKS.items():
        head, tail = F.when(role == name, before).otherwise(head), F.when(role == name, after).otherwise(tail)
    body = escape(F.coalesce("text", F.lit("")))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("opened", role.alias("role"), body.alias("body"), "message", head.alias("head"), tail.alias("tail")))).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    none = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda t: F.array(segment(t["head"], none), segment(t["body"], t["role"] == TRAINED), segment(t["tail"], none))))
    return turns.select("conv_id", segments.alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parsed(text: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted conversation."""

    def turn(t: Column) -> Column:
        inner = F.substring_index(F.substring(t, len(OTHER[0]) + 1, F.length(t) - len(OTHER[0]) - len(OTHER[2])), OTHER[1], 1)
        role, start, stop = unescape(inner), F.length(inner) + len(OTHER[0]) + len(OTHER[1]), F.lit(len(OTHER[2]))
        for name, (before, after) in MARKS.items():
            own = F.startswith(t, F.lit(before))
            role, start, stop = F.when(own, name).otherwise(role), F.when(own, len(before)).otherwise(start), F.when(own, len(after)).otherwise(stop)
        return F.struct(role.alias("role"), unescape(F.substring(t, start + 1, F.length(t) - start - stop)).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(TURN), F.lit(0)), turn)


def report(rendered: DataFrame) -> DataFrame:
    """The contract's columns, read back from formatted conversations and their masks."""
    turns = parsed(F.col("text"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    rows = rendered.select("conv_id", "segments", formatted(F.col("segments")).alias("text")).select("conv_id", "text", turns.alias("turns"), loss.alias("loss"))
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"),
    )


#: Room for a turn's events between the next turn's seq and its own; code points of a streamed delta, and deltas of a text at most.
ROOM, DELTA, DELTAS = 1 << 10, 256, 16


def log_of(rows: DataFrame) -> DataFrame:
    """Finished rows (conv_id, turn, role, text) as the log that a chat service would have kept of them.

    A user first sends the first eighth and edits it into the whole; an assistant streams its first eighth, is made to
    start again, and streams the whole in deltas; others send the whole. Rows of equal turns and repeated rows are messages of their own.
    """
    text = F.coalesce("text", F.lit(""))
    draft = F.substring(text, F.lit(1), F.floor(F.length(text) / 8).cast("int"))
    size = F.greatest(F.lit(DELTA), F.ceil(F.length(text) / DELTAS)).cast("int")

    def event(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"))

    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / size).cast("int")), lambda i: event("delta", F.substring(text, i * size + 1, size)))
    events = F.when(F.col("role") == "user", F.array(event("open", draft), event("edit", text)))
    events = events.when(F.col("role") == TRAINED, F.concat(F.array(event("open", F.lit("")), event("delta", draft), event("regenerate", F.lit(""))), deltas)).otherwise(F.array(event("open", text)))
    first = F.coalesce(F.col("turn").cast("long") * ROOM, F.lit(-(1 << 62)))
    # numbered before a row turns into several
    numbered = rows.select("conv_id", first.alias("first"), F.monotonically_increasing_id().alias("message"), "role", events.alias("events"))
    logged = numbered.select("conv_id", "first", "message", "role", F.posexplode("events").alias("place", "event"))
    return logged.select("conv_id", (F.col("first") + F.col("place")).alias("seq"), "message", "event.kind", "role", "event.text")


#: The query's rows in DuckDB.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)', '\1\\\2\3', 'g'))
    + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 25 + length(regexp_replace(role, '([<\[])(\\*)(/?INST\]|/?s>|</?SYS>>|</?ROLE>>|<TEXT>>)', '\1\\\2\3', 'g')) END AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
