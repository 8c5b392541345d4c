r"""Chat formatting: event-sourced reconstruction of conversations, then rendering.

Template: each message is `<s>[role]\n` + text + `</s>\n`. Inside roles and texts a backslash is
doubled, and a backslash is put after the first character of every control string (`<s>`, `</s>`,
`[INST]`, `[/INST]`), so none is left; in roles also before `]`. Dropping the backslash before any
character restores the original exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "</s>\n"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(text, r"([<\[])(?=/?(?:s>|INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log.

    events: conv_id, seq, message, kind, role, text. In order of seq (ties: kind, text), a `delta`
    appends to its message, an `edit` replaces what it said so far, a `regenerate` empties it and
    starts over with its own text; other kinds count as deltas. Text null is empty; the role is that
    of the last event that states one, empty if none does. A log that delivers the same event twice
    (all six columns) counts it once. Deltas are folded per message, so a long conversation is spread.
    """
    events = events.select("conv_id", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    one = F.struct("seq", "kind", "text", "role")
    folded = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(one)).alias("log"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "text", "role"))).alias("role"),
    )
    resets = F.expr("transform(log, (e, i) -> CASE WHEN e.kind IN ('edit', 'regenerate') THEN i ELSE 0 END)")
    return folded.withColumn("_last", F.array_max(resets)).select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.expr("array_join(transform(slice(log, _last + 1, size(log)), e -> e.text), '')").alias("text")
    )


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask: the rendered conversation and its masked spans.

    loss_mask: array of (start, length) in code points of formatted, the texts of learned_role in order.
    """
    piece = messages.select(
        "conv_id",
        "message",
        F.concat(F.lit("<s>["), F.regexp_replace(escape(F.col("role")), r"\]", r"\\]"), F.lit("]\n")).alias("_head"),
        escape(F.col("text")).alias("_body"),
        (F.col("role") == learned_role).alias("_learn"),
    )
    before = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    length = F.length("_head") + F.length("_body") + len(END)
    piece = piece.withColumn("_at", F.coalesce(F.sum(length).over(before), F.lit(0)))
    span = F.struct((F.col("_at") + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length"))
    return piece.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("message", F.concat("_head", "_body", F.lit(END)).alias("piece")))), lambda x: x.piece), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("_learn"), span))).alias("loss_mask"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """What render() wrote, read back: adds turns (array of role, text) and loss_text."""
    pieces = F.filter(F.split("formatted", r"</s>\n"), lambda p: p != "")
    turn = lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)\A<s>\[([^\\\]]*(?:\\.[^\\\]]*)*)\]\n", 1)).alias("role"), unescape(F.regexp_replace(p, r"(?s)\A<s>\[[^\\\]]*(?:\\.[^\\\]]*)*\]\n", "")).alias("text")
    )
    masked = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s.start.cast("int") + 1, s.length.cast("int"))))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(masked, "")})


def rows_as_events(rows: DataFrame) -> DataFrame:
    """A conversations table as the log that a chat service would have kept of it; fold_events() gives the rows back.

    Each row, in order of (turn, role, text), is a message of three events. By a hash of the row it was
    streamed in three deltas, or drafted and then edited, or drafted and then generated again, the final text
    arriving in parts; only the first event states the role.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", F.row_number().over(order).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    third = F.expr("length(text) div 3")
    part = lambda a, b: F.substring("text", a + 1, b - a)
    head, middle, tail = part(F.lit(0), third), part(third, 2 * third), part(2 * third, F.length("text"))
    event = lambda j, kind, text: F.struct(F.lit(j).alias("j"), F.lit(kind).alias("kind"), text.alias("text"))
    logs = [
        [event(0, "delta", head), event(1, "delta", middle), event(2, "delta", tail)],
        [event(0, "delta", tail), event(1, "edit", F.concat(head, middle)), event(2, "delta", tail)],
        [event(0, "delta", middle), event(1, "regenerate", head), event(2, "delta", F.concat(middle, tail))],
    ]
    kind = F.pmod(F.xxhash64("conv_id", "message", "text"), F.lit(len(logs)))
    log = F.when(kind == 0, F.array(*logs[0])).when(kind == 1, F.array(*logs[1])).otherwise(F.array(*logs[2]))
    events = numbered.select("conv_id", "message", "role", F.explode(log).alias("e"))
    return events.select("conv_id", (F.col("message") * 3 + F.col("e.j")).alias("seq"), "message", "e.kind", F.when(F.col("e.j") == 0, F.col("role")).alias("role"), "e.text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conversations rows (conv_id, turn, role, text) to conv_id, formatted, loss_mask, by way of their event log.

    Null roles and texts are empty. Repeated rows and equal turns are turns of their own, ordered by
    role and text. Null conv_id is a conversation of its own. Other columns are ignored, whatever their names.
    Very long texts are kept whole; a conversation must fit into a row. An empty table gives no rows.
    """
    return render(fold_events(rows_as_events(rows.select("conv_id", "turn", "role", "text"))))


def digest(formatted: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return parse(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT conv_id, turn, role, text,
         regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS body,
         replace(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g'), ']', '\]') AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
