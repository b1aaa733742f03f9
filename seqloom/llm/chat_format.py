"""Chat formatting by event sourcing, with DataFrame functions only.

A log holds events ``conv_id, turn, message, seq, kind, role, text``: ``start`` opens a message and gives its role,
``delta`` appends streamed text, ``edit`` replaces all text so far and ``regenerate`` throws it away.  Events of a
message are brought together, sorted by sequence and folded into the final text; only these final messages then meet
by conversation.  A message and a rendered conversation are single values and must fit in a row; what a conversation
gathers is its final messages and not its log.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles a backslash is doubled and ``<|``
becomes ``<\\|``, so no control string can appear in them; in roles a line end gets a backslash too.
Taking the backslash off each escaped character gives the original back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN = r"(?s)<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def message_log(conversations: DataFrame, piece: int = 600) -> DataFrame:
    """The log that a chat service would have kept for finished turns.

    An assistant's text was streamed, begun once in vain and then regenerated in pieces; other texts were
    typed, then edited into their final form.  Each row is a message of its own, also if a turn number is repeated.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    event = lambda k, kind, t: F.struct(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), t.alias("text"))
    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))  # one pass; substring would begin anew for each piece
    pieces = F.transform(cuts, lambda t, i: F.struct((i + 3).alias("seq"), F.lit("delta").alias("kind"), t.alias("text")))
    begun = F.array(event(0, "start", F.lit("")), event(1, "delta", F.substring(text, 1, 24)))
    streamed = F.concat(begun, F.array(event(2, "regenerate", F.lit(""))), pieces)
    typed = F.concat(begun, F.array(event(2, "edit", text)))
    rows = conversations.select("conv_id", "turn", role.alias("role"), F.monotonically_increasing_id().alias("message"), F.when(role == "assistant", streamed).otherwise(typed).alias("events"))
    return rows.select("conv_id", "turn", "message", "role", F.explode("events").alias("e")).select("conv_id", "turn", "message", "e.seq", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, message, role, text`` of a log.

    Text before the last edit or regeneration does not count.  Equal sequence numbers are ordered by kind and text; a
    message without a start has an empty role; null texts add nothing.
    """
    last = F.max(F.when(F.col("kind") != "delta", F.struct("seq", "kind")))
    folded = log.groupBy("conv_id", "turn", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))).alias("events"), last.alias("reset"), F.max("role").alias("role"))
    live = F.filter("events", lambda e: (F.col("reset").isNull()) | (e["seq"] > F.col("reset.seq")) | ((e["seq"] == F.col("reset.seq")) & (e["kind"] == "edit")))
    return folded.select("conv_id", "turn", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted``: the turns in order of turn, role and text."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    one = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), escape(t["text"]), F.lit(END + "\n"))
    return messages.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", one), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns``: what a rendered text says, as an array of role, text and whether the loss counts it."""
    roles, texts = (F.regexp_extract_all("formatted", F.lit(_TURN), i) for i in (1, 2))
    plain = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text"), (r == "assistant").alias("loss")))
    return formatted.select("conv_id", "formatted", plain.alias("turns"))


def digest(parsed: DataFrame) -> DataFrame:
    """Digest columns of parsed conversations; an empty conversation has digests of nothing."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Digest columns of all conversations, read back from their formatted texts.

    Null texts and roles are empty; a null turn comes first; repeated rows are turns of their own; a null conv_id is one
    conversation; an empty table gives no rows; other columns are not looked at.
    """
    return digest(parse(render(reconstruct(message_log(conversations.select("conv_id", "turn", "role", "text"))))))


#: The same for another engine.  {rows} is the relation with the turns.
SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({rows})),
e AS (SELECT conv_id, turn, role, text,
  '<|im_start|>' || replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || chr(10)) || chr(10)
  || replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') || '<|im_end|>' || chr(10) AS one FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(one)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
