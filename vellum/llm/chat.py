"""Chat formatting: conversations rebuilt from their event log, then rendered.

A log has a row per event: conv_id, turn, seq, kind, role, text. Kinds, applied by seq within (conv_id, turn):
``start`` opens a message with a role, ``delta`` appends streamed text to it, ``edit`` replaces its text,
``regenerate`` empties it for a new answer, anything else is left alone. The messages of a conversation stand
in the order of their turns and are rendered as ``### role: text</turn>`` with a newline after each.

Inside roles and texts a backslash becomes two, ``#`` becomes ``\\#``, ``</turn>`` becomes ``<\\/turn>`` and, in
roles, ``:`` becomes ``\\:``; so no text can hold a control string, and dropping each escaping backslash restores it.
The loss spans are the places (start, length; code points) of the assistants' escaped texts in the output.

Defined results. Null text or role: empty. Null conv_id: a conversation of its own. Null turn: before all
others. Null seq: before all others of its turn. Equal seq: by kind (start first), role, text. Competing rows of a turn
of ``conversation_log``: by role, text. Repeated rows: each is applied. Events before any start open a message without a role. No rows: no conversations.
Extra columns are dropped. Time is linear in a conversation's messages; a conversation must fit a row (2 GB, 500 million
characters). Everything is native: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def conversation_log(turns: DataFrame) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as a log: a start and one delta each. Competing rows of a turn follow each other by role and text."""
    order = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.monotonically_increasing_id()]
    numbered = turns.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(*order)))
    events = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("start").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("part"), F.lit("delta").alias("kind"), F.lit("").alias("role"), F.col("text").alias("text")),
    )
    return numbered.select("conv_id", "turn", "n", F.explode(events).alias("e")).select("conv_id", "turn", (F.col("n") * 2 + F.col("e.part")).alias("seq"), "e.kind", "e.role", "e.text")


def messages(log: DataFrame) -> DataFrame:
    """conv_id, turn, and messages (role, text) of each turn: its events folded in order.

    A start opens the next message; a start, edit or regeneration also begins its text anew, so a message's text is
    what its last such event and the deltas after it hold.
    """
    kind = F.coalesce("kind", F.lit(""))
    rank = F.when(kind == "start", 0).otherwise(1)
    rows = log.select("conv_id", "turn", "seq", rank.alias("rank"), kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    so_far = Window.partitionBy("conv_id", "turn").orderBy("seq", "rank", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("int")).over(so_far)
    placed = rows.select("*", count("start").alias("message"), count("start", "edit", "regenerate").alias("epoch"), F.count("*").over(so_far).alias("place"))
    said = F.when(F.col("kind").isin("start", "edit", "delta"), F.struct("place", "epoch", "text"))
    known = F.max(F.col("kind").isin("start", "edit", "delta", "regenerate"))
    each = placed.groupBy("conv_id", "turn", "message").agg(
        F.max(F.when(F.col("kind") == "start", F.col("role"))).alias("role"), F.max("epoch").alias("last"), F.array_sort(F.collect_list(said)).alias("parts"), known.alias("known"))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["epoch"] == F.col("last")), lambda p: p["text"]), "")
    message = F.when(F.col("known"), F.struct("message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")))
    folded = each.select("conv_id", "turn", message.alias("m")).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return folded.select("conv_id", "turn", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def render(folded: DataFrame, mask_role: str = ASSISTANT) -> DataFrame:
    """conv_id, formatted, loss_spans (start, length) of every conversation: a message's place is the running length of those before it."""
    said = folded.select("conv_id", "turn", F.posexplode_outer("messages").alias("k", "m")).select("conv_id", "turn", "k", "m.role", "m.text")
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    pieces = said.select("conv_id", "turn", "k", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == mask_role).alias("loss"))
    end = "</turn>\n"
    size = F.length("head") + F.length("body") + len(end)
    before = Window.partitionBy("conv_id").orderBy("turn", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("loss"), F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length")))
    piece = F.struct("turn", "k", F.concat("head", "body", F.lit(end)).alias("text"), span.alias("span"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), piece))).alias("p"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda p: p["text"]), "").alias("formatted"), F.array_compact(F.transform("p", lambda p: p["span"])).alias("loss_spans"))


def under(text: Column, spans: Column) -> Column:
    """The stretches (start, length; code points) of a text. They are cut from four bytes a character, so each costs its own length only."""
    guard = F.lit(b"\x00\x00\x00A")  # a byte order mark at a stretch's start is text
    cut = lambda b: F.transform(spans, lambda s: F.substr(F.decode(F.concat(guard, F.substring(b, 4 * s["start"] + 1, 4 * s["length"])), "UTF-32"), F.lit(2)))
    return F.get(F.transform(F.array(F.encode(text, "UTF-32")), cut), F.lit(0))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans and turns (role, text) as read back from the output alone."""
    parts = F.filter(F.split("formatted", "</turn>\n"), lambda s: s != "")

    def turn(s: Column) -> Column:
        head = F.regexp_extract(s, r"(?s)^### (?:[^\\:]++|\\.)*+: ", 0)
        role = F.substr(head, F.lit(5), F.length(head) - 6)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(s, F.length(head) + 1)).alias("text"))

    return formatted.select("conv_id", "formatted", "loss_spans", F.transform(parts, turn).alias("turns"))


def chat_format(log: DataFrame, mask_role: str = ASSISTANT) -> DataFrame:
    """conv_id, formatted, loss_spans of a log of events."""
    return render(messages(log), mask_role)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    tricky = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(tricky).alias("text"))
    read = parse(chat_format(conversation_log(turns.unionByName(own))))
    lost = F.array_join(F.transform(under(F.col("formatted"), F.col("loss_spans")), unescape), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", "formatted", "turns", lost.alias("lost"), said.alias("said")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode("said", "utf-8"), 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.encode("lost", "utf-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP4_SQL = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS head
  FROM own)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
