"""Chat formatting by event sourcing, with DataFrame functions only.

A conversation log is a table of events (conv_id, message, seq, kind, role, text).  The log
is partitioned by conversation; each message's events are folded in order of seq:

* ``start``       opens the message with its role and a first text,
* ``delta``       appends streamed text,
* ``edit``        replaces all text so far,
* ``regenerate``  drops all text so far; deltas of the new attempt follow.

So a message's text is what its last start, edit or regenerate event holds, followed by the
deltas after it.  Messages are then rendered in order into one string, and the assistant texts'
character spans form the loss mask.

Template: each turn is ``<turn>### ROLE: TEXT</turn>`` and a newline.  Inside roles and texts
``\\`` becomes ``\\b``, ``<`` becomes ``\\l``, ``###`` becomes ``\\h`` (and ``:`` becomes ``\\c`` in
roles), so no mark can occur inside a text and the rendering can be read back exactly.

Defined results: null text is empty, null role is an empty role, null conversation ids are one
conversation of their own, a message without start event has an empty role, ties in order are
broken by role and text (equal rows are all kept), an empty log gives an empty table.  Columns besides
those named are not read.  A conversation is one row of the result: its events meet in one task, as
long as they may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<turn>### ", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("###", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("###", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, position, message, role, text) of the final messages of a log.

    `position` orders messages; `message` tells the messages of a conversation apart.
    """
    e = events.select(
        "conv_id", "position", "message", F.coalesce("seq", F.lit(0)).alias("seq"), "kind",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    m = e.repartition("conv_id").groupBy("conv_id", "position", "message").agg(log.alias("log"))
    resets = F.filter("log", lambda x: x["kind"] != "delta")
    base = F.element_at(resets, -1)
    has = F.size(resets) > 0
    role = F.coalesce(F.try_element_at(F.filter("log", lambda x: x["kind"] == "start"), F.lit(1))["role"], F.lit(""))
    first = F.when(has & (base["kind"] != "regenerate"), base["text"]).otherwise(F.lit(""))
    tail = F.filter("log", lambda x: (x["kind"] == "delta") & (~has | (x["seq"] > base["seq"])))
    text = F.concat(first, F.array_join(F.transform(tail, lambda x: x["text"]), ""))
    return m.select("conv_id", "position", "message", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are (start, length) in characters from 0."""
    turns = F.array_sort(F.collect_list(F.struct("position", "role", "text")))
    c = messages.groupBy("conv_id").agg(turns.alias("turns"))
    c = c.withColumn("heads", F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(": "))))
    c = c.withColumn("bodies", F.transform("turns", lambda t: escape(t["text"])))
    parts = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE)))
    c = c.withColumn("formatted", F.array_join(parts, ""))
    pairs = F.transform(F.arrays_zip("turns", "heads", "bodies"), lambda x: F.struct((x["turns"]["role"] == learned_role).alias("learn"), F.length(x["heads"]).alias("head"), F.length(x["bodies"]).alias("body")))
    empty = F.lit(None).cast("array<struct<start:long,length:long>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:long,length:long>>")).alias("spans"))
    spans = F.aggregate(
        pairs, state,
        lambda s, x: F.struct(
            (s["at"] + x["head"] + x["body"] + len(CLOSE)).alias("at"),
            F.when(x["learn"], F.array_append(s["spans"], F.struct((s["at"] + x["head"]).cast("long").alias("start"), x["body"].cast("long").alias("length")))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return c.select("conv_id", "formatted", spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a rendered conversation holds."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(len(OPEN) + 1))
        colon = F.instr(body, ": ")
        return F.struct(unescape_role(F.substr(body, F.lit(1), colon - 1)).alias("role"), unescape(F.substr(body, colon + 2)).alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    Spans are looked up in the turns that hold them, turn by turn, so that no turn is walked for another one's span.
    """
    none = F.array().cast("array<string>")

    def step(s: Column, piece: Column) -> Column:
        n, span = F.length(piece), F.get(spans, s["i"])
        here = F.coalesce(span["start"] <= s["at"] + n, F.lit(False))
        text = unescape(F.substr(piece, (span["start"] - s["at"] + 1).cast("int"), span["length"].cast("int")))
        return F.struct((s["at"] + n + len(CLOSE)).alias("at"), (s["i"] + here.cast("int")).alias("i"), F.when(here, F.array_append(s["texts"], text)).otherwise(s["texts"]).alias("texts"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("i"), none.alias("texts"))
    return F.array_join(F.aggregate(F.split(formatted, CLOSE), begin, step, lambda s: s["texts"]), "")


def events_from_turns(turns: DataFrame, piece: int = 512) -> DataFrame:
    """The event log of finished turns, as a streaming server would have written it.

    Every turn is a message: a start event with its role, then its text as deltas of `piece`
    characters.  Equal rows stay messages of their own.
    """
    t = turns.select("conv_id", F.col("turn").alias("position"), F.monotonically_increasing_id().alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))  # one walk over the text
    deltas = F.transform(pieces, lambda x, k: F.struct((k + 1).alias("seq"), F.lit("delta").alias("kind"), x.alias("text")))
    start = F.array(F.struct(F.lit(0).alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text")))
    return t.select("conv_id", "position", "message", "role", F.explode(F.concat(start, deltas)).alias("e")).select("conv_id", "position", "message", F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def digest(rendered: DataFrame) -> DataFrame:
    """Digests read back from rendered conversations."""
    d = rendered.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that tries to break the template.
HOSTILE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return digest(render(fold_events(events_from_turns(c.unionByName(hostile)))))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '###', '\h')) AS body,
        length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '###', '\h'), ':', '\c')) AS head FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(10 + head + 2 + body + 8)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
