"""Chat formatting from an event log.

A conversation is a log of events. Folding it gives the final messages: a
``message`` opens one, a ``delta`` adds to it, an ``edit`` replaces its text, a
``regenerate`` clears it so that later deltas build it anew. The fold groups by
message, never by conversation: the last event that sets a text is found with an
aggregate, earlier events go, and what is left is joined in order. Conversations
of any length are then dealt out by their id, sorted by Spark, and rendered and
read back as a stream of messages, so no task holds a whole conversation.

The template writes a turn as ``<|im_start|>role\\n text<|im_end|>\\n`` (without
the blank). In a text each ``<``, any number of backslashes, ``|`` gets one
backslash more, so no control string can arise, and taking one away again gives
the text back. In a role, backslash and line feed are written ``\\\\`` and ``\\n``
before that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import map_batches

START, END = "<|im_start|>", "<|im_end|>\n"
#: What a run of events does to its message.
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes are found from the left, so the parts between them
    hold a backslash only before the ``n`` of a line feed."""
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, role, text)`` of a log ``(conv_id, seq,
    kind, turn, role, text)``.

    A ``message`` opens a message at its turn; the other kinds go to the latest
    message of their turn (or to one of their own, if none came before). A message
    keeps what its last ``message``, ``edit`` or ``regenerate`` set, with the later
    deltas behind it, and the last role that is not null. Null text counts as
    empty, an unknown or null kind as ``message``. Events with equal seq go by kind
    (openers first, deltas last) and text; repeated events count each. Null
    conversations and turns are groups of their own; an empty log gives no
    messages; further columns are ignored.
    """
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.lit("message"))
    key = F.struct(F.col("seq").alias("seq"), (kind != "message").alias("later"), (kind == "delta").alias("adds"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = W.partitionBy("conv_id", "turn").orderBy("e").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = events.select("conv_id", "turn", F.col("role").cast("string").alias("role"), key.alias("e")).withColumn("nth", F.sum((~F.col("e.later")).cast("int")).over(order))
    last = e.groupBy("conv_id", "turn", "nth").agg(
        F.max(F.when(~F.col("e.adds"), F.col("e"))).alias("base"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("e"))).alias("role"),
        F.sort_array(F.collect_list(F.when(F.col("e.adds"), F.col("e")))).alias("deltas"),
    )
    later = F.filter("deltas", lambda d: F.col("base").isNull() | (d > F.col("base")))
    text = F.concat(F.coalesce(F.col("base.text"), F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return last.select("conv_id", "turn", "role", text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Formatted turns ``(conv_id, turn, formatted, loss_start, loss_end)``.

    A conversation's formatted text is its rows' ``formatted`` by turn, role and
    text, nothing between. ``loss_start`` and ``loss_end`` are the code points of
    ``formatted`` that an assistant's text takes (null for other roles). Null
    texts and roles count as empty. Narrow, and JVM only.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = escape(text)
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    formatted = F.concat(head, body, F.lit(END))
    mask = F.when(role == "assistant", F.length(head))
    return messages.select("conv_id", "turn", formatted.alias("formatted"), mask.alias("loss_start"), (mask + F.length(body)).alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, loss_text)`` out of rows of :func:`render`:
    splits at the template's own marks, cuts the mask out, unescapes."""
    inner = F.substring(F.col("formatted"), F.lit(len(START) + 1), F.length("formatted") - len(START) - len(END))
    at = F.instr(inner, "\n")
    role, text = F.substring(inner, F.lit(1), at - 1), F.substring(inner, at + 1, F.length(inner))
    masked = F.when(F.col("loss_start").isNotNull(), F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    return formatted.select("conv_id", "turn", unescape_role(role).alias("role"), unescape(text).alias("text"), unescape(masked).alias("loss_text"), F.length("formatted").alias("chars"))


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation with the digests of what :func:`read_back` reads.

    Rows are dealt by conversation and sorted by Spark, then a running hash takes
    them one after another: a conversation of any length needs one message of
    memory.
    """
    back = read_back(formatted)
    kind = back.schema["conv_id"].dataType.simpleString()
    dealt = back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = object(), None, []

        def close():
            turns, text, loss, chars, size = state
            out.append((now, turns, text.hexdigest(), chars, loss.hexdigest(), size))

        def flush():
            columns = list(zip(*out, strict=True)) or [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return batch

        names, types = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, role, text, loss, chars in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if conv != now:
                    if state:
                        close()
                    now, state = conv, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += chars
                if loss is not None:
                    state[2].update(loss.encode())
                    state[3] += len(loss)
            if out:
                yield flush()
        if state:
            close()
            yield flush()

    return dealt.transform(map_batches, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(turns: DataFrame) -> DataFrame:
    """A plain table of turns as a log: each row is one ``message``."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


#: Characters of a streamed delta.
DELTA = 256


def as_stream(turns: DataFrame) -> DataFrame:
    """A plain table of turns as the log of a chat service that ends in these turns: by
    a hash of its text a turn came as one ``message``; as a draft and an ``edit``; as an
    empty message and streamed ``delta`` parts; or as a draft with a part behind it that
    a ``regenerate`` took back before the parts of the text.

    Rows of one turn come one after another by role and text, each with its own events.
    Null text counts as empty; an empty table gives no events.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("role").cast("string")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    nth = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    places = F.sequence(F.lit(0), F.ceil(F.length("text") / DELTA).cast("int") - 1)
    parts = F.when(F.length("text") > 0, F.transform(places, lambda i: event("delta", F.substring(F.col("text"), i * DELTA + 1, F.lit(DELTA))))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    draft = event("message", F.concat(F.lit("draft "), F.reverse(F.substring("text", 1, DELTA))))
    ways = [
        F.array(event("message", F.col("text"))),
        F.array(draft, event("edit", F.col("text"))),
        F.concat(F.array(event("message", F.lit(""))), parts),
        F.concat(F.array(draft, event("delta", F.lit(" and more")), event("regenerate", F.lit(""))), parts),
    ]
    way = F.pmod(F.xxhash64("text"), F.lit(len(ways)))
    log = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    sent = rows.withColumn("nth", nth).select("conv_id", "turn", "role", "nth", F.posexplode(log).alias("at", "event"))
    seq = F.shiftleft(F.col("nth").cast("long"), 32) + F.col("at")
    return sent.select("conv_id", seq.alias("seq"), "event.kind", "turn", "role", "event.text")
