"""Chat formatting from event logs: fold streamed deltas, edits and regenerations into messages, then render.

An event has conv_id, seq (any orderable type; its order is the conversation's), message_id, kind, role and text.
`start` opens a message, `delta` adds text, `edit` and `regenerate` put their text in place of all before, `delete` takes the
message away. Folding groups by message, not by conversation, so one conversation with a third of all events is spread
over tasks; only reading a conversation back in order streams through one task, holding one row at a time.

The template: a user's text stands in `<s>[INST] ... [/INST]`, an assistant's before ` </s>`, a system's in `<<SYS>>`
lines, any other role's in `<|role:NAME|>` and `<|end|>`. Control strings inside texts are escaped reversibly: each
backslash is doubled, and a backslash is put behind the first character of each control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_task

RESETS = ("start", "edit", "regenerate", "delete")
#: Code points of text in one streamed delta that a stored message is cut into.
DELTA = 200
#: The first character of a control string, seen where the rest follows.
_CONTROL = r"([<\[])(?=/?s>|/?INST\]|</?SYS>>|/SYS>>|\|role:|\|end\|>)"
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|<\|role:(?P<role>.*?)\|>\n(?P<other>.*?)<\|end\|>| (?P<assistant>.*?) </s>", re.S)
_ESCAPE = re.compile(r"\\(\\?)")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, message_id, seq of the first event, role, text) after all events.

    Null texts add nothing. Deltas before any start count from an empty text. The role is the first event's that names
    one, else empty. Events that tie in seq are taken in the order of kind and text. Null ids are a group of their own.
    """
    logged = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))))
    folded = events.groupBy("conv_id", "message_id").agg(logged.alias("log"))
    resets = F.filter(F.transform("log", lambda e, k: F.when(e["kind"].isin(*RESETS), k)), lambda k: k.isNotNull())
    last = F.coalesce(F.array_max(resets), F.lit(0))
    kept = folded.withColumn("last", last).where(F.get("log", F.col("last"))["kind"] != "delete")
    text = F.array_join(F.transform(F.slice("log", F.col("last") + 1, F.size("log")), lambda e: e["text"]), "")
    role = F.coalesce(F.get(F.filter(F.col("log")["role"], lambda r: r.isNotNull()), F.lit(0)), F.lit(""))
    return kept.select("conv_id", "message_id", F.get("log", F.lit(0))["seq"].alias("seq"), role.alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, seq, formatted, and the loss mask as loss_start and loss_end (code points; else null).

    A conversation's training text is its rows' formatted texts in the order of seq, one behind the other. The mask
    covers an assistant's escaped text and nothing else.
    """
    body, role = escape(F.col("text")), F.col("role")
    formatted = (
        F.when(role == "user", F.concat(F.lit("<s>[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit(" "), body, F.lit(" </s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>\n"), body, F.lit("\n<</SYS>>\n\n")))
        .otherwise(F.concat(F.lit("<|role:"), F.replace(escape(role), F.lit("|>"), F.lit("|\\>")), F.lit("|>\n"), body, F.lit("<|end|>")))
    )
    out = messages.select("conv_id", "seq", "role", formatted.alias("formatted"))
    spoken = F.col("role") == "assistant"
    return out.select("conv_id", "seq", "formatted", F.when(spoken, F.lit(1)).alias("loss_start"), F.when(spoken, F.length("formatted") - 5).alias("loss_end"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text, whole conversations or parts."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


def digests(rendered: DataFrame) -> DataFrame:
    """Each conversation read back from its rendered rows: turns and loss text as digests, and the length.

    Rows are sorted within partitions and streamed: a conversation needs one pass in order, not memory.
    """

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def closed() -> tuple:
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def told(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            for conv_id, formatted, a, b in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or conv_id != now:
                    if state is not None:
                        done.append(closed())
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    loss = unescape(formatted[a:b])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(formatted)
            if done:
                yield told(done, kind)
        if state is not None:
            yield told([closed()], kind)

    id_kind = rendered.schema["conv_id"].dataType.simpleString()
    ordered = rendered.repartition(by_task(rendered), "conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(read, f"conv_id {id_kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(turns: DataFrame) -> DataFrame:
    """Stored turns (conv_id, turn, role, text) as an event log that would have made them.

    A message starts and streams its text in deltas. By a hash of its id, a quarter of all messages streamed a draft first and
    were generated again, a quarter were edited after a draft, and a quarter stand beside a message that was deleted.
    Turns order by turn (nulls first), then role and a digest of the text; rows that repeat are turns of their own.
    """
    copies = turns.groupBy("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).count()
    one = copies.select("conv_id", "turn", "role", "text", F.sha1("text").alias("tie"), F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy"))
    named = one.withColumn("message_id", F.sha1(F.to_json(F.struct("turn", "role", "tie", "copy"))))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / DELTA).cast("int") - 1), lambda k: event("delta", F.substr("text", k * DELTA + 1, F.lit(DELTA))))
    start, draft, nothing = event("start", F.lit("")), event("delta", F.concat(F.lit("draft "), F.substr("text", F.lit(1), F.lit(DELTA)))), F.array().cast("array<struct<kind: string, text: string>>")
    fate = F.pmod(F.xxhash64("conv_id", "message_id"), F.lit(4))
    before = F.when(fate == 1, F.array(start, draft, event("regenerate", F.lit("")))).when(fate == 2, F.array(start, draft, event("edit", F.lit("")))).otherwise(F.array(start))
    own = F.struct(F.col("message_id"), F.concat(before, F.when(F.length("text") > 0, cuts).otherwise(nothing)).alias("log"))
    gone = F.struct(F.concat(F.col("message_id"), F.lit("-gone")).alias("message_id"), F.array(start, draft, event("delete", F.lit(None).cast("string"))).alias("log"))
    messages = named.select("conv_id", "turn", "role", "tie", "copy", F.explode(F.when(fate == 3, F.array(own, gone)).otherwise(F.array(own))).alias("m"))
    logged = messages.select("conv_id", "turn", "role", "tie", "copy", F.col("m.message_id").alias("message_id"), F.posexplode("m.log").alias("k", "e"))
    return logged.select("conv_id", "message_id", F.struct("turn", "role", "tie", "copy", "k").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """Stored turns as events, folded, rendered and read back. A null text is empty, a null role an empty name; conv_id has any type."""
    return digests(render(fold(events_of(turns))))
