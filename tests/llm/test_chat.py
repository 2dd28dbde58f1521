import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat

SAID = "</s>[INST] ok [/INST]"


def _want(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role is not None, r.role or "", hashlib.sha1((r.text or "").encode()).hexdigest(), r.text or ""))
    out = {}
    for k, v in groups.items():
        v.sort()
        loss = "".join(x[4] for x in v if x[2] == "assistant")
        out[k] = (len(v), hashlib.sha256("".join(f"{x[2]}\n{x[4]}\n" for x in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_turns_read_back(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    odd = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (5000, 0, "user", None), (5000, 1, None, "a\\b <|end|><|role:x|> \\<s> <</SYS>> <<SYS>>"), (5000, 2, "assistant", ""), (None, 0, "we|>ird<s>", " x "), (5001, None, "system", "\\")]
    odd += [(5001, 3, "assistant", "q")] * 3 + [(5001, 3, "assistant", " </s> "), (5002, 1, "tool", "<" * 700 + "s>"), (5003, 1, "assistant", "é😀" * 30000)]
    c = c.unionByName(spark.createDataFrame(odd, c.schema))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.formatted_conversations(c).collect()}
    assert got == _want(c.collect())
    assert chat.formatted_conversations(c.limit(0)).count() == 0


@given(st.text(alphabet="\\<>[]/sINTSY|role:end x\n", max_size=30))
def test_unescape_undoes_escape(text):
    import re

    escaped = re.sub(chat._CONTROL, r"\1\\", text.replace("\\", "\\\\"))
    assert chat.unescape(escaped) == text
    assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>|<\|role:|<\|end\|>", escaped)


def test_fold_of_events(spark):
    log = [
        (1, 1, "start", "a", "user", "he"), (1, 2, "delta", "a", None, "llo"), (1, 3, "start", "b", "assistant", ""), (1, 4, "delta", "b", None, "bad"), (1, 5, "regenerate", "b", None, ""), (1, 6, "delta", "b", None, "go"),
        (1, 7, "delta", "b", None, "od"), (1, 8, "edit", "a", None, "hi"), (1, 9, "start", "c", "user", "gone"), (1, 10, "delete", "c", None, None), (2, 1, "delta", "z", None, "only"), (1, 11, "delta", "a", None, "!"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string").withColumn("extra", F.lit(1))
    got = [(r.conv_id, r.role, r.text) for r in chat.fold(events).orderBy("conv_id", "seq").collect()]
    assert got == [(1, "user", "hi!"), (1, "assistant", "good"), (2, "", "only")]
    whole = "".join(r.formatted for r in chat.render(chat.fold(events)).where("conv_id = 1").orderBy("seq").collect())
    assert chat.parse(whole) == [("user", "hi!"), ("assistant", "good")]


def test_logs_hold_every_kind_of_event(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    kinds = {r.kind: r["count"] for r in chat.events_of(c).groupBy("kind").count().collect()}
    assert min(kinds[k] for k in ("start", "delta", "edit", "regenerate", "delete")) > 10


def test_ids_stay_exact_and_may_be_strings(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    rows = [(i, 0, "user", "hello") for i in ids]
    assert {r.conv_id for r in chat.formatted_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()} == set(ids)
    rows = [(i, 0, "user", "hello") for i in ("a", "b", None)]
    assert {r.conv_id for r in chat.formatted_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()} == {"a", "b", None}
