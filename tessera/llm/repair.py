"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

A conversation is a sequence of rows. Each is kept (0), rerole-d to user or assistant (2) or deleted (3, and this is forced for
blank rows and for rows whose role and text stood before); empty user or assistant turns are inserted (2); a truncated row that
is not deleted adds 1. Among the cheapest edits those are taken whose initials D, I, K, R in order are least in ASCII.

The method is a DP over the rows that are retained. With S(i) the cost to delete all rows from i on (a running sum), the last
retained role q and a next retained row j as role r, what lies between costs S(i) - S(j), and the inserts that the pair
(q, r) needs. So one running minimum of g(j, r) - S(j) for each role r prices every gap, whatever its length. Read from the
last row to the first, this gives for each row and each of four states whether the row is deleted or as which role it is
retained in the least audit: one byte a row. Read forwards, the bytes are followed from the start.

How it runs. Equal rows are merged with their number before the shuffle, faults are column expressions, and the first of the rows
with one role and text comes from minima salted by turn, so a conversation, row or text that a third of all rows hold
is dealt out. The two readings stream over rows sorted within partitions and hold a few numbers; only the
audit grows with a conversation, and it is part of the result. The first reading sees no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_task, cut
from tessera.llm.components import with_least

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: States are the role retained last: none, s, u, a. What has to be inserted before the next retained role, if that can follow at all.
NEXT = (
    {1: "", 2: "", 3: "u"},
    {2: "", 3: "u"},
    {2: "a", 3: ""},
    {2: "", 3: "u"},
)
#: What has to be inserted behind the last row.
LAST = ("", "ua", "a", "")
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
_NEVER = float("inf")


def _choose(state: int, left: list[float], cost: dict[int, float], then: list[float], initial: str) -> int:
    """How the row is retained in this state (1 to 3), or 0 where it is deleted: the least audit among the cheapest edits."""
    if DELETE + then[state] == left[state]:
        return 0
    audits = [("I" * len(new) + ("K" if "?sua"[r] == initial else "R"), r) for r, new in NEXT[state].items() if INSERT * len(new) + cost[r] == left[state]]
    return min(audits)[1]


class Backward:
    """The reading from the last row to the first."""

    def __init__(self) -> None:
        self.deleted = 0
        self.best = {1: _NEVER, 2: _NEVER, 3: _NEVER}  # of g(j, r) - S(j)

    def ahead(self) -> list[float]:
        """The cost of all that follows, by state."""
        return [self.deleted + min(INSERT * len(LAST[q]), *(INSERT * len(new) + self.best[r] for r, new in NEXT[q].items())) for q in range(4)]

    def row(self, initial: str, truncated: bool) -> int:
        """A row that need not go: two bits for each state, lowest first."""
        then = self.ahead()
        cost = {r: (0 if "?sua"[r] == initial else _NEVER if r == 1 else REROLE) + TRUNCATED * truncated + then[r] for r in (1, 2, 3)}
        self.deleted += DELETE
        self.best = {r: min(self.best[r], cost[r] - self.deleted) for r in cost}
        left = self.ahead()
        return sum(_choose(q, left, cost, then, initial) << 2 * q for q in range(4))

    def gone(self, n: int) -> None:
        """n rows that have to go."""
        self.deleted += DELETE * n


class Forward:
    """The reading from the first row to the last, which follows the choices and digests what they give."""

    def __init__(self) -> None:
        self.state, self.cost, self.illegal, self.before = 0, 0, 0, None
        self.low, self.high, self.turns = None, None, 0
        self.blank = self.duplicate = self.truncated = self.lines = 0
        self.audit, self.digest = bytearray(), hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.digest.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self, roles: str) -> None:
        for r in roles:
            self.audit += b"I"
            self.cost += INSERT
            self.say(ROLES[r], "")

    def rows(self, turn: int | None, role: str, text: str, n: int, blank: bool, first: bool, truncated: bool, choices: int) -> None:
        """n equal rows side by side; the first of them may be retained where it is neither blank nor a duplicate."""
        if turn is not None and (self.low is None or turn != self.high):
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        self.illegal += n - 1 + (self.before is not None and self.before + initial not in LEGAL)
        self.before = initial
        live = first and not blank
        self.blank += n * blank
        self.duplicate += (n - first) * (not blank)
        self.truncated += live and truncated
        as_role = choices >> 2 * self.state & 3 if live else 0
        if as_role:
            self.insert(NEXT[self.state][as_role])
            same = "?sua"[as_role] == initial
            self.audit += b"K" if same else b"R"
            self.cost += REROLE * (not same) + TRUNCATED * truncated
            self.say(role if same else ROLES["?sua"[as_role]], text)
            self.state = as_role
        gone = n - (as_role > 0)
        self.audit += b"D" * gone
        self.cost += DELETE * gone

    def closed(self) -> tuple:
        self.insert(LAST[self.state])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, int(self.truncated), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage, equal ones merged: conv_id, turn, role, text, n. Null roles and texts are one space, as are null ids in the checksum."""
    written = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(written.cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    hit = rows.where("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("n"))
    return hit.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without their texts: conv_id, turn, role, tie (a digest of the text), n, blank, first, truncated."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select("conv_id", "turn", "role", "tie", "n", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    keyed = narrow.withColumn("same", F.sha2(F.to_json(F.struct("conv_id", "role", "tie")), 256)).withColumn("at", F.struct("turn"))
    return with_least(keyed, "same", "at", "least", by="turn").withColumn("first", F.col("at").eqNullSafe(F.col("least"))).drop("same", "at", "least")


def _choices(rows: DataFrame, id_kind: str) -> DataFrame:
    """Each row's choices by state, from a reading of each conversation backwards."""
    names = ["conv_id", "turn", "role", "tie", "n", "blank", "first", "truncated"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found = []
            for conv_id, role, n, blank, first, truncated in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "n", "blank", "first", "truncated")), strict=True):
                if state is None or conv_id != now:
                    now, state = conv_id, Backward()
                live = first and not blank
                state.gone(n - live)
                found.append(state.row(role[:1], truncated) if live else 0)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found, pa.int32())], [*names, "choices"])

    backwards = [F.col("conv_id"), F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("tie")]
    ordered = rows.select(*names).repartition(by_task(rows), "conv_id").sortWithinPartitions(*backwards)
    return ordered.mapInArrow(read, f"conv_id {id_kind}, turn long, role string, tie string, n long, blank boolean, first boolean, truncated boolean, choices int")


def repaired(turns: DataFrame) -> DataFrame:
    """For each conv_id of turns (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 after damage.

    Rows go by turn, nulls first; rows of one turn by role and a digest of the text, so equal ones lie side by side. A null
    conv_id is a conversation of its own; ids have any type that can be ordered. A conversation without rows after damage has
    zeros, an empty audit and the digest of nothing. An empty table gives no rows. Other columns may have any name.
    """
    named = turns.select("conv_id", "turn", "role", "text")
    rows = cut(damaged(named).withColumn("tie", F.sha2("text", 256)))
    id_kind = turns.schema["conv_id"].dataType.simpleString()
    told = _choices(_faults(rows), id_kind)

    def empty(kind: str, name: str) -> Column:
        return F.lit(None).cast(kind).alias(name)

    numbers = [("n", "long"), ("blank", "boolean"), ("first", "boolean"), ("truncated", "boolean"), ("choices", "int")]
    there = named.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), empty("long", "turn"), empty("string", "role"), empty("string", "tie"), *(empty(k, c) for c, k in numbers), empty("string", "text"))
    choice = told.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "tie", *(c for c, _ in numbers), empty("string", "text"))
    texts = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "tie", *(empty(k, c) for c, k in numbers), "text")
    names = ["conv_id", "kind", "turn", "role", "n", "blank", "first", "truncated", "choices", "text"]
    out = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, own = None, None, ()

        def closed(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], out)

        for batch in batches:
            done, id_type = [], batch.schema.field("conv_id").type
            for conv_id, kind, turn, role, n, blank, first, truncated, choices, text in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if kind == 0:
                    if state is not None:
                        done.append((now, *state.closed()))
                    now, state = conv_id, Forward()
                elif kind == 1:
                    own = (n, blank, first, truncated, choices)
                else:
                    state.rows(turn, role, text, *own)
            if done:
                yield closed(done, id_type)
        if state is not None:
            yield closed([(now, *state.closed())], id_type)

    all_rows = there.union(choice).union(texts)
    ordered = all_rows.repartition(by_task(rows), "conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, F.col("turn").asc_nulls_first(), "role", "tie", "kind")
    return ordered.select(*names).mapInArrow(read, f"conv_id {id_kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _retained(state: int) -> str:
    """SQL: the ways to retain the row so that it has this state's role, from each state before."""
    mark, said = "?sua"[state], {2: "user", 3: "assistant"}.get(state)
    ways = []
    for before, follows in enumerate(NEXT):
        if state in follows:
            new = follows[state]
            inserts = "".join(f" || chr(10) || '{ROLES[r]}:'" for r in new)
            cost = f"w.q{before}.c + {INSERT * len(new)} + x.cut"
            kept = f"CASE WHEN x.initial = '{mark}' THEN struct_pack(c := {cost}, a := w.q{before}.a || '{'I' * len(new)}K', t := w.q{before}.t{inserts} || chr(10) || x.role || ':' || x.text)"
            other = f" ELSE struct_pack(c := {cost} + {REROLE}, a := w.q{before}.a || '{'I' * len(new)}R', t := w.q{before}.t{inserts} || chr(10) || '{said}:' || x.text)" if said else ""
            ways.append(f"CASE WHEN NOT x.must AND w.q{before} IS NOT NULL THEN {kept}{other} END END")
    return ", ".join(ways)


_STEPS = ",\n    ".join(
    f"list_aggregate(list_filter([CASE WHEN w.q{q} IS NOT NULL THEN struct_pack(c := w.q{q}.c + {DELETE}, a := w.q{q}.a || 'D', t := w.q{q}.t) END{', ' + _retained(q) if q else ''}], lambda z: z IS NOT NULL), 'min') AS q{q}"
    for q in range(4)
)
_ENDS = ", ".join(
    f"CASE WHEN q{q} IS NOT NULL THEN struct_pack(c := q{q}.c + {INSERT * len(LAST[q])}, a := q{q}.a || '{'I' * len(LAST[q])}', t := q{q}.t{''.join(f" || chr(10) || '{ROLES[r]}:'" for r in LAST[q])}) END"
    for q in range(4)
)

#: The same rows by a DP over whole edits from the first row to the last, with the checksum as SQL.
ORACLE_SQL = rf"""
WITH RECURSIVE
tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) AS r(i))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fated AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM named, tbl),
hit AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM hit),
marked AS (
  SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(bare, 1) NOT IN ('.', '!', '?') AS open,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM ordered),
x AS (SELECT *, blank OR again AS must, CASE WHEN open THEN {TRUNCATED} ELSE 0 END AS cut FROM marked),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, struct_pack(c := 0, a := '', t := '') AS q0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS q1, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS q2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS q3
  FROM conversations
  UNION ALL
  SELECT w.conv_id, x.i,
    {_STEPS}
  FROM walk w JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1),
best AS (
  SELECT conv_id, list_aggregate(list_filter([{_ENDS}], lambda z: z IS NOT NULL), 'min') AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM walk) WHERE back = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(open AND NOT again AND NOT blank) AS truncated, count_if(illegal) AS illegal
  FROM marked GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(substr(b.t, 2)) AS repaired_sha256
FROM best LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id
"""
