"""Operator 13: conversation structure repair by a retained-subsequence dynamic programme."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import cut, small_batches

# Fixed values of the repair: what edits cost, and the roles that can be assigned.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROLES = {"u": "user", "a": "assistant"}

#: By the last retained role (0: nothing yet) and the next one, the state after it.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The pairs of roles that hold once one turn is inserted between them.
BRIDGED = {(0, "a"): 3, (1, "a"): 3, (2, "u"): 2, (3, "a"): 3}
#: What closes a conversation that ends in a state: inserted turns.
CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}
#: The role that comes next where a turn is inserted or takes another role.
EXPECTED = {0: "u", 1: "u", 2: "a", 3: "u"}
EDITS = ("D", "IK", "IR", "K", "R")  # in ASCII order; none begins another
NONE = 1 << 60


class Programme:
    """The cheapest edits of one conversation, its turns given one after the other.

    A state is the last retained role. Deleting a turn adds the same to every state, so deletions are one running sum and each
    state keeps its minimum less that sum: a gap between retained turns costs nothing to carry. Retaining a turn moves a state's
    minimum along a pair of roles; the pair tells whether a turn has to be inserted. Audits of equal cost are compared by the
    order of the states' own audits, which is kept: all have as many edits of turns and end in one, so none begins another, and the order of two
    audits stays when something is appended. One byte a turn and state is held, for the way back.
    """

    def __init__(self):
        self.cost, self.order, self.deleted, self.back = [0, NONE, NONE, NONE], [0, 1, 2, 3], 0, bytearray()

    def turn(self, initial: str, faulty: bool, truncated: bool) -> None:
        self.deleted += DELETE
        found = [(self.cost[p], self.order[p], 0, p) for p in range(4)]  # deleted: the state stays
        if not faulty:
            extra = (TRUNCATED if truncated else 0) - DELETE
            for p in range(4):
                if self.cost[p] >= NONE:
                    continue
                for role, edit, price in ((initial, "K", 0), ("u", "R", REROLE), ("a", "R", REROLE)):
                    for steps, way, more in ((NEXT, edit, 0), (BRIDGED, "I" + edit, INSERT)):
                        if (t := steps.get((p, role))) is not None:
                            found[t] = min(found[t], (self.cost[p] + price + more + extra, self.order[p], EDITS.index(way), p))
        self.cost = [f[0] for f in found]
        places = sorted(range(4), key=lambda t: found[t][1:3])
        self.order = [places.index(t) for t in range(4)]
        self.back += bytes(f[2] << 2 | f[3] for f in found)

    def result(self) -> tuple[int, str]:
        """(cost, audit)."""
        cost, _, state = min((self.cost[t] + INSERT * CLOSING[t], self.order[t], t) for t in range(4))
        audit = ["I" * CLOSING[state]]
        for i in range(len(self.back) // 4 - 1, -1, -1):
            step = self.back[4 * i + state]
            audit.append(EDITS[step >> 2])
            state = step & 3
        return cost + self.deleted, "".join(reversed(audit))


def faults(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, digest, fault): the turns with their first fault: blank, duplicate, truncated or null.

    A duplicate has role and text of an earlier turn of its conversation. Null role and text: one space.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), own(role_col).alias("role"), own(text_col).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    seen = F.row_number().over(W.partitionBy("conv", "digest").orderBy("turn")) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return rows.withColumn("seen", seen).withColumn("fault", F.when(last == "", "blank").when(F.col("seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")).drop("seen")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in one task, one after the other: first its head, then turns by number, role and digest. Spark sorts and spills."""
    return rows.repartition("conv").sortWithinPartitions("conv", "head", "turn", "role", "digest")


def plans(faulty: DataFrame, every: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) for each row of `every` (conv, distinct) by the turns of faults().

    Texts don't come along, and a conversation's turns pass one after the other, so however long it is a task holds four
    bytes for each of its turns.
    """
    kind = every.schema["conv"].dataType
    rows = faulty.select("conv", F.lit(1).alias("head"), "turn", "role", "digest", "fault").unionByName(every.select("conv", F.lit(0).alias("head")), allowMissingColumns=True)
    out = T.StructType([T.StructField("conv", kind)] + [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        key, state = None, None

        def result():
            low, high, turns = state["turns"]
            cost, audit = state["dp"].result()
            return (key, high - low + 1 - turns if turns else 0, *(state[c] for c in ("blank", "duplicate", "truncated", "illegal")), cost, audit)

        for b in batches:
            done = []
            for conv, head, turn, role, fault in zip(*(b.column(c).to_pylist() for c in ("conv", "head", "turn", "role", "fault")), strict=True):
                if head == 0:
                    if state:
                        done.append(result())
                    key, state = conv, {"dp": Programme(), "turns": (0, 0, 0), "before": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                    continue
                low, high, turns = state["turns"]
                if turn is not None and (not turns or turn != high):
                    state["turns"] = (low if turns else turn, turn, turns + 1)
                initial = role[:1]
                state["illegal"] += state["before"] is not None and state["before"] + initial not in ("su", "ua", "au")
                state["before"] = initial
                if fault:
                    state[fault] += 1
                state["dp"].turn(initial, fault in ("blank", "duplicate"), fault == "truncated")
            if done:
                yield _batch(done, out)
        if state:
            yield _batch([result()], out)

    return _in_order(rows).select("conv", "head", "turn", "role", "fault").mapInArrow(run, out)


def _batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repaired(faulty: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, position, role, text, edit): the turns of every conversation once its plan is carried out, in order within a task; edit is K, R or I."""
    rows = faulty.select("conv", F.lit(1).alias("head"), "turn", "role", "digest", "text").unionByName(plan.select("conv", F.lit(0).alias("head"), "audit"), allowMissingColumns=True)
    out = T.StructType([T.StructField("conv", faulty.schema["conv"].dataType), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        key, audit, end, at, state, position = None, "", 0, 0, 0, 0
        for b in batches:
            done = []

            def insert():
                nonlocal at, state, position
                while at < len(audit) and audit[at] == "I":
                    done.append((key, position, ROLES[EXPECTED[state]], "", "I"))  # noqa: B023
                    state, position, at = NEXT[state, EXPECTED[state]], position + 1, at + 1

            for conv, head, role, text, own in zip(*(b.column(c).to_pylist() for c in ("conv", "head", "role", "text", "audit")), strict=True):
                if head == 0:
                    key, audit, end, at, state, position = conv, own, len(own.rstrip("I")), 0, 0, 0
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit != "D":
                    initial = role[:1] if edit == "K" else EXPECTED[state]
                    done.append((key, position, role if edit == "K" else ROLES[initial], text, edit))
                    state, position = NEXT[state, initial], position + 1
                if at == end:  # what is left closes the conversation
                    insert()
            if done:
                yield _batch(done, out)

    return _in_order(rows).select("conv", "head", "role", "text", "audit").mapInArrow(run, out)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of conversations with turns, from `role:text` of repaired(), joined by newlines; hashed as the turns pass."""
    out = T.StructType([turns.schema["conv"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        key, sha = None, None
        for b in batches:
            done = []
            for conv, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "position", "role", "text")), strict=True):
                if position == 0:
                    if sha:
                        done.append((key, sha.hexdigest()))
                    key, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield _batch(done, out)
        if sha:
            yield _batch([(key, sha.hexdigest())], out)

    return turns.mapInArrow(run, out)


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of `conv_id:turn` modulo 20 a row is dropped, emptied, loses `.!?`, is repeated or becomes a user's. Nulls: one space."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", own("role").alias("role"), own("text").alias("text"), (F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20).alias("d"))
    text: Column = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("d != 0").select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "d")
    return rows.withColumn("copy", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("d", "copy")


def repair(turns: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired turns) of a conversation table (conv_id, turn, role, text); `every` (conv_id) names the conversations to report.

    Turns go by number, nulls first; equal numbers by role and a digest of role and text, so repeated rows stand side by side. A
    null conv_id is a conversation like others. Null role or text: one space. Long texts pass in small batches; an empty table gives no
    rows; a conversation without turns has zeros and an empty audit; other columns are not read.
    """
    small_batches(turns.sparkSession)
    found = faults(turns)
    plan = cut(plans(found, every.select(F.col("conv_id").alias("conv")).distinct()))
    return plan, repaired(found, plan)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows: every conversation after damage, its faults, the cheapest repair, and a hash of the repaired text."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    plan, turns = repair(damage(conversations), conversations)
    hashed = digests(turns).withColumnRenamed("conv", "other")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return plan.join(hashed, F.col("conv").eqNullSafe(F.col("other")), "left").select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
