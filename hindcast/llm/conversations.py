"""Repair of conversation structure by a dynamic program over a trie of role and fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_small, table

#: White space that can make a text blank, and what may end a text.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What edits cost: another role, a deletion, an empty turn put in; and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Initials and faults of a signature's letters: letter number 4 * initial + fault.
INITIALS, FAULTS = "sua", ("clean", "blank", "duplicate", "truncated")
#: What the repaired turns end in so far: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Rows of a conversation whose letters are gathered at once, as a power of two; text by which rows of one turn are ordered.
BLOCK_BITS, HEAD = 10, 64
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


# one signature


def after(state: int) -> int:
    """The state behind one more user or assistant turn, whichever may follow."""
    return ASSISTANT if state == USER else USER


@cache
def edits(initial: int, fault: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, letters, next state) of what can be done with a turn in a state, inserted turns before it included."""
    out = []
    for k in range(3):
        first = "I" * k
        out.append((INSERT * k + DELETE, first + "D", state))
        if FAULTS[fault] not in ("blank", "duplicate"):
            cost = INSERT * k + TRUNCATED * (FAULTS[fault] == "truncated")
            out.append((cost + REROLE, first + "R", after(state)))
            fits = (state == NOTHING, state != USER, state == USER, False)[initial]
            if fits:
                out.append((cost, first + "K", initial + 1))
        state = after(state)
    return out


@cache
def step(layer: tuple, symbol: int) -> tuple[int, tuple, tuple]:
    """(added cost, next layer, way back): the layer behind one more turn.

    A layer holds (cost over the least, rank) for each state that can be reached: rank orders the cheapest and then least
    letters that lead to each. Letters that lead to different states have as many turns and end in a turn's letter, so none
    is the start of another and the rank decides, whatever follows. The way back holds (state before, letters) for each.
    """
    best: list = [None] * 4
    for state, reached in enumerate(layer):
        if reached:
            for cost, letters, to in edits(*divmod(symbol, 4), state):
                found = (reached[0] + cost, reached[1], letters, state)
                if best[to] is None or found < best[to]:
                    best[to] = found
    order = sorted(b[1:3] for b in best if b)
    least = min(b[0] for b in best if b)
    return least, tuple(b and (b[0] - least, order.index(b[1:3])) for b in best), tuple(b and (b[3], b[2]) for b in best)


START = ((0, 0), None, None, None)
#: Turns to put in at the end of each state: a conversation is nothing, or ends in an assistant's turn.
CLOSING = (0, 2, 1, 0)


def solve(signatures: Iterator[str]) -> Iterator[tuple[str, int, int, int, int, int, str]]:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of each signature; they come in ascending order.

    Sorted signatures walk a prefix trie depth first, and the stack holds the layers of the path to the current node: a
    prefix that several share is computed once, and memory is that of one path. Signatures end at their nodes.
    """
    stack = [(START, None, 0, (0, 0, 0), 0, "")]
    before = ""
    for signature in signatures:
        shared = 0
        for a, b in zip(before, signature, strict=False):
            if a != b:
                break
            shared += 1
        del stack[shared + 1 :]
        for letter in signature[shared:]:
            symbol = ord(letter) - 65
            layer, _, cost, faults, illegal, last = stack[-1]
            added, layer, back = step(layer, symbol)
            initial, fault = INITIALS[symbol // 4 : symbol // 4 + 1], symbol % 4
            faults = tuple(n + (fault == k + 1) for k, n in enumerate(faults))
            illegal += len(stack) > 1 and (last, initial) not in LEGAL
            stack.append((layer, back, cost + added, faults, illegal, initial))
        layer, _, cost, faults, illegal, _ = stack[-1]
        more, _, state = min((reached[0] + INSERT * CLOSING[s], reached[1], s) for s, reached in enumerate(layer) if reached)
        letters = ["I" * CLOSING[state]]
        for node in reversed(stack[1:]):
            state, own = node[1][state]
            letters.append(own)
        yield signature, *faults, illegal, cost + more, "".join(reversed(letters))
        before = signature


# all conversations


def initial_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def fault_of(text: Column) -> Column:
    core = F.rtrim(text, F.lit(BLANKS))
    return F.when(core == "", 1).when(F.instr(F.lit(ENDS), F.right(core, F.lit(1))) > 0, 0).otherwise(3)


def places(turns: DataFrame) -> list[Column]:
    """What orders the rows of a conversation: turn, role, the text's start, and the digest of role and text."""
    return [F.substring("text", 1, HEAD).alias("head"), F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)).alias("digest")]


ORDER = ("turn", "role", "head", "digest")


def signatures(turns: DataFrame) -> DataFrame:
    """(conv, gaps, signature) of every conversation, from rows without their texts.

    Rows are numbered in sorted ranges, so one conversation may lie in many tasks; letters are gathered in blocks of at most
    1,024 rows and then as one string of a byte a row, as long as the audit that comes of it.
    """
    light = turns.select("conv", "turn", "role", *places(turns), (F.col("copies") == 0).alias("gone"), initial_of(F.col("role")).alias("initial"), fault_of(F.col("text")).alias("fault"), F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"))
    # equal rows would all meet in one range; their place among each other does not matter
    light = light.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = light.repartitionByRange("conv", *ORDER, "salt").sortWithinPartitions("conv", *ORDER, "salt")
    rows = cut(ranged.select("conv", "turn", "digest", "gone", "initial", "fault", F.monotonically_increasing_id().alias("number")), "turns")
    again = rows.where("not gone and fault <> 1").groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("number").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    marked = join_small(rows, cut(again, "again"), {"conv": "_conv", "digest": "_digest"}, "left")
    fault = F.when((F.col("fault") != 1) & (F.col("number") > F.col("_first")), 2).otherwise(F.col("fault"))
    letter = F.when(F.col("gone"), "").otherwise(F.char(65 + 4 * F.col("initial") + fault))
    text = lambda key: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "letters"))), lambda x: x["letters"]), "")
    blocks = marked.withColumn("letters", letter).groupBy("conv", F.shiftright("number", BLOCK_BITS).alias("block")).agg(text("number").alias("letters"))
    whole = blocks.groupBy("conv").agg(text("block").alias("signature"))
    stand = rows.where("not gone").groupBy(F.col("conv").alias("_conv"), "turn").agg(F.lit(1)).groupBy("_conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    return whole.join(stand, whole["conv"].eqNullSafe(stand["_conv"]), "left").select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "signature")


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def answers(whole: DataFrame) -> DataFrame:
    """(signature, counts, audit) of each distinct signature, by sorted ranges: each task walks the trie of its range."""
    schema = "_signature string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for found in solve(s for batch in batches for s in batch.column(0).to_pylist()):
            rows.append(found)
            if len(rows) >= 5_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        signature, *counts, audit = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(signature), *[pa.array(c, pa.int64()) for c in counts], pa.array(audit)], names=["_signature", *COUNTS, "audit"])

    distinct = whole.select("signature").distinct()
    return distinct.repartitionByRange(F.substring("signature", 1, HEAD)).sortWithinPartitions("signature").mapInArrow(run, schema)


class Repaired:
    """One conversation's repaired turns, as its rows come by in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.user_next = audit, 0, True

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.rerole(), ""

    def rerole(self) -> str:
        self.user_next = not self.user_next
        return "assistant" if self.user_next else "user"

    def take(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.user_next = role[:1] != "u"
            yield role, text
        elif letter == "R":
            yield self.rerole(), text


def rewritten(turns: DataFrame, plans: DataFrame, digest: bool) -> DataFrame:
    """The plans with the digest of their conversation's repaired turns, or those turns themselves.

    A plan comes before its conversation's rows, and rows pass one by one, so a task holds an audit and no conversation.
    """
    n = len(plans.columns)
    lone = [F.lit(None).cast(f.dataType).alias(f.name) for f in plans.schema.fields[1:]]
    texts = turns.where("copies > 0").select("conv", F.lit(1).alias("_kind"), "turn", "role", *places(turns), "text", "copies", *lone)
    heads = plans.select("conv", F.lit(0).alias("_kind"), *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in (*ORDER, "text", "copies")], *plans.columns[1:])
    stream = heads.union(texts).repartition("conv").sortWithinPartitions("conv", "_kind", *ORDER).select("_kind", "role", "text", "copies", *plans.columns)
    if digest:
        schema = T.StructType([*plans.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    else:
        schema = T.StructType([plans.schema["conv"], T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        plan = own = None

        def ended(found) -> Iterator[tuple]:
            for role, text in found:
                yield from said(role, text)

        def said(role: str, text: str) -> Iterator[tuple]:
            nonlocal position
            if digest:
                hashed.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            else:
                yield plan[0], position, role, text
            position += 1

        for batch in batches:
            kinds, roles, texts, copies = (batch.column(k).to_pylist() for k in range(4))
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if own:
                        yield from ended(own.inserted())
                        if digest:
                            yield *plan, hashed.hexdigest()
                    plan = tuple(batch.column(4 + k)[i].as_py() for k in range(n))
                    own, position, hashed = Repaired(plan[-1]), 0, hashlib.sha256()
                else:
                    for _ in range(copies[i]):
                        yield from ended(own.take(roles[i], texts[i]))
        if own:
            yield from ended(own.inserted())
            if digest:
                yield *plan, hashed.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, size = to_arrow_schema(schema), [], 0
        for row in rows_of(batches):
            held.append(row)
            size += len(row[-1]) + 64
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return stream.mapInArrow(run, schema)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turn, role, text, copies): each row damaged by the CRC-32 of "conv:turn" modulo 20; copies 0 drops a row.

    0 drops it, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes it the user's. Nulls: one space.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space(conv_col), F.lit(":"), or_space(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space("text"), f"[{ENDS}]", "")).otherwise(or_space("text"))
    role = F.when(kind == 4, "user").otherwise(or_space("role"))
    return turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def repair_conversations(turns: DataFrame, output: str = "summary") -> DataFrame:
    """Conversations edited at least cost to an optional system turn and then user and assistant in turn, or to nothing.

    turns has conv, turn, role, text and copies (how often the row stands there; 0 only names its conversation), as from
    ``damage``. output "summary": conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, one row per
    conversation; "turns": conv, position, role, text of the repaired turns.

    A row's first fault counts: blank, duplicate (role and text stood earlier), truncated (no sentence end). Keep costs 0,
    Rerole 1, Delete 2, Insert 5, a truncated row that stays 5; blank and duplicate rows go. Of the cheapest edits the ASCII
    least letters win, and they say all: where a role is changed or put in, it is the one that may follow.

    Only role initials and faults decide, so conversations become signatures, each distinct one is solved once, and the
    letters go back to the rows. Rows of one turn stand by role, the first 64 characters and the digest of role and text;
    null turns come first; equal rows are each other's duplicates. Null roles and texts count as one space, a null conv is a
    conversation of its own, one without rows has zeros, an empty audit and the digest of ''. An empty table gives an empty
    result; other columns are not read.

    A conversation with very many rows is numbered, marked and counted in ranges of rows; as one SHA-256 is one stream of
    bytes, its repaired text passes through a single task, row by row, holding its audit alone.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    turns = turns.select("conv", "turn", blank("role"), blank("text"), F.col("copies").cast("int").alias("copies"))
    whole = cut(signatures(turns), "signatures")
    found = join_small(whole, cut(answers(whole), "answers"), {"signature": "_signature"}, "left")
    return rewritten(turns, found.select("conv", "gaps", *COUNTS, "audit"), output == "summary")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")
