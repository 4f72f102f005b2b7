"""Repair of conversation structure by signature.

A conversation's rows in order of their turns become a string of one character a row: the role's class, in upper case where the
text is truncated, or `d` where the row must go. Many conversations share a signature, so each distinct one is solved once, by
recursion over (row, state) that remembers its results; the edits are joined back and replayed over the rows.

Texts are shuffled once, for the replay. Rows stream through it in order, so a conversation's memory is one byte a row (its signature
and its edits) however long it is; but it is hashed or rebuilt in order, which is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintra.llm.common import Scratch

BLANK = r"^[\x20\x09-\x0D]*$"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"
#: Role that rerole and insert give in each state: at the start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row leads, by state and initial.
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


def solve(signature: str, block: int = 100) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that make the roles of a signature alternate; of equal ones the ASCII-least audit.

    The recursion goes by blocks from the end, so that its depth stays small and only the choices of earlier blocks are kept.
    """
    costs: dict[tuple[int, int], int] = {}
    edits = bytearray(4 * (len(signature) + 1))
    never = 1 << 60

    def consuming(at: int, state: int) -> tuple[int, str]:
        """The cheapest edit that deals with row `at` itself, or the end."""
        if at == len(signature):
            return (0 if state in (START, ASSISTANT) else never), "."
        kind = signature[at]
        options = [(DELETE + best(at + 1, state), "D")]
        if kind != "d":
            extra = TRUNCATED * kind.isupper()
            if (state, kind.lower()) in KEEPS:
                options.append((extra + best(at + 1, KEEPS[state, kind.lower()]), "K"))
            options.append((extra + REROLE + best(at + 1, NEXT_ROLE[state]), "R"))
        return min(options)

    def best(at: int, state: int) -> int:
        """With up to two rows put in before row `at`: more lead back to a state that was there already."""
        if (at, state) not in costs:
            once = NEXT_ROLE[state]
            options = [consuming(at, state), (INSERT + consuming(at, once)[0], "I"), (2 * INSERT + consuming(at, NEXT_ROLE[once])[0], "I")]
            costs[at, state], edit = min(options)
            edits[4 * at + state] = ord(edit)
        return costs[at, state]

    for at in range(len(signature), -1, -block):
        for state in range(4):
            best(at, state)
        for done in [x for x in costs if x[0] > at]:
            del costs[done]
    total, audit, at, state = best(0, START), bytearray(), 0, START
    while (edit := edits[4 * at + state]) != ord("."):
        audit.append(edit)
        state = after(state, chr(edit), signature[at].lower() if at < len(signature) else "")
        at += edit != ord("I")
    return total, audit.decode()


def after(state: int, edit: str, initial: str) -> int:
    """The state that an edit of a row with this initial leads to."""
    return state if edit == "D" else KEEPS[state, initial] if edit == "K" else NEXT_ROLE[state]


def prepared(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are one space. digest stands for the text in comparisons."""
    text = F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def in_order(*first: str) -> list:
    """A conversation's rows by turn, nulls first; those of one turn by role and digest."""
    return ["conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest"]


COUNTS = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal")


def signatures(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, class, fault) in order -> one row a conversation: its signature and counts."""
    nothing = object()
    conv, codes, faults, illegal, distinct, first, last, previous = nothing, [], {}, 0, 0, None, None, ""

    def row() -> tuple:
        gaps = 0 if first is None else min(last - first + 1 - distinct, (1 << 63) - 1)
        return conv, "".join(codes), sum(map(len, codes)), gaps, faults.get("b", 0), faults.get("d", 0), faults.get("t", 0), illegal

    for batch in batches:
        out = []
        for c, turn, role, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv or conv is nothing:
                if conv is not nothing:
                    out.append(row())
                conv, codes, faults, illegal, distinct, first, last, previous = c, [], {}, 0, 0, None, None, ""
            codes.append("d" if fault in ("b", "d") else role.upper() if fault else role)
            if len(codes) >= 10_000:  # a long conversation's characters are kept as one string
                codes = ["".join(codes)]
            faults[fault] = faults.get(fault, 0) + 1
            illegal += bool(previous) and previous + role not in ("su", "ua", "au")
            previous = role
            if turn is not None:
                distinct += turn != last
                first, last = turn if first is None else first, turn
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
    if conv is not nothing:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row(), strict=True))], schema=schema)


def arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.column(0).to_pylist()
        cost, audit = zip(*map(solve, given), strict=True) if given else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(given, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])


def audits(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> for each conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit.

    A row's first fault counts: blank, duplicate (an earlier row has this role and text) or truncated (the last character that is no
    white space isn't one of `.!?`). gaps: turns missing between the least and the greatest. illegal: neighbours whose roles' initials
    aren't su, ua or au. audit: the initials of the edits (Keep, Rerole, Delete, Insert) in order.

    Rows stand by turn, nulls first; rows of one turn by role and the text's digest, equal rows are copies. Null roles and texts are
    one space. Any role with the initial s, u or a counts as that one; others must be given a new role or go. Rows with a null conv_id are one
    conversation. Very long texts cost a hash. Other columns are ignored, whatever their names. No rows: no rows.
    """
    scratch = Scratch(turns.sparkSession)
    initial = F.substring("role", 1, 1)
    rows = prepared(turns).select(
        "conv_id", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("class"), F.when(F.col("text").rlike(BLANK), "b").when(F.col("text").rlike(CUT_OFF), "t").otherwise("").alias("fault")
    )
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.repartition("conv_id").withColumn("fault", F.when((F.col("fault") != "b") & (nth > 1), "d").otherwise(F.col("fault")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, signature string, " + ", ".join(f"{c} long" for c in COUNTS)
    at = arrow(shape)
    convs = scratch.save(rows.sortWithinPartitions(*in_order()).select("conv_id", "turn", "class", "fault").mapInArrow(lambda b: signatures(b, at), shape), "signatures")
    known = scratch.save(convs.select("signature").distinct().mapInArrow(solved, "signature string, cost long, audit string"), "solved")
    return convs.join(known, "signature").select("conv_id", *COUNTS, "cost", "audit")


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each conversation's audit, then its rows (conv_id, role, text, audit) in order -> (conv_id, role, text, edit) as repaired.

    A conversation begins with (conv_id, None, None, None).
    """
    conv, audit, at, state = None, "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT_ROLE[state]
            yield conv, ROLE_NAMES[state], "", "I"

    for batch in batches:
        for c, role, text, edits in zip(*(batch.column(k) for k in range(4)), strict=True):
            if edits.is_valid:
                yield from inserted()
                conv, audit, at, state = c.as_py(), edits.as_py(), 0, START
                yield conv, None, None, None
                continue
            yield from inserted()
            edit, role, at = audit[at], role.as_py(), at + 1
            state = after(state, edit, role[:1])
            if edit != "D":
                yield conv, role if edit == "K" else ROLE_NAMES[state], text.as_py(), edit
    yield from inserted()


def with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The input of replayed(): rows clustered by conversation, its audit first. Texts are shuffled here and nowhere else."""
    none = F.lit(None)
    heads = found.select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("binary").alias("digest"), "audit")
    rows = prepared(turns).withColumn("audit", none.cast("string"))
    return heads.unionByName(rows).withColumn("is_row", F.col("audit").isNull()).repartition("conv_id").sortWithinPartitions(*in_order("is_row")).select("conv_id", "role", "text", "audit")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K, R or I), as `found` (audits() of the same turns) says."""
    kind = found.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, position long, role string, text string, edit string"
    schema = arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, position = [], 0, 0
        for conv, role, text, edit in replayed(batches):
            if edit is None:
                position = 0
                continue
            out.append((conv, position, role, text, edit))
            position, size = position + 1, size + len(text) + 50
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return with_audits(turns, found).mapInArrow(run, shape)


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 over the repaired rows as `role:text`, joined by newlines, hashed as they stream by."""
    shape = f"conv_id {found.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    schema = arrow(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, now, between = [], [], hashlib.sha256(), b""
        for conv, role, text, edit in replayed(batches):
            if edit is None:
                if ids:
                    digests.append(now.hexdigest())
                if len(ids) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(digests, pa.string())], schema=schema)
                    ids, digests = [], []
                ids.append(conv)
                now, between = hashlib.sha256(), b""
                continue
            now.update(between + f"{role}:{text}".encode())
            between = b"\n"
        if ids:
            digests.append(now.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(digests, pa.string())], schema=schema)

    return with_audits(turns, found).mapInArrow(run, shape)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults drawn by crc32 of `conv_id:turn`: of twenty, 0 drops a row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes its role user. Nulls are one space there, and roles and texts after."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("nth")).drop("nth")
