"""Repair of conversations whose turns are damaged, by iterative-deepening A*.

Every row is kept, given another role or deleted, and empty turns are inserted, so that the roles read ``(s?(ua)+)?`` at the least cost.  The search
goes depth first in the edits' ASCII order (Delete, Insert, Keep, Rerole) under a cost bound; the bound rises to the
least cost that was cut off.  What failed is remembered by row and state of the roles as a raised lower bound, over all bounds.  So the first
path that is accepted is the cheapest one, and of equals the ASCII-least.

Conversations may be of any length.  Rows go by ranges of (conversation, turn, role, digest of the text), so that a long one lies in many tasks; a task
cuts its rows into blocks of ``BLOCK`` and searches each between all states.  Blocks are joined by two passes over their costs, one row
a block.  Only then do the texts move, once.

Rows have conv_id, turn, role and text; a null role or text is one blank.  Turns go in order, nulls first, and in a turn by role and by digest of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import small_batches
from causeway.plans.durable import written

#: Rows of a block; within one the search grows with the square.
BLOCK = 64
#: Costs of edits (fixed values).
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
BLANKS = " \t\n\x0b\x0c\r"
#: States of the roles: 0 nothing yet, 1 after the system, 2 after the user, 3 after the assistant.  A state's next speaker, and where each initial leads.
STATES = 4
NEXT = ("user", "user", "assistant", "user")
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Inserts that close the roles in each state.
CLOSING = (0, 2, 1, 0)
NEVER = 1 << 60


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with damage by crc32 of ``<conv_id>:<turn>`` modulo 20, nulls being one blank.

    0 drops the row, 1 empties the text, 2 removes its sentence ends, 3 repeats the row, 4 sets the role to user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    role = F.when(case == 4, "user").otherwise(said("role"))
    text = F.when(case == 1, "").when(case == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(case == 3, 2).otherwise(1)))
    return rows.where(case != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_times")).drop("_times")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, copies, blank, duplicate, truncated)``: distinct rows, how often each occurs, and the first fault of its first copy.

    All further copies are blank or duplicates.  Equality of texts is that of SHA-256.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    own = _filled(rows).select("conv_id", "turn", "role", _digest(), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    distinct = written(own.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("copies")), "turns")
    said = distinct.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    said = said.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.col("first.turn").alias("_turn"), F.lit(True).alias("_again"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    later = F.coalesce("_again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_turn")) & ~F.col("blank")
    found = distinct.join(said, same, "left").withColumn("duplicate", later)
    return found.select("conv_id", "turn", "role", "digest", "copies", "blank", "duplicate", (F.col("truncated") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated"))


class Search:
    """Cheapest edits of rows (initial, must go, truncated, copies) from a state of the roles to an end; ``end`` has a cost and edits by final state."""

    def __init__(self, rows: list[tuple[str, bool, bool, int]], end: dict[int, tuple[int, str]]):
        self.rows, self.end = rows, end
        ahead, self.least = 0, [NEVER] * (STATES * (len(rows) + 1))
        for q, (cost, _) in end.items():
            self.least[STATES * len(rows) + q] = cost
        can = set(end)
        for i in range(len(rows) - 1, -1, -1):
            initial, gone, truncated, copies = rows[i]
            own = DELETE if gone else min(DELETE, TRUNCATED * truncated + (0 if initial in ("s", "u", "a") else REROLE))
            ahead += own + DELETE * (copies - 1)
            # States from which the end cannot be reached stay at NEVER, else their bound would rise for ever.
            can = self._reaching(can, initial, gone)
            for q in can:
                self.least[STATES * i + q] = ahead

    @staticmethod
    def _reaching(can: set[int], initial: str, gone: bool) -> set[int]:
        """States before a row from which one of the states after it can be reached."""
        spoken = [LEADS[q][NEXT[q][0]] for q in range(STATES)]
        found = {q for q in range(STATES) if q in can or (not gone and (spoken[q] in can or LEADS[q].get(initial) in can))}
        for _ in range(STATES):
            found |= {q for q in range(STATES) if spoken[q] in found}
        return found

    def moves(self, i: int, q: int) -> Iterator[tuple[str, int, int]]:
        """``(edits, cost, next node)`` in ASCII order; a row's further copies go with it."""
        initial, gone, truncated, copies = self.rows[i]
        here, on, more, rest = STATES * i, STATES * (i + 1), "D" * (copies - 1), DELETE * (copies - 1)
        spoken = LEADS[q][NEXT[q][0]]
        yield "D" + more, DELETE + rest, on + q
        yield "I", INSERT, here + spoken
        if not gone:
            kept = LEADS[q].get(initial)
            if kept is not None:
                yield "K" + more, TRUNCATED * truncated + rest, on + kept
            yield "R" + more, REROLE + TRUNCATED * truncated + rest, on + spoken

    def _within(self, node: int, left: int, path: list[str]) -> bool:
        """Whether the end can be reached for ``left``; if so the edits are in ``path``, if not ``least`` of the node exceeds ``left``."""
        i, q = divmod(node, STATES)
        if i == len(self.rows):
            path.append(self.end[q][1])
            return True
        raised = NEVER
        for edits, cost, onward in self.moves(i, q):
            if self.least[onward] <= left - cost:
                path.append(edits)
                if self._within(onward, left - cost, path):
                    return True
                path.pop()
            raised = min(raised, cost + self.least[onward])
        self.least[node] = raised
        return False

    def cheapest(self, start: int) -> tuple[int, str] | None:
        """``(cost, edits)``, or None where the end cannot be reached."""
        while (bound := self.least[start]) < NEVER:
            path: list[str] = []
            if self._within(start, bound, path):
                return bound, "".join(path)
        return None


def repaired_whole(rows: list[tuple[str, bool, bool, int]], start: int = 0) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    return Search(rows, {q: (INSERT * n, "I" * n) for q, n in enumerate(CLOSING)}).cheapest(start)


def between_states(rows: list[tuple[str, bool, bool, int]]) -> list[tuple[int, str] | None]:
    """Cost and edits from each state (slow index) to each state; a block ends with its last row, what is inserted after it is the next one's."""
    searches = []
    for m in range(STATES):
        reach = {m: (0, "")}
        searches.append(Search(rows, reach))
    return [searches[m].cheapest(q) for q in range(STATES) for m in range(STATES)]


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _through(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[dict]], size: int = 500) -> DataFrame:
    """``df``'s partitions as streams of rows through ``work``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(work(row for batch in batches for row in batch.to_pylist()), arrow, size)

    return df.mapInArrow(run, schema)


def _block_schema(kind: str) -> str:
    return (
        f"conv_id {kind}, part int, seq bigint, turns array<bigint>, roles array<string>, digests array<binary>, copies array<bigint>, "
        "blank bigint, duplicate bigint, truncated bigint, illegal bigint, whole boolean, costs array<bigint>, edits array<string>"
    )


def _illegal(before: str | None, after: str) -> int:
    return int(before is not None and before + after not in ("su", "ua", "au"))


def _blocks(rows: Iterator[dict]) -> Iterator[dict]:
    """Sorted rows cut into blocks of one conversation.  Only a conversation between two others of the same partition is surely whole."""
    part, seq, held, opened = TaskContext.get().partitionId(), 0, [], False

    def block(held: list[dict], whole: bool) -> dict:
        short = [(r["role"][:1], r["blank"] or r["duplicate"], r["truncated"], r["copies"]) for r in held]
        illegal = sum(_illegal(a[0], b[0]) for a, b in zip(short, short[1:])) + sum(r["copies"] - 1 for r in held)
        found = [repaired_whole(short)] if whole else between_states(short)
        return {
            "conv_id": held[0]["conv_id"], "part": part, "seq": seq, "turns": [r["turn"] for r in held], "roles": [r["role"] for r in held], "digests": [r["digest"] for r in held],
            "copies": [r["copies"] for r in held], "blank": sum(r["copies"] for r in held if r["blank"]),
            "duplicate": sum(r["copies"] - (not r["duplicate"]) for r in held if not r["blank"]), "truncated": sum(r["truncated"] for r in held), "illegal": illegal,
            "whole": whole, "costs": [f and f[0] for f in found], "edits": [f and f[1] for f in found],
        }

    inside = False  # the held rows start a conversation that no earlier partition has
    for row in rows:
        if held and row["conv_id"] != held[0]["conv_id"]:
            yield block(held, inside and not opened)
            held, opened, inside, seq = [], False, True, seq + 1
        elif len(held) == BLOCK:
            yield block(held, False)
            held, opened, seq = [], True, seq + 1
        held.append(row)
    if held:
        yield block(held, False)


def _backward(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks from a conversation's last to its first: from each state the end state of the block that is best for all that follows."""
    conv, ahead, some = None, [], False
    for row in rows:
        last = not some or row["conv_id"] != conv
        conv, some = row["conv_id"], True
        if last:
            ahead = [INSERT * n for n in CLOSING]
        choice, cost = [], []
        for q in range(STATES):
            ways = [(row["costs"][STATES * q + m] + ahead[m], row["edits"][STATES * q + m], m) for m in range(STATES) if row["costs"][STATES * q + m] is not None and ahead[m] < NEVER]
            best = min(ways, default=(NEVER, "", 0))
            choice.append(best[2])
            cost.append(best[0])
        ahead = cost
        yield row | {"choice": choice, "last": last}


def _forward(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks from first to last: the edits on the chosen way, and illegal pairs between blocks."""
    conv, q, before, some = None, 0, None, False
    for row in rows:
        if not some or row["conv_id"] != conv:
            conv, q, before, some = row["conv_id"], 0, None, True
        m = row["choice"][q]
        closing = CLOSING[m] if row["last"] else 0
        illegal = row["illegal"] + _illegal(before, row["roles"][0][:1])
        yield row | {"start": q, "edit": row["edits"][STATES * q + m] + "I" * closing, "cost": row["costs"][STATES * q + m] + INSERT * closing, "illegal": illegal}
        q, before = m, row["roles"][-1][:1]


def _conversation_order(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.sortWithinPartitions("conv_id", *columns)


def plan(found: DataFrame) -> DataFrame:
    """Blocks of the conversations of :func:`faults` with their edits: conv_id, part, seq, the rows' keys, counts of faults, ``start`` (state), ``edit``, ``cost``."""
    kind = found.schema["conv_id"].dataType.simpleString()
    ranged = found.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    blocks = written(_through(ranged, _block_schema(kind), _blocks), "blocks")
    kept = ["conv_id", "part", "seq", "turns", "roles", "digests", "copies", "blank", "duplicate", "truncated", "illegal"]
    whole = blocks.where("whole").select(*kept, F.lit(0).alias("start"), F.col("edits")[0].alias("edit"), F.col("costs")[0].alias("cost"))
    cut = _conversation_order(blocks.where("not whole").drop("whole").repartition("conv_id"), F.desc("part"), F.desc("seq"))
    chosen = _through(cut, _block_schema(kind).replace("whole boolean, ", "") + ", choice array<int>, last boolean", _backward)
    joined = _through(_conversation_order(chosen, "part", "seq"), _block_schema(kind).split(", whole")[0] + ", start int, edit string, cost bigint", _forward)
    return written(whole.unionByName(joined.select(*whole.columns)), "plan")


def _row_edits(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks to one row a distinct row: what is inserted before it (initials), its own edit, and what is inserted after a conversation's last."""
    for block in rows:
        q, at, edits, out = block["start"], 0, block["edit"], None
        for turn, role, digest, copies in zip(block["turns"], block["roles"], block["digests"], block["copies"], strict=True):
            before = ""
            while edits[at] == "I":
                before += NEXT[q][0]
                q, at = LEADS[q][NEXT[q][0]], at + 1
            own = edits[at]
            at += copies
            becomes = {"K": role, "R": NEXT[q]}.get(own)
            if becomes:
                q = LEADS[q][becomes[0]]
            if out:
                yield out
            out = {"conv_id": block["conv_id"], "turn": turn, "role": role, "digest": digest, "edit": own, "before": before, "becomes": becomes, "after": ""}
        while at < len(edits):
            out["after"] += NEXT[q][0]
            q, at = LEADS[q][NEXT[q][0]], at + 1
        yield out


def _applied(rows: Iterator[dict]) -> Iterator[dict]:
    """Each distinct row's edit, followed by the row's copies with their text, to numbered edits."""
    conv, place, edit, some, after = None, 0, None, False, ""

    def made(letter: str, role: str, text: str) -> dict:
        nonlocal place
        place += 1
        return {"conv_id": conv, "place": place, "edit": letter, "role": role, "text": text}

    def inserted(initials: str) -> Iterator[dict]:
        for c in initials:
            yield made("I", {"u": "user", "a": "assistant"}[c], "")

    for row in rows:
        if row["text"] is None:
            yield from inserted(after)
            if not some or row["conv_id"] != conv:
                conv, place, some = row["conv_id"], 0, True
            edit, after = row, row["after"]
            yield from inserted(row["before"])
        else:
            yield made(edit["edit"], edit["becomes"] or row["role"], row["text"])
            edit = edit | {"edit": "D", "becomes": None}
    yield from inserted(after)


def edits(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the edits of every conversation in order, D rows with what they had, the others with what they become.

    Rows of a conversation lie in one partition, in order; the task reads them as a stream.  No rows give none; other columns are left out.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    planned = plan(faults(rows)) if planned is None else planned
    steps = _through(planned, f"conv_id {kind}, turn bigint, role string, digest binary, edit string, before string, becomes string, after string", _row_edits)
    texts = _filled(rows).select("conv_id", "turn", "role", _digest(), "text")
    both = steps.withColumn("text", F.lit(None).cast("string")).unionByName(texts, allowMissingColumns=True)
    ordered = _conversation_order(both.repartition("conv_id"), "turn", "role", "digest", F.col("text").isNotNull())
    return _through(ordered, f"conv_id {kind}, place bigint, edit string, role string, text string", _applied)


def _audited(rows: Iterator[dict]) -> Iterator[dict]:
    conv, some, audit, digest, first = None, False, [], hashlib.sha256(), True
    for row in rows:
        if some and row["conv_id"] != conv:
            yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            audit, digest, first = [], hashlib.sha256(), True
        conv, some = row["conv_id"], True
        audit.append(row["edit"])
        if row["edit"] != "D":
            digest.update(("" if first else "\n").encode() + f"{row['role']}:{row['text']}".encode())
            first = False
    if some:
        yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def audit(originals: DataFrame, rows: DataFrame) -> DataFrame:
    """The contract's columns for every conv_id of ``originals``, whose rows are now ``rows`` (damaged, or none at all)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    planned = plan(faults(rows))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    turns = planned.select("conv_id", F.explode("turns").alias("turn")).where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("_one"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    digests = _through(edits(rows, planned), f"conv_id {kind}, audit string, repaired_sha256 string", _audited)
    parts = originals.select("conv_id").distinct()
    for part in (planned.select("conv_id", *counts), gaps, digests):
        parts = parts.unionByName(part, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    none = hashlib.sha256(b"").hexdigest()
    return parts.groupBy("conv_id").agg(
        *[zero(c) for c in ("gaps", *counts)], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(none)).alias("repaired_sha256")
    )
