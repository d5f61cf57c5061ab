"""Repair of the turn structure of conversations by a Viterbi search with survivor coalescence.

A conversation is repaired to `(s?(ua)+)?` in the initials of its roles by keeping, re-labelling, deleting and
inserting turns at the least cost. The search reads the turns in order. Each state's best way so far, its
survivor, is a leaf of a tree of backpointers whose nodes count what refers to them; what no survivor reaches
is freed, and when all survivors come from one node, the edits up to it are emitted and forgotten. Of two
ways of equal cost the whole suffixes below their last common node decide, ASCII-least first. So memory holds
the unresolved suffix, not the conversation: a conversation of any length is a stream, sorted by Spark.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.llm.common import column, utf8

#: Costs of the edits, and of leaving a truncated turn in.
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
#: From which states a turn of this state may follow.
BEFORE = {SYSTEM: (EMPTY,), USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
STATE = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}
LEGAL = {b"su", b"ua", b"au"}
SPACES = " \t\n\x0b\x0c\r"
#: Rows of an output batch, and bytes of their texts.
ROWS, BYTES = 4096, 8 << 20


class Step:
    """A node of the backpointer tree: one edit after those of its parents. `refs` counts the steps and
    survivors that refer to it."""

    __slots__ = ("parent", "edit", "turn", "role", "cost", "total", "depth", "refs")

    def __init__(self, parent: Step | None, edit: str, turn, role: bytes | None, cost: int):
        self.parent, self.edit, self.turn, self.role, self.cost = parent, edit, turn, role, cost
        self.total = parent.total + cost if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.refs = 0

    def beats(self, other: Step | None) -> bool:
        """Lower cost, or the ASCII-least edits from the last common step on."""
        if other is None or self.total != other.total:
            return other is None or self.total < other.total
        a, b, mine, theirs = self, other, "", ""
        while a is not b:
            deeper = a.depth - b.depth
            if deeper >= 0:
                mine, a = a.edit, a.parent
            if deeper <= 0:
                theirs, b = b.edit, b.parent
        return mine < theirs

    def hold(self) -> None:
        step = self
        while step:
            step.refs += 1
            step = step.parent if step.refs == 1 else None

    def let_go(self) -> None:
        step = self
        while step:
            step.refs -= 1
            step = None if step.refs else step.parent


class Search:
    """The search over one conversation. `add` and `end` give the edits that are settled by then, in order."""

    def __init__(self):
        self.root = Step(None, "", None, None, 0)
        self.survivors: dict[int, Step] = {}
        self._survive({EMPTY: self.root})

    def add(self, turn, initial: bytes, must_go: bool, truncated: bool) -> list[Step]:
        best: dict[int, Step] = {}

        def offer(state: int, step: Step) -> None:
            if step.beats(best.get(state)):
                best[state] = step

        late = TRUNCATED if truncated else 0
        kept = STATE.get(initial)
        for state, step in self.survivors.items():
            offer(state, Step(step, "D", turn, None, DELETE))
            if must_go:
                continue
            if kept is not None and state in BEFORE[kept]:
                offer(kept, Step(step, "K", turn, None, late))
            to = ASSISTANT if state == USER else USER
            offer(to, Step(step, "R", turn, ROLES[to], RELABEL + late))
        self._survive(best)
        return self._settled()

    def end(self) -> list[Step]:
        last = None
        for state in (EMPTY, ASSISTANT):
            step = self.survivors.get(state)
            if step and step.beats(last):
                last = step
        return self._path(last)

    def _survive(self, best: dict[int, Step]) -> None:
        """Lets turns be inserted behind the best ways, leaves out those that cannot win."""

        def insert(state: int, origin: int) -> bool:
            if origin in best:
                step = Step(best[origin], "I", None, ROLES[state], INSERT)
                if step.beats(best.get(state)):
                    best[state] = step
                    return True
            return False

        insert(USER, EMPTY)
        insert(USER, SYSTEM)
        if not insert(ASSISTANT, USER):  # no use in asking again after a reply that was inserted
            insert(USER, ASSISTANT)
        # Whatever can follow no turns or a system turn can follow a reply, if the one system turn that may
        # come yet is deleted.
        most = {EMPTY: best[ASSISTANT].total + DELETE, SYSTEM: best[ASSISTANT].total}
        best = {state: step for state, step in best.items() if step.total <= most.get(state, step.total)}
        for step in best.values():
            step.hold()
        for step in self.survivors.values():
            step.let_go()
        self.survivors = best

    def _path(self, step: Step) -> list[Step]:
        """The steps below the root down to `step`."""
        steps = []
        while step is not self.root:
            steps.append(step)
            step = step.parent
        return steps[::-1]

    def _settled(self) -> list[Step]:
        """Moves the root down while only one step refers to it."""
        leaves = list(self.survivors.values())
        if self.root.refs > 1 or self.root in leaves:
            return []
        settled = []
        for step in self._path(leaves[0]):
            settled.append(step)
            if step.refs > 1 or step in leaves:
                break
        self.root = settled[-1]
        self.root.parent = None
        return settled


EDITS = "seq long, edit string, turn {turn}, old_role string, role string, text string, fault string, cost int"


def repair(turns: DataFrame) -> DataFrame:
    """The edits of each conversation: (conv_id, seq, edit, turn, old_role, role, text, fault, cost).

    `turns` has conv_id, turn, role and text; a null role or text is one space, null ids are a conversation,
    other columns are not read. Turns are taken by `turn`, nulls first, equal ones by role and text; of equal
    rows all but the first are duplicates. Edits are K(eep), R(elabel), D(elete) and I(nsert), in order; `role`
    and `text` are those after the repair, null for a deleted turn. `fault` is the first of blank, duplicate
    and truncated that a turn has. Rows come in order of `seq` within a conversation, none for no turns.

    A conversation is read by one task, since its edits depend on all before them, but only as a sorted
    stream of which the unresolved suffix is held.
    """
    turns = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    # The exchange by conversation serves both sorts.
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    ordered = (
        turns.repartition("conv_id")
        .withColumn("nth", F.row_number().over(seen))
        .select(
            "conv_id",
            "turn",
            "role",
            "text",
            "nth",
            F.when(last == "", F.lit("blank"))
            .when(F.col("nth") > 1, F.lit("duplicate"))
            .when(~last.isin(".", "!", "?"), F.lit("truncated"))
            .alias("fault"),
        )
        .sortWithinPartitions("conv_id", "turn", "role", "text", "nth")
        .drop("nth")
    )
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    names = ["conv_id", "seq", "edit", "turn", "old_role", "role", "text", "fault", "cost"]

    def run(batches):
        rows: list[tuple] = []
        size = 0
        key, search, seq, types = None, None, 0, None

        def emit(steps: list[Step]) -> None:
            nonlocal seq, size
            for step in steps:
                if step.turn:
                    turn, role, text, fault = step.turn
                    size += len(text)
                    if step.edit == "D":
                        rows.append((key, seq, "D", turn, role, None, None, fault, step.cost))
                    else:
                        rows.append((key, seq, step.edit, turn, role, step.role or role, text, fault, step.cost))
                else:
                    rows.append((key, seq, "I", None, None, step.role, b"", None, step.cost))
                seq += 1

        def flush():
            nonlocal size
            columns = list(zip(*rows, strict=True))
            rows.clear()
            size = 0
            text = pa.binary()
            kinds = [types[0], pa.int64(), pa.string(), types[1], text, text, text, pa.string(), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            arrays = [a.cast(pa.string()) if a.type == text else a for a in arrays]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            types = batch.column("conv_id").type, batch.column("turn").type
            columns = column(batch, "conv_id"), column(batch, "turn"), utf8(batch, "role"), utf8(batch, "text")
            for conv_id, turn, role, text, fault in zip(*columns, column(batch, "fault"), strict=True):
                if search is None or conv_id != key:
                    if search:
                        emit(search.end())
                    key, search, seq = conv_id, Search(), 0
                emit(search.add((turn, role, text, fault), role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
                if len(rows) >= ROWS or size >= BYTES:
                    yield flush()
        if search:
            emit(search.end())
        if rows:
            yield flush()

    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, {EDITS.format(turn=kinds['turn'])}")


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def summaries(edits: DataFrame) -> DataFrame:
    """One row for each conversation of `repair`'s result, which must come as it is: it is folded in its order.

    gaps: numbers missing between the least and the greatest turn; blank, duplicate, truncated: turns with
    that fault; illegal: neighbours before the repair whose roles cannot follow each other; cost; audit: the
    edits; repaired_sha256: of the repaired `role:text`, joined by line feeds. Texts are not collected.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edits.schema}

    def run(batches):
        rows: list[tuple] = []
        state: dict = {}
        kind = None

        def close() -> None:
            turns = state["turns"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            faults = [state[k] for k in ("blank", "duplicate", "truncated")]
            rest = [state["illegal"], state["cost"], "".join(state["audit"]), state["hash"].hexdigest()]
            rows.append((state["key"], gaps, *faults, *rest))

        def flush():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *SUMMARY])

        for batch in batches:
            kind = batch.column("conv_id").type
            columns = [column(batch, c) for c in ("conv_id", "seq", "edit", "turn", "fault", "cost")]
            for key, seq, edit, turn, fault, cost, old, role, text in zip(
                *columns, utf8(batch, "old_role"), utf8(batch, "role"), utf8(batch, "text"), strict=True
            ):
                if not seq:
                    if state:
                        close()
                    state = {"key": key, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
                    state |= {"turns": None, "audit": [], "hash": hashlib.sha256(), "initial": None, "kept": False}
                state["audit"].append(edit)
                state["cost"] += cost
                if edit != "I":
                    if fault:
                        state[fault] += 1
                    if state["initial"] is not None:
                        state["illegal"] += state["initial"] + old[:1] not in LEGAL
                    state["initial"] = old[:1]
                    if turn is not None:
                        least, most, n = state["turns"] or (turn, turn - 1, 0)
                        state["turns"] = least, turn, n + (turn != most)
                if edit != "D":
                    state["hash"].update(b"\n" * state["kept"] + role + b":" + text)
                    state["kept"] = True
            if len(rows) >= ROWS:
                yield flush()
        if state:
            close()
        if rows:
            yield flush()

    schema = ", ".join(f"{name} long" for name in SUMMARY[:6])
    return edits.mapInArrow(run, f"conv_id {kinds['conv_id']}, {schema}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a share of their turns dropped, emptied, cut short, repeated or given a wrong role,
    as the checksum of `conv_id:turn` has it. Nulls are one space, but a null turn stays null."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    turns = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        kind.alias("damage"),
    ).where("damage <> 0")
    return turns.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop(
        "damage", "copy"
    )


def audit(conversations: DataFrame) -> DataFrame:
    """Damages `conversations`, repairs them, and gives a row for each id, also where no turn is left."""
    found = summaries(repair(damaged(conversations)))
    ids = conversations.select("conv_id").distinct()
    found = found.withColumnRenamed("conv_id", "found_id")
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["found_id"]), "left").drop("found_id")

    def filled(name: str) -> Column:
        empty = F.lit(0).cast("long")
        if name == "audit":
            empty = F.lit("")
        elif name == "repaired_sha256":
            empty = F.lit(hashlib.sha256(b"").hexdigest())
        return F.coalesce(F.col(name), empty).alias(name)

    return joined.select("conv_id", *map(filled, SUMMARY))
