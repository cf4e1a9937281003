"""Conversation repair by Hirschberg's divide and conquer.

A repaired conversation has the role initials `(s?(ua)+)?`, an automaton of four states: nothing yet,
after the system turn, after a user turn, after an assistant turn. Keeping, renaming, deleting a row
and inserting one have costs; the audit is the list of the cheapest edits, least in
ASCII among equals.

A stretch of rows is cut in its middle. A forward vector (a cost for each state) comes from its first row, a
backward one from its last; the state that both reach at the least sum is where the
best edits cross, and both halves are solved between known states. Costs alone leave ties. So a forward vector also
ranks its states by their least audits: these differ before one ends, since each
ends with the edit of the same row, and so their order never depends on what comes after.
Only vectors are kept, never a table of rows by states.

Conversations of any length are cut in chunks of `CHUNK` rows. A chunk is summarised by the vectors that it
makes of each entry state, the summaries of a conversation are solved in the same way (a
summary takes the place of a row), and each chunk is then solved between the states it was given, all at
the same time. The order of rows and what came before them is found by
`OrderedKeys`, which cuts large conversations in ranges. Only the hash of a repaired conversation needs its text in
sequence: it is read as a stream, one row at a time.

Rows: null role or text is one space; rows go by turn (nulls first), role and text; rows alike are duplicates;
a null `conv_id` is one conversation; a conversation of blank rows becomes empty; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweft.operators.ordered import OrderedKeys
from careweft.session import cut_lineage

# Fixed values of the contract.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOT_BLANK, FINISHED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ACCEPTS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# The state after a renamed or inserted row.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# Rows to insert at the end.
MISSING = (0, 2, 1, 0)

CHUNK = 4096
NEVER = 1 << 50
GOOD, CUT_OFF, UNWANTED = range(3)
INITIALS = ("s", "u", "a", "")

# table[entry][exit]: (cost, edits) of the cheapest way, then the least; None if there is none.
Table = Sequence[Sequence[tuple | None]]
Vector = tuple[tuple[int, int], ...]


def row_table(initial: str, fault: int) -> Table:
    """Edits of one row and of rows inserted before it."""
    table = [[None] * 4 for _ in STATES]
    for entry in STATES:
        at, spent, inserted = entry, 0, ""
        for _ in range(3):  # two inserted rows reach every state there is to reach
            ways = [(at, DELETE, "D")]
            if fault != UNWANTED:
                extra = TRUNCATED if fault == CUT_OFF else 0
                ways.append((NEXT[at], RENAME + extra, "R"))
                if (at, initial) in ACCEPTS:
                    ways.append((ACCEPTS[at, initial], extra, "K"))
            for to, cost, edit in ways:
                way, known = (spent + cost, inserted + edit), table[entry][to]
                table[entry][to] = way if known is None else min(known, way)
            at, spent, inserted = NEXT[at], spent + INSERT, inserted + "I"
    return table


ROWS = [row_table(initial, fault) for initial in INITIALS for fault in (GOOD, CUT_OFF, UNWANTED)]


def only(state: int) -> Vector:
    return tuple((0 if s == state else NEVER, 0) for s in STATES)


def forward(vector: Vector, table: Table) -> tuple[int, Vector]:
    """Costs and ranks after one more row, without what all have in common."""
    best = [(NEVER, 0, "")] * 4
    for (cost, rank), ways in zip(vector, table, strict=True):
        if cost < NEVER:
            for to, way in enumerate(ways):
                if way is not None:
                    best[to] = min(best[to], (cost + way[0], rank, way[1])) if best[to][0] < NEVER else (cost + way[0], rank, way[1])
    # Whatever follows costs at most two more from an assistant turn than from nothing, and no more than from a system turn.
    costs = [b[0] for b in best]
    usual = min(costs[ASSISTANT], costs[USER] + INSERT)
    costs[START] = costs[START] if costs[START] <= usual + DELETE else NEVER
    costs[SYSTEM] = costs[SYSTEM] if costs[SYSTEM] <= usual else NEVER
    base = min(costs)
    ranks = {s: i for i, s in enumerate(sorted((s for s in STATES if costs[s] < NEVER), key=lambda s: best[s][1:]))}
    return base, tuple((costs[s] - base, ranks[s]) if s in ranks else (NEVER, 0) for s in STATES)


def backward(ends: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """Costs from each state to the end, one row earlier, without what all have in common."""
    costs = [min((way[0] + end for way, end in zip(ways, ends, strict=True) if way is not None), default=NEVER) for ways in table]
    base = min(costs)
    return tuple(c - base if c < NEVER else NEVER for c in costs)


# Vectors without their common cost are few, so rows mostly find theirs here.
@lru_cache(maxsize=1 << 16)
def forward_row(vector: Vector, kind: int) -> tuple[int, Vector]:
    return forward(vector, ROWS[kind])


@lru_cache(maxsize=1 << 16)
def backward_row(ends: tuple[int, ...], kind: int) -> tuple[int, ...]:
    return backward(ends, ROWS[kind])


def crossings(items: Sequence, entry: int, ends: tuple[int, ...], ahead: Callable, back: Callable, table_of: Callable) -> list[int]:
    """The states after each item on the cheapest way, its audit least among equals."""
    out = [0] * len(items)
    todo = [(0, len(items), entry, ends)]
    while todo:
        low, high, entry, ends = todo.pop()
        if high - low == 1:
            ways = table_of(items[low])[entry]
            out[low] = min((w[0] + end, w[1], to) for to, (w, end) in enumerate(zip(ways, ends, strict=True)) if w is not None)[2]
            continue
        middle = (low + high) // 2
        vector, rest = only(entry), ends
        for i in range(low, middle):
            vector = ahead(vector, items[i])[1]
        for i in range(high - 1, middle - 1, -1):
            rest = back(rest, items[i])
        state = min(STATES, key=lambda s: (vector[s][0] + rest[s], vector[s][1]))
        todo.append((low, middle, entry, tuple(0 if s == state else NEVER for s in STATES)))
        todo.append((middle, high, state, ends))
    return out


FINAL = tuple(INSERT * n for n in MISSING)


def row_crossings(kinds: Sequence[int], entry: int = START, ends: tuple[int, ...] = FINAL) -> list[int]:
    return crossings(kinds, entry, ends, forward_row, backward_row, ROWS.__getitem__)


def summary(kinds: Sequence[int]) -> Table:
    """What a chunk makes of each entry state: (cost, rank) by exit state."""
    table = []
    for entry in STATES:
        vector, total = only(entry), 0
        for kind in kinds:
            base, vector = forward_row(vector, kind)
            total += base
        table.append([(total + cost, rank) if cost < NEVER else None for cost, rank in vector])
    return table


def chunk_crossings(summaries: Sequence[Table]) -> list[int]:
    return crossings(summaries, START, FINAL, forward, backward, lambda table: table)


def inserted(state: int, count: int) -> tuple[str, int]:
    """Lines of inserted rows, and the state after them."""
    lines = ""
    for _ in range(count):
        state = NEXT[state]
        lines += NAMES[state] + ":\n"
    return lines, state


def edits_between(kinds: Sequence[int], entry: int, exit_: int | None) -> list[tuple[str, str, str | None]]:
    """(edits, inserted lines, new role) of each row; `exit_` None: the end of the conversation."""
    ends = FINAL if exit_ is None else tuple(0 if s == exit_ else NEVER for s in STATES)
    out = []
    for kind, state in zip(kinds, row_crossings(kinds, entry, ends), strict=True):
        edits = ROWS[kind][entry][state][1]
        lines, _ = inserted(entry, len(edits) - 1)
        out.append((edits, lines, NAMES[state] if edits[-1] == "R" else None))
        entry = state
    return out


def marked_rows(rows: DataFrame, **split) -> DataFrame:
    """Rows with their place `pos` in the conversation, `kind` for `ROWS`, and what is counted of them."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    initial = F.substring("role", 1, 1)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    keyed = OrderedKeys(plain.withColumn("initial", initial), ["conv_id"], order, **split)
    keyed = keyed.previous({"last_initial": "initial", "last_turn": "turn"}, flag="follows").running(sums={"pos": F.lit(1).cast("long")})
    pair = F.concat("last_initial", "initial")
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.when(F.col("follows"), F.col("last_turn")))
    placed = cut_lineage(
        keyed.frame.select(
            "conv_id", "pos", "turn", "role", "text", "initial", F.md5(F.col("text").cast("binary")).alias("digest"),
            (~F.col("text").rlike(NOT_BLANK)).alias("blank"), (~F.col("text").rlike(FINISHED)).alias("unfinished"),
            (F.col("follows") & ~pair.isin("su", "ua", "au")).alias("illegal"), new_turn.alias("new_turn"),
        )
    )
    # The first row of each text, found with map-side minima, meets its row by place: no text's rows are gathered.
    firsts = placed.filter(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first_pos"))
    firsts = firsts.select(F.col("conv_id").alias("first_conv"), "first_pos", F.lit(True).alias("first"))
    seen = placed.drop("text", "digest").join(
        firsts, F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("pos") == F.col("first_pos")), "left"
    )
    duplicate = ~F.col("blank") & F.col("first").isNull()
    truncated = ~F.col("blank") & ~duplicate & F.col("unfinished")
    number = F.array_position(F.array(*[F.lit(i) for i in INITIALS[:3]]), F.col("initial"))
    which = F.when(number > 0, number - 1).otherwise(3)
    fault = F.when(F.col("blank") | duplicate, UNWANTED).when(truncated, CUT_OFF).otherwise(GOOD)
    marks = seen.select(
        "conv_id", "pos", "turn", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"), (3 * which + fault).cast("int").alias("kind"),
        *[c.cast("long").alias(n) for n, c in {"blank": F.col("blank"), "duplicate": duplicate, "truncated": truncated, "illegal": F.col("illegal"), "new_turn": F.col("new_turn")}.items()],
    )
    return placed.select("conv_id", "pos", "role", "text"), marks


def chunks_of(marks: DataFrame) -> DataFrame:
    """A row per chunk: counts, kinds in order, and its summary."""
    counted = ["blank", "duplicate", "truncated", "illegal", "new_turn"]
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"])
    grouped = marks.groupBy("conv_id", "chunk").agg(
        *[F.sum(c).alias(c) for c in counted], F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), kinds.alias("kinds")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [[way for ways in summary(k) for way in ways] for k in batch.column("kinds").to_pylist()]
            costs = pa.array([[None if w is None else w[0] for w in t] for t in tables], pa.list_(pa.int64()))
            ranks = pa.array([[None if w is None else w[1] for w in t] for t in tables], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, costs, ranks], names=[*batch.schema.names, "costs", "ranks"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema)
    return cut_lineage(grouped.mapInArrow(run, f"{fields}, costs array<long>, ranks array<int>"))


def solved(chunks: DataFrame) -> DataFrame:
    """A row per conversation: counts, `cost`, the state at its end, and entry and exit of each chunk."""
    counted = ["blank", "duplicate", "truncated", "illegal"]
    gaps = F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("new_turn"), F.lit(0)).cast("long")
    grouped = chunks.groupBy("conv_id").agg(
        gaps.alias("gaps"), *[F.sum(c).alias(c) for c in counted],
        F.array_sort(F.collect_list(F.struct("chunk", "costs", "ranks"))).alias("parts"),
    )
    names = ["conv_id", "gaps", *counted]
    border = pa.struct([("chunk", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, ends, borders = [], [], []
            for parts in batch.column("parts").to_pylist():
                ways = [[None if c is None else (c, r) for c, r in zip(p["costs"], p["ranks"], strict=True)] for p in parts]
                tables = [[w[4 * e : 4 * e + 4] for e in STATES] for w in ways]
                states = [START, *chunk_crossings(tables)]
                costs.append(sum(t[a][b][0] for t, a, b in zip(tables, states, states[1:])) + FINAL[states[-1]])
                ends.append(states[-1])
                # The last chunk is solved to the end of the conversation: its exit is open.
                exits = [*states[1:-1], None]
                borders.append([{"chunk": p["chunk"], "entry": a, "exit": b} for p, a, b in zip(parts, states, exits)])
            new = [pa.array(costs, pa.int64()), pa.array(ends, pa.int32()), pa.array(borders, pa.list_(border))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], names=[*names, "cost", "end_state", "borders"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.select(*names).schema)
    return cut_lineage(grouped.mapInArrow(run, f"{fields}, cost long, end_state int, borders array<struct<chunk:bigint,entry:int,exit:int>>"))


def row_edits(chunks: DataFrame, conversations: DataFrame) -> DataFrame:
    """(edited_conv, edited_pos, edits, before, new_role) of every row."""
    borders = conversations.select(F.col("conv_id").alias("border_conv"), F.inline("borders").alias("border_chunk", "entry", "exit"))
    match = F.col("conv_id").eqNullSafe(F.col("border_conv")) & (F.col("chunk") == F.col("border_chunk"))
    joined = chunks.join(borders, match).select("conv_id", "chunk", "kinds", "entry", "exit")
    edit = pa.struct([("edits", pa.string()), ("before", pa.string()), ("new_role", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for kinds, entry, exit_ in zip(*[batch.column(c).to_pylist() for c in ("kinds", "entry", "exit")], strict=True):
                found.append([{"edits": e, "before": b, "new_role": r} for e, b, r in edits_between(kinds, entry, exit_)])
            columns = [batch.column("conv_id"), batch.column("chunk"), pa.array(found, pa.list_(edit))]
            yield pa.RecordBatch.from_arrays(columns, names=["edited_conv", "chunk", "found"])

    kind = joined.schema["conv_id"].dataType.simpleString()
    edits = joined.mapInArrow(run, f"edited_conv {kind}, chunk long, found array<struct<edits:string,before:string,new_role:string>>")
    listed = edits.select("edited_conv", "chunk", F.posexplode("found").alias("i", "edit"))
    return listed.select("edited_conv", (F.col("chunk") * CHUNK + F.col("i") + 1).alias("edited_pos"), "edit.*")


def repaired_lines(texts: DataFrame, edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, edits, before, line) in any order: what each row becomes (`line` null: deleted) after the
    lines inserted before it; one more row per conversation for what is inserted at its end."""
    match = F.col("conv_id").eqNullSafe(F.col("edited_conv")) & (F.col("pos") == F.col("edited_pos"))
    line = F.when(~F.col("edits").endswith("D"), F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text"))
    rows = texts.join(edits, match).select("conv_id", "pos", "edits", "before", line.alias("line"))
    closing = [(s, "I" * n, inserted(s, n)[0]) for s, n in enumerate(MISSING)]

    def pick(place: int) -> Column:
        return F.element_at(F.array(*[F.lit(c[place]) for c in closing]), F.col("end_state") + 1)

    last = conversations.select(
        "conv_id", F.lit(2**62).cast("long").alias("pos"), pick(1).alias("edits"), pick(2).alias("before"), F.lit(None).cast("string").alias("line")
    )
    return rows.unionByName(last)


def stream_digests(lines: DataFrame) -> DataFrame:
    """(repaired_conv, audit, repaired_sha256): rows of a conversation pass one by one, in order; nothing but its edits and
    the hash so far is held."""
    kind = lines.schema["conv_id"].dataType.simpleString()
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(conv, edits, digest) -> pa.RecordBatch:
            columns = [pa.array([conv], key_type), pa.array(["".join(edits)], pa.string()), pa.array([digest.hexdigest()], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["repaired_conv", "audit", "repaired_sha256"])

        open_, conv, key_type = False, None, None
        for batch in batches:
            key_type, done = batch.schema.field("conv_id").type, []
            for key, edit, before, line in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edits", "before", "line")], strict=True):
                if not open_ or key != conv:
                    if open_:
                        done.append(closed(conv, edits, digest))
                    open_, conv, edits, digest, between = True, key, [], hashlib.sha256(), b""
                edits.append(edit)
                for one in [*before.split("\n")[:-1], *([] if line is None else [line])]:
                    digest.update(between + one.encode())
                    between = b"\n"
            yield from (pa.Table.from_batches(done).combine_chunks().to_batches() if done else ())
        if open_:
            yield closed(conv, edits, digest)

    return ordered.mapInArrow(run, f"repaired_conv {kind}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, **split) -> tuple[DataFrame, DataFrame]:
    """Conversations with faults, cost and edits, and the lines they become.

    The first has a row per conversation: `conv_id`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`,
    `end_state`, `borders`; the second is that of `repaired_lines`. `split` goes to `OrderedKeys`.
    """
    texts, marks = marked_rows(rows, **split)
    chunks = chunks_of(marks)
    conversations = solved(chunks)
    return conversations, repaired_lines(texts, row_edits(chunks, conversations), conversations)


def repair_digests(rows: DataFrame, every: DataFrame, **split) -> DataFrame:
    """A row for each `conv_id` of `every`, whether it has rows left or not."""
    conversations, lines = repair(rows, **split)
    digests = stream_digests(lines)
    ids = every.select(F.col("conv_id").alias("id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        ids.join(conversations, F.col("id").eqNullSafe(F.col("conv_id")), "left")
        .join(digests, F.col("id").eqNullSafe(F.col("repaired_conv")), "left")
        .select(
            F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
