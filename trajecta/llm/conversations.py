"""Conversation structure repair by a parallel Viterbi search with rank convergence.

A conversation should read ``(system)? (user assistant)+``, or be empty.  Four states tell what may
follow (the start, and after each of the three roles), and every row is kept, given another role
or deleted, with rows inserted between them, at least cost.  A vector holds the cost to the end
from each state.  Only differences between its entries matter, so a vector is named by them: there
are few such vectors, and the step back over a row is a table.

A conversation may be longer than a task should hold, so its rows are cut into chunks.  A chunk does
not know the costs behind it and starts from speculative vectors, all that can occur.  Runs that
differ only by a constant become one, in most chunks all of them after a few rows: such a chunk's
own result is final.  Fix-up passes replace what others assumed by what the chunk behind found, over
twice as many chunks in each pass, until every chunk has its vector.  The stitched costs then drive
the trace from the front, which takes the edit that sorts first among the cheapest.  Its state at
each chunk's start is found in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.session import materialise

CHUNK_ROWS = 8192
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_OTHER = 3  # class of a role that is none of system, user, assistant (0, 1, 2)
_KEEP = {(_START, 0): _SYSTEM, (_START, 1): _USER, (_SYSTEM, 1): _USER, (_ASSISTANT, 1): _USER, (_USER, 2): _ASSISTANT}
_GIVEN = [_USER, _USER, _ASSISTANT, _USER]  # state after the role that is inserted or given
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}  # classes of neighbouring rows
_BLANK, _DUPLICATE, _CUT = 1, 2, 3  # first fault of a row
_GONE = 8  # kind of a row that must be deleted; others are class + 4 if truncated
_SPACE = " \t\n\x0b\f\r"


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first."""
    out = list(costs)
    for _ in range(4):
        out = [min(c, INSERT + out[_GIVEN[s]]) for s, c in enumerate(out)]
    return tuple(out)


def _before(kind: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from before a row of ``kind``, given those from behind it."""
    if kind == _GONE:
        return tuple(DELETE + c for c in after)
    role, cut = kind % 4, TRUNCATED * (kind // 4)
    costs = []
    for s in range(4):
        options = [DELETE + after[s], REROLE + cut + after[_GIVEN[s]]]
        if (s, role) in _KEEP:
            options.append(cut + after[_KEEP[s, role]])
        costs.append(min(options))
    return _closed(costs)


def _edit(kind: int, after: tuple[int, ...], state: int) -> tuple[str, int, list[str], str | None]:
    """Edits up to and with a row, in the order that sorts first; the state after them; inserted
    roles; and the row's role: None if it is deleted, empty if it keeps its own."""
    before, edits, inserted = _before(kind, after), "", []
    cut = TRUNCATED * (kind // 4)
    while True:
        cost = before[state]
        if DELETE + after[state] == cost:
            return edits + "D", state, inserted, None
        if INSERT + before[_GIVEN[state]] == cost:
            state = _GIVEN[state]
            edits += "I"
            inserted.append(_ROLE[state])
            continue
        kept = _KEEP.get((state, kind % 4))
        if kept is not None and cut + after[kept] == cost:
            return edits + "K", kept, inserted, ""
        state = _GIVEN[state]
        return edits + "R", state, inserted, _ROLE[state]


def _tables():
    """All vectors that occur behind some rows, the step back over each kind, and the edits."""
    end = _closed([0, 1 << 20, 1 << 20, 0])
    vectors, number, steps = [end], {end: 0}, []
    for vector in vectors:
        row = []
        for kind in range(9):
            costs = _before(kind, vector)
            costs = tuple(c - min(costs) for c in costs)
            if costs not in number:
                number[costs] = len(vectors)
                vectors.append(costs)
            row.append(number[costs])
        steps.append(row)
    edits = [[[_edit(kind, v, s) for s in range(4)] for kind in range(8)] for v in vectors]
    return vectors, steps, edits


_VECTORS, _STEPS, _EDITS = _tables()
_STEP_OF_KIND = np.array(_STEPS, np.uint8).T.copy()
_END = 0  # the vector at the end of a conversation


def _kinds(codes: list[int]) -> list[int]:
    """Kinds of rows from class + 4 * fault."""
    return [_GONE if c >> 2 in (_BLANK, _DUPLICATE) else (c & 3) + 4 * (c >> 2 == _CUT) for c in codes]


def _converged(kinds: list[int]) -> list[int]:
    """Vector before the rows for each vector behind them."""
    runs = np.arange(len(_VECTORS), dtype=np.uint8)
    for i in range(len(kinds) - 1, -1, -1):
        runs = _STEP_OF_KIND[kinds[i]][runs]
        if i % 16 == 0 and (runs == runs[0]).all():
            one = int(runs[0])
            for k in kinds[:i][::-1]:
                one = _STEPS[one][k]
            return [one] * len(_VECTORS)
    return runs.tolist()


def _trail(kinds: list[int], behind: int) -> list[int]:
    """Vector behind each row."""
    out = [0] * len(kinds)
    for i in range(len(kinds) - 1, -1, -1):
        out[i] = behind
        behind = _STEPS[behind][kinds[i]]
    return out


def _ends(kinds: list[int], behind: int) -> list[int]:
    """State after the rows for each state before them."""
    trail, out = _trail(kinds, behind), []
    for s in range(4):
        for v, k in zip(trail, kinds):
            if k != _GONE:
                s = _EDITS[v][k][s][1]
        out.append(s)
    return out


def _trace(codes: list[int], copies: list[int], roles: list[str], texts: list[str], behind: int, state: int, last: bool):
    """Edits, cost and ``(edit, role, text)`` of the rows that stay; ``last`` closes the conversation.

    Copies of a row after the first are duplicates.
    """
    kinds = _kinds(codes)
    edits, cost, rows = [], 0, []
    for i, (v, k) in enumerate(zip(_trail(kinds, behind), kinds)):
        if k == _GONE:
            edits.append("D" * copies[i])
            cost += DELETE * copies[i]
            continue
        edit, state, inserted, role = _EDITS[v][k][state]
        rows += [("I", r, "") for r in inserted]
        cost += INSERT * len(inserted)
        if role is None:
            cost += DELETE
        else:
            rows.append((edit[-1], role or roles[i], texts[i]))
            cost += REROLE * bool(role) + TRUNCATED * (k // 4)
        edits.append(edit + "D" * (copies[i] - 1))
        cost += DELETE * (copies[i] - 1)
    while last and _VECTORS[_END][state]:
        state = _GIVEN[state]
        edits.append("I")
        rows.append(("I", _ROLE[state], ""))
        cost += INSERT
    return "".join(edits), cost, rows


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults in some rows, by a hash of conv_id and turn.

    Of 20 hash values, 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats the row
    and 4 makes its role user.  Null roles and texts, and nulls in the hash, become one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    fault = F.col("fault")
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        text.alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fault"),
    ).filter(fault != 0)
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _faults(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies, code)``: equal rows once, code is class + 4 * fault."""
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", digest)
    counted = materialise(counted, "turns")
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))  # nulls first
    said = counted.groupBy(F.col("conv_id").alias("said_in"), F.col("digest").alias("said")).agg(
        F.min(when).alias("first"), F.count("*").alias("times")
    )
    again = said.filter("times > 1").drop("times")
    known = counted.join(again, F.col("conv_id").eqNullSafe(F.col("said_in")) & (F.col("digest") == F.col("said")), "left")
    end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    fault = (
        F.when(end == "", _BLANK)
        .when(when > F.col("first"), _DUPLICATE)
        .when(~end.isin(".", "!", "?"), _CUT)
        .otherwise(0)
    )
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(_OTHER)
    return known.select("conv_id", "turn", "role", "text", "copies", (role + 4 * fault).cast("byte").alias("code"))


def _chunks(conversations: DataFrame, chunk_rows: int) -> DataFrame:
    """``(id, conv_id, prev, turns, roles, texts, copies, codes)``: rows of a conversation in order.

    Ids grow along a conversation.  ``prev`` is the chunk before, null for a conversation's first.
    """
    faults = _faults(conversations)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    # A range may end inside a conversation; long roles and texts are not needed to tell where.
    spread = [*order[:2], F.left("role", F.lit(16)), F.left("text", F.lit(64))]
    kind = faults.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column(0)
            code = conv.dictionary_encode().indices.fill_null(-1).to_numpy()
            new = np.r_[True, code[1:] != code[:-1]]
            starts = np.flatnonzero(new)
            pieces = [np.arange(a, b, chunk_rows) for a, b in zip(starts, [*starts[1:], len(batch)])]
            starts = np.concatenate(pieces)
            edges = pa.array(np.r_[starts, len(batch)], pa.int32())
            ids = number + np.arange(len(starts))
            follows = ~new[starts]
            follows[0] = before is not None and before == conv[:1].to_pylist()
            lists = [pa.ListArray.from_arrays(edges, batch.column(k)) for k in range(1, 6)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), conv.take(pa.array(starts)), pa.array(ids - 1, mask=~follows), *lists],
                names=["id", "conv_id", "prev", "turns", "roles", "texts", "copies", "codes"],
            )
            number += len(starts)
            before = conv[len(batch) - 1 :].to_pylist()

    schema = (
        f"id long, conv_id {kind}, prev long, turns array<long>, roles array<string>, texts array<string>, "
        "copies array<long>, codes array<tinyint>"
    )
    sorted_rows = faults.repartitionByRange(*spread).sortWithinPartitions(*order)
    return materialise(sorted_rows.mapInArrow(cut, schema), "chunks")


def _linked(chunks: DataFrame) -> DataFrame:
    """``(id, prev, next)`` of the chunks of conversations with more than one."""
    part = F.shiftright("id", 32)
    own = chunks.select("id", "conv_id", "prev")
    # Where a range begins inside a conversation, its first chunk follows the last one of the range before.
    ranges = own.groupBy(part.alias("part")).agg(
        F.min_by(F.struct("id", "conv_id"), "id").alias("first"), F.max_by(F.struct("id", "conv_id"), "id").alias("last")
    )
    ranges = ranges.withColumn("before", F.lag("last").over(Window.orderBy("part")))  # a row per range
    across = ranges.filter(F.col("first.conv_id").eqNullSafe(F.col("before.conv_id")) & F.col("before").isNotNull()).select(
        F.col("first.id").alias("id"), F.col("before.id").alias("prev")
    )
    links = materialise(own.filter("prev IS NOT NULL").select("id", "prev").union(across), "links")
    ahead = links.select(F.col("prev").alias("id"), F.col("id").alias("next"))
    return materialise(links.join(ahead, "id", "full"), "chains")


def _settled(maps: DataFrame, start: int) -> DataFrame:
    """``(id, value)`` of ``maps(id, to, map)``: the maps of a chunk and of all behind it along ``to``,
    the farthest first, applied to ``start``.

    A constant map is settled, as is one with nothing behind it.  Each pass joins the others with
    the chunk they point to and points on to where that one pointed, so the passes are as many as
    the logarithm of the longest stretch that does not converge.
    """
    settled = (F.array_max("map") == F.array_min("map")) | F.col("to").isNull()
    maps = materialise(maps, "maps")
    while not maps.filter(~settled).isEmpty():
        other = maps.select(F.col("id").alias("to"), F.col("to").alias("onward"), F.col("map").alias("behind"))
        joined = maps.join(other, "to", "left")
        done = F.col("behind").isNull() | (F.array_max("map") == F.array_min("map"))
        composed = F.transform("behind", lambda x: F.get("map", x))
        maps = materialise(
            joined.select(
                "id",
                F.when(~done, F.col("onward")).alias("to"),
                F.when(done, F.col("map")).otherwise(composed).alias("map"),
            ),
            "maps",
        )
    return maps.select("id", F.get("map", F.lit(start)).alias("value"))


def _known(chunks: DataFrame) -> DataFrame:
    """``(id, behind, state, first, last)``: vector behind and state before each chunk of a longer
    conversation, and whether it is the first or last."""
    chains = _linked(chunks)
    codes = chunks.select("id", "codes").join(chains, "id")

    def converge(batches):
        for batch in batches:
            maps = [_converged(_kinds(c)) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(maps, pa.list_(pa.int32()))], names=["id", "to", "map"])

    fronts = _settled(codes.select("id", F.col("next").alias("to"), "codes").mapInArrow(converge, "id long, to long, map array<int>"), _END)
    behind = chains.join(fronts.select(F.col("id").alias("next"), "value"), "next", "left").select(
        "id", "prev", "next", F.coalesce("value", F.lit(_END)).alias("behind")
    )
    behind = materialise(behind, "behind")

    def trace(batches):
        for batch in batches:
            maps = [_ends(_kinds(c), v) for c, v in zip(*(batch.column(k).to_pylist() for k in (2, 3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(maps, pa.list_(pa.int32()))], names=["id", "to", "map"])

    traced = chunks.select("id", "codes").join(behind, "id").select("id", F.col("prev").alias("to"), "codes", "behind")
    ends = _settled(traced.mapInArrow(trace, "id long, to long, map array<int>"), _START)
    before = behind.join(ends.select(F.col("id").alias("prev"), "value"), "prev", "left")
    return materialise(
        before.select(
            "id", "behind", F.coalesce("value", F.lit(_START)).alias("state"),
            F.col("prev").isNull().alias("first"), F.col("next").isNull().alias("last"),
        ),
        "known",
    )


def _placed(conversations: DataFrame, chunk_rows: int) -> DataFrame:
    """Chunks with what ``_trace`` needs."""
    chunks = _chunks(conversations, chunk_rows)
    known = _known(chunks)
    return chunks.drop("prev").join(known, "id", "left").select(
        *[c for c in chunks.columns if c != "prev"],
        F.coalesce("behind", F.lit(_END)).alias("behind"),
        F.coalesce("state", F.lit(_START)).alias("state"),
        F.coalesce("first", F.lit(True)).alias("first"),
        F.coalesce("last", F.lit(True)).alias("last"),
    )


def _traces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """One chunk after another; a batch of long chunks is not turned into Python rows at once."""
    for i in range(len(batch)):
        row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
        yield row, _trace(row["codes"], row["copies"], row["roles"], row["texts"], row["behind"], row["state"], row["last"])


def repaired_rows(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(conv_id, chunk, place, edit, role, text)``: rows of the repaired conversations, which read in
    the order of chunk and place.  Edits are K, R or I; see ``audits`` for the rules."""
    placed = _placed(conversations, chunk_rows)
    kind = placed.schema["conv_id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            for i, (row, (_, _, kept)) in enumerate(_traces(batch)):
                edits, roles, texts = zip(*kept) if kept else ((), (), ())
                conv = batch.column(1).take(pa.array([i] * len(kept), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [conv, pa.array([row["id"]] * len(kept), pa.int64()), pa.array(range(len(kept)), pa.int64()),
                     *(pa.array(x, pa.string()) for x in (edits, roles, texts))],
                    names=["conv_id", "chunk", "place", "edit", "role", "text"],
                )

    return placed.mapInArrow(rows, f"conv_id {kind}, chunk long, place long, edit string, role string, text string")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PART = [*_COUNTS, "turns", "low", "high", "first_class", "last_class", "audit"]


def _part(row: dict, audit: str, cost: int) -> dict:
    """What a chunk adds to its conversation's line."""
    codes, copies = row["codes"], row["copies"]
    turns = [t for t in row["turns"] if t is not None]
    out = dict.fromkeys(_COUNTS, 0)
    for c, m in zip(codes, copies):
        fault = c >> 2
        out["blank"] += m * (fault == _BLANK)
        out["duplicate"] += m if fault == _DUPLICATE else m - 1 if fault != _BLANK else 0
        out["truncated"] += fault == _CUT
        out["illegal"] += m - 1  # no role may follow itself
    out["illegal"] += sum((a & 3, b & 3) not in _LEGAL for a, b in zip(codes, codes[1:]))
    out |= {"cost": cost, "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None}
    return out | {"first_class": codes[0] & 3, "last_class": codes[-1] & 3, "audit": audit}


class _Line:
    """One conversation's line, from its chunks in order."""

    def __init__(self):
        self.total = dict.fromkeys(_COUNTS, 0)
        self.turns, self.low, self.high, self.last_class = 0, None, None, None
        self.audit: list[str] = []
        self.hash, self.started = hashlib.sha256(), False

    def add(self, part: dict, body: bytes | None) -> None:
        for c in _COUNTS:
            self.total[c] += part[c]
        if self.last_class is not None:
            self.total["illegal"] += (self.last_class, part["first_class"]) not in _LEGAL
        self.last_class = part["last_class"]
        if part["low"] is not None:
            self.turns += part["turns"] - (part["low"] == self.high)
            self.low = part["low"] if self.low is None else self.low
            self.high = part["high"]
        self.audit.append(part["audit"])
        if body is not None:
            self.hash.update(b"\n" + body if self.started else body)
            self.started = True

    def line(self) -> tuple:
        if self.low is not None:
            self.total["gaps"] = min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (*(self.total[c] for c in _COUNTS), "".join(self.audit), self.hash.hexdigest())


def _body(rows: list[tuple[str, str, str]]) -> bytes | None:
    return "\n".join(f"{role}:{text}" for _, role, text in rows).encode() if rows else None


_LINE = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_LINE_NAMES = [*_COUNTS, "audit", "repaired_sha256"]


def _line_batch(conv: pa.Array, lines: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*lines)) or [()] * len(_LINE_NAMES)
    types = [pa.int64()] * len(_COUNTS) + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([conv, *(pa.array(c, t) for c, t in zip(columns, types))], names=["conv_id", *_LINE_NAMES])


def audits(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row
    per conversation with rows.

    Rows go by turn (nulls first), then role and text.  A row's first fault counts: blank (nothing but
    ``[\\x20\\x09-\\x0D]``), duplicate (role and text were there before), truncated (the last other
    character is none of ``.!?``).  ``gaps`` are missing turns between the lowest and the highest,
    ``illegal`` neighbouring rows whose roles' initials are not su, ua or au.  Edits are Keep (cost 0),
    Rerole to user or assistant (2), Delete (3; must be for blank and duplicate rows) and Insert of an
    empty row (2); a truncated row that stays costs 1 more.  ``audit`` has the initials of the cheapest
    edits after which roles read ``(s?(ua)+)?`` by their initials, the first in ASCII order among equals.
    ``repaired_sha256`` is the hash of the repaired ``role:text``, joined by line feeds.

    Null roles and texts are one space; a null conv_id is a conversation of its own, and null turns
    count as no turn; repeated rows are duplicates; other columns are ignored; an empty table gives no
    rows.  Rows of one conversation may lie in any number of tasks of ``chunk_rows`` rows and less; only
    its audit and running hash pass through one, a chunk at a time, as the line asks for.
    """
    placed = _placed(conversations, chunk_rows)
    kind = placed.schema["conv_id"].dataType.simpleString()
    part_type = pa.struct([(c, pa.string() if c == "audit" else pa.int64()) for c in _PART])
    part_schema = ", ".join(f"{c}: {'string' if c == 'audit' else 'bigint'}" for c in _PART)

    def whole(batches):
        for batch in batches:
            lines = []
            for row, (audit, cost, rows) in _traces(batch):
                line = _Line()
                line.add(_part(row, audit, cost), _body(rows))
                lines.append(line.line())
            yield _line_batch(batch.column(1), lines)

    def parts(batches):
        for batch in batches:
            for i, (row, (audit, cost, rows)) in enumerate(_traces(batch)):
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).columns[:2], pa.array([_part(row, audit, cost)], part_type), pa.array([_body(rows)], pa.binary())],
                    names=["id", "conv_id", "part", "body"],
                )

    def joined(batches):
        conv, line = None, _Line()
        for batch in batches:
            for i in range(len(batch)):
                own = batch.column(1).slice(i, 1)
                if conv is not None and not own.equals(conv):
                    yield _line_batch(conv, [line.line()])
                    line = _Line()
                conv = own
                line.add(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
        if conv is not None:
            yield _line_batch(conv, [line.line()])

    schema = f"conv_id {kind}, {_LINE}"
    short = placed.filter("first AND last").mapInArrow(whole, schema)
    long = (
        placed.filter("NOT (first AND last)")
        .mapInArrow(parts, f"id long, conv_id {kind}, part struct<{part_schema}>, body binary")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "id")
        .mapInArrow(joined, schema)
    )
    return short.union(long)


def audited(conversations: DataFrame, damaged: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``audits`` of ``damaged``, with a line of zeros, an empty audit and the hash of the empty text
    for every conversation of which no row is left."""
    found = materialise(audits(damaged, chunk_rows), "audits").withColumnRenamed("conv_id", "found_id")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
