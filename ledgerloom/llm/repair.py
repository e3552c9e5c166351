"""Conversation structure repair: faults of a conversation's rows, and the cheapest edits that make its roles alternate.

The cost to go from each row and state of the grammar ``(s?(ua)+)?`` is computed backward; a walk forward then takes, of the edits that keep to the least cost, the one whose
initial is first in ASCII. Conversations of any length are possible: what lies in several partitions is summed up by its costs between states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, tidy

#: Costs of edits: Delete, Insert, Rerole; Keep costs nothing; a truncated row that stays adds TRUNCATED.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after a system turn, after a user's, after an assistant's. KEPT has the state after a role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state after the one role that a new or renamed turn can have.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 40
#: Costs at the end of a conversation, where missing turns are still inserted.
END = [0, 2 * INSERT, INSERT, 0]
GOOD = {"su", "ua", "au"}

#: What is known of a row besides its text: (initial of its role, must go, is truncated).
Row = tuple[str, bool, bool]


def costs_to_go(rows: list[Row], end: list[int]) -> list[list[int]]:
    """For each row and for the end, the least cost from there on by state."""
    out = [end]
    for initial, gone, short in reversed(rows):
        after = out[-1]
        here = []
        for s in range(4):
            c = DELETE + after[s]
            if not gone:
                c = min(c, REROLE + TRUNCATED * short + after[NEXT[s]])
                if initial in KEPT[s]:
                    c = min(c, TRUNCATED * short + after[KEPT[s][initial]])
            here.append(c)
        out.append([min(here[s], INSERT + here[NEXT[s]], 2 * INSERT + here[NEXT[NEXT[s]]]) for s in range(4)])
    return out[::-1]


def between(rows: list[Row]) -> list[int]:
    """The least costs from each state before the rows to each state right after them, as sixteen numbers."""
    by_end = [costs_to_go(rows, [0 if s == t else NEVER for s in range(4)])[0] for t in range(4)]
    return [min(by_end[t][s], NEVER) for s in range(4) for t in range(4)]


def walk(rows: list[Row], to_go: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The initials of the cheapest edits, of which the first in ASCII, and the state in which they end; ``last``: turns that the end lacks are inserted."""
    out, i = [], 0
    while i < len(rows) or (last and to_go[i][state]):
        left, then = to_go[i][state], NEXT[state]
        if i == len(rows):
            out.append("I")
            state = then
            continue
        initial, gone, short = rows[i]
        if DELETE + to_go[i + 1][state] == left:
            out.append("D")
            i += 1
        elif INSERT + to_go[i][then] == left:
            out.append("I")
            state = then
        elif not gone and initial in KEPT[state] and TRUNCATED * short + to_go[i + 1][KEPT[state][initial]] == left:
            out.append("K")
            state, i = KEPT[state][initial], i + 1
        else:
            out.append("R")
            state, i = then, i + 1
    return "".join(out), state


class Rebuilt:
    """Turns as edits leave them, taken up row by row and hashed on the way."""

    def __init__(self) -> None:
        self.state, self.audit, self.sha, self.any, self.edits, self.at = START, [], hashlib.sha256(), False, "", 0

    def _turn(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state = NEXT[self.state]
            self._turn(ROLES[self.state], "")
            self.at += 1

    def begin(self, edits: list[str]) -> None:
        """The edits of the rows that follow, by the state in which the rows before have ended."""
        self._inserts()
        self.edits, self.at = edits[self.state], 0
        self.audit.append(self.edits)

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state][role[:1]]
            self._turn(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._turn(ROLES[self.state], text)

    def end(self) -> tuple[str, str]:
        self._inserts()
        return "".join(self.audit), self.sha.hexdigest()


#: What is known of a stretch of rows: rows, faults, adjacent roles, turns, and the costs between states.
_SUMS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]
_ENDS = ["first_role", "last_role", "least_turn", "most_turn"]


def _sums(rows: list[tuple]) -> dict:
    """Of rows (turn, initial, blank, duplicate, truncated) in order; each row has the first of its faults only."""
    turns = {r[0] for r in rows if r[0] is not None}
    return {
        "n": len(rows), "blank": sum(r[2] for r in rows), "duplicate": sum(r[3] for r in rows), "truncated": sum(r[4] for r in rows),
        "illegal": sum(a[1] + b[1] not in GOOD for a, b in zip(rows, rows[1:])), "turns": len(turns),
        "first_role": rows[0][1] if rows else None, "last_role": rows[-1][1] if rows else None, "least_turn": min(turns, default=None), "most_turn": max(turns, default=None),
    }


def _joined(parts: Iterable[dict]) -> dict:
    """The sums of stretches that follow one another; turns are in order, so only the last of one and the first of the next can be the same."""
    out = _sums([])
    for p in parts:
        if not p["n"]:
            continue
        same = out["most_turn"] is not None and out["most_turn"] == p["least_turn"]
        illegal = out["n"] and out["last_role"] + p["first_role"] not in GOOD
        for k in _SUMS:
            out[k] += p[k]
        out["turns"] -= same
        out["illegal"] += bool(illegal)
        out["first_role"] = p["first_role"] if out["first_role"] is None else out["first_role"]
        out["last_role"] = p["last_role"]
        out["least_turn"] = p["least_turn"] if out["least_turn"] is None else out["least_turn"]
        out["most_turn"] = out["most_turn"] if p["most_turn"] is None else p["most_turn"]
    return out


def _gaps(sums: dict) -> int:
    if sums["least_turn"] is None:
        return 0
    return min(sums["most_turn"] - sums["least_turn"] + 1 - sums["turns"], (1 << 63) - 1)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_TYPES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = ["turn", "role", "text", "empty", "open", "present"]
_ROW_TYPES = "turn long, role string, text string, empty boolean, open boolean, present boolean"


def _faults(rows: list[tuple]) -> list[tuple]:
    seen: set[tuple[str, str]] = set()
    out = []
    for turn, role, text, empty, open_, _ in rows:
        again = (role, text) in seen
        seen.add((role, text))
        out.append((turn, role[:1], empty, again and not empty, open_ and not empty and not again))
    return out


def _whole(rows: list[tuple]) -> tuple:
    """The result of a conversation all of whose rows are here."""
    rows = [r for r in rows if r[5]]
    known = _faults(rows)
    plain = [(k[1], k[2] or k[3], k[4]) for k in known]
    to_go = costs_to_go(plain, END)
    done = Rebuilt()
    done.begin([walk(plain, to_go, START, True)[0]])
    for r in rows:
        done.row(r[1], r[2])
    sums = _sums(known)
    return (_gaps(sums), *(sums[k] for k in ("blank", "duplicate", "truncated", "illegal")), to_go[0][START], *done.end())


def _stream(kind: pa.DataType):
    """Results of conversations that lie within a sorted partition; the rows of its first and last conversation, which may go on elsewhere, as they are."""
    result = [*[pa.int64()] * 6, *[pa.string()] * 2]
    row = [pa.int64(), pa.string(), pa.string(), *[pa.bool_()] * 3]
    names = ["id", *RESULT, "part", "place", *_ROW]

    def batch(ids: list, results: list[tuple] | None, part: int | None, place: int, rows: list[tuple] | None) -> pa.RecordBatch:
        n = len(ids)
        left = [pa.array(c, t) for c, t in zip(zip(*results), result)] if results else [pa.nulls(n, t) for t in result]
        right = [pa.array(c, t) for c, t in zip(zip(*rows), row)] if rows else [pa.nulls(n, t) for t in row]
        at = [pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *left, *at, *right], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, open_id, held, place = True, None, [], 0
        for b in batches:
            found = []
            for key, rows in groupby(zip(b.column("id").to_pylist(), *(b.column(c).to_pylist() for c in _ROW)), key=lambda r: r[0]):
                rows = [r[1:] for r in rows]
                if (held or place) and key != open_id:  # a conversation has ended
                    if first:
                        first = False
                        if held:
                            yield batch([open_id] * len(held), None, part, place, held)
                    else:
                        found.append((open_id, _whole(held)))
                    held, place = [], 0
                open_id = key
                held += rows
                if first:  # the first one is passed on as it comes
                    yield batch([open_id] * len(held), None, part, place, held)
                    held, place = [], place + len(held)
            if found:
                yield batch([f[0] for f in found], [f[1] for f in found], None, 0, None)
        if held:
            yield batch([open_id] * len(held), None, part, place, held)

    return run


def _segment(key: tuple, table: pa.Table) -> pa.Table:
    """Sums and costs of one conversation's rows in one partition."""
    rows = _known(table)
    out = _sums(rows) | {"id": table.column("id")[0].as_py(), "part": table.column("part")[0].as_py(), "costs": between([(r[1], r[2] or r[3], r[4]) for r in rows])}
    return pa.Table.from_pylist([out], pa.schema([("id", table.schema.field("id").type), ("part", pa.int32()), *((c, pa.int64()) for c in _SUMS), *((c, pa.string()) for c in _ENDS[:2]), *((c, pa.int64()) for c in _ENDS[2:]), ("costs", pa.list_(pa.int64()))]))


def _known(table: pa.Table) -> list[tuple]:
    t = table.filter(table.column("present")).sort_by("place")
    turn, role, empty, again, open_ = (t.column(c).to_pylist() for c in ("turn", "role", "empty", "again", "open"))
    return [(a, b, c, d and not c, e and not c and not d) for a, b, c, d, e in zip(turn, role, empty, again, open_)]


def _chain(key: tuple, table: pa.Table) -> pa.Table:
    """For each stretch of a conversation, costs from its end on, and the conversation's sums and cost; as many rows as partitions that hold it."""
    stretches = sorted(table.to_pylist(), key=lambda r: r["part"])
    sums = _joined(stretches)
    end, out = END, []
    for i, p in enumerate(reversed(stretches)):
        out.append({"id": p["id"], "part": p["part"], "end": end, "last": i == 0})
        end = [min(p["costs"][4 * s + t] + end[t] for t in range(4)) for s in range(4)]
    for r in out:
        r |= {k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": _gaps(sums), "cost": end[START]}
    return pa.Table.from_pylist(out, pa.schema([("id", table.schema.field("id").type), ("part", pa.int32()), ("end", pa.list_(pa.int64())), ("last", pa.bool_()), *((c, pa.int64()) for c in RESULT[:6])]))


def _audits(key: tuple, rows: pa.Table, ends: pa.Table) -> pa.Table:
    """The edits of a stretch from each state in which it may begin."""
    end = ends.to_pylist()[0]
    known = [(r[1], r[2] or r[3], r[4]) for r in _known(rows)]
    to_go = costs_to_go(known, end["end"])
    edits = [walk(known, to_go, s, end["last"])[0] if to_go[0][s] < NEVER else "" for s in range(4)]
    return pa.Table.from_pylist([{"id": end["id"], "part": end["part"], "edits": edits} | {c: end[c] for c in RESULT[:6]}], pa.schema([("id", ends.schema.field("id").type), ("part", pa.int32()), ("edits", pa.list_(pa.string())), *((c, pa.int64()) for c in RESULT[:6])]))


def _hashed(kind: pa.DataType):
    """Results of conversations from rows in order; each stretch begins with a row that has its edits by state. Only one row is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, done = None, (), None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], kind), *(pa.array([v], pa.int64()) for v in sums), *(pa.array([v], pa.string()) for v in done.end())], names=["id", *RESULT])

        for b in batches:
            for this, edits, role, text, *rest in zip(*(b.column(c).to_pylist() for c in ("id", "edits", "role", "text", *RESULT[:6]))):
                if edits is None:
                    done.row(role, text)
                    continue
                if done is None or this != key:
                    if done is not None:
                        yield result()
                    key, sums, done = this, rest, Rebuilt()
                done.begin(edits)
        if done is not None:
            yield result()

    return run


def repair(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None = None) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    A conversation's rows stand in the order of turn, null first; rows of one turn by the MD5 of ``role:text``. A row is blank without a character that is no ASCII space, else a duplicate of an
    earlier one of its role and text, else truncated if its last such character is none of ``.!?``. Edits keep a row, give it the role user or assistant, delete it, or insert an empty turn; blank
    rows and duplicates must go. ``audit`` has the initials of the cheapest edits that make the initials of roles match ``(s?(ua)+)?``; the hash is of the turns that they leave, as
    ``role:text`` joined by newlines. ``gaps`` counts the numbers that turns leave out.

    Null role or text is one space, a role whose initial is not s, u or a cannot be kept, a turn that is no whole number is null; all rows with a null id are one conversation. Rows
    where ``present`` is not true only name their conversation; without other rows it has zeros, no edits and the hash of nothing. Repeated rows are duplicates. An empty table has no rows.
    Other columns are left out, and their names do not matter.

    Rows are dealt by ranges of conversation, turn and MD5, so a conversation of any size spreads over partitions. All but the first and last conversation of a partition are settled there.
    The rest, two a partition at most, are summed up by stretch, joined by costs, walked by stretch, and hashed as a stream, as a hash takes its bytes in order.
    """
    flag = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    spaces = "\\x20\\x09-\\x0D"
    read = rows.select(rows[conv].alias("id"), F.when(flag, rows[turn].try_cast("long")).alias("turn"), F.coalesce(rows[role].cast("string"), F.lit(" ")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit(" ")).alias("text"), flag.alias("present"))
    read = read.withColumns({"empty": ~F.col("text").rlike(f"[^{spaces}]"), "open": ~F.col("text").rlike(f"[.!?][{spaces}]*\\z"), "tie": F.md5(F.concat_ws(":", "role", "text").cast("binary")), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("row")]
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order)
    name = read.schema["id"].dataType.simpleString()
    kind = read.select("id").limit(0).toArrow().schema.field("id").type
    found = cut(dealt.select("id", *_ROW).mapInArrow(tidy(_stream(kind)), f"id {name}, {_TYPES}, part int, place long, {_ROW_TYPES}"))
    settled = found.filter("part is null").select("id", *RESULT)

    border = found.filter("part is not null").withColumn("mark", F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256))
    # Ids may be null and nulls must meet, so stretches and rows are joined by a text of the id.
    border = border.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")))
    earliest = border.filter("present").groupBy("conv", "mark").agg(F.min(F.struct("part", "place")).alias("earliest"))
    flags = border.select("id", "conv", "mark", "part", "place", "turn", F.substring("role", 1, 1).alias("role"), "empty", "open", "present").join(earliest, ["conv", "mark"], "left")
    again = F.coalesce(F.struct("part", "place") > F.col("earliest"), F.lit(False))
    flags = cut(flags.withColumn("again", again).drop("earliest", "mark"))
    sums = ", ".join(f"{c} long" for c in _SUMS)
    stretches = flags.groupBy("conv", "part").applyInArrow(_segment, f"id {name}, part int, {sums}, first_role string, last_role string, least_turn long, most_turn long, costs array<long>")
    stretches = stretches.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")))
    results = ", ".join(f"{c} long" for c in RESULT[:6])
    ends = stretches.groupBy("conv").applyInArrow(_chain, f"id {name}, part int, `end` array<long>, last boolean, {results}")
    ends = ends.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")))
    audits = flags.groupBy("conv", "part").cogroup(ends.groupBy("conv", "part")).applyInArrow(_audits, f"id {name}, part int, edits array<string>, {results}")
    none = [F.lit(None).cast("long").alias(c) for c in RESULT[:6]]
    lines = border.filter("present").select("id", "part", "place", F.lit(None).cast("array<string>").alias("edits"), "role", "text", *none)
    heads = audits.select("id", "part", F.lit(-1).cast("long").alias("place"), "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *RESULT[:6])
    ordered = lines.unionByName(heads).repartition(F.col("id")).sortWithinPartitions(F.col("id").asc_nulls_first(), "part", "place")
    return settled.unionByName(ordered.mapInArrow(tidy(_hashed(kind)), f"id {name}, {_TYPES}"))


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with faults, as (id, turn, role, text, present), by ``crc32(conv:turn) % 20``: 0 takes the row away, 1 its text, 2 its ``.!?``; 3 repeats it, 4 gives it to the user. Nulls are one space."""
    spaced = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    said = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("said", ".!?", "")).otherwise(F.col("said"))
    out = rows.select(rows[conv].alias("id"), rows[turn].alias("turn"), spaced(role).alias("role"), spaced(text).alias("said"), code.alias("code"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return out.select("id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("code") != 0).alias("present"), copies.alias("copy")).drop("copy")
