"""Conversation structure repair by a square-root checkpointed dynamic program.

A conversation's roles should read ``(s?(ua)+)?`` by initials: a system row at
most, then pairs of user and assistant. Rows may be kept, given another role,
deleted or inserted before; the cheapest edits that make the roles legal are
found from the back: a vector holds, for each of four states, the least cost of
the rest. Vectors are stored only at every root-of-n-th row; the walk from the
front, which takes the least letter among the edits that the vectors allow,
recomputes one block of them at a time.

A long conversation is cut into segments. What a segment does to a vector is a
4 x 4 matrix of least costs, so a small table of one matrix a segment gives the
vector at the end of each; the segments are then walked apart, from each state
that they may begin in, and a second small table tells which one it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ordered_parts, short_batches

#: Costs of the edits. A truncated row that is not deleted adds its own.
RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant row leads to, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Rows of a segment at most.
SEGMENT_ROWS = 1 << 16
#: ASCII white space, as the contracts define words.
SPACE = " \t\n\x0b\x0c\r"
#: Initials and faults make up a row's code, a letter from "a" on.
INITIALS, FAULTS = "sua?", ("fine", "blank", "duplicate", "truncated")
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}


# --- one row, one segment ---


def code(initial: int, fault: int) -> str:
    return chr(97 + initial * len(FAULTS) + fault)


def _parts(letter: str) -> tuple[int, int]:
    return divmod(ord(letter) - 97, len(FAULTS))


def _kept(state: int, initial: int) -> int | None:
    """The state after keeping a row of that initial; None if it may not stand there."""
    if initial == 0:
        return SYSTEM if state == START else None
    return initial + 1 if initial < 3 and NEXT[state] == initial + 1 else None


def _inserting(vector: list[float]) -> list[float]:
    """The least costs if rows may be inserted first."""
    for _ in range(3):
        vector = [min(v, INSERT + vector[NEXT[q]]) for q, v in enumerate(vector)]
    return vector


#: Costs at the end: nothing, or whole pairs.
END = tuple(_inserting([0, inf, inf, 0]))


def _edits(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after it) of a row, in order of letters."""
    initial, fault = _parts(letter)
    out = [("D", DELETE, state)]
    if fault not in (1, 2):
        extra = TRUNCATED if fault == 3 else 0
        after = _kept(state, initial)
        if after is not None:
            out.append(("K", extra, after))
        out.append(("R", RETITLE + extra, NEXT[state]))
    return out


@cache
def back(letter: str, vector: tuple) -> tuple[tuple, float]:
    """The vector before a row, less its least cost, and that cost. There are few
    such vectors, as no two costs differ by much."""
    costs = _inserting([min(c + vector[q] for _, c, q in _edits(letter, state)) for state in range(4)])
    least = min(costs)
    return tuple(c - least for c in costs), least


@cache
def forth(letter: str, vector: tuple, state: int) -> tuple[str, int]:
    """The least letters of cheapest edits before and of a row, and the state after."""
    costs, least = back(letter, vector)
    letters = ""
    while True:
        here = costs[state] + least
        options = [(e, q) for e, c, q in _edits(letter, state) if c + vector[q] == here]
        if INSERT + costs[NEXT[state]] == costs[state]:
            options.append(("I", NEXT[state]))
        edit, state = min(options)
        letters += edit
        if edit != "I":
            return letters, state


def matrix(codes: str) -> list[list[float]]:
    """Least costs [state before][state after] of a segment."""
    columns = []
    for state in range(4):
        vector, base = tuple(0 if q == state else inf for q in range(4)), 0
        for letter in reversed(codes):
            vector, least = back(letter, vector)
            base += least
        columns.append([base + v for v in vector])
    return [list(row) for row in zip(*columns, strict=True)]


def through(m: list[list[float]], vector: tuple) -> tuple:
    return tuple(min(c + v for c, v in zip(row, vector, strict=True)) for row in m)


def walk(codes: str, end: tuple, state: int, last: bool) -> tuple[float, str, int]:
    """(cost up to the end of all, edits, state after) of a segment from a state;
    ``end`` is the vector behind it. The last segment may insert at its end."""
    step = isqrt(len(codes)) + 1
    marks, vector, base = {}, end, 0
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % step == 0 or i == len(codes) - 1:
            marks[i // step] = vector
        vector, least = back(codes[i], vector)
        base += least
    cost, out = base + vector[state], []
    for block in range(-(-len(codes) // step)):
        letters = codes[block * step : (block + 1) * step]
        vectors = [marks[block]]
        for letter in reversed(letters[1:]):
            vectors.append(back(letter, vectors[-1])[0])
        for letter, vector in zip(letters, reversed(vectors), strict=True):
            edits, state = forth(letter, vector, state)
            out.append(edits)
    if last:
        while state not in (START, ASSISTANT):
            state = NEXT[state]
            out.append("I")
    return cost, "".join(out), state


def counts(codes: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and adjacent roles that do not follow."""
    kinds = [_parts(c) for c in codes]
    faults = [f for _, f in kinds]
    illegal = sum((a, b) not in LEGAL_PAIRS for (a, _), (b, _) in zip(kinds, kinds[1:], strict=False))
    return faults.count(1), faults.count(2), faults.count(3), illegal


# --- tasks ---

_TALLY = "blank long, duplicate long, truncated long, illegal long"
_WALKED = f"ck string, start long, {_TALLY}, cost long, audit string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one segment."""
    for batch in batches:
        found = [(walk(c, END, START, True), counts(c)) for c in batch["codes"].to_pylist()]
        columns = list(zip(*((*n, int(w[0]), w[1]) for w, n in found), strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([batch["ck"], batch["start"], *map(pa.array, columns)], ["ck", "start", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


_SUMMARY = f"ck string, start long, {_TALLY}, head string, tail string, m array<double>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch["codes"].to_pylist()
        columns = list(zip(*((*counts(c), c[0], c[-1], [float(v) for row in matrix(c) for v in row]) for c in codes), strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([batch["ck"], batch["start"], *map(pa.array, columns)], ["ck", "start", "blank", "duplicate", "truncated", "illegal", "head", "tail", "m"])


_CHAINED = f"ck string, start long, behind array<double>, last boolean, {_TALLY}, cost long"


def _chain(table: pa.Table) -> pa.Table:
    """One conversation's segment summaries (a row a segment): the vector behind each, and the sums."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    vector, behind = tuple(map(float, END)), []
    for r in reversed(rows):
        behind.append(list(vector))
        vector = through([r["m"][k : k + 4] for k in range(0, 16, 4)], vector)
    seams = sum((_parts(a["tail"])[0], _parts(b["head"])[0]) not in LEGAL_PAIRS for a, b in zip(rows, rows[1:], strict=False))
    total = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += seams
    return pa.Table.from_pylist(
        [{"ck": r["ck"], "start": r["start"], "behind": b, "last": r is rows[-1], **total, "cost": int(vector[START])} for r, b in zip(rows, reversed(behind), strict=True)],
        pa.schema([("ck", pa.string()), ("start", pa.int64()), ("behind", pa.list_(pa.float64())), ("last", pa.bool_()),
                   *((k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "cost"))]),
    )


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's edits from each state, and the state after."""
    for batch in batches:
        for ck, start, codes, behind, last in zip(*(batch[c].to_pylist() for c in ("ck", "start", "codes", "behind", "last")), strict=True):
            found = [walk(codes, tuple(behind), state, last) for state in range(4)]
            yield pa.RecordBatch.from_pydict(
                {"ck": [ck] * 4, "start": pa.array([start] * 4, pa.int64()), "state": pa.array(range(4), pa.int32()),
                 "after": pa.array([f[2] for f in found], pa.int32()), "audit": [f[1] for f in found]}
            )


def _follow(table: pa.Table) -> pa.Table:
    """The state in which each segment of one conversation begins."""
    after: dict[int, dict[int, int]] = {}
    for r in table.to_pylist():
        after.setdefault(r["start"], {})[r["state"]] = r["after"]
    state, out = START, []
    for start in sorted(after):
        out.append({"ck": table["ck"][0].as_py(), "start": start, "state": state})
        state = after[start][state]
    return pa.Table.from_pylist(out, pa.schema([("ck", pa.string()), ("start", pa.int64()), ("state", pa.int32())]))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired rows (ck, pos, at, role, text, edit) of segments in order: a
    segment's edits come first (kind 0), then its rows."""
    letters, state = iter(()), START
    for batch in batches:
        for ck, pos, kind, begins, audit, role, text in zip(*(batch[c].to_pylist() for c in ("ck", "pos", "kind", "state", "audit", "role", "text")), strict=True):
            if kind != 1:  # 0 begins a segment; 2 is behind the last one's rows
                if kind == 0:
                    letters, state = iter(audit), begins
                    continue
                for at, edit in enumerate(letters):
                    state = NEXT[state]
                    yield ck, pos, at, ROLES[state], "", edit
                continue
            at = 0
            for edit in letters:
                if edit == "K":
                    state = _kept(state, INITIALS.index(role[0]))
                    yield ck, pos, at, role, text, edit
                elif edit != "D":
                    state = NEXT[state]
                    yield ck, pos, at, ROLES[state], "" if edit == "I" else text, edit
                at += 1
                if edit != "I":
                    break


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["ck", "pos", "at", "role", "text", "edit"])

    for row in _applied(batches):
        rows.append(row)
        if len(rows) == 256:
            yield flush()
            rows.clear()
    yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired lines, one line in memory at a time."""
    done: list[tuple[str, str]] = []
    open_, digest = None, None
    for ck, _, _, role, text, _ in _applied(batches):
        if ck != open_:
            if digest:
                done.append((open_, digest.hexdigest()))
            open_, digest = ck, hashlib.sha256(f"{role}:{text}".encode())
        else:
            digest.update(f"\n{role}:{text}".encode())
    if digest:
        done.append((open_, digest.hexdigest()))
    yield pa.RecordBatch.from_pydict({"ck": pa.array([d[0] for d in done], pa.string()), "sha": pa.array([d[1] for d in done], pa.string())})


# --- the job ---


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by the hash of ``conv_id:turn``, as
    the contract words it. A null counts as one space, in the hash too."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), own(role_col).alias("role"), own(text_col).alias("text"),
        (F.crc32(F.concat(own(conv_col), F.lit(":"), own(turn_col))) % 20).alias("harm"),
    ).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("harm") == 3, 2).otherwise(1)
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("null"))


def _segment(rows: int, pos: str = "pos") -> Column:
    """The first position that a row's segment may hold."""
    return F.col(pos) - F.col(pos) % rows


class Repair:
    """The edits of every conversation of (conv_id, turn, role, text).

    Rows of a conversation are taken by turn, nulls first, then by role and
    text. Null roles and texts count as one space. A role counts by its first
    character; one that is empty or has another initial cannot be kept. A null
    conv_id is a conversation of its own. Rows alike in all columns are each
    other's duplicates. Only rows alike in conversation, turn, role and first
    ``PREFIX`` characters need stand in one task, which streams them.
    """

    PREFIX = 64

    def __init__(self, rows: DataFrame, segment_rows: int = SEGMENT_ROWS):
        short_batches(rows.sparkSession)
        blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
        d = rows.select("conv_id", _key(F.col("conv_id")).alias("ck"), "turn", blank("role").alias("role"), blank("text").alias("text"))
        d = d.withColumn("prefix", F.substring("text", 1, self.PREFIX))
        # Range keys hold no long text, as samples of them go to the driver.
        order = ordered_parts(d, "ck", "turn", "role", "prefix").sortWithinPartitions("ck", "turn", "role", "text").drop("prefix")
        end = F.rtrim("text", F.lit(SPACE))
        initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS[:3])) - 1
        initial = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial)
        self.rows = materialize(
            order.select(
                "*", F.monotonically_increasing_id().alias("pos"), F.md5(F.concat("role", F.lit("\x00"), "text")).alias("same"),
                initial.alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
            ),
            "repair-rows",
        )
        first = self.rows.groupBy("ck", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
        slim = self.rows.select("ck", "pos", "initial", "blank", "cut").join(first, "pos", "left")
        fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
        letter = F.char((97 + F.col("initial") * len(FAULTS) + fault).cast("int"))
        segments = (
            slim.select("ck", "pos", letter.alias("letter"), _segment(segment_rows).alias("segment"))
            .groupBy("ck", "segment")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "letter"))).alias("r"))  # at most segment_rows rows
            .select("ck", F.col("r")[0]["pos"].alias("start"), F.col("segment"), F.array_join(F.col("r.letter"), "").alias("codes"))
        )
        segments = materialize(segments, "repair-segments")
        many = segments.groupBy("ck").count().where("count > 1").select("ck")
        many = materialize(many, "repair-long")
        whole = segments.join(many, "ck", "left_anti").select("ck", "start", "codes").mapInArrow(_whole, _WALKED)
        long = segments.join(many, "ck", "left_semi").select("ck", "start", "codes")
        chained = materialize(long.mapInArrow(_summaries, _SUMMARY).groupBy("ck").applyInArrow(_chain, _CHAINED), "repair-chain")
        walks = materialize(
            long.join(chained.select("ck", "start", "behind", "last"), ["ck", "start"]).mapInArrow(_walks, "ck string, start long, state int, after int, audit string"),
            "repair-walks",
        )
        path = walks.select("ck", "start", "state", "after").groupBy("ck").applyInArrow(_follow, "ck string, start long, state int")
        chosen = walks.join(path, ["ck", "start", "state"]).join(chained.drop("behind"), ["ck", "start"])
        tally = ["blank", "duplicate", "truncated", "illegal", "cost"]
        self.edits = materialize(
            whole.select("ck", "start", F.lit(START).alias("state"), F.lit(True).alias("last"), *tally, "audit").unionByName(
                chosen.select("ck", "start", "state", "last", *tally, "audit")
            ),
            "repair-edits",
        )
        self.segment_rows = segment_rows

    def _merged(self, *keys: str) -> DataFrame:
        """Segments' edits and rows, dealt by ``keys`` and sorted."""
        rows = self.rows.select("ck", "pos", F.lit(1).alias("kind"), F.lit(0).alias("state"), F.lit("").alias("audit"), "role", "text")
        none = (F.lit("").alias("role"), F.lit("").alias("text"))
        begins = self.edits.select("ck", F.col("start").alias("pos"), F.lit(0).alias("kind"), "state", "audit", *none)
        ends = self.edits.where("last").select(
            "ck", (_segment(self.segment_rows, "start") + self.segment_rows - 1).alias("pos"),
            F.lit(2).alias("kind"), F.lit(0).alias("state"), F.lit("").alias("audit"), *none,
        )
        merged = begins.unionByName(rows).unionByName(ends).withColumn("segment", _segment(self.segment_rows))
        merged = merged.repartition(*keys).sortWithinPartitions("ck", "segment", "pos", "kind")
        return merged.drop("segment")

    def repaired(self) -> DataFrame:
        """(conv_id, pos, at, role, text, edit): the repaired rows, in order of pos and at;
        inserted ones have an empty text. A long conversation is repaired by many tasks."""
        out = self._merged("ck", "segment").mapInArrow(_repaired, "ck string, pos long, at int, role string, text string, edit string")
        names = self.rows.groupBy("ck").agg(F.first("conv_id").alias("conv_id"))
        return out.join(names, "ck").select("conv_id", "pos", "at", "role", "text", "edit")

    def digests(self) -> DataFrame:
        """(ck, sha) of each conversation with a repaired row. One SHA-256 is one
        sequence of bytes, so a conversation's lines stream through one task."""
        return self._merged("ck").mapInArrow(_digests, "ck string, sha string")


def report(rows: DataFrame, convs: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), one row for each conversation of ``rows`` and of ``convs``.

    A conversation of ``convs`` without rows has zeros, no edits and the hash of
    nothing. Gaps beyond the range of a long are clipped to it. An empty table
    gives an empty result.
    """
    done = Repair(rows, segment_rows)
    turns = done.rows.groupBy("ck").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.countDistinct("turn").alias("n"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.least(F.coalesce(big("high") - big("low") + 1 - big("n"), F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    tally = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audits = done.edits.groupBy("ck").agg(
        *(F.max(c).alias(c) for c in tally), F.array_sort(F.collect_list(F.struct("start", "audit"))).alias("a")
    ).select("ck", *tally, F.array_join(F.col("a.audit"), "").alias("audit"))
    every = (convs if convs is not None else rows).select("conv_id").distinct().withColumn("ck", _key(F.col("conv_id")))
    joined = every.join(turns.select("ck", gaps.alias("gaps")), "ck", "left").join(audits, "ck", "left").join(done.digests(), "ck", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *tally)]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The same in SQL (DuckDB): a walk from the front that keeps, for each state, the
    least (cost, edits) and the lines that they give."""
    moves = []
    for state in range(4):
        for initial in range(4):
            for fault in range(4):
                least: dict[tuple, float] = {}
                at, lines, edits = state, "", ""
                for n in range(3):
                    for e, c, after in _edits(code(initial, fault), at):
                        row = "" if e == "D" else "k" if e == "K" else ROLES[after][0]
                        least.setdefault((edits + e, lines + row, after), n * INSERT + c)
                    at = NEXT[at]
                    edits, lines = edits + "I", lines + ROLES[at][0].upper()
                moves += [f"({state}, {initial}, {fault}, '{e}', '{lines}', {c}, {q})" for (e, lines, q), c in least.items()]
    ends = ", ".join(f"({q}, '{e}', {c}, {t})" for q, e, c, t in (
        (START, "", 0, "''"), (ASSISTANT, "", 0, "''"), (USER, "I", INSERT, "chr(10) || 'assistant:'"), (SYSTEM, "II", 2 * INSERT, "chr(10) || 'user:' || chr(10) || 'assistant:'")))
    line = """
      CASE WHEN l[1] = 'U' THEN chr(10) || 'user:' WHEN l[1] = 'A' THEN chr(10) || 'assistant:' ELSE '' END
      || CASE WHEN l[2] = 'U' THEN chr(10) || 'user:' WHEN l[2] = 'A' THEN chr(10) || 'assistant:' ELSE '' END
      || CASE right(l, 1) WHEN 'k' THEN chr(10) || role || ':' || text WHEN 'u' THEN chr(10) || 'user:' || text WHEN 'a' THEN chr(10) || 'assistant:' || text ELSE '' END"""
    byte = "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
harmed AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || [unicode(c)::BIGINT FOR c IN string_split(k, '')],
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], {byte})), 4294967295::BIGINT) % 20 AS harm
  FROM keyed),
d AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harmed, range(CASE WHEN harm = 3 THEN 2 ELSE 1 END) WHERE harm <> 0),
o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS initial, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM d),
f AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, initial,
         CASE WHEN t = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior
  FROM o),
moves(q, initial, fault, e, l, c, q2) AS (VALUES {", ".join(moves)}),
ends(q, e, c, t) AS (VALUES {ends}),
w AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS b FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT w.conv_id, w.i + 1, q2, min({{'c': w.b.c + m.c, 'e': w.b.e || m.e, 't': w.b.t || {line}}})
  FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1 JOIN moves m ON m.q = w.q AND m.initial = f.initial AND m.fault = f.fault
  GROUP BY w.conv_id, w.i, q2),
tally AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (prior IS NOT NULL AND (prior, initial) NOT IN ((0, 1), (1, 2), (2, 1))) AS illegal, max(i) AS n
  FROM f GROUP BY conv_id),
best AS (
  SELECT y.conv_id, min({{'c': w.b.c + ends.c, 'e': w.b.e || ends.e, 't': w.b.t || ends.t}}) AS b
  FROM tally y JOIN w ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = y.n JOIN ends USING (q) GROUP BY y.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN tally ON a.conv_id IS NOT DISTINCT FROM tally.conv_id LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id
"""
