"""Repair of conversation structure as a lightest derivation.

Repaired conversations follow ``(s?(ua)+)?`` in the initials of their roles. Repairing is a weighted deduction: axioms are the edits of
single rows (keep, change the role, delete) and the insertion of a turn; an item ``at i in q`` says that the first i rows have been
dealt with and the automaton is in state q; a hyperedge joins such an item and an edit of row i to ``at i+1 in q'``, or such an item
and an insertion to ``at i in q'``. Values are (cost, audit), where the audit strings the initials of the edits together. Joining adds
costs and concatenates audits, which never makes a value smaller and keeps the order of two derivations of one item (equal costs
over the same rows never leave one audit a proper prefix of another, as every insertion costs). So Knuth's algorithm applies: the
agenda pops the smallest value, which is final for its item, until the goal item is popped.

A conversation is one group of rows. One with more than LONG_ROWS rows or LONG_BYTES of text is never held by a task: its rows are put
in order by ranges, cut into segments, each segment gets the lightest derivation from every state to every state (again items: spans),
the spans are joined along the conversation, and the repaired text is hashed in a stream, as a hash must be.

Rows are taken by turn, nulls first, rows of one turn by role and text. Defined results: a null role or text reads as one space, a null
conversation id is a conversation of its own; equal rows are duplicates; an empty table gives an empty table; texts may be of any
length; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulon.llm.shared import ship, written

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
UNFINISHED = 5  # cost of a truncated row that stays
# States: what stands last. A conversation may end where nothing stands yet or after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = "0sua"
FINAL = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"

CHUNK = 128  # rows of one agenda; longer conversations join spans
LONG_ROWS, LONG_BYTES = 20_000, 1 << 26
SEGMENT_ROWS = 8_192

Value = tuple[int, str]
Item = tuple[str, int, str]


def lightest(axioms: dict[Item, Value], deduce: Callable[[Item, dict[Item, Value]], Iterable[tuple[Item, Value]]],
             goal: Item | None = None) -> dict[Item, Value]:
    """Knuth's generalisation of Dijkstra's algorithm: final values of items, up to the goal or of all items.

    ``deduce(item, final)`` gives the heads, with their values, of all hyperedges whose last antecedent to become final is ``item``.
    """
    agenda = [(value, item) for item, value in axioms.items()]
    heapq.heapify(agenda)
    final: dict[Item, Value] = {}
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if item == goal:
            break
        for head, found in deduce(item, final):
            if head not in final:
                heapq.heappush(agenda, (found, head))
    return final


def row_edits(symbol: str) -> dict[str, Value]:
    """What a row may become, by the role that it then has ("-": none). Symbols: role initial (``o``: another one), upper case if
    truncated, or ``x``, a row that must go."""
    out = {"-": (DELETE, "D")}
    if symbol != "x":
        extra = UNFINISHED if symbol.isupper() else 0
        out |= {role: (REROLE + extra, "R") for role in ROLES}
        if symbol.lower() in "sua":
            out[symbol.lower()] = (KEEP + extra, "K")
    return out


def _joined(a: Value, b: Value) -> Value:
    return a[0] + b[0], a[1] + b[1]


def _system(symbols: str, state: str) -> tuple[dict[Item, Value], Callable]:
    """Axioms and deductions of repairing these rows, begun in a state."""
    rows = [row_edits(s) for s in symbols]
    axioms: dict[Item, Value] = {("at", 0, state): (0, "")}
    for i, edits in enumerate(rows):
        axioms |= {("edit", i, role): value for role, value in edits.items()}
    axioms |= {("insert", -1, role): (INSERT, "I") for role in ROLES}

    def deduce(item: Item, final: dict[Item, Value]) -> Iterator[tuple[Item, Value]]:
        kind, i, mark = item
        if kind == "at":
            if i < len(rows):
                for role in rows[i]:
                    after = mark if role == "-" else NEXT.get((mark, role))
                    if after and ("edit", i, role) in final:
                        yield ("at", i + 1, after), _joined(final[item], final["edit", i, role])
            for role in ROLES:
                if (mark, role) in NEXT and ("insert", -1, role) in final:
                    yield ("at", i, NEXT[mark, role]), _joined(final[item], final["insert", -1, role])
            if i == len(rows) and mark in FINAL:
                yield ("goal", i, ""), final[item]
        elif kind == "edit":
            for state in "0sua":
                after = state if mark == "-" else NEXT.get((state, mark))
                if after and ("at", i, state) in final:
                    yield ("at", i + 1, after), _joined(final["at", i, state], final[item])
        elif kind == "insert":
            for at, value in [(k, v) for k, v in final.items() if k[0] == "at" and (k[2], mark) in NEXT]:
                yield ("at", at[1], NEXT[at[2], mark]), _joined(value, final[item])

    return axioms, deduce


@functools.lru_cache(50_000)
def repaired(symbols: str) -> Value:
    """The lightest derivation of the goal over a short conversation."""
    return lightest(*_system(symbols, START), goal=("goal", len(symbols), ""))["goal", len(symbols), ""]


@functools.lru_cache(5_000)
def spans(symbols: str, state: str) -> tuple[tuple[str, Value], ...]:
    """The lightest derivations that lead over these rows from one state to each other state."""
    final = lightest(*_system(symbols, state))
    return tuple((s, final["at", len(symbols), s]) for s in "0sua" if ("at", len(symbols), s) in final)


def joined_spans(reached: dict[str, Value], over: Callable[[str], Iterable[tuple[str, Value]]]) -> tuple[dict[str, Value], dict[str, str]]:
    """One more span behind what has been reached: the lightest value of each state, and the state it came from."""
    out: dict[str, Value] = {}
    origin: dict[str, str] = {}
    for state, value in reached.items():
        for end, found in over(state):
            total = _joined(value, found)
            if end not in out or total < out[end]:
                out[end], origin[end] = total, state
    return out, origin


def _over_chunks(symbols: str, state: str) -> dict[str, Value]:
    reached = {state: (0, "")}
    for at in range(0, len(symbols), CHUNK):
        reached, _ = joined_spans(reached, functools.partial(spans, symbols[at:at + CHUNK]))
    return reached


def repair(symbols: str) -> Value:
    """(cost, audit) of the cheapest repair, the smallest audit of equal costs."""
    if len(symbols) <= CHUNK:
        return repaired(symbols)
    reached = _over_chunks(symbols, START)
    return min(reached[s] for s in FINAL if s in reached)


class Rewriter:
    """Applies an audit to rows that come one by one."""

    def __init__(self):
        self.state = START

    def _own(self) -> str:
        role = "a" if self.state == USER else "u"
        self.state = NEXT[self.state, role]
        return ROLES[role]

    def insertion(self) -> tuple[str, str]:
        return self._own(), ""

    def apply(self, edit: str, role: str, text: str) -> tuple[str, str] | None:
        if edit == "D":
            return None
        if edit == "R":
            return self._own(), text
        self.state = NEXT[self.state, role[:1]]
        return role, text


def rewritten(edits: Iterator[str], rows: Iterable[tuple[str, str]], rewriter: Rewriter, last: bool = True) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay, in order; with ``last`` what is inserted behind the last row is given too."""
    for role, text in rows:
        for edit in edits:
            turn = rewriter.insertion() if edit == "I" else rewriter.apply(edit, role, text)
            if turn:
                yield edit, *turn
            if edit != "I":
                break
    if last:
        for edit in edits:
            yield edit, *rewriter.insertion()


def symbol_of(role: str, text: str, seen: bool) -> tuple[str, str]:
    """(symbol, fault) of a row; the fault is "", "blank", "duplicate" or "truncated"."""
    visible = text.rstrip(BLANKS)
    if not visible:
        return "x", "blank"
    if seen:
        return "x", "duplicate"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (initial, "") if visible[-1] in ".!?" else (initial.upper(), "truncated")


def legal(before: str, after: str) -> bool:
    return before[:1] + after[:1] in ("su", "ua", "au")


# ---- tables -------------------------------------------------------------------------------------------------------------

SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def read_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times): the rows as ``repair_conversations`` takes them; each one counts once."""
    return conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("times"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by the checksum of ``conv_id:turn``: 0 modulo 20 drops the row, 1 empties its text, 2 takes the ends of
    its sentences, 3 repeats it, 4 makes it the user's."""
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    return turns.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def repair_conversations(turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES,
                         segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``turns`` are (conv_id, turn, role, text, times); a row with ``times`` 0 only says that there is such a conversation.
    """
    ship(turns.sparkSession)
    short, long = _divided(turns, long_rows, long_bytes)
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL(SUMMARY).fields])
    out = _in_order(short).mapInArrow(_by(_summaries, schema), schema)
    return out if long is None else out.unionByName(_long_summaries(long, schema, segment_rows))


def repaired_turns(turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, turn by turn."""
    ship(turns.sparkSession)
    short, long = _divided(turns, long_rows, long_bytes)
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL("place long, edit string, role string, text string").fields])
    out = _in_order(short).mapInArrow(_by(_turns, schema), schema)
    if long is None:
        return out
    segments = _Segments(long, segment_rows)
    return out.unionByName(segments.streamed().mapInArrow(_by(_streamed_turns, schema), schema))


def _divided(turns: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations that one task can hold, and the rows of the others if there are any."""
    sizes = turns.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text") * F.col("times")).alias("bytes"))
    long = written(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("long_id")))
    if long.isEmpty():
        return turns, None
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return turns.join(long, same, "left_anti"), turns.join(long, same, "left_semi")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", *_order())


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows of turn, role, text) of consecutive rows with one id."""
    rows: list[tuple] = []
    current, begun = None, False
    for batch in batches:
        for conv, turn, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times"))):
            if begun and conv != current:
                yield current, rows
                rows = []
            current, begun = conv, True
            rows += [(turn, role, text)] * times
    if begun:
        yield current, rows


def _judged(rows: list[tuple]) -> tuple[str, dict[str, int]]:
    """The symbols of a conversation, and its faults."""
    faults, seen, symbols = {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, role, text in rows:
        symbol, fault = symbol_of(role, text, (role, text) in seen)
        seen.add((role, text))
        faults[fault] += 1
        symbols.append(symbol)
    return "".join(symbols), faults


def _digest(lines: Iterable[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest()


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 1_000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == size or weight > chars:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _by(function: Callable, schema: T.StructType) -> Callable:
    """The function of batches, told the Arrow schema of its result."""
    return functools.partial(function, schema=to_arrow_schema(schema))


def _summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def results() -> Iterator[tuple]:
        for conv, rows in _conversations(batches):
            symbols, faults = _judged(rows)
            cost, audit = repair(symbols)
            turns = {turn for turn, _, _ in rows if turn is not None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            illegal = sum(not legal(a[1], b[1]) for a, b in zip(rows, rows[1:]))
            lines = rewritten(iter(audit), ((role, text) for _, role, text in rows), Rewriter())
            yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, _digest(lines)

    yield from _batched(results(), schema)


def _turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def results() -> Iterator[tuple]:
        for conv, rows in _conversations(batches):
            _, audit = repair(_judged(rows)[0])
            for place, line in enumerate(rewritten(iter(audit), ((role, text) for _, role, text in rows), Rewriter())):
                yield conv, place, *line

    yield from _batched(results(), schema)


# ---- long conversations -------------------------------------------------------------------------------------------------


class _Segments:
    """Long conversations, put in order and cut: the cheapest repair of each, and their rows with the edits of each segment."""

    def __init__(self, turns: DataFrame, rows: int):
        spark, conv = turns.sparkSession, turns.schema["conv_id"]
        copies = turns.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).withColumn(
            "row", F.monotonically_increasing_id())
        keys = [F.col("conv_id"), *_order(), F.col("row")]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Numbers given after the sort rise with the order within and across the ranges.
        self.rows = written(copies.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("copy", "row").withColumn(
            "seq", F.monotonically_increasing_id()))
        first = self.rows.groupBy("conv_id", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).agg(F.min("seq").alias("seq"))
        judged = self.rows.join(first.select("seq", F.lit(True).alias("is_first")), "seq", "left")
        ends = F.rtrim("text", F.lit(BLANKS))
        initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
        fault = F.when(ends == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(
            ~F.right(ends, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
        symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(
            F.col("initial"))
        # Numbers of different ranges lie far apart, so a segment holds rows of one range, at most so many of them.
        narrow = judged.select("conv_id", "turn", "seq", fault.alias("fault"), initial.alias("initial")).select(
            "conv_id", "turn", "seq", "fault", F.substring("initial", 1, 1).alias("initial"), symbol.alias("symbol"),
            F.floor(F.col("seq") / rows).alias("segment"))
        self.narrow = written(narrow)
        schema = T.StructType([conv, *T.StructType.fromDDL(
            "segment long, first_seq long, head string, tail string, illegal long, spans array<struct<start: string, end: string, "
            "cost: long, audit: string>>").fields])
        self.segments = written(self.narrow.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "seq")
                                .mapInArrow(_by(_segment_spans, schema), schema))
        joined = T.StructType([conv, *T.StructType.fromDDL(
            "cost long, audit string, illegal long, path array<struct<segment: long, start: string, end: string>>").fields])
        self.repairs = written(self.segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
                               .mapInArrow(_by(_joined_segments, joined), joined))

    def streamed(self) -> DataFrame:
        """The rows in order; the first one of each segment carries the segment's edits."""
        path = self.repairs.select(F.col("conv_id").alias("c"), F.explode("path").alias("p")).select("c", "p.*")
        chosen = self.segments.join(path, F.col("conv_id").eqNullSafe(F.col("c")) & (self.segments["segment"] == path["segment"])).select(
            F.col("first_seq").alias("seq"),
            F.filter("spans", lambda s: (s["start"] == F.col("start")) & (s["end"] == F.col("end")))[0]["audit"].alias("edits"))
        return self.rows.join(chosen, "seq", "left").select("conv_id", "seq", "role", "text", "edits").repartition(
            "conv_id").sortWithinPartitions("conv_id", "seq")


def _long_summaries(turns: DataFrame, schema: T.StructType, segment_rows: int) -> DataFrame:
    segments = _Segments(turns, segment_rows)
    counts = segments.narrow.groupBy("conv_id", "turn").agg(*(
        F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated"))).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    hashed = T.StructType([T.StructField("h", schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    hashes = segments.streamed().mapInArrow(_by(_streamed_hashes, hashed), hashed)
    repairs = segments.repairs.select(F.col("conv_id").alias("r"), "cost", "audit", "illegal")
    return counts.join(repairs, F.col("conv_id").eqNullSafe(F.col("r"))).join(hashes, F.col("conv_id").eqNullSafe(F.col("h"))).select(*schema.names)


def _grouped(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows with the same key; each group must be read before the next one."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return itertools.groupby(rows, key=lambda row: tuple(row[k] for k in key))


def _segment_spans(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (conv, segment), group in _grouped(batches, ("conv_id", "segment")):
        rows = list(group)  # narrow, and bounded in number
        symbols, initials = "".join(r["symbol"] for r in rows), [r["initial"] for r in rows]
        illegal = sum(not legal(a, b) for a, b in zip(initials, initials[1:]))
        found = [{"start": start, "end": end, "cost": cost, "audit": audit}
                 for start in "0sua" for end, (cost, audit) in _over_chunks(symbols, start).items()]
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "segment": segment, "first_seq": rows[0]["seq"], "head": initials[0],
                                           "tail": initials[-1], "illegal": illegal, "spans": found}], schema)


def _joined_segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (conv,), group in _grouped(batches, ("conv_id",)):
        reached, illegal, tail, steps = {START: (0, "")}, 0, None, []
        for row in group:
            by_start: dict[str, list] = {}
            for s in row["spans"]:
                by_start.setdefault(s["start"], []).append((s["end"], (s["cost"], s["audit"])))
            reached, origin = joined_spans(reached, lambda state: by_start.get(state, ()))
            steps.append((row["segment"], origin))
            illegal += row["illegal"] + (tail is not None and not legal(tail, row["head"]))
            tail = row["tail"]
        state = min((s for s in FINAL if s in reached), key=reached.__getitem__)
        cost, audit = reached[state]
        path = []
        for segment, origin in reversed(steps):
            path.append({"segment": segment, "start": origin[state], "end": state})
            state = origin[state]
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "cost": cost, "audit": audit, "illegal": illegal, "path": path}], schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str, str]]]]:
    """Each conversation with its repaired turns, which come one by one."""

    def lines(group: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
        rewriter, edits = Rewriter(), iter("")
        for row in group:
            if row["edits"] is not None:
                yield from rewritten(edits, (), rewriter)
                edits = iter(row["edits"])
            yield from rewritten(edits, [(row["role"], row["text"])], rewriter, last=False)
        yield from rewritten(edits, (), rewriter)

    for (conv,), group in _grouped(batches, ("conv_id",)):
        yield conv, lines(group)


def _streamed_hashes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for conv, lines in _streamed(batches):
        digest = hashlib.sha256()
        for place, (_, role, text) in enumerate(lines):
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield _batch([(conv, digest.hexdigest())], schema)


def _streamed_turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = ((conv, place, *line) for conv, lines in _streamed(batches) for place, line in enumerate(lines))
    yield from _batched(rows, schema)
