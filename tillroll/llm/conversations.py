"""Repair of damaged conversations by an auction for shortest paths.

A conversation's rows in order of turn are a line of lattice layers with four
nodes each: what the output so far allows next. Keeping, reroling, deleting or
inserting a row is an arc with a whole-number cost. The cheapest path from the
first layer to the end is found by the auction algorithm: every node has a
price, at most the price of any successor plus the arc to it; a path grows from
the start, extends over an arc that is tight, or contracts by a node after
raising that node's price to the best that its successors offer. When the path
reaches the end, the start's price is the least cost, and every arc of every
cheapest path is tight; tracing tight arcs by the least letter first gives the
least of the cheapest edit strings.

Spark deals the work. Rows are range-partitioned by conversation and turn, so a
conversation with a third of all rows is cut over many tasks, and cut into
segments of ``SEGMENT`` places at most. Each segment, on its own, finds the least
cost from every entry node to every exit node. One pass over the segments of a
conversation (16 numbers each, streamed, none kept) from last to first adds them
up to the cost that is still to come at each segment's end; with that, segments
trace their edits on their own, for each entry node; one pass from first to last
picks the entry nodes. Inside a segment the auction goes over blocks of
``BLOCK`` rows from the last to the first, with the later block's prices as
given, so no path is ever long; solved blocks are kept, as most recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare, saved

#: Places of a segment as a power of two, rows of a block.
SEGMENT_BITS, BLOCK = 12, 16
#: White space, the ends of sentences, costs.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL_PAIRS = ("su", "ua", "au")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

#: Nodes of a layer: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NODES = range(4)
#: Node reached by keeping a row of the role's initial, and the turn that may follow by insertion or reroling.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
#: What is still to pay after the last row: nothing, or insertions up to an assistant.
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40

#: A row's letter: its role's initial (o for any other), in upper case if the row
#: is truncated; d if it must go. A layer's arcs follow from the letter alone.
Prices = tuple[int, int, int, int]


def _arcs(letter: str, node: int) -> Iterator[tuple[str, bool, int, int]]:
    """(edit, whether it takes the row, node, cost), least edit letter first."""
    extra = TRUNCATED if letter.isupper() else 0
    yield "D", True, node, DELETE
    yield "I", False, NEXT[node], INSERT
    if letter != "d":
        kept = KEPT.get((letter.lower(), node))
        if kept is not None:
            yield "K", True, kept, extra
        yield "R", True, NEXT[node], REROLE + extra


@lru_cache(maxsize=1 << 15)
def _block(letters: str, ends: Prices) -> tuple[Prices, tuple]:
    """Least cost from each entry node of a block to the end, where ``ends`` is what
    is still to pay after it, and for each entry node (edits, exit node)."""
    n = len(letters)
    goal = (n + 1, 0)
    arcs = {(i, s): [(edit, (i + took, to), cost) for edit, took, to, cost in _arcs(letters[i], s)] for i in range(n) for s in NODES}
    arcs |= {(n, s): [("", goal, ends[s])] if ends[s] < NEVER else [] for s in NODES}
    # Nodes from which the end can be reached; the others are no part of the lattice.
    live, grew = {goal}, True
    while grew:
        grew = False
        for node in sorted(arcs, reverse=True):
            if node not in live and any(to in live for _, to, _ in arcs[node]):
                live.add(node)
                grew = True
    arcs = {node: [a for a in out if a[1] in live] for node, out in arcs.items() if node in live}
    # Prices to begin with: the least that the rows still to come and the end cost.
    # Arcs that take a row cost at least that row's least, so no price is too high.
    least = [min(cost for s in NODES for _, took, _, cost in _arcs(x, s) if took) for x in letters]
    floor = min(ends)
    price = {node: sum(least[node[0]:]) + floor for node in arcs}
    price[goal] = 0
    for entry in NODES:
        if (0, entry) in live:
            _auction(arcs, price, (0, entry), goal)
    # Among tight arcs, those from which tight arcs lead on to the end.
    tight = {node: [a for a in out if price[node] == a[2] + price[a[1]]] for node, out in arcs.items()}
    leads, grew = {goal}, True
    while grew:
        grew = False
        for node in sorted(tight, reverse=True):
            if node not in leads and any(to in leads for _, to, _ in tight[node]):
                leads.add(node)
                grew = True
    traces = []
    for entry in NODES:
        node, edits = (0, entry), []
        if node not in live:
            traces.append(("", -1))
            continue
        while node[0] < n:
            edit, node = next((edit, to) for edit, to, _ in tight[node] if to in leads)
            edits.append(edit)
        traces.append(("".join(edits), node[1]))
    return tuple(price.get((0, s), NEVER) for s in NODES), tuple(traces)


def _auction(arcs: dict, price: dict, start: tuple, goal: tuple) -> None:
    """Raises ``price`` until a path of tight arcs leads from start to goal."""
    path = [start]
    while path[-1] != goal:
        node = path[-1]
        offer, to = min((cost + price[to], to) for _, to, cost in arcs[node])
        if price[node] < offer:
            price[node] = offer
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def _settled(letters: str, ends: Prices) -> tuple[Prices, tuple]:
    """``_block`` with prices relative to the least one, so that blocks recur."""
    least = min(ends)
    prices, traces = _block(letters, tuple(e - least if e < NEVER else NEVER for e in ends))
    return tuple(p + least if p < NEVER else NEVER for p in prices), traces


def solve(letters: str, ends: Prices = AT_END) -> tuple[Prices, list]:
    """Least cost from each entry node of a run of rows to the end, and the traces
    of its blocks from the last one to the first."""
    traces = []
    for at in reversed(range(0, len(letters), BLOCK)):
        ends, trace = _settled(letters[at:at + BLOCK], ends)
        traces.append(trace)
    return ends, traces


def walk(traces: list, entry: int) -> tuple[str, int]:
    """(edits, exit node) of a run entered at ``entry``."""
    out = []
    for trace in reversed(traces):
        edits, entry = trace[entry]
        out.append(edits)
        if entry < 0:
            return "", -1
    return "".join(out), entry


def best_edits(letters: str) -> tuple[int, str]:
    """Least cost and the least of the cheapest edit strings of a whole conversation."""
    prices, traces = solve(letters)
    edits, node = walk(traces, START)
    return prices[START], edits + "I" * (AT_END[node] // INSERT)


# --- the same over Spark ---------------------------------------------------

def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls of the last two as one space) in order of
    conversation, turn (nulls first), role and text, with ``_at``: a number that
    rises in that order. Kept in the checkpoint folder, so the numbers stay."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    by = ["conv_id", "turn", "role", "text"]
    return saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """Of rows of ``ordered``: conv_id, _at, initial, fault (blank, duplicate,
    truncated or null)."""
    shown = F.rtrim("text", F.lit(SPACE))
    # The first of equal rows of a conversation, by a digest of the text: a hot
    # text is combined before the shuffle, and its places join one to one.
    firsts = (rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("_digest"))
              .agg(F.min("_at").alias("_first")).select("_first"))
    marks = rows.select("conv_id", "_at", F.substring("role", 1, 1).alias("initial"), (shown == "").alias("_blank"),
                        (~F.substring(shown, -1, 1).isin(*ENDS)).alias("_cut"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated")
    return marks.join(firsts, F.col("_at") == F.col("_first"), "left").select("conv_id", "_at", "initial", fault.alias("fault"))


def _segments(marked: DataFrame, bits: int) -> DataFrame:
    """A row a segment: conv_id, segment, letters, counts, first and last initial."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    cells = F.array_sort(F.collect_list(F.struct("_at", letter.alias("letter"), known.alias("known"))))
    found = marked.groupBy("conv_id", F.shiftright("_at", bits).alias("segment")).agg(
        cells.alias("_cells"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    return found.select("conv_id", "segment", "blank", "duplicate", "truncated",
                        F.array_join(F.col("_cells.letter"), "").alias("letters"), F.array_join(F.col("_cells.known"), "").alias("initials"))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, fn, fields: T.StructType) -> DataFrame:
    """``fn`` over the rows of each partition, as dictionaries, in their order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(fields)
    return df.mapInArrow(lambda batches: _batched(fn(_rows_of(batches)), schema), fields)


def _transfer(rows: Iterator[dict]) -> Iterator[dict]:
    """Adds the least cost from each entry node (row) to each exit node (column)."""
    for row in rows:
        columns = [solve(row["letters"], tuple(0 if s == out else NEVER for s in NODES))[0] for out in NODES]
        yield row | {"costs": [columns[out][entry] for entry in NODES for out in NODES]}


def _still_to_pay(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows by conversation, last segment first: adds the cost that is still to come
    at the segment's end, whether it is the last, and the cost from its start."""
    conv, ends = object(), AT_END
    for row in rows:
        final = row["conv_id"] != conv
        if final:
            conv, ends = row["conv_id"], AT_END
        costs = row.pop("costs")
        row |= {"ends": list(ends), "final": final}
        ends = tuple(min(NEVER, *(costs[4 * s + e] + ends[e] for e in NODES)) for s in NODES)
        yield row | {"cost": ends[START]}


def _trace(rows: Iterator[dict]) -> Iterator[dict]:
    """Adds the edits and the exit node for each entry node."""
    for row in rows:
        traces = solve(row["letters"], tuple(row.pop("ends")))[1]
        found = [walk(traces, s) for s in NODES]
        yield row | {"edits": [e for e, _ in found], "exits": [x for _, x in found]}


def _picked(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows by conversation, first segment first: keeps the edits of the entry node
    that the segments before lead to, with the insertions after the last row, and
    counts the illegal pairs of roles, those across the border among them."""
    conv, node, before = object(), START, ""
    for row in rows:
        if row["conv_id"] != conv:
            conv, node, before = row["conv_id"], START, ""
        edits, exits, initials = row.pop("edits"), row.pop("exits"), before + row.pop("initials")
        illegal = sum(initials[i:i + 2] not in LEGAL_PAIRS for i in range(len(initials) - 1))
        out = exits[node]
        closing = "I" * (AT_END[out] // INSERT) if row.pop("final") else ""
        yield row | {"entry": node, "audit": edits[node] + closing, "illegal": illegal}
        node, before = out, initials[-1]


def audits(marked: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """A row for each segment of the rows of ``faults``: conv_id, segment, counts of
    faults, illegal, cost (from here to the conversation's end, if entered at the
    start: right for its first segment), entry node, audit."""
    conv = marked.schema["conv_id"]
    long, text, number, flag = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()
    counts = [T.StructField(c, long) for c in ("segment", "blank", "duplicate", "truncated")]
    both = [T.StructField("letters", text), T.StructField("initials", text)]

    def schema(*more: tuple[str, T.DataType], keep: list = both) -> T.StructType:
        return T.StructType([conv, *counts, *keep, *[T.StructField(n, t) for n, t in more]])

    with_costs = _mapped(_segments(marked, segment_bits), _transfer, schema(("costs", T.ArrayType(long))))
    back = with_costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment"))
    paid = _mapped(back, _still_to_pay, schema(("ends", T.ArrayType(long)), ("final", flag), ("cost", long)))
    traced = _mapped(paid.repartition("conv_id", "segment"), _trace,
                     schema(("final", flag), ("cost", long), ("edits", T.ArrayType(text)), ("exits", T.ArrayType(number))))
    forth = traced.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return _mapped(forth.drop("letters"), _picked,
                   schema(("cost", long), ("entry", number), ("audit", text), ("illegal", long), keep=[]))


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows of segments, each after the row with its audit, in order: the repaired rows."""
    edits, node, row = iter(()), START, {}
    names = {USER: "user", ASSISTANT: "assistant"}

    def made(edit: str, role: str, text: str) -> dict:
        return {"conv_id": row["conv_id"], "turn": row["turn"], "edit": edit, "role": role, "text": text}

    def inserted() -> Iterator[dict]:
        nonlocal node
        for edit in edits:  # after a segment's last row only insertions are left
            node = NEXT[node]
            yield made(edit, names[node], "")

    for following in rows:
        if following["audit"] is not None:
            yield from inserted()
            edits, node = iter(following["audit"]), following["entry"]
            continue
        row = following
        for edit in edits:
            if edit == "K":
                node = KEPT[row["role"][:1], node]
                yield made(edit, row["role"], row["text"])
            elif edit != "D":
                node = NEXT[node]
                yield made(edit, names[node], "" if edit == "I" else row["text"])
            if edit != "I":
                break
    yield from inserted()


def repaired_rows(rows: DataFrame, found: DataFrame, segment_bits: int = SEGMENT_BITS, whole: bool = False) -> DataFrame:
    """The repaired rows: conv_id, turn (of an inserted row: of the row that it
    stands at), edit (K, R or I), role, text. ``found`` is ``audits`` of ``rows``.

    whole: the rows of a conversation are in one partition and in order, else
    those of a segment.
    """
    none = lambda kind: F.lit(None).cast(kind)
    head = found.select("conv_id", "segment", F.lit(-1).cast("long").alias("_at"), none(rows.schema["turn"].dataType).alias("turn"),
                        none("string").alias("role"), none("string").alias("text"), "entry", "audit")
    body = rows.select("conv_id", F.shiftright("_at", segment_bits).alias("segment"), "_at", "turn", "role", "text",
                       none("int").alias("entry"), none("string").alias("audit"))
    dealt = head.unionByName(body).repartition(*(["conv_id"] if whole else ["conv_id", "segment"]))
    fields = T.StructType([rows.schema["conv_id"], rows.schema["turn"], *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])
    return _mapped(dealt.sortWithinPartitions("conv_id", "segment", "_at"), _repaired, fields)


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    conv, digest, any_row = None, None, False
    for row in rows:
        line = f"{row['role']}:{row['text']}".encode()
        if not any_row or row["conv_id"] != conv:
            if any_row:
                yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}
            conv, digest, any_row = row["conv_id"], hashlib.sha256(line), True
        else:
            digest.update(b"\n" + line)
    if any_row:
        yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}


def repair(conversations: DataFrame, segment_bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, audits, report) of conversations with conv_id, turn, role, text: the
    rows as ``ordered`` them, ``audits`` of them, and a row for each conv_id with
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Nulls: a null conv_id is a conversation of its own; rows with a null turn come
    first; a null role or text is one space, so a null text is blank and a null
    role is neither system, user nor assistant. Rows of one turn are in order of
    role and text; of equal rows all but the first are duplicates. A blank row may
    be very long, an empty table gives empty results; other columns are ignored.

    A conversation's hash is one chain over its text by definition: its rows pass
    through one task, as a stream that holds a batch. Nothing else does.
    """
    prepare(conversations.sparkSession)
    rows = ordered(conversations)
    found = saved(audits(faults(rows), segment_bits))
    hashes = _mapped(repaired_rows(rows, found, segment_bits, whole=True), _digests,
                     T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "cost", "audit")))
    sums = (found.groupBy("conv_id").agg(parts.alias("_parts"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
            .select("conv_id", "blank", "duplicate", "truncated", "illegal", F.col("_parts")[0]["cost"].alias("cost"),
                    F.array_join(F.col("_parts.audit"), "").alias("audit")))
    # One row a conversation from each part; null ids group, though they do not join.
    every = gaps.unionByName(sums, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
    report = every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in every.columns[1:]])
    return rows, found, report.fillna({"repaired_sha256": EMPTY_HASH})  # without a row left


def completed(report: DataFrame, ids: DataFrame) -> DataFrame:
    """``report`` of ``repair`` with a row for every conv_id of ``ids``: zeros, an
    empty audit and the empty text's hash where it has none."""
    every = report.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(EMPTY_HASH)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults put in for trials, by crc32 of ``conv_id:turn`` modulo 20 (a null as
    one space): 0 drops a row, 1 empties its text, 2 removes the ends of its
    sentences, 3 repeats it, 4 makes its role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")
