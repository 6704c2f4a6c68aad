"""Repair of conversation structure: a run-length min-plus programme over role and fault symbols.

A conversation is in order if the initials of its roles read ``(s?(ua)+)?``. Four states read
that: nothing yet, behind ``s``, behind ``u``, behind ``a``. A row is one symbol: its role (s, u, a
or another, o), in capitals if its text breaks off, or ``x`` if it has to go. Every symbol is a
4 x 4 matrix of least costs from state to state, over {min, +}: inserted turns, then Keep, Rerole or
Delete. Equal rows fold into one with a count before anything is sorted, equal neighbours into runs,
and a run of n advances the costs by the binary powers of its matrix, which are kept.

The rows are dealt by ranges of (conversation, turn, role, digest of the text), so that a hot
conversation lies in many tasks. Each task folds its stretch of a conversation, a piece, into runs
and one matrix; the matrices of a conversation's pieces give the cost still to come behind each of
them. Knowing that, every piece unrolls its own cheapest edits, first in ASCII order, for each state
it may begin in, and the pieces chain. One matrix a piece and the audit itself are what
meets in one task; texts never do: `repaired` streams them past the audit in order.

Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty turn 2; a row whose
text breaks off costs 1 more unless deleted. Blank and duplicate rows must be deleted.

Defined results: null roles and texts are one space, so their rows are blank or of another role; a
null conversation is one conversation; rows of one turn come by role, then by the digest of the text,
null turns before all others; repeated rows are duplicates; an empty table gives no rows. Turns are
long integers; gaps beyond a long are given as its largest value. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piitrace.session import cut

#: Folded rows of a piece.
PIECE = 1 << 15
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Larger than any cost, small enough to be added up.
NEVER = 1 << 60
#: White space of texts.
BLANKS = " \t\n\x0b\f\r"
#: Where a role leads from each state; -1 where it may not stand.
STEP = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1),
        "o": (-1, -1, -1, -1)}
#: The turn that may stand next, user or assistant, from each state.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = ("su", "ua", "au")
LARGEST = (1 << 63) - 1


def minplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of a matrix with a matrix or a column of costs."""
    if b.ndim == 1:
        return np.minimum((a + b[None, :]).min(axis=1), NEVER)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def _inserts() -> np.ndarray:
    """Least cost of inserted turns from state to state."""
    once = np.full((4, 4), NEVER, np.int64)
    for q in range(4):
        once[q, q] = 0
        once[q, NEXT[q]] = min(once[q, NEXT[q]], INSERT)
    return minplus(once, minplus(once, once))


INSERTS = _inserts()
#: Cost still to come at the end of a conversation, by state.
CLOSE = INSERTS[:, [START, ASSISTANT]].min(axis=1)


@lru_cache(maxsize=None)
def power(symbol: str, log: int) -> np.ndarray:
    """The transition of ``2 ** log`` rows of one symbol."""
    if log:
        half = power(symbol, log - 1)
        return minplus(half, half)
    row = np.full((4, 4), NEVER, np.int64)
    for q in range(4):
        row[q, q] = DELETE
        if symbol != "x":
            more = TRUNCATED if symbol.isupper() else 0
            row[q, NEXT[q]] = min(row[q, NEXT[q]], REROLE + more)
            to = STEP[symbol.lower()][q]
            if to >= 0:
                row[q, to] = min(row[q, to], KEEP + more)
    return minplus(INSERTS, row)


def advance(symbol: str, n: int, after: np.ndarray) -> np.ndarray:
    """Costs to come before ``n`` rows of a symbol, given those (a column or matrix) behind them."""
    for log in range(n.bit_length()):
        if n >> log & 1:
            after = minplus(power(symbol, log), after)
    return after


def _inside(symbol: str, n: int, after: np.ndarray) -> np.ndarray:
    """Costs to come behind each of ``n`` rows of a symbol, doubled up by the kept powers."""
    out = after[None, :]
    log = 0
    while len(out) < n:
        step = power(symbol, log)
        out = np.concatenate([out, np.minimum((step[None] + out[:, None, :]).min(axis=2), NEVER)])
        log += 1
    return out[:n][::-1]


def unroll(runs: list[tuple[str, int]], after: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """The cheapest edits of a piece from ``state``, the first in ASCII order, and the state behind it.

    ``after`` are the costs to come behind the piece; behind the last one turns may be inserted.
    """
    ends = [after]
    for symbol, n in reversed(runs[1:]):
        ends.append(advance(symbol, n, ends[-1]))
    out: list[str] = []
    for (symbol, n), end in zip(runs, reversed(ends), strict=True):
        more = TRUNCATED if symbol.isupper() else 0
        step = STEP.get(symbol.lower())
        later = _inside(symbol, n, end).tolist()
        here = minplus(power(symbol, 0), np.array(later[0], np.int64)).tolist()
        for i in range(n):
            left = later[i]
            while True:
                cost, to = here[state], NEXT[state]
                if DELETE + left[state] == cost:
                    out.append("D")
                    break
                if INSERT + here[to] == cost:
                    out.append("I")
                    state = to
                    continue
                kept = step[state] if step else -1
                if kept >= 0 and KEEP + more + left[kept] == cost:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = to
                break
            here = left
    while last and state not in (START, ASSISTANT):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


@lru_cache(maxsize=50_000)
def whole(symbols: str) -> tuple[str, int]:
    """Audit and cost of a short conversation; many conversations read alike."""
    runs = _runs(symbols, [1] * len(symbols))
    cost = CLOSE
    for symbol, n in reversed(runs):
        cost = advance(symbol, n, cost)
    return unroll(runs, CLOSE, START, True)[0], int(cost[START])


def _runs(symbols: str, counts: list[int]) -> list[tuple[str, int]]:
    out: list[list] = []
    for s, n in zip(symbols, counts, strict=True):
        if out and out[-1][0] == s:
            out[-1][1] += n
        else:
            out.append([s, n])
    return [(s, n) for s, n in out]


def digest(text: Column) -> Column:
    """What stands for a text where rows are compared and ordered."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role`` and ``text`` with planted faults, chosen by a checksum of
    ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it,
    4 makes it a user's. Nulls are read as one space."""
    blank = lambda col: F.coalesce(col.cast("string"), F.lit(" "))
    rows = df.select(df[conv].alias("conv"), df[turn].alias("turn"), df[role].alias("role"),
                     df[text].alias("text"))
    c = F.col
    kind = F.crc32(F.concat(blank(c("conv")), F.lit(":"), blank(c("turn"))).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    changed = rows.select(
        "conv", "turn",
        F.when(c("kind") == 4, "user").otherwise(blank(c("role"))).alias("role"),
        F.when(c("kind") == 1, "").when(c("kind") == 2, F.translate(blank(c("text")), ".!?", ""))
        .otherwise(blank(c("text"))).alias("text"),
        F.explode(F.when(c("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy"))
    return changed.drop("copy").select(c("conv").alias(conv), c("turn").alias(turn),
                                       c("role").alias(role), c("text").alias(text))


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = lambda name: F.coalesce(df[name].cast("string"), F.lit(" "))
    return df.select(df[conv].alias("conv"), df[turn].cast("long").alias("turn"), space(role).alias("role"),
                     space(text).alias("text"))


def _symbols(rows: DataFrame) -> DataFrame:
    """Folded rows with their counts and whether they are the first of their role and text."""
    c = F.col
    end = F.right(F.rtrim(c("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", "x").when(end.isin(".", "!", "?"), "-").otherwise("t")
    folded = rows.select("conv", "turn", "role", digest(c("text")).alias("digest"), fault.alias("fault")
                         ).groupBy("conv", "turn", "role", "digest").agg(
        F.count("*").alias("n"), F.first("fault").alias("fault"))
    folded = cut(folded, "turns")
    # The place of the first sighting is joined on all its columns, so no key is hot.
    seen = folded.groupBy("conv", "role", "digest").agg(
        F.min(F.struct(c("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    names = ("conv", "turn", "role", "digest")
    seen = seen.select(*(c(x).alias(f"seen_{x}") for x in names), F.lit(True).alias("first"))
    on = [c(x).eqNullSafe(c(f"seen_{x}")) for x in names]
    marked = folded.join(seen, on, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return cut(marked.select(*names, F.left("role", F.lit(1)).alias("initial"), "n", "fault", "first"), "symbols")


_PIECE = ("conv {kind}, piece long, symbols string, counts array<long>, matrix array<long>, blank long, "
          "duplicate long, truncated long, illegal long, first string, last string, turns long, "
          "low long, high long")


def _pieces(symbols: DataFrame, kind: str) -> DataFrame:
    """The stretches of conversations in each range of rows, as runs and a matrix."""
    order = [F.col(x).asc_nulls_first() for x in ("conv", "turn", "role", "digest")]
    dealt = symbols.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        names = None
        for batch in batches:
            names = names or batch.schema
            conv = batch.column(0).to_pylist()
            rest = [batch.column(i).to_pylist() for i in range(1, 6)]
            out = []
            for row in zip(conv, *rest, strict=True):
                if held and (row[0] != held[0][0] or len(held) >= PIECE):
                    out.append(_piece(held, number))
                    number += 1
                    held = []
                held.append(row)
            if out:
                yield rows(out, names)
        if held:
            yield rows([_piece(held, number)], names)

    def rows(out: list[tuple], read: pa.Schema) -> pa.RecordBatch:
        long, string = pa.int64(), pa.string()
        types = [read.field(0).type, long, string, pa.list_(long), pa.list_(long), *[long] * 4, string,
                 string, *[long] * 3]
        names = [x.split()[0] for x in _PIECE.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(col, t) for col, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return dealt.select("conv", "turn", "initial", "n", "fault", "first").mapInArrow(
        run, _PIECE.format(kind=kind))


def _piece(rows: list[tuple], number: int) -> tuple:
    blank = duplicate = truncated = illegal = turns = 0
    symbols, counts, low, high, before = [], [], None, None, None
    for _, turn, initial, n, fault, first in rows:
        role = initial if initial in STEP and initial != "o" else "o"
        illegal += n - 1 + (before is not None and before + role not in LEGAL)
        before = role
        if turn is not None and turn != high:
            low, high, turns = turn if low is None else low, turn, turns + 1
        if fault == "x":
            blank += n
            symbols.append("x")
            counts.append(n)
            continue
        if first:
            truncated += fault == "t"
            symbols.append(role.upper() if fault == "t" else role)
            counts.append(1)
            n -= 1
        if n:
            duplicate += n
            symbols.append("x")
            counts.append(n)
    runs = _runs("".join(symbols), counts)
    matrix = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for symbol, n in reversed(runs):
        matrix = advance(symbol, n, matrix)
    first = rows[0][2] if rows[0][2] in STEP else "o"
    return (rows[0][0], number, "".join(s for s, _ in runs), [n for _, n in runs], matrix.ravel().tolist(),
            blank, duplicate, truncated, illegal, first, before, turns, low, high)


def audits(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
           ) -> DataFrame:
    """Per conversation ``gaps`` between its turns, rows ``blank``, ``duplicate`` and ``truncated``,
    ``illegal`` neighbours, the least ``cost`` of repair and ``audit``, the initials of its edits."""
    c = F.col
    kind = df.schema[conv].dataType.simpleString()
    pieces = cut(_pieces(_symbols(_rows(df, conv, turn, role, text)), kind), "pieces")

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The costs to come behind each piece of a conversation of several."""
        for batch in batches:
            for list_ in batch.column(0).to_pylist():
                out, cost = [], CLOSE
                for piece in reversed(list_):
                    out.append((piece["piece"], cost.tolist()))
                    cost = minplus(np.array(piece["matrix"], np.int64).reshape(4, 4), cost)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in out], pa.int64()),
                     pa.array([t for _, t in out], pa.list_(pa.int64()))], names=["piece", "after"])

    # Only conversations of several pieces need the costs behind each of them.
    several = pieces.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(
        F.struct("piece", "matrix"))).alias("list")).where("n > 1")
    after = several.select("list").mapInArrow(tails, "piece long, after array<long>")

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols, counts, after in zip(*(x.to_pylist() for x in batch.columns[1:]), strict=True):
                if after is None and sum(counts) <= 64:
                    out.append(((whole("".join(s * n for s, n in zip(symbols, counts, strict=True)))[0],) + ("",) * 3,
                                (ASSISTANT,) * 4))
                    continue
                runs = list(zip(symbols, counts, strict=True))
                behind = CLOSE if after is None else np.array(after, np.int64)
                starts = range(1) if after is None else range(4)
                found = [unroll(runs, behind, q, False) for q in starts]
                if after is None:
                    found = [unroll(runs, behind, START, True)] * 4
                out.append(([a for a, _ in found], [q for _, q in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(a) for a, _ in out], pa.list_(pa.string())),
                 pa.array([list(q) for _, q in out], pa.list_(pa.int32()))],
                names=["piece", "edits", "ends"])

    edits = pieces.join(after, "piece", "left").select("piece", "symbols", "counts", "after").mapInArrow(
        unrolled, "piece long, edits array<string>, ends array<int>")
    joined = pieces.select("conv", "piece", "matrix", "blank", "duplicate", "truncated", "illegal", "first",
                           "last", "turns", "low", "high").join(edits, "piece")
    fields = [x for x in joined.columns if x != "conv"]
    listed = joined.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("list"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_summary(x) for x in batch.column(1).to_pylist()]
            cols = [pa.array(col, pa.string() if i == 6 else pa.int64())
                    for i, col in enumerate(zip(*out, strict=True))]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[
                    "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return listed.mapInArrow(close, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, "
                             "illegal long, cost long, audit string").withColumnRenamed("conv", conv)


def _summary(pieces: list[dict]) -> tuple:
    """One conversation from its pieces in order."""
    total = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for one, two in zip(pieces, pieces[1:], strict=False):
        total["illegal"] += one["last"] + two["first"] not in LEGAL
        total["turns"] -= one["high"] is not None and one["high"] == two["low"]
    low = next((p["low"] for p in pieces if p["low"] is not None), None)
    high = next((p["high"] for p in reversed(pieces) if p["high"] is not None), None)
    gaps = 0 if low is None else min(high - low + 1 - total["turns"], LARGEST)
    cost = CLOSE
    for p in reversed(pieces):
        cost = minplus(np.array(p["matrix"], np.int64).reshape(4, 4), cost)
    state, audit = START, []
    for p in pieces:
        audit.append(p["edits"][state])
        state = p["ends"][state]
    if len(pieces) > 1 and state not in (START, ASSISTANT):
        audit.append("I" if state == USER else "II")
    return (gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"],
            int(cost[START]), "".join(audit))


def repaired(df: DataFrame, audit: DataFrame, conv: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: ``conv``, ``place`` from 0, ``edit``, ``role`` and ``text``.

    ``audit`` is what ``audits`` gave for the same rows. The rows of a conversation leave in order, in
    one partition; they are streamed, never held.
    """
    c = F.col
    kind = df.schema[conv].dataType.simpleString()
    rows = _rows(df, conv, turn, role, text)
    no = lambda t: F.lit(None).cast(t)
    both = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", digest(c("text")).alias("digest"), "text"
                       ).unionByName(audit.where(F.length("audit") > 0).select(
                           audit[conv].alias("conv"), F.lit(0).alias("kind"), no("long").alias("turn"),
                           no("string").alias("role"), no("binary").alias("digest"), c("audit").alias("text")))
    order = [c(x).asc_nulls_first() for x in ("conv", "kind", "turn", "role", "digest")]
    dealt = both.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, place, odd, of = "", 0, 0, False, None
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []

            def inserted() -> None:
                nonlocal at, place
                while at < len(edits) and edits[at] == "I":  # noqa: B023
                    out.append((of, place, "I", "user" if (place - odd) % 2 == 0 else "assistant", ""))  # noqa: B023
                    at, place = at + 1, place + 1

            for key, head, who, said in zip(keys, *(x.to_pylist() for x in batch.columns[1:]), strict=True):
                if head == 0:
                    edits, at, place, of = said, 0, 0, key
                    odd = (len(edits) - edits.count("D")) % 2 == 1
                    inserted()
                    continue
                edit, at = edits[at], at + 1
                if edit != "D":
                    if edit == "R":
                        who = "user" if (place - odd) % 2 == 0 else "assistant"
                    out.append((key, place, edit, who, said))
                    place += 1
                inserted()
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)],
                                             names=["conv", "place", "edit", "role", "text"])

    return dealt.mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string"
                            ).withColumnRenamed("conv", conv)


def digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv`` and ``repaired_sha256`` of its ``role:text`` lines, from the rows of `repaired` as they
    stream by: no shuffle, one conversation's hash at a time."""
    kind = turns.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, of, field = None, None, None
        for batch in batches:
            out, field = [], batch.schema.field(0).type
            for key, place, who, said in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if place == 0:
                    if hashed is not None:
                        out.append((of, hashed.hexdigest()))
                    hashed, of = hashlib.sha256(), key
                else:
                    hashed.update(b"\n")
                hashed.update(f"{who}:{said}".encode())
            yield rows(out, field)
        if hashed is not None:
            yield rows([(of, hashed.hexdigest())], field)

    def rows(out: list[tuple], field: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], field),
                                           pa.array([h for _, h in out], pa.string())],
                                          names=["conv", "repaired_sha256"])

    return turns.select(conv, "place", "role", "text").mapInArrow(
        run, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", conv)


#: The hash of an empty text.
EMPTY_HASH = hashlib.sha256().hexdigest()


def report(original: DataFrame, rows: DataFrame, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``original``: the audit and hash of its ``rows``, or those of none."""
    c = F.col
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = cut(audits(rows, conv, turn, role, text), "audits")
    hashes = digests(repaired(rows, found, conv, turn, role, text), conv)
    none = [F.lit(0).cast("long").alias(x) if x in names[:6] else F.lit(None).cast("string").alias(x)
            for x in names]
    parts = found.withColumn("repaired_sha256", F.lit(None).cast("string")).unionByName(
        hashes.select(conv, *none[:7], "repaired_sha256")).unionByName(
        original.select(original[conv].alias(conv)).distinct().select(conv, *none))
    folded = parts.groupBy(conv).agg(*(F.max(x).alias(x) for x in names))
    return folded.select(conv, *names[:6], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce(c("repaired_sha256"), F.lit(EMPTY_HASH)).alias("repaired_sha256"))
