"""Conversation structure repair by a lightest-derivation agenda (operator 13).

Role initials of a repaired conversation spell ``(s?(ua)+)?``; the states of its
automaton are 0 nothing yet, 1 after s, 2 after u, 3 after a (0 and 3 accept). Repair
is a deduction over a weighted hypergraph with the items

    Fix(i, r)     row i is left as role r (none: deleted): Keep 0, Rerole 3, Delete 4,
                  3 more for a truncated row that stays
    Rest(i, q)    rows i and after, from state q on, are repaired
                  Rest(i, q) <- Fix(i, r), Rest(i + 1, step(q, r))
                  Rest(i, q) <- Rest(i, step(q, r))       Insert r, cost 3
                  Rest(end, q) <-                         q accepts

An item's value is (cost, rows, audit). The rules add costs and rows and join audits
from the left, which never makes a value less than one it is made of and keeps the
order of values of one item, as Knuth's algorithm asks: the agenda gives up items by
least value, each is final when it comes out, and it ends with the goal Rest(0, 0).
An audit and the first state fix all roles, so equal audits are equal repairs.

Rows travel sorted by conversation and turn in ranges, so one conversation may lie in
many tasks. Conversations inside one range are repaired there; equal patterns of
initials and faults are looked up in a bounded table. The first and last conversation
of a range may go on elsewhere: those are cut into segments of at most
``SEGMENT_ROWS`` rows, every segment gives Rest from every state to every state, and
the segments' tables are joined in order. A last sorted pass streams such
conversations' texts into the hash with their audit; no text is held longer than its
row.

Defined cases: a null conv_id, turn, role or text is one space in the damage draw, a
null role or text one space in the row too; a null conv_id is a conversation of its
own, returned as null. A role with no initial can't be kept. Rows of equal turn are
taken by role, then text (by their first 100 characters, then by hash). Repeated rows are rows (the later is a duplicate). Texts of
any length are read whole. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirage.llm.common import partitions, stash, table

RANGE_ROWS = 1 << 16  # rows aimed at in a range
SEGMENT_ROWS = 1024
CACHE_PATTERNS = 100_000
CACHE_PATTERN_ROWS = 64
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_ROLES = {"u": "user", "a": "assistant"}


# --- damage -----------------------------------------------------------------------

def damaged_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the row's draw names."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    draw = F.crc32(key.cast("binary")) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(draw == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(draw == 0, F.array().cast("array<int>")).when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


_LAST = re.compile(f"[^{_SPACE}]")


def fault(text: str, seen: bool) -> str:
    """'b'lank, 'd'uplicate, 't'runcated or 'k' for none."""
    bare = text.rstrip(_SPACE)
    if not bare:
        return "b"
    return "d" if seen else "k" if bare[-1] in ".!?" else "t"


# --- lightest derivations -----------------------------------------------------------

def fixes(symbol: str) -> dict[str, tuple[int, str]]:
    """Lightest Fix(i, r) of a row ``initial + fault``, by role r ('' none)."""
    initial, bad = symbol[:-1], symbol[-1]
    out = {"": (DELETE, "D")}
    if bad in "kt":
        more = TRUNCATED if bad == "t" else 0
        out |= {r: (REROLE + more, "R") for r in "ua"}
        if initial in ("s", "u", "a"):
            out[initial] = (more, "K")
    return out


def lightest(symbols: list[str], ends: tuple[int, ...], starts: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """(cost, audit) of Rest(0, q) for q in ``starts``, with ``ends`` accepting."""
    n = len(symbols)
    fix = [fixes(s) for s in symbols]
    into: dict[int, list[tuple[int, str]]] = {}
    for (q, r), t in STEP.items():
        into.setdefault(t, []).append((q, r))
    agenda = [(0, 0, "", n, q) for q in ends]
    heapq.heapify(agenda)
    final: dict[tuple[int, int], tuple[int, str]] = {}
    goals = set(starts)
    while agenda and goals:
        cost, rows, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = cost, audit
        if i == 0:
            goals.discard(q)
        for p, r in into.get(q, ()):
            if r != "s" and (i, p) not in final:
                heapq.heappush(agenda, (cost + INSERT, rows, "I" + audit, i, p))
        if i:
            c, letter = fix[i - 1][""]
            if (i - 1, q) not in final:
                heapq.heappush(agenda, (cost + c, rows + 1, letter + audit, i - 1, q))
            for p, r in into.get(q, ()):
                if r in fix[i - 1] and (i - 1, p) not in final:
                    c, letter = fix[i - 1][r]
                    heapq.heappush(agenda, (cost + c, rows + 1, letter + audit, i - 1, p))
    return {q: final[0, q] for q in starts if (0, q) in final}


def segments(symbols: list[str], segment_rows: int = SEGMENT_ROWS) -> list[dict[tuple[int, int], tuple[int, str]]]:
    """Per segment (cost, audit) from state p to state q."""
    out = []
    for i in range(0, len(symbols), segment_rows):
        some = symbols[i:i + segment_rows]
        out.append({(p, q): v for q in range(4) for p, v in lightest(some, (q,), (0, 1, 2, 3)).items()})
    return out


def chain(tables: Iterator[dict]) -> tuple[int, str]:
    """(cost, audit) of a conversation from its segments in order."""
    reached: dict[int, tuple[int, str]] = {0: (0, "")}
    for t in tables:
        after: dict[int, tuple[int, str]] = {}
        for p, (cost, audit) in reached.items():
            for (p2, q), (c, a) in t.items():
                if p2 == p and (q not in after or (cost + c, audit + a) < after[q]):
                    after[q] = cost + c, audit + a
        reached = after
    return min(reached[q] for q in ACCEPT if q in reached)


class Writer:
    """The repaired rows of an audit, hashed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.hash, self.empty = hashlib.sha256(), True

    def _put(self, r: str, role: str, text: str) -> None:
        self.state = STEP[self.state, r]
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _next_role(self) -> str:
        return "a" if self.state == 2 else "u"

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._put(self._next_role(), _ROLES[self._next_role()], "")

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role[0], role, text)
        elif edit == "R":
            r = self._next_role()
            self._put(r, _ROLES[r], text)

    def digest(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


# --- streams over sorted rows -------------------------------------------------------

class _Tally:
    """Counts of consecutive rows of a conversation; two neighbours add up."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.low, self.high, self.first, self.last = 0, None, None, None, None

    def add(self, turn, initial: str, bad: str) -> None:
        if bad != "k":
            self.counts[{"b": "blank", "d": "duplicate", "t": "truncated"}[bad]] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def follow(self, b: _Tally) -> None:
        for c, n in b.counts.items():
            self.counts[c] += n
        if self.last is not None and b.first is not None and self.last + b.first not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if b.low is not None:
            self.turns += b.turns - (b.low == self.high)
            self.low, self.high = b.low if self.low is None else self.low, b.high
        self.first, self.last = b.first if self.first is None else self.first, b.last if b.last is not None else self.last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_RESULT = ("conv_id long, named boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _in_order(rows: DataFrame) -> list:
    """Sort keys of a conversation's rows. Long texts never travel as keys."""
    return ["named", "conv_id", F.asc_nulls_first("turn"), F.substring("role", 1, 100), F.substring("text", 1, 100), F.xxhash64("role", "text"),
            *(["seen"] if "seen" in rows.columns else [])]


def _sorted_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """Ranges in order; equal rows may be parted. ``named`` is false for a null
    conv_id."""
    keys = [*_in_order(rows), "_tie"]
    every = rows.withColumn("_tie", F.monotonically_increasing_id())
    return every.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_tie")


def repaired_inside(rows: DataFrame, ranges: int) -> DataFrame:
    """Results of conversations that lie inside one range; of the others only
    (conv_id, named), the rest null."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        known: dict[tuple[str, ...], tuple[int, str]] = {}

        def solve(symbols: list[str]) -> tuple[int, str]:
            pattern = tuple(symbols)
            got = known.get(pattern)
            if got is None:
                got = lightest(symbols, ACCEPT, (0,))[0]
                if len(pattern) <= CACHE_PATTERN_ROWS:
                    if len(known) >= CACHE_PATTERNS:
                        known.clear()
                    known[pattern] = got
            return got

        names = [f.split()[0] for f in _RESULT.split(", ")]
        fields = pa.schema([(n, pa.bool_() if n == "named" else pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
        out = {n: [] for n in names}

        def flush():
            got = pa.RecordBatch.from_pydict(out, schema=fields)
            for v in out.values():
                v.clear()
            return got

        def put(key, *values):
            for n, v in zip(names, (*key, *values), strict=True):
                out[n].append(v)

        own, held, inside = None, [], False  # the first conversation is not held
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "named", "turn", "role", "text")]
            for conv, named, turn, role, text in zip(*cols, strict=True):
                if own != (conv, named):
                    if own is not None:
                        put(own, *(repair(held, solve) if inside else [None] * 8))
                        inside = True
                    own, held = (conv, named), []
                if inside:
                    held.append((turn, role, text))
            if out["named"]:
                yield flush()
        if own is not None:
            put(own, *[None] * 8)
            yield flush()

    return _sorted_ranges(rows, ranges).mapInArrow(run, _RESULT)


def repair(rows: list[tuple], solve) -> list:
    """[gaps, blank, duplicate, truncated, illegal, cost, audit, sha256] of a
    conversation's (turn, role, text)."""
    tally, seen, symbols = _Tally(), set(), []
    for turn, role, text in rows:
        bad = fault(text, (role, text) in seen)
        seen.add((role, text))
        tally.add(turn, role[:1], bad)
        symbols.append(role[:1] + bad)
    cost, audit = solve(symbols)
    w = Writer(audit)
    for _, role, text in rows:
        w.row(role, text)
    return [tally.gaps(), *[tally.counts[c] for c in _COUNTS], cost, audit, w.digest()]


_SEGMENT = ("conv_id long, named boolean, part long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
            "first string, last string, ways string")


def segment_rows_of(rows: DataFrame, ranges: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per segment of the conversations in ``rows`` (with ``seen``), in the
    order of ``part``; ``ways`` has its (state, state, cost, audit)."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        import json

        from pyspark import TaskContext
        part = TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in _SEGMENT.split(", ")]
        kinds = {"named": pa.bool_(), "first": pa.string(), "last": pa.string(), "ways": pa.string()}
        schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
        own, tally, symbols = None, _Tally(), []

        def close():
            nonlocal part, tally, symbols
            ways = json.dumps([[p, q, c, a] for (p, q), (c, a) in segments(symbols, len(symbols))[0].items()])
            row = [*own, part, *[tally.counts[c] for c in _COUNTS], tally.turns, tally.low, tally.high, tally.first, tally.last, ways]
            part, tally, symbols = part + 1, _Tally(), []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "named", "turn", "role", "text", "seen")]
            for conv, named, turn, role, text, seen in zip(*cols, strict=True):
                if symbols and (own != (conv, named) or len(symbols) >= segment_rows):
                    yield close()
                own = conv, named
                bad = fault(text, seen)
                tally.add(turn, role[:1], bad)
                symbols.append(role[:1] + bad)
        if symbols:
            yield close()

    return _sorted_ranges(rows, ranges).mapInArrow(run, _SEGMENT)


def joined_segments(parts: DataFrame) -> DataFrame:
    """Counts, cost and audit of conversations from their segments."""
    import pandas as pd

    def run(pdf):
        import json
        pdf = pdf.sort_values("part")
        whole = _Tally()
        for r in pdf.itertuples():
            t = _Tally()
            t.counts = {c: int(getattr(r, c)) for c in _COUNTS}
            t.turns, t.first, t.last = int(r.turns), r.first, r.last
            t.low, t.high = (None, None) if pd.isna(r.low) else (int(r.low), int(r.high))
            whole.follow(t)
        cost, audit = chain({(p, q): (c, a) for p, q, c, a in json.loads(w)} for w in pdf["ways"])
        head = pdf.iloc[0]
        return pd.DataFrame([[None if pd.isna(head.conv_id) else int(head.conv_id), bool(head.named), whole.gaps(),
                              *[whole.counts[c] for c in _COUNTS], cost, audit]], columns=names)

    names = [f.split()[0] for f in _RESULT.split(", ")][:-1]
    parts = parts.withColumn("conv_id", F.coalesce("conv_id", F.lit(0).cast("long"))).withColumn("low", F.col("low").cast("string")).withColumn(
        "high", F.col("high").cast("string"))
    out = parts.groupBy("named", "conv_id").applyInPandas(run, _RESULT.rsplit(", ", 1)[0])
    return out.withColumn("conv_id", F.when(F.col("named"), F.col("conv_id")))


def hashed_repairs(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, named, repaired_sha256) of streamed conversations: each one's audit
    comes first, then its rows in order."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        own, w = None, None
        schema = pa.schema([("conv_id", pa.int64()), ("named", pa.bool_()), ("repaired_sha256", pa.string())])

        def done():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*own, w.digest()), schema, strict=True)], schema=schema)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "named", "audit", "role", "text")]
            for conv, named, audit, role, text in zip(*cols, strict=True):
                if audit is not None:
                    if own is not None:
                        yield done()
                    own, w = (conv, named), Writer(audit)
                else:
                    w.row(role, text)
        if own is not None:
            yield done()

    blank = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    both = rows.select("conv_id", "named", "turn", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(
        audits.select("conv_id", "named", *blank, "audit"))
    order = [*_in_order(both)[:2], F.asc_nulls_last("audit"), *_in_order(both)[2:]]
    return both.repartition(partitions(rows.sparkSession), "named", "conv_id").sortWithinPartitions(*order).mapInArrow(
        run, "conv_id long, named boolean, repaired_sha256 string")


def repair_report(conversations: DataFrame, damage=damaged_rows, range_rows: int = RANGE_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conv_id of ``conversations``: faults, cost, audit and hash of the
    cheapest repair of its rows after ``damage``."""
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ids = given.select("conv_id").distinct()
    rows = damage(given).withColumn("named", F.col("conv_id").isNotNull())
    spark = conversations.sparkSession
    ranges = max(partitions(spark), -(-conversations.count() // range_rows))
    found = stash(repaired_inside(rows, ranges))
    inside = found.filter("audit is not null")
    # At most two conversations of every range.
    open_ = found.filter("audit is null").select("named", F.col("conv_id").alias("_c")).distinct()
    same = (rows["named"] == open_["named"]) & rows["conv_id"].eqNullSafe(open_["_c"])
    cut = rows.join(F.broadcast(open_), same, "left_semi")
    earlier = Window.partitionBy("named", "conv_id", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    marked = stash(cut.withColumn("seen", F.row_number().over(earlier) > 1))
    joined = stash(joined_segments(segment_rows_of(marked, ranges, segment_rows)))
    hashes = hashed_repairs(marked, joined).select(F.col("conv_id").alias("_c"), F.col("named").alias("_m"), "repaired_sha256")
    outside = joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("named") == F.col("_m"))).drop("_c", "_m")
    every = inside.unionByName(outside).withColumnRenamed("conv_id", "_c")
    left = ids.join(every, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return left.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))
