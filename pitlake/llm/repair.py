"""Conversation structure repair: cheapest edits of whole conversations by bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import row_numbers
from ..session import materialise
from .common import SPACE_CLASS, SPACES, query, same, table

#: Rows of a conversation that one search spans; longer conversations are cut into parts whose results are put together.
PART = 256
RENAME, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: Role initials in order: ``(s?(ua)+)?`` as an automaton. 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Marks of a row: nothing wrong, unfinished text, to be deleted.
FINE, CUT, GONE = "-", "t", "x"

_INTO = {q: [(p, x) for (p, x), to in STEP.items() if to == q] for q in range(4)}


def _row_edges(code: str, letter: str) -> list[tuple[str, int]]:
    """Edits that turn a row of this code into one whose initial is ``letter``, with their costs."""
    initial, mark = code
    if mark == GONE:
        return []
    late = UNFINISHED if mark == CUT else 0
    return [e for e, possible in ((("K", late), initial == letter), (("R", RENAME + late), letter in ROLES)) if possible]


def _ahead(codes: list[str], i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    for letter in "sua":
        to = STEP.get((q, letter))
        if to is not None:
            if i < len(codes):
                for edit, cost in _row_edges(codes[i], letter):
                    yield edit, cost, i + 1, to
            if letter in ROLES:
                yield "I", INSERT, i, to
    if i < len(codes):
        yield "D", DELETE, i + 1, q


def _behind(codes: list[str], i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    for p, letter in _INTO[q]:
        if i:
            for edit, cost in _row_edges(codes[i - 1], letter):
                yield edit, cost, i - 1, p
        if letter in ROLES:
            yield "I", INSERT, i, p
    if i:
        yield "D", DELETE, i - 1, q


def search(codes: list[str], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost of edits that lead from ``start`` to one of ``ends`` over all rows, and the least audit at that cost.

    Nodes of the lattice are (rows passed, state of the automaton). A heap runs forward from the start,
    another backward from the ends, the one with the lower top next. Both settle a node at its least
    cost with its least part of the audit: at equal cost nodes come in the order of rows, as only edits
    that pass a row can cost nothing. Once the tops add up to more than the best crossing, every
    path of that cost has an edge from a node settled forward to one settled backward; all such
    crossings are read and the least concatenated audit taken. Equal-cost audits into one
    node never begin with each other, so least parts make least wholes.
    """
    n = len(codes)
    fore: dict[tuple[int, int], tuple[int, str]] = {}
    back: dict[tuple[int, int], tuple[int, str]] = {}
    heap_f, heap_b = [(0, 0, "", start)], [(0, 0, "", q) for q in ends]
    best: int | None = None
    while heap_f and heap_b and (best is None or heap_f[0][0] + heap_b[0][0] <= best):
        if heap_f[0][0] <= heap_b[0][0]:
            cost, i, audit, q = heappop(heap_f)
            if (i, q) in fore:
                continue
            fore[i, q] = (cost, audit)
            if (i, q) in back and (best is None or cost + back[i, q][0] < best):
                best = cost + back[i, q][0]
            for edit, more, j, to in _ahead(codes, i, q):
                if (j, to) in back and (best is None or cost + more + back[j, to][0] < best):
                    best = cost + more + back[j, to][0]
                if (j, to) not in fore:
                    heappush(heap_f, (cost + more, j, audit + edit, to))
        else:
            cost, left, audit, q = heappop(heap_b)
            i = n - left
            if (i, q) in back:
                continue
            back[i, q] = (cost, audit)
            if (i, q) in fore and (best is None or cost + fore[i, q][0] < best):
                best = cost + fore[i, q][0]
            for edit, more, j, to in _behind(codes, i, q):
                if (j, to) in fore and (best is None or cost + more + fore[j, to][0] < best):
                    best = cost + more + fore[j, to][0]
                if (j, to) not in back:
                    heappush(heap_b, (cost + more, n - j, edit + audit, to))
    if best is None:
        return None
    found = []
    for (i, q), (cost, audit) in fore.items():
        if (i, q) in back and cost + back[i, q][0] == best:
            found.append(audit + back[i, q][1])
        for edit, more, j, to in _ahead(codes, i, q):
            if (j, to) in back and cost + more + back[j, to][0] == best:
                found.append(audit + edit + back[j, to][1])
    return best, min(found)


def lines(codes: list[str], state: int, audit: str) -> tuple[list[tuple[int, str | None]], int]:
    """What an audit leaves: (row or -1 for an inserted one, new role or None for its own), and the state at the end."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        letter = codes[i][0] if edit == "K" else "a" if state == 2 else "u"
        out.append((-1 if edit == "I" else i, None if edit == "K" else ROLES[letter]))
        i += edit != "I"
        state = STEP[state, letter]
    return out, state


def _bad_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _batches(names: list[str], kinds: list[pa.DataType], key: pa.Array, take: list[int], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key.take(pa.array(take, pa.int64())), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)


_LINE = pa.list_(pa.struct([("seq", pa.int64()), ("place", pa.int64()), ("role", pa.string())]))
_PART_NAMES = ["conv", "part", "cost", "illegal", "audit", "lines"]
_PART_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _LINE]
_PART_SQL = "part long, cost long, illegal long, audit string, lines array<struct<seq: long, place: long, role: string>>"


def _part_row(part: int, cost: int, illegal: int, state: int, audit: str, codes: list[str]) -> tuple:
    kept, _ = lines(codes, state, audit)
    return part, cost, illegal, audit, [(seq, i if i >= 0 else None, role) for seq, (i, role) in enumerate(kept)]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one part: one search each."""
    for batch in batches:
        rows = []
        for part, joined in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            codes = [joined[i : i + 2] for i in range(0, len(joined), 2)]
            cost, audit = search(codes, 0, ACCEPTED)
            rows.append(_part_row(part, cost, _bad_pairs(joined[::2]), 0, audit, codes))
        yield _batches(_PART_NAMES, _PART_KINDS, batch.column(0), list(range(batch.num_rows)), rows)


_TABLE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of longer conversations: the best edits between any two states at their borders."""
    for batch in batches:
        rows = []
        for part, joined in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            codes = [joined[i : i + 2] for i in range(0, len(joined), 2)]
            each = [(a, b, *r) for a in ((0,) if part == 0 else range(4)) for b in range(4) if (r := search(codes, a, (b,)))]
            rows.append((part, joined, each))
        yield _batches(["conv", "part", "codes", "ways"], [pa.int64(), pa.string(), _TABLE], batch.column(0), list(range(batch.num_rows)), rows)


class _Joiner:
    """Puts the parts of one conversation together as they come: per state the best way so far.

    A way is its cost and its pieces in the parts that are not decided yet. A part on whose piece all
    states agree is decided and given out, so few are held however long the conversation is.
    """

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, list[tuple[int, int, str]]]] = {0: (0, [])}
        self.held: list[tuple[int, str, int]] = []
        self.last = ""

    def add(self, part: int, codes: str, each: list[dict]) -> list[tuple]:
        illegal = _bad_pairs(self.last + codes[::2])
        self.last = codes[-2]
        self.held.append((part, codes, illegal))
        new: dict[int, tuple[int, list[tuple[int, int, str]]]] = {}
        for way in each:
            if way["start"] in self.ways:
                cost, pieces = self.ways[way["start"]]
                to = (cost + way["cost"], [*pieces, (way["cost"], way["start"], way["audit"])])
                new[way["end"]] = min(new.get(way["end"], to), to, key=self._order)
        self.ways = new
        return self._decided()

    @staticmethod
    def _order(way: tuple[int, list[tuple[int, int, str]]]) -> tuple[int, str]:
        return way[0], "".join(p[2] for p in way[1])

    def _decided(self) -> list[tuple]:
        out = []
        while self.held and len({w[1][0] for w in self.ways.values()}) == 1:
            (part, joined, illegal), piece = self.held.pop(0), next(iter(self.ways.values()))[1][0]
            codes = [joined[i : i + 2] for i in range(0, len(joined), 2)]
            out.append(_part_row(part, piece[0], illegal, piece[1], piece[2], codes))
            base = piece[0]
            self.ways = {q: (cost - base, pieces[1:]) for q, (cost, pieces) in self.ways.items()}
        return out

    def end(self) -> list[tuple]:
        best = min((w for q, w in self.ways.items() if q in ACCEPTED), key=self._order)
        self.ways = {0: best}
        return self._decided()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order, one conversation after the other: the chosen edits of each part."""
    joiner, before = None, None

    def given(rows: list[tuple], key: pa.Array) -> pa.RecordBatch:
        return _batches(_PART_NAMES, _PART_KINDS, key, [0] * len(rows), rows)

    for batch in batches:
        for i, (part, joined, each) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 4)))):
            key = batch.column(0).slice(i, 1)
            if part == 0:
                if joiner is not None:
                    yield given(joiner.end(), before)
                joiner, before = _Joiner(), key
            yield given(joiner.add(part, joined, each), before)
    if joiner is not None:
        yield given(joiner.end(), before)


def rows_in_order(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of each conversation, numbered from 0 in ``place``, and each one's first fault.

    Columns ``conv``, ``place``, ``turn``, ``role``, ``text`` (NULL role or text: one space),
    ``fault`` (blank, duplicate, truncated or NULL) and ``code``. Rows come by turn, NULL first, equal
    turns by role and the text's MD5, so equal rows stand together. Written once.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), value(role).alias("role"), value(text).alias("text")).withColumn("mark", F.md5("text"))
    rows = materialise(row_numbers(rows, ["conv"], ["turn", "role", "mark"]), "repair-rows")
    blank = ~F.col("text").rlike(f"[^{SPACE_CLASS}]")
    first = rows.groupBy("conv", "role", "mark").agg(F.min("place").alias("_p")).select(F.col("conv").alias("_c"), "_p")
    found = rows.join(first, same(F.col("conv"), F.col("_c")) & (F.col("place") == F.col("_p")), "left")
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(blank, "blank").when(F.col("_p").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", CUT).otherwise(FINE)
    found = found.withColumn("fault", fault).withColumn("code", F.concat(known, mark))
    return materialise(found.select("conv", "place", "turn", "role", "text", "fault", "code"), "repair-faults")


def best_edits(rows: DataFrame, size: int = PART) -> DataFrame:
    """Per part of a conversation: ``conv``, ``part``, ``cost``, ``illegal``, ``audit`` and the ``lines`` that the edits leave.

    A line has the ``place`` of its row in the part, NULL if inserted.

    A part's two letters a row are all that meets in one place. A conversation of less than ``size``
    rows is searched whole; of longer ones every part is searched on its own, between all states
    at its ends, and the parts of one conversation, a row each, pass in order through a joiner.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    part = F.floor(F.col("place") / size).cast("long")
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
    parts = materialise(rows.groupBy("conv", part.alias("part")).agg(codes.alias("codes")), "repair-parts")
    alone = (F.col("part") == 0) & (F.length("codes") < 2 * size)
    whole = parts.where(alone).mapInArrow(_whole, f"conv {kind}, {_PART_SQL}")
    ways = "ways array<struct<start: int, end: int, cost: long, audit: string>>"
    cut = materialise(parts.where(~alone).mapInArrow(_tables, f"conv {kind}, part long, codes string, {ways}"), "repair-ways")
    joined = cut.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_join, f"conv {kind}, {_PART_SQL}")
    return materialise(whole.unionByName(joined), "repair-edits")


def repaired(rows: DataFrame, edits: DataFrame, size: int = PART) -> DataFrame:
    """The repaired rows: ``conv``, ``part``, ``seq`` (their order), ``role``, ``text``; inserted ones have an empty text."""
    line = edits.select(F.col("conv").alias("_c"), "part", F.inline("lines")).withColumnsRenamed({"place": "_p", "role": "_role"}).withColumn("_p", F.col("_p") + F.col("part") * size)
    kept = line.where("_p is not null").join(rows.select("conv", "place", "role", "text"), same(F.col("conv"), F.col("_c")) & (F.col("place") == F.col("_p")))
    kept = kept.select("conv", "part", "seq", F.coalesce("_role", "role").alias("role"), "text")
    added = line.where("_p is null").select(F.col("_c").alias("conv"), "part", "seq", F.col("_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(added)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows with one key; only the hash is carried from row to row."""
    sha, before = None, None
    given = lambda: pa.RecordBatch.from_arrays([before, pa.array([sha.hexdigest()])], names=["conv", "sha"])
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for i, (key, line) in enumerate(zip(keys, batch.column(1).to_pylist())):
            if sha is None or key != before[0].as_py():
                if sha is not None:
                    yield given()
                sha, before = hashlib.sha256(), batch.column(0).slice(i, 1)
            else:
                sha.update(b"\n")
            sha.update(line.encode("utf-8", "surrogatepass"))
    if sha is not None:
        yield given()


def digests(lines_: DataFrame) -> DataFrame:
    """``conv`` and ``sha``: SHA-256 of the conversation's ``role:text`` lines joined by line breaks.

    One hash has to see a conversation's rows in order, so they pass through one task, row by row;
    nothing but the hash is held.
    """
    kind = lines_.schema["conv"].dataType.simpleString()
    ordered = lines_.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return ordered.select("conv", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(_hash_runs, f"conv {kind}, sha string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = PART) -> tuple[DataFrame, DataFrame]:
    """Per conversation its faults and cheapest repair, and the repaired rows.

    The first: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit``. Roles must read ``(s?(ua)+)?`` by their initials afterwards. Keep costs 0, Rerole (to user
    or assistant) 3, Delete 4, Insert (an empty user or assistant row) 3; blank and duplicate rows must
    go; a truncated row that stays costs 3 more. Equal costs: the least audit. NULL role or text is one
    space, a NULL turn comes first and counts in no gap, NULL conversations are one. Other columns are
    left out. No rows, no conversations. An empty role, or one of other initials, can't be kept.
    """
    rows = rows_in_order(turns, conv, turn, role, text)
    edits = best_edits(rows, size)
    fault = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    gaps = F.coalesce((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long"), F.lit(0)).alias("gaps")
    faults = rows.groupBy("conv").agg(gaps, *[fault(n) for n in ("blank", "duplicate", "truncated")])
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    costs = edits.groupBy(F.col("conv").alias("_c")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    return faults.join(costs, same(F.col("conv"), F.col("_c"))).drop("_c"), repaired(rows, edits, size)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with every twentieth row lost, emptied, without end marks, doubled or given to the user, by CRC-32 of ``conv_id:turn``."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(value("text"), "[.!?]", "")).otherwise(value("text"))
    rows = turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(value("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("sequence(1, _n)"))).drop("col")


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and then repaired; those without rows after the damage have zeros and empty texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, fixed = repair(damaged(turns))
    sha = digests(fixed).withColumnRenamed("conv", "_s")
    out = turns.select("conv_id").distinct().join(found, same(F.col("conv_id"), F.col("conv")), "left").join(sha, same(F.col("conv_id"), F.col("_s")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
