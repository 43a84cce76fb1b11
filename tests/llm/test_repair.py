"""Repair against an exhaustive table of all edits, and cases that it must stand."""

import hashlib
import random
import re
import zlib
from functools import lru_cache, partial

import pytest

from pitlake.llm import repair as R


def plain(codes, start=0, ends=(0, 3)):
    """(cost, audit) by a table over rows and states: the least pair of each, at most three insertions between rows."""
    ways = {start: (0, "")}

    def inserted(ways):
        for _ in range(3):
            for q, (c, a) in list(ways.items()):
                for x in "ua":
                    if (q, x) in R.STEP:
                        to = R.STEP[q, x]
                        ways[to] = min(ways.get(to, (c + 3, a + "I")), (c + 3, a + "I"))
        return ways

    ways = inserted(dict(ways))
    for initial, mark in codes:
        new = {}

        def put(q, way):
            new[q] = min(new.get(q, way), way)

        for q, (c, a) in ways.items():
            put(q, (c + 4, a + "D"))
            late = 3 if mark == "t" else 0
            if mark != "x":
                if (q, initial) in R.STEP:
                    put(R.STEP[q, initial], (c + late, a + "K"))
                for x in "ua":
                    if (q, x) in R.STEP:
                        put(R.STEP[q, x], (c + 3 + late, a + "R"))
        ways = inserted(new)
    return min((ways[q] for q in ends if q in ways), default=None)


def every_audit(codes):
    """All edit sequences of a short conversation with at most two insertions in a place."""

    @lru_cache(None)
    def rest(i, q, added):
        out = {""} if i == len(codes) and q in (0, 3) else set()
        if added < 2:
            for x in "ua":
                if (q, x) in R.STEP:
                    out |= {"I" + a for a in rest(i, R.STEP[q, x], added + 1)}
        if i < len(codes):
            initial, mark = codes[i]
            out |= {"D" + a for a in rest(i + 1, q, 0)}
            if mark != "x":
                if (q, initial) in R.STEP:
                    out |= {"K" + a for a in rest(i + 1, R.STEP[q, initial], 0)}
                for x in "ua":
                    if (q, x) in R.STEP:
                        out |= {"R" + a for a in rest(i + 1, R.STEP[q, x], 0)}
        return frozenset(out)

    def cost(audit):
        i, total = 0, 0
        for e in audit:
            total += {"K": 0, "R": 3, "D": 4, "I": 3}[e]
            if e != "I":
                total += 3 if codes[i][1] == "t" and e != "D" else 0
                i += 1
        return total

    return min((cost(a), a) for a in rest(0, 0, 0))


def codes_of(rng, n):
    return [rng.choice("suaau?") + rng.choice("----tx") for _ in range(n)]


def test_search_finds_the_cheapest_and_least_audit():
    rng = random.Random(1)
    for _ in range(300):
        codes = codes_of(rng, rng.randrange(7))
        assert R.search(codes, 0, R.ACCEPTED) == plain(codes) == every_audit(tuple(codes)), codes
    for _ in range(300):
        codes = codes_of(rng, rng.randrange(40))
        for a in range(4):
            for b in range(4):
                assert R.search(codes, a, (b,)) == plain(codes, a, (b,)), (codes, a, b)


def test_parts_put_together_equal_one_search():
    rng = random.Random(2)
    for _ in range(60):
        codes = codes_of(rng, rng.randrange(8, 120))
        joiner, out = R._Joiner(), []
        for part in range(-(-len(codes) // 8)):
            own = codes[part * 8 : part * 8 + 8]
            ways = [dict(start=a, end=b, cost=r[0], audit=r[1]) for a in ((0,) if part == 0 else range(4)) for b in range(4) if (r := R.search(own, a, (b,)))]
            out += joiner.add(part, "".join(own), ways)
        out += joiner.end()
        assert (sum(r[1] for r in out), "".join(r[3] for r in out)) == plain(codes)
        assert sum(r[2] for r in out) == R._bad_pairs("".join(c[0] for c in codes))
        kept = [(r[0] * 8 + p if p is not None else -1, role) for r in out for _, p, role in r[4]]
        assert kept == R.lines(codes, 0, "".join(r[3] for r in out))[0]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole(rows):
    """The query's row for the rows (turn, role, text) of one conversation after damage."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", sha(""))
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, codes, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        codes.append((role[:1] if role[:1] in ("s", "u", "a") and role else "?") + ("t" if fault == "truncated" else "x" if fault else "-"))
    cost, audit = plain(codes)
    out, i, state = [], 0, 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        letter = codes[i][0] if e == "K" else "a" if state == 2 else "u"
        role = rows[i][1] if e == "K" else {"u": "user", "a": "assistant"}[letter]
        out.append(f"{role}:{'' if e == 'I' else rows[i][2]}")
        i += e != "I"
        state = R.STEP[state, letter]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], R._bad_pairs("".join(c[0] for c in codes)), cost, audit, sha("\n".join(out)))


def damage(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def as_tuple(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def check(spark, tmp_path, rows):
    spark.createDataFrame([(c, t, r, x, "y") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, place string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: as_tuple(r) for r in R.conversation_repair(spark, str(tmp_path)).collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).extend(damage(c, t, r, x))
    assert got == {c: whole(v) for c, v in want.items()}


@pytest.mark.parametrize("part", [256, 4])
def test_query_matches_plain_python(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(R, "repair", partial(R.repair, size=part))
    rng = random.Random(part)
    said = ["Ja.", "Nein!", "no end", "", None, " \t", "Was?", "x" * 30_000 + ".", "é? "]
    rows = []
    for conv in [*range(120), None, -7]:
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(said)))
    rows += rows[:9]  # repeated rows
    check(spark, tmp_path, rows)


def test_one_long_conversation_among_short_ones(spark, tmp_path):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randrange(400)}{rng.choice('.!?x')}") for t in range(3000)]
    rows += [(2, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(R.PART)]  # exactly one part
    check(spark, tmp_path, rows + [(3, 0, "user", "a.")])


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])
