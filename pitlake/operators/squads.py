"""Rules and scoring for large numbers of fixed-size squads.

A squad has fifteen rows per period, so arrays and windows inside one squad are small by
definition; everything across squads is an ordinary join or aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import HIT_COST, MAX_FREE, selling_price
from ..session import materialise
from .scale import grown_join, spread_join, top_rows

# Fixed values of the game.
SQUAD_SIZE = 15
LINEUP_SIZE = 11
QUOTAS = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}
MAX_PER_CLUB = 3
FORMATIONS = [(3, 4, 3), (3, 5, 2), (4, 3, 3), (4, 4, 2), (4, 5, 1), (5, 2, 3), (5, 3, 2), (5, 4, 1)]
CHIPS = ["wildcard", "free_hit", "bench_boost", "triple_captain"]
FIRST_HALF_END = 19
LEGAL = [f"{d}-{m}-{f}" for d, m, f in FORMATIONS]


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _violations(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def played(df: DataFrame, name: str = "played") -> DataFrame:
    """Took part: any minutes, or a card."""
    cards = F.coalesce("yellow_cards", F.lit(0)) + F.coalesce("red_cards", F.lit(0))
    return df.withColumn(name, (F.coalesce("minutes", F.lit(0)) > 0) | (cards > 0))


def formations(squads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Formation of each lineup and whether it is one of the legal ones (with exactly one keeper)."""
    inside = F.col("in_lineup")
    counts = squads.groupBy(*keys).agg(
        _count(inside).alias("n_lineup"),
        *[_count(inside & (F.col("position") == p)).alias(p) for p in QUOTAS],
    )
    shape = F.concat_ws("-", *[F.col(p).cast("string") for p in ("DEF", "MID", "FWD")])
    legal = (F.col("GK") == 1) & (F.col("n_lineup") == LINEUP_SIZE) & shape.isin(LEGAL)
    return counts.select(*keys, shape.alias("formation"), legal.alias("is_legal"))


def audit_squads(squads: DataFrame, bank: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names of the rules each squad breaks; an unknown club is exempt from the club limit.

    Squads are shuffled before they are counted: a task that reads a whole file of squads holds no counts of them.
    """
    squads = squads.repartition(*keys)
    inside, pos = F.col("in_lineup"), F.col("position")
    per_club = squads.groupBy(*keys, "team").agg(
        F.count(F.lit(1)).alias("n"), _count(inside).alias("n_in"),
        *[_count(pos == p).alias(f"n_{p}") for p in QUOTAS],
        *[_count(inside & (pos == p)).alias(f"in_{p}") for p in QUOTAS],
        _count(F.col("is_captain") & inside).alias("cap"), _count(F.col("is_vice") & inside).alias("vice"),
    )
    s = lambda c: F.sum(c).alias(c)
    total = per_club.groupBy(*keys).agg(
        s("n"), s("n_in"), *[s(f"n_{p}") for p in QUOTAS], *[s(f"in_{p}") for p in QUOTAS], s("cap"), s("vice"),
        F.coalesce(F.max(F.when(F.col("team").isNotNull(), F.col("n"))), F.lit(0)).alias("most"),
    )
    total = grown_join(total, bank, keys, "left")
    shape = F.concat_ws("-", *[F.col(f"in_{p}").cast("string") for p in ("DEF", "MID", "FWD")])
    checks = {
        "size": F.col("n") != SQUAD_SIZE,
        **{f"quota_{p}": F.col(f"n_{p}") != q for p, q in QUOTAS.items()},
        "lineup_size": F.col("n_in") != LINEUP_SIZE,
        "bench_size": F.col("n") - F.col("n_in") != SQUAD_SIZE - LINEUP_SIZE,
        "lineup_keeper": F.col("in_GK") != 1,
        "formation": ~shape.isin(LEGAL),
        "club_limit": F.col("most") > MAX_PER_CLUB,
        "captain": F.col("cap") != 1,
        "vice_captain": F.col("vice") != 1,
        "bank": F.coalesce(F.col("bank") < 0, F.lit(False)),
    }
    return total.select(*keys, _violations(checks).alias("violations"))


def _line_arrays(squads: DataFrame, keys: Sequence[str], xp: str) -> DataFrame:
    """Per squad and position, expected points in descending order."""
    return squads.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("position") == p, F.col(xp))), False).alias(p) for p in QUOTAS]
    )


def _with_best(df: DataFrame, arrays: dict[str, Column], name: str) -> DataFrame:
    """Add ``name``: best (objective, formation) over the legal formations, NULL when none can be filled.

    For fixed counts the best lineup takes the top players of each position, which maximises the
    sum and the captain's extra points at once, so eight sums replace a search. A position's
    running sums are plain columns; one that needs a missing player is NULL and rules itself out.
    """
    own = f"{name}_"
    out = df.withColumns({f"{own}{p}": a for p, a in arrays.items()})
    sums: dict[str, Column] = {f"{own}GK1": F.get(f"{own}GK", F.lit(0))}
    for p in ("DEF", "MID", "FWD"):
        total = F.get(f"{own}{p}", F.lit(0))
        sums[f"{own}{p}1"] = total
        for i in range(1, QUOTAS[p]):
            total = total + F.get(f"{own}{p}", F.lit(i))
            sums[f"{own}{p}{i + 1}"] = total
    out = out.withColumns(sums)
    c = lambda key: F.col(own + key)
    captain = F.greatest(c("GK1"), c("DEF1"), c("MID1"), c("FWD1"))

    def option(d: int, m: int, f: int) -> Column:
        points = c("GK1") + c(f"DEF{d}") + c(f"MID{m}") + c(f"FWD{f}") + captain
        return F.when(points.isNotNull(), F.struct(points.alias("objective"), F.lit(f"{d}-{m}-{f}").alias("formation")))

    out = out.withColumn(name, F.greatest(*[option(*shape) for shape in FORMATIONS]))
    return out.drop(*[f"{own}{p}" for p in arrays], *sums)


def best_lineup(squads: DataFrame, keys: Sequence[str], xp: str) -> DataFrame:
    """Best lineup value (eleven starters plus the captain again) and its formation; ``xp`` is integral."""
    arrays = _line_arrays(squads, keys, xp)
    best = _with_best(arrays, {p: F.col(p) for p in QUOTAS}, "__best")
    return best.select(*keys, "__best.objective", "__best.formation")


def bench_order(bench: DataFrame, keys: Sequence[str], item: str, xp: str) -> DataFrame:
    """Bench places: the keeper first, then by expected points."""
    w = Window.partitionBy(*keys).orderBy((F.col("position") == "GK").desc(), F.col(xp).desc(), F.col(item))
    return bench.withColumn("bench_place", F.row_number().over(w))


def build_pool(
    facts: DataFrame, keys: Sequence[str], points: str, price: str, order: str, players: DataFrame, item: str,
    preds: DataFrame | None = None,
) -> DataFrame:
    """Players available per period: merged points, first price, position and team all valid.

    The value is the prediction (0 where there is none) or, without predictions, the points scored.
    """
    merged = facts.groupBy(*keys).agg(F.sum(points).alias("points"), F.min_by(price, order).alias("price"))
    pool = merged.join(players.select(item, "position", "team"), item)
    pool = pool.where(F.col("position").isNotNull() & F.col("team").isNotNull() & (F.coalesce("price", F.lit(0)) > 0))
    if preds is None:
        return pool.withColumn("xp", F.col("points").cast("double")).drop("points")
    pool = pool.join(preds.select(*keys, F.col("prediction").alias("xp")), list(keys), "left")
    return pool.fillna(0.0, ["xp"]).drop("points")


def _asks(squads: DataFrame, ledger: DataFrame, keys: list[str], item: str, xp: str) -> DataFrame:
    """One row per slot with what it may spend, the squad's members, and its clubs of at least three (``__crowded``) and four (``__over``).

    A squad's fifteen rows are packed into arrays once, so candidates are judged beside the slot and need no join.
    """
    # shuffled before they are packed: no task holds parts of all squads
    rows = squads.repartition(*keys).groupBy(*keys).agg(
        F.collect_list(F.struct("position", "slot", F.col("team").alias("out_team"), F.col(xp).alias("out_xp"), "sell_price")).alias("__slots"),
        F.collect_list(item).alias("__owned"), F.sort_array(F.collect_list("team")).alias("__clubs"))
    # sorted clubs: one that meets itself ``n - 1`` places further has at least ``n`` members
    at_least = lambda n: F.array_distinct(F.filter("__clubs", lambda t, i: t == F.get("__clubs", i + (n - 1))))
    rows = rows.withColumns({"__crowded": at_least(MAX_PER_CLUB), "__over": at_least(MAX_PER_CLUB + 1)})
    rows = grown_join(rows.drop("__clubs"), ledger.select(*keys, "bank", "free"), keys)
    out = rows.select(*keys, "bank", "free", "__owned", "__crowded", "__over", F.inline("__slots"))
    return out.withColumn("__budget", F.col("bank") + F.col("sell_price")).drop("bank", "sell_price")


def _best_incoming(squads: DataFrame, pool: DataFrame, ledger: DataFrame, keys: list[str], period: str, item: str, xp: str, first_look: int) -> DataFrame:
    """For each slot of each squad the best ``in_xp`` of a non-member that is affordable and within the club limit.

    A pool is looked at from the best value down: the first legal candidate is the answer. Slots that
    find none among the ``first_look`` best of their position look eight times deeper, and so on to
    the end of the pool, past candidates that none of them can pay; slots that cannot pay its cheapest member drop out at once.
    """
    spare = sum(QUOTAS.values())
    group = [period, "position"]
    pool = pool.select(*group, F.col(item).alias("in_item"), F.col("team").alias("in_team"), "price", F.col(xp).alias("in_xp"))
    # a pool may come from a small file that grows in one task
    pool = materialise(pool.repartition(*group, "in_item"), "transfers")
    floor = materialise(pool.groupBy(*group).agg(F.min("price").alias("__least"), F.count(F.lit(1)).alias("__members")), "transfers")
    depth = floor.agg(F.max("__members")).first()[0] or 0
    asks = _asks(squads, ledger, keys, item, xp)
    open_ = materialise(spread_join(asks, floor.drop("__members"), group, [keys[0]]).where(F.col("__least") <= F.col("__budget")).drop("__least"), "transfers")
    has = lambda array, value: F.coalesce(F.array_contains(array, F.col(value)), F.lit(False))
    full = has("__crowded", "in_team") & ~(F.col("in_team").eqNullSafe(F.col("out_team")) & ~has("__over", "in_team"))
    found, look = None, first_look
    while True:
        # what no open slot can pay is no candidate
        most = materialise(open_.groupBy(*group).agg(F.max("__budget").alias("__most")), "transfers")
        within = spread_join(pool, most, group, ["in_item"]).where(F.col("price") <= F.col("__most")).drop("__most")
        short = materialise(top_rows(within, group, [F.col("in_xp").desc(), F.col("in_item")], look + spare, "__place").drop("__place"), "transfers")
        swaps = spread_join(open_, short, group, [keys[0]]).where((F.col("price") <= F.col("__budget")) & ~has("__owned", "in_item") & ~full)
        best = swaps.groupBy(*keys, "slot", "position", "out_xp", "free").agg(F.max("in_xp").alias("in_xp"))
        best = materialise(best, "transfers")
        found = best if found is None else found.unionByName(best)
        if look >= depth:
            return found
        open_ = materialise(grown_join(open_, best.select(*keys, "slot"), [*keys, "slot"], "left_anti"), "transfers")
        if open_.isEmpty():
            return found
        look *= 8


def best_single_transfer(
    squads: DataFrame, pool: DataFrame, ledger: DataFrame, squad: str, period: str, item: str, xp: str, first_look: int = 20
) -> DataFrame:
    """Best value reachable with at most one transfer, net of the hit, and the gain over none.

    ``squads`` carry ``sell_price``, ``ledger`` holds ``bank`` and ``free`` per squad and period, and
    ``pool`` has unique (period, item) with position, team, price and the integral ``xp``. All
    non-members of a position are candidates. Swapping a given player for a better one of
    the same position never lowers the lineup value, so per outgoing player only the best affordable
    candidate within the club limit needs a lineup value: at most fifteen per squad. ``first_look``
    only says how many are looked at first.
    """
    keys = [squad, period]
    best = _best_incoming(squads, pool, ledger, keys, period, item, xp, first_look)
    arrays = _line_arrays(squads, keys, xp)

    def swapped(p: str) -> Column:
        where = F.array_position(F.col(p), F.col("out_xp")).cast("int")
        rest = F.filter(F.col(p), lambda _v, i: i != where - 1)
        changed = F.sort_array(F.concat(rest, F.array("in_xp")), False)
        return F.when(F.col("position") == p, changed).otherwise(F.col(p))

    arrays = _with_best(arrays, {p: F.col(p) for p in QUOTAS}, "__now").withColumn("before", F.col("__now.objective"))
    alternatives = grown_join(arrays, best, keys, "left")
    alternatives = _with_best(alternatives, {p: swapped(p) for p in QUOTAS}, "__new")
    hit = F.greatest(1 - F.col("free"), F.lit(0)) * HIT_COST
    after = F.when(F.col("slot").isNotNull(), F.col("__new.objective") - hit)
    value = alternatives.select(*keys, "before", after.alias("after"))
    result = value.groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    objective = F.greatest("before", "after")
    return result.select(*keys, "before", objective.alias("objective"), (objective - F.col("before")).alias("gain"))


def _with_facts(squads: DataFrame, facts: DataFrame, period: str, item: str) -> DataFrame:
    cols = [period, item, "total_points", "minutes", "yellow_cards", "red_cards"]
    out = played(squads.join(facts.select(*[c for c in cols if c in facts.columns]), [period, item], "left"))
    return out.withColumn("total_points", F.coalesce("total_points", F.lit(0)))


def squad_points(squads: DataFrame, facts: DataFrame, keys: Sequence[str], period: str = "gw", item: str = "element") -> DataFrame:
    rows = _with_facts(squads, facts, period, item)
    inside = F.col("in_lineup")
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("total_points"))), F.lit(0))
    return rows.groupBy(*keys).agg(pick(inside).alias("lineup_points"), pick(~inside).alias("bench_points"))


def captain_bonus(
    squads: DataFrame, facts: DataFrame, chips: DataFrame, keys: Sequence[str], period: str = "gw", item: str = "element"
) -> DataFrame:
    """Extra captain points (doubled or tripled) and whether the vice-captain had to step in.

    The failover flag is also true when neither of the two counted.
    """
    rows = _with_facts(squads, facts, period, item)
    good = F.col("played") & F.col("in_lineup")
    cap, vice = F.col("is_captain") & good, F.col("is_vice") & good
    sides = rows.groupBy(*keys).agg(
        F.max(F.when(cap, F.col("total_points"))).alias("__cap"), F.max(F.when(vice, F.col("total_points"))).alias("__vice")
    )
    sides = grown_join(sides, chips.select(*keys, "chip"), keys, "left")
    extra = F.when(F.col("chip") == "triple_captain", 2).otherwise(1)
    points = F.coalesce(F.col("__cap"), F.col("__vice"), F.lit(0)) * extra
    return sides.select(*keys, points.alias("captain_points"), F.col("__cap").isNull().alias("captain_failover"))


def auto_subs(squads: DataFrame, facts: DataFrame, keys: Sequence[str], period: str = "gw", item: str = "element") -> DataFrame:
    """Substitute absent starters by the bench in order while the formation stays legal.

    A fold over the bench with the lineup as state. Gives one row per player with the new
    ``in_lineup``, the element replaced (``for_element``) and the bench order of those left.
    """
    rows = _with_facts(squads, facts, period, item)
    place = F.struct(
        F.col("slot").alias("place"), F.col("slot").alias("slot"), F.col("position").alias("position"),
        (~F.col("played")).alias("open"), F.lit(None).cast("bigint").alias("out_slot"),
    )
    bench = F.struct(F.col("bench_order").alias("place"), F.col("slot"), F.col("position"), F.col("played"))
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("in_lineup"), place))).alias("__lineup"),
        F.array_sort(F.collect_list(F.when(~F.col("in_lineup"), bench))).alias("__bench"),
    )

    def formation_after(lineup: Column, out_pos: Column, in_pos: Column) -> Column:
        def n(p: str) -> Column:
            now = F.size(F.filter(lineup, lambda x: x["position"] == p))
            return now - F.when(out_pos == p, 1).otherwise(0) + F.when(in_pos == p, 1).otherwise(0)

        shape = F.concat_ws("-", *[n(p).cast("string") for p in ("DEF", "MID", "FWD")])
        return (n("GK") == 1) & (F.size(lineup) == LINEUP_SIZE) & shape.isin(LEGAL)

    def step(lineup: Column, sub: Column) -> Column:
        options = F.filter(lineup, lambda x: x["open"] & formation_after(lineup, x["position"], sub["position"]))
        chosen = F.try_element_at(options, F.lit(1))["place"]

        def replace(x: Column) -> Column:
            new = F.struct(
                x["place"].alias("place"), sub["slot"].alias("slot"), sub["position"].alias("position"),
                F.lit(False).alias("open"), x["slot"].alias("out_slot"),
            )
            return F.when(x["place"] == chosen, new).otherwise(x)

        return F.when(sub["played"] & chosen.isNotNull(), F.transform(lineup, replace)).otherwise(lineup)

    final = packed.select(*keys, F.explode(F.aggregate("__bench", F.col("__lineup"), step)).alias("__x"))
    final = final.select(*keys, F.col("__x.slot").alias("slot"), F.col("__x.out_slot").alias("__out"))
    names = squads.select(*keys, F.col("slot").alias("__out"), F.col(item).alias("for_element"))
    final = grown_join(final, names, [*keys, "__out"], "left").withColumn("__now", F.lit(True)).drop("__out")
    out = grown_join(squads, final, [*keys, "slot"], "left")
    inside = F.coalesce("__now", F.lit(False))
    was_bench = F.when(~inside, F.col("bench_order"))
    return out.withColumns({"in_lineup": inside, "bench_order": was_bench}).drop("__now")


def gameweek_score(
    squads: DataFrame, facts: DataFrame, ledger: DataFrame, chips: DataFrame, keys: Sequence[str], period: str = "gw",
    item: str = "element",
) -> DataFrame:
    """Lineup + captain + bench (under a bench boost) - hit; ``ledger`` holds ``hit`` per squad and period.

    Pass squads through :func:`auto_subs` first to score the lineup that really played.
    """
    base = squad_points(squads, facts, keys, period, item)
    cap = captain_bonus(squads, facts, chips, keys, period, item)
    out = grown_join(grown_join(base, cap, keys), chips.select(*keys, "chip"), keys, "left")
    out = grown_join(out, ledger, keys, "left")
    boost = F.when(F.col("chip") == "bench_boost", F.col("bench_points")).otherwise(0)
    out = out.withColumn("hit", F.coalesce("hit", F.lit(0)))
    out = out.withColumn("gw_points", F.col("lineup_points") + F.col("captain_points") + boost)
    return out.withColumn("net_points", F.col("gw_points") - F.col("hit"))


def free_transfer_ledger(ledger: DataFrame, squad: str, period: str, start: int = 1) -> DataFrame:
    """Free transfers before and after each period: unused ones carry over, plus one, at most five.

    ``ledger(squad, period, n, chip)``; a wildcard or free hit leaves the balance as it is.
    """
    moves = ledger.groupBy(squad).agg(
        F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col("n").cast("int").alias("n"), "chip"))).alias("__m")
    )
    empty = F.array(F.struct(F.lit(None).cast("bigint").alias("p"), F.lit(0).alias("free"), F.lit(start).alias("next")))

    def step(states: Column, move: Column) -> Column:
        free = F.element_at(states, -1)["next"]
        kept = F.coalesce(move["chip"].isin("wildcard", "free_hit"), F.lit(False))
        after = F.when(kept, free).otherwise(F.least(F.greatest(free - move["n"], F.lit(0)) + 1, F.lit(MAX_FREE)))
        state = F.struct(move["p"].cast("bigint").alias("p"), free.alias("free"), after.alias("next"))
        return F.concat(states, F.array(state))

    folded = moves.select(squad, F.explode(F.aggregate("__m", empty, step)).alias("__s")).where("__s.p is not null")
    return folded.select(squad, F.col("__s.p").alias(period), F.col("__s.free").alias("free"), F.col("__s.next").alias("free_next"))


def validate_chips(chips: DataFrame, squad: str, period: str) -> DataFrame:
    """Rules each chip use breaks: unknown name, second chip in a period, second use in a half,
    free hits in both of the two middle periods.

    Uses are judged in the order of period and name, and only accepted ones count against later ones,
    so a squad's uses, a few a period at most, are folded from the first to the last.
    """
    use = F.struct(F.col(period).alias("p"), F.col("chip").alias("chip"))
    kind = f"array<struct<p:{chips.schema[period].dataType.simpleString()},chip:string>>"
    start = F.struct(F.array().cast(kind).alias("booked"), F.array().cast("array<array<string>>").alias("out"))

    def judge(state: Column, u: Column) -> Column:
        booked, half = state["booked"], lambda x: x["p"] <= FIRST_HALF_END
        free_hit = lambda x, at: (x["chip"] == "free_hit") & (x["p"] == at)
        found = _violations({
            "unknown": F.coalesce(~u["chip"].isin(CHIPS), F.lit(True)),
            "second_in_period": F.exists(booked, lambda x: x["p"] == u["p"]),
            "used_in_half": F.exists(booked, lambda x: (x["chip"] == u["chip"]) & (half(x) == half(u))),
            "free_hit_twice": free_hit(u, FIRST_HALF_END + 1) & F.exists(booked, lambda x: free_hit(x, FIRST_HALF_END)),
        })
        return F.struct(F.when(F.size(found) == 0, F.array_append(booked, u)).otherwise(booked).alias("booked"), F.array_append(state["out"], found).alias("out"))

    uses = chips.groupBy(squad).agg(F.sort_array(F.collect_list(use)).alias("__uses"))
    judged = uses.withColumn("__out", F.aggregate("__uses", start, judge, lambda s: s["out"]))
    each = judged.select(squad, F.inline(F.arrays_zip("__uses", "__out")))
    return each.select(squad, F.col("__uses.p").alias(period), F.col("__uses.chip").alias("chip"), F.col("__out").alias("violations"))


def audit_transfers(
    ledger: DataFrame, squads: DataFrame, players: DataFrame, bank: DataFrame, squad: str, period: str, item: str
) -> DataFrame:
    """Rules broken by each squad's transfers of a period.

    ``ledger(squad, period, element_out, element_in)``, ``squads`` with ``sell_price``, and
    ``players(period, item, position, team, price)``. Swaps run in the order that frees most cash
    first, and the bank may never fall below zero on the way. A player without a price in the period
    costs that of the period before; one without either is an unknown price, and one without a
    position an unknown position: such swaps cost nothing but are violations.
    """
    keys = [squad, period]
    sold = squads.select(
        *keys, F.col(item).alias("element_out"), F.col("sell_price"), F.col("position").alias("out_pos"),
        F.col("team").alias("out_team"), F.lit(True).alias("__owned"),
    )
    bought = players.select(
        period, F.col(item).alias("element_in"), F.col("price"), F.col("position").alias("in_pos"), F.col("team").alias("in_team")
    )
    before = players.select((F.col(period) + 1).alias(period), F.col(item).alias("element_in"), F.col("price").alias("__before"))
    t = grown_join(ledger, sold, [*keys, "element_out"], "left")
    t = grown_join(grown_join(t, bought, [period, "element_in"], "left"), bank, keys, "left")
    t = grown_join(t, before, [period, "element_in"], "left").withColumn("price", F.coalesce("price", "__before"))
    cash = F.coalesce("sell_price", F.lit(0)) - F.coalesce("price", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(F.col("__cash").desc(), F.col("element_out"), F.col("element_in"))
    t = t.withColumn("__cash", cash)
    t = t.withColumn("__bank", F.coalesce("bank", F.lit(0)) + F.sum("__cash").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per_swap = t.groupBy(*keys).agg(
        F.count("element_out").alias("n_out"), F.count("element_in").alias("n_in"),
        _count(F.col("element_out").isNotNull() & F.col("__owned").isNull()).alias("not_owned"),
        F.min("__bank").alias("lowest_bank"),
        _count(F.col("element_in").isNotNull() & F.col("price").isNull()).alias("no_price"),
        _count(F.col("element_in").isNotNull() & F.col("in_pos").isNull()).alias("no_position"),
        *[(_count(F.col("in_pos") == p) - _count(F.col("out_pos") == p)).alias(f"d_{p}") for p in QUOTAS],
    )
    moves = t.select(*keys, F.inline(F.array(
        F.struct(F.col("out_team").alias("team"), F.lit(-1).alias("d")), F.struct(F.col("in_team").alias("team"), F.lit(1).alias("d")))))
    held = grown_join(squads, ledger.select(*keys).distinct(), keys, "left_semi").select(*keys, "team", F.lit(1).alias("d"))
    clubs = held.unionByName(moves).where("team is not null").groupBy(*keys, "team").agg(F.sum("d").alias("n"))
    most = clubs.groupBy(*keys).agg(F.max("n").alias("most"))
    checks = {
        "unequal": F.col("n_out") != F.col("n_in"),
        "not_owned": F.col("not_owned") > 0,
        "unknown_price": F.col("no_price") > 0,
        "unknown_position": F.col("no_position") > 0,
        "bank": F.col("lowest_bank") < 0,
        "composition": F.greatest(*[F.abs(f"d_{p}") for p in QUOTAS]) > 0,
        "club_limit": F.coalesce("most", F.lit(0)) > MAX_PER_CLUB,
    }
    out = grown_join(per_swap, most, keys, "left")
    return out.select(*keys, F.col("n_out").alias("n_transfers"), "lowest_bank", _violations(checks).alias("violations"))


def team_value(squads: DataFrame, prices: DataFrame, keys: Sequence[str], period: str, item: str = "element") -> DataFrame:
    """Sum of selling prices per squad and period, and its change from the period before."""
    priced = grown_join(squads, prices, [*keys, period, item])
    value = priced.groupBy(*keys, period).agg(F.sum(selling_price("purchase_price", "current_price")).alias("value"))
    return value.withColumn("value_change", F.col("value") - F.lag("value").over(Window.partitionBy(*keys).orderBy(period)))


def reward(
    net: DataFrame, value: DataFrame, averages: DataFrame, keys: Sequence[str], period: str, w_rel: float = 0.1, w_val: float = 0.05
) -> DataFrame:
    """Net points, plus a share of the lead over the period average and of the value gained (in tens)."""
    df = spread_join(grown_join(net, value, [*keys, period], "left"), averages, [period], keys, "left")
    relative = F.col("net") - F.coalesce("period_avg", F.lit(0.0))
    change = F.coalesce("value_change", F.lit(0)) / 10.0
    return df.withColumn("reward", F.col("net") + w_rel * relative + w_val * change)


def season_report(
    scores: DataFrame, shapes: DataFrame, captains: DataFrame, names: DataFrame, moves: DataFrame, squad: str, period: str
) -> DataFrame:
    """One line per squad and period: formation, points, hit, cumulative net, captain and transfers by name."""
    keys = [squad, period]
    label = lambda side: names.select(F.col("element").alias(f"element_{side}"), F.col("name").alias(f"name_{side}"))
    named = moves.join(label("out"), "element_out", "left").join(label("in"), "element_in", "left")
    pair = F.concat_ws(
        ">", F.coalesce("name_out", F.col("element_out").cast("string")), F.coalesce("name_in", F.col("element_in").cast("string"))
    )
    listed = named.groupBy(*keys).agg(F.concat_ws(", ", F.array_sort(F.collect_list(pair))).alias("transfers"))
    caps = captains.join(names.select("element", F.col("name").alias("captain")), "element", "left").select(*keys, "captain")
    running = F.sum("net_points").over(
        Window.partitionBy(squad).orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = grown_join(grown_join(grown_join(scores, shapes, keys), caps, keys, "left"), listed, keys, "left")
    return out.select(
        *keys, "formation", F.col("gw_points").alias("gross"), "hit", F.col("net_points").alias("net"),
        running.alias("cumulative"), "captain", F.coalesce("transfers", F.lit("")).alias("transfers"),
    )


def audit_free_hit(squads: DataFrame, chips: DataFrame, squad: str, period: str, item: str = "element") -> DataFrame:
    """For every free hit with a following period: how many members differ from the period before it."""
    used = chips.where(F.col("chip") == "free_hit").select(squad, F.col(period).alias("hit_period")).distinct()
    rows = grown_join(squads.select(squad, period, item), used, [squad])
    rows = rows.where(F.col(period).isin(F.col("hit_period") - 1, F.col("hit_period") + 1))
    side = rows.groupBy(squad, "hit_period", item).agg(
        F.max((F.col(period) < F.col("hit_period")).cast("int")).alias("before"),
        F.max((F.col(period) > F.col("hit_period")).cast("int")).alias("after"),
    )
    out = side.groupBy(squad, "hit_period").agg(
        F.sum(F.when(F.col("before") != F.col("after"), 1).otherwise(0)).alias("n_different"),
        F.max("before").alias("__b"), F.max("after").alias("__a"),
    )
    out = out.where((F.col("__b") == 1) & (F.col("__a") == 1))
    return out.select(squad, "hit_period", "n_different", (F.col("n_different") == 0).alias("reverted"))
