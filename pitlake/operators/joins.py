"""Joins: identity resolution, as-of and scaffold joins, opponent joins, fallbacks and back-fills.

No join is forced to broadcast: dimensions are small when they are, and adaptive execution finds
out by measuring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.names import normalise_name, trimmed
from ..functions.scalars import apply_alias
from ..functions.stats import share
from ..session import materialise
from .aggs import two_level
from .scale import first_after, spread_join, top_rows
from .windows import lagged_rolling


def attach_code(facts: DataFrame, id_map: DataFrame, on: Sequence[str] = ("season", "element")) -> DataFrame:
    """Season-local id to stable code; facts without a mapping are dropped."""
    return facts.join(id_map, list(on))


def assemble(base: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins of keyed parts onto the base; each part is unique on its keys."""
    out = base
    for part, on in parts:
        out = out.join(part, list(on), "left")
    return out


def scaffold(entities: DataFrame, periods: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Every entity at every period of its scope; a scope's entities are spread over several tasks."""
    names = [c for c in entities.columns if c not in scope]
    out = spread_join(entities.distinct(), periods.distinct(), scope, names)
    return out.select(*entities.columns, *[c for c in periods.columns if c not in scope])


def asof_rolling(
    events: DataFrame, cutoffs: DataFrame, scope: Sequence[str], key: str, ts: str, tie: str,
    specs: Sequence[tuple[str, str, int]], period: str = "period", cutoff: str = "cutoff",
    entities: DataFrame | None = None,
) -> DataFrame:
    """Means of the last ``n`` events strictly before each cut-off, for every key and cut-off.

    ``specs`` are ``(output, column, n)``; ``entities(scope.., key)`` lists who gets rows, by default all
    keys with events, and those without get NULLs. An event belongs to the first cut-off after it, which a
    sweep over events and cut-offs finds, however many cut-offs a scope has. Of each
    (key, cut-off) only the newest ``max(n)`` events can matter to any cut-off, so the rest is
    dropped before the shuffle and the ordered pass sees at most that many rows per cut-off.
    """
    scope = list(scope)
    k = max(n for _, _, n in specs)
    cols = list(dict.fromkeys(c for _, c, _ in specs))
    own = events.select(*dict.fromkeys([*scope, key, ts, tie, *cols]))
    placed = first_after(own, cutoffs.select(*scope, cutoff, period), scope, ts, cutoff).where("__next is not null")
    placed = placed.withColumn("__p", F.col("__next")[period]).drop("__next")
    newest = top_rows(placed, [*scope, key, "__p"], [F.col(ts).desc(), F.col(tie).desc()], k, "__back")
    line = Window.partitionBy(*scope, key).orderBy(ts, tie)
    rolled = newest.withColumns({out: F.avg(c).over(line.rowsBetween(-(n - 1), 0)) for out, c, n in specs})
    outs = [out for out, _, _ in specs]
    ends = rolled.where("__back = 1").select(*scope, key, F.col("__p").alias(period), F.struct(*outs).alias("__f"))
    who = events if entities is None else entities
    grid = scaffold(who.select(*scope, key), cutoffs.select(*scope, period, cutoff), scope)
    carry = Window.partitionBy(*scope, key).orderBy(cutoff, period).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(ends, [*scope, key, period], "left").withColumn("__f", F.last("__f", ignorenulls=True).over(carry))
    return filled.select(*scope, key, period, cutoff, "__f.*")


def conceded(
    df: DataFrame, scope: Sequence[str], period: str, side: str, other: str, fixture: str, value: str, name: str = "conceded"
) -> DataFrame:
    """Per team and period, what its opponents scored in the fixtures they shared.

    One aggregate of the facts feeds both sides of the self-join; an opponent without rows counts 0.
    """
    keys = [*scope, period, fixture]
    scored = df.groupBy(*keys, side).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__v"), F.min(other).alias(other))
    against = scored.select(*keys, F.col(side).alias(other), F.col("__v").alias("__opp"))
    pairs = scored.select(*keys, side, other).join(against, [*keys, other], "left")
    return pairs.groupBy(*scope, side, period).agg(F.sum(F.coalesce("__opp", F.lit(0))).alias(name))


def attach_opponent(df: DataFrame, stats: DataFrame, scope: Sequence[str], period: str, team: str, opponent: str) -> DataFrame:
    """Team statistics attached through the opponent's id."""
    return df.join(stats.withColumnRenamed(team, opponent), [*scope, period, opponent], "left")


def fixture_difficulty(
    df: DataFrame, fixtures: DataFrame, on: Sequence[str], was_home: str = "was_home",
    home: str = "team_h_difficulty", away: str = "team_a_difficulty", name: str = "fdr",
) -> DataFrame:
    """Rating of the fixture for the row's side, scaled to 0-1; unknown when the home rating is."""
    out = df.join(fixtures.select(*on, home, away), list(on), "left")
    rating = F.when(F.col(was_home), F.col(home)).otherwise(F.col(away)) / 5.0
    return out.withColumn(name, F.when(F.col(home).isNotNull(), rating)).drop(home, away)


STRENGTH_SCALE = 1500.0


def opponent_strength(df: DataFrame, teams: DataFrame, opponent: str = "opponent_team", was_home: str = "was_home") -> DataFrame:
    """The opponent's strengths, home or away values by where it plays; all divided by one scale."""
    lookup = teams.select(
        F.col("id").alias(opponent), "strength", "strength_attack_home", "strength_attack_away",
        "strength_defence_home", "strength_defence_away",
    )
    out = df.join(lookup, opponent, "left")
    pick = lambda kind: F.when(F.col(was_home), F.col(f"strength_{kind}_away")).otherwise(F.col(f"strength_{kind}_home"))
    out = out.withColumns({
        "opp_strength": F.col("strength") / STRENGTH_SCALE,
        "opp_attack_strength": pick("attack") / STRENGTH_SCALE,
        "opp_defence_strength": pick("defence") / STRENGTH_SCALE,
    })
    return out.drop(*[c for c in lookup.columns if c != opponent])


def team_names(teams: DataFrame, master: DataFrame, scope: Sequence[str], name: str = "name", team: str = "id") -> DataFrame:
    """(scope, name) -> team id: a scope's own list of teams, or the master list where a scope has none.

    A scope with any usable row of its own takes nothing from the master list. Of several ids for a name
    the largest counts; rows without name or id are left out.
    """
    keys = [*scope, name]
    listed = [df.select(*keys, team).dropna(subset=[name, team]).groupBy(*keys).agg(F.max(team).alias(team)) for df in (teams, master)]
    return listed[0].unionByName(listed[1].join(listed[0].select(*scope).distinct(), list(scope), "left_anti"))


def sides_to_ids(
    matches: DataFrame, names: DataFrame, scope: Sequence[str], sides: Sequence[str], salt_by: Sequence[str],
    aliases: DataFrame | None = None, name: str = "name", team: str = "id",
) -> DataFrame:
    """Matches whose sides are named, with team ids in place of the names; a name that no list has becomes NULL.

    ``aliases`` (alias, name) translates another source's spellings first. The lists are short but a scope's matches
    are not, so each name is joined in parts by a hash of ``salt_by``.
    """
    columns = matches.columns
    for side in sides:
        matches = apply_alias(matches, side, aliases) if aliases is not None else matches
        lookup = names.select(*scope, F.col(name).alias(side), F.col(team).alias("__id"))
        matches = spread_join(matches, lookup, [*scope, side], salt_by, "left").withColumn(side, F.col("__id")).select(*columns)
    return matches


def attach_team_probs(df: DataFrame, probs: DataFrame, keys: Sequence[str], team: str, period_keys: Sequence[str], order: str) -> DataFrame:
    """Team probabilities for each (entity, period); an entity listed under two teams takes its first."""
    own = df.groupBy(*keys).agg(F.min_by(team, order).alias(team))
    return own.join(probs, [*period_keys, team], "left")


def coalesce_sources(primary: DataFrame, fallback: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Column by column, the primary source's value or else the fallback's."""
    other = fallback.select(*on, *[F.col(c).alias(f"__f_{c}") for c in cols])
    out = primary.join(other, list(on), "full_outer")
    return out.withColumns({c: F.coalesce(c, f"__f_{c}") for c in cols}).drop(*[f"__f_{c}" for c in cols])


def repair_team(
    df: DataFrame, scope: Sequence[str], fixture: str, team: str, opponent: str, gate: float = 0.5, name: str = "team_id"
) -> DataFrame:
    """Numeric team ids where the source has ids, names or nothing.

    The choice is made per scope (season): ids are kept when most rows have one; names are translated
    through fixtures with exactly two sides (a side's id is what the other side calls its opponent);
    otherwise the id is the fixture's other opponent.
    """
    scope = list(scope)
    df = df.withColumn("__numeric", F.col(team).try_cast("bigint"))
    gates = df.groupBy(*scope).agg(
        share(F.col(team).isNotNull()).alias("__has"), share(F.col("__numeric").isNotNull()).alias("__num")
    )
    sides = df.where(F.col(team).isNotNull()).groupBy(*scope, fixture, team).agg(F.min(opponent).alias("__opp"))
    two = sides.groupBy(*scope, fixture).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(F.col(team), F.col("__opp"))).alias("__a"),
        F.max(F.struct(F.col(team), F.col("__opp"))).alias("__b"),
    ).where("__n = 2")
    named = two.select(*scope, fixture, F.inline(F.array(
        F.struct(F.col(f"__a.{team}").alias(team), F.col("__b.__opp").alias("__id")),
        F.struct(F.col(f"__b.{team}").alias(team), F.col("__a.__opp").alias("__id")),
    ))).groupBy(*scope, team).agg(F.max_by("__id", fixture).alias("__mapped"))
    ends = df.groupBy(*scope, fixture).agg(F.min(opponent).alias("__lo"), F.max(opponent).alias("__hi"))
    between = df.select(*scope, fixture, opponent).distinct().groupBy(*scope, fixture).agg(F.count(opponent).alias("__sides"))
    ends = ends.join(between, [*scope, fixture])
    mapped_any = named.groupBy(*scope).agg(F.count(F.lit(1)).alias("__names"))
    gates = gates.join(mapped_any, scope, "left")
    out = spread_join(df, gates, scope, [fixture, opponent]).join(named, [*scope, team], "left").join(ends, [*scope, fixture])
    derived = F.when(F.col("__sides") == 2, F.when(F.col(opponent) == F.col("__lo"), F.col("__hi")).otherwise(F.col("__lo")))
    has_names = (F.col("__has") > gate) & (F.coalesce("__names", F.lit(0)) > 0)
    ids = F.when((F.col("__has") > gate) & (F.col("__num") > gate), F.col("__numeric")).when(has_names, F.col("__mapped")).otherwise(derived)
    return out.withColumn(name, ids).select(*[c for c in df.columns if c != "__numeric"], name)


def name_variants(people: DataFrame, code: str, order: str, first: str, second: str, web: str) -> DataFrame:
    """(norm, code, ord) rows: full, short, mixed and nick names of each person.

    The parts are normalised once and the spellings put together from them; ``ord`` sorts by
    person, then by spelling.
    """
    f, s, w = [F.coalesce(trimmed(c), F.lit("")) for c in (first, second, web)]
    parts = people.select(code, F.col(order).cast("bigint").alias("__order"), f.alias("__f"), s.alias("__s"), w.alias("__w"))
    parts = parts.withColumns({"__last": F.regexp_replace("__s", r"(?s)^.*\s", ""), "__nick": F.regexp_extract("__f", r"'([^']+)'", 1)})
    parts = parts.withColumns({f"__n_{c}": normalise_name(f"__{c}") for c in ("f", "s", "w", "last", "nick")})
    raw = lambda c: F.col(f"__{c}")
    has = lambda c: raw(c) != ""
    n = lambda *cs: F.trim(F.concat_ws(" ", *[f"__n_{c}" for c in cs]))
    variants = [
        F.when(has("f") & has("s"), n("f", "s")),
        F.when(has("w"), n("w")),
        F.when(has("f") & has("w") & (raw("w") != raw("f")), n("f", "w")),
        F.when(has("f"), n("f")),
        F.when(has("s") & (raw("s") != raw("f")), n("s")),
        F.when(has("f") & raw("s").contains(" "), n("f", "last")),
        F.when(has("nick"), n("nick")),
    ]
    rows = parts.select(code, "__order", F.posexplode(F.array(*variants)).alias("__rank", "norm"))
    return rows.where("norm <> ''").select("norm", code, (F.col("__order") * 10 + F.col("__rank")).alias("ord"))


def name_index(variants: DataFrame, code: str) -> DataFrame:
    """Normalised spelling -> code, the first definition (by person, then spelling) winning."""
    return variants.groupBy("norm").agg(F.min_by(code, "ord").alias(code), F.min("ord").alias("ord"))


def _spelling_key(norm: Column) -> Column:
    """Sixteen bytes that stand for a spelling, so an index row does not grow with it."""
    return F.unhex(F.md5(norm))


def _spelling_hashes(first: Column, rest: Sequence[Column]) -> list[Column]:
    """``__k1``, ``__k2``: sixteen bytes that stand for a spelling, from its first word and ``_rest_hashes``."""
    return [F.xxhash64(first, rest[0]).alias("__k1"), F.xxhash64(F.lit(1), first, rest[1]).alias("__k2")]


def _rest_hashes(norm: Column) -> list[Column]:
    """What follows the first word, hashed once for all lengths of that word; NULL for no spelling."""
    rest = F.substr(norm, F.length(F.substring_index(norm, " ", 1)) + 1)
    return [F.when(norm.isNotNull(), h) for h in (F.xxhash64(rest), F.xxhash64(F.lit(1), rest))]


def prefix_index(variants: DataFrame, code: str, min_prefix: int = 3) -> DataFrame:
    """``__k1``, ``__k2`` of spellings as they are and, behind all of those, with the first of several words shortened.

    Shortened keys hold the first ``min_prefix``.. letters of the first word; an exact spelling
    always beats a shortened one, and among equals the first definition wins. Only the first word and hashes of the
    rest are repeated for each length.
    """
    rest = dict(zip(("__r1", "__r2"), _rest_hashes(F.col("norm")), strict=True))
    words = variants.where("norm is not null").select(
        code, "ord", F.substring_index("norm", " ", 1).alias("__first"), F.col("norm").contains(" ").alias("__several"), *[h.alias(n) for n, h in rest.items()])
    whole = F.length("__first")
    lengths = F.when(F.col("__several") & (whole > min_prefix), F.sequence(F.lit(min_prefix), whole)).otherwise(F.array(whole))
    keys = words.select(code, "ord", "__first", *rest, F.explode(lengths).alias("__n"))
    order = F.when(F.col("__n") < whole, F.col("ord") + F.lit(1 << 61)).otherwise(F.col("ord"))
    keys = keys.select(code, order.alias("ord"), *_spelling_hashes(F.substr("__first", F.lit(1), F.col("__n")), [F.col(n) for n in rest]))
    return keys.groupBy("__k1", "__k2").agg(F.min_by(code, "ord").alias(code))


def match_names(probes: DataFrame, name: str, variants: DataFrame, code: str, min_prefix: int = 3) -> DataFrame:
    """Probe names to codes: exact spelling first, shortened first names (several words only) second."""
    keyed = probes.withColumn("norm", normalise_name(name))
    known = F.col("norm").isNotNull()
    hashes = _spelling_hashes(F.substring_index("norm", " ", 1), _rest_hashes(F.col("norm")))
    keyed = keyed.withColumns({k: F.when(known, h) for k, h in zip(("__k1", "__k2"), hashes, strict=True)})
    return keyed.join(prefix_index(variants, code, min_prefix), ["__k1", "__k2"], "left").drop("__k1", "__k2")


def match_full_name(probes: DataFrame, name: str, people: DataFrame, code: str, order: str, full: str, web: str) -> DataFrame:
    """Full names first (the last person of that name wins), else short names (the first wins)."""
    # both spellings in one index, met by sixteen bytes: names are neither shuffled nor joined twice
    spelled = people.select(code, order, F.inline(F.array(*[F.struct(F.col(c).alias("__name"), F.lit(c == full).alias("__is_full")) for c in dict.fromkeys((full, web))])))
    spelled = spelled.select(code, order, "__is_full", _spelling_key(normalise_name("__name")).alias("key"))
    by_kind = lambda pick, cond: pick(code, F.when(cond, F.col(order)))
    is_web = F.lit(True) if full == web else ~F.col("__is_full")
    index = spelled.groupBy("key").agg(by_kind(F.max_by, F.col("__is_full")).alias("__full"), by_kind(F.min_by, is_web).alias("__web"))
    out = probes.withColumn("norm", normalise_name(name)).withColumn("key", _spelling_key(F.col("norm"))).join(index, "key", "left")
    return out.withColumn(code, F.coalesce("__full", "__web")).drop("key", "__full", "__web")


#: Characters of the probes that one automaton holds, and of the texts that one task holds.
BLOCK_CHARS, TASK_CHARS = 500_000, 16_000_000


def contains_lookup(people: DataFrame, name: str, probes: DataFrame, probe: str, block_chars: int = BLOCK_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """Every (person, probe) where the normalised name contains the normalised probe.

    Distinct probes go into automata for many patterns (Aho-Corasick), one for each ``block_chars``
    characters of them; each passes once over the texts and gives every text the probes that it
    holds. With one block nothing is written; with more, texts are normalised once and written, and blocks come one after the other, so
    the driver never holds more than one. Texts are cut into tasks of about ``task_chars`` characters, as a task's Python
    may hold all of its texts at once, in several forms. Empty probes and missing names match nothing.
    """
    p = probes.withColumn("probe_norm", normalise_name(probe)).where("probe_norm <> ''")
    distinct = p.select("probe_norm").distinct()
    blocks = max(1, -(-(distinct.agg(F.sum(F.length("probe_norm"))).first()[0] or 0) // block_chars))
    tasks = -(-(people.agg(F.sum(F.length(name))).first()[0] or 0) // task_chars)
    people = people.repartition(max(tasks, people.sparkSession.sparkContext.defaultParallelism)) if tasks > 1 else people
    texts = people.select(F.struct(*people.columns).alias("__row"), normalise_name(name).alias("__norm")).where("__norm is not null")
    if blocks > 1:
        texts = materialise(texts, "texts")
        distinct = materialise(distinct.withColumn("__block", F.pmod(F.xxhash64("probe_norm"), F.lit(blocks))), "probes")
    found = None
    for block in range(blocks):
        mine = distinct if blocks == 1 else distinct.where(F.col("__block") == block)
        part = _holding(texts, [r.probe_norm for r in mine.select("probe_norm").collect()])
        part = part if blocks == 1 else materialise(part, "held")
        found = part if found is None else found.unionByName(part)
    pairs = found.select("__row.*", F.explode("__held").alias("probe_norm"))
    return pairs.join(p, "probe_norm")


def _holding(texts: DataFrame, probes: Sequence[str]) -> DataFrame:
    """``__row`` and ``__held``, the distinct probes in ``__norm``, for the texts that hold any."""
    words = list(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            # one text at a time, not all of them as Python strings
            held = [sorted({w for _, w in automaton.iter(t.as_py())}) for t in batch.column(1)] if words else []
            some = pa.array([i for i, h in enumerate(held) if h], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array([h for h in held if h], pa.list_(pa.string()))], names=["__row", "__held"])

    return texts.mapInArrow(run, texts.select("__row").schema.add("__held", ArrayType(StringType())))


def unmatched(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(dim, list(on), "left_anti")


def backfill_attribute(df: DataFrame, key: str, col: str, order: str) -> DataFrame:
    """Missing values from the entity's first known one."""
    known = df.where(F.col(col).isNotNull()).groupBy(key).agg(F.min_by(col, order).alias("__known"))
    return df.join(known, key, "left").withColumn(col, F.coalesce(col, "__known")).drop("__known")


def resolve_attribute(sources: Sequence[DataFrame], scope: Sequence[str], key: Sequence[str], col: str) -> DataFrame:
    """Attribute from the first source that knows anything for the scope; sources never mix inside one.

    Every source is unique on (scope, key).
    """
    scope = list(scope)
    tagged = [s.where(F.col(col).isNotNull()).select(*scope, *key, col, F.lit(i).alias("source")) for i, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    first = rows.groupBy(*scope).agg(F.min("source").alias("source"))
    return spread_join(rows, first, [*scope, "source"], key, "left_semi")


def attach_predictions(df: DataFrame, preds: DataFrame, on: Sequence[str], col: str = "prediction", default: float = 0.0) -> DataFrame:
    return df.join(preds.select(*on, col), list(on), "left").fillna(default, [col])


def join_models(a: DataFrame, b: DataFrame, on: Sequence[str], col: str = "prediction") -> DataFrame:
    """Two prediction tables side by side, with their difference."""
    left = a.withColumnRenamed(col, f"{col}_a")
    right = b.select(*on, F.col(col).alias(f"{col}_b"))
    return left.join(right, list(on)).withColumn("difference", F.col(f"{col}_b") - F.col(f"{col}_a"))


def opponent_features(
    df: DataFrame, fixtures: DataFrame, teams: DataFrame, scope: Sequence[str], element: str, period: str, points: str, conceded_col: str
) -> DataFrame:
    """Eight opponent and fixture features per (scope, element, period)."""
    scope = list(scope)
    rows = df.select(*scope, element, period, "fixture", "was_home", "opponent_team", "team").distinct()
    gc = two_level(df, [*scope, "team", period, "fixture"], [*scope, "team", period], conceded_col, "__gc")
    pts = conceded(df, scope, period, "team", "opponent_team", "fixture", points, "__pc")
    stats = gc.join(pts, [*scope, "team", period], "full_outer")
    stats = lagged_rolling(stats, [*scope, "team"], period, [
        ("opp_goals_conceded_r5", "__gc", 5, "mean"), ("opp_pts_conceded_r5", "__pc", 5, "mean")]).drop("__gc", "__pc")
    rows = attach_opponent(rows, stats, scope, period, "team", "opponent_team")
    rows = fixture_difficulty(rows, fixtures, [*scope, "fixture"])
    rows = opponent_strength(rows, teams)
    games = df.select(*scope, "team", period, "fixture").distinct().groupBy(*scope, "team", period).agg(
        (F.count(F.lit(1)) > 1).cast("double").alias("is_dgw"))
    rows = rows.join(games, [*scope, "team", period], "left").withColumn("home", F.col("was_home").cast("double"))
    return rows.groupBy(*scope, element, period).agg(
        F.avg("home").alias("was_home"),
        *[F.avg(c).alias(c) for c in ("opp_goals_conceded_r5", "opp_pts_conceded_r5", "fdr", "opp_strength", "opp_attack_strength", "opp_defence_strength")],
        F.max("is_dgw").alias("is_dgw"),
    )
