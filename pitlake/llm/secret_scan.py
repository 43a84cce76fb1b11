"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import query, same, table

# The patterns to match, as given.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS = 6, 20

# Kinds that the ownership method adds: vendor tokens, credentials in addresses, bearer headers.
VENDOR = r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})"
ADDRESS = r"://[^\s:/@]++:([^\s:/@]{6,}+)@"
BEARER = r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]{20,}=*)"
KINDS = ("assign", "access", "hex", "vendor", "address", "bearer")
BASE_KINDS = 3

#: A value in so many repositories of so many owners is a copied example, not somebody's credential.
EXAMPLE_REPOSITORIES = 5
EXAMPLE_OWNERS = 3

REDACTED = "[secret removed]"

FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"
SPANS = "array<struct<start:int,kind:int,end:int,example:boolean>>"


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Non-overlapping matches from the left as structs of start, kind, end (code points) and value.

    Pieces between the matches and the matches themselves give the places. Matches whose ``group`` is
    shorter than ``least`` go, but still use up their text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def places(x: Column) -> Column:
        gaps, whole, val = x["gaps"], x["whole"], x["value"]
        start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(gaps, i))
            end = begin + F.length(F.get(whole, i))
            one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(val, i).alias("value"))
            return F.struct(end.alias("at"), F.when(F.length(F.get(val, i)) >= least, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), start, step, lambda acc: acc["out"])

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("whole"), value.alias("value"))
    none = F.array().cast(FOUND)
    return F.when(text.rlike(pattern), F.transform(F.array(parts), places)[0]).otherwise(none)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_found``: all candidates of a text by start and kind. NULL and empty texts have none.

    Each pattern is tried only on texts that hold a fixed string of it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lower = F.lower(whole)
    none = F.array().cast(FOUND)
    when = lambda test, found: F.when(test, found).otherwise(none)
    vendor = _any(whole, "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk-", "eyJ")
    base = F.concat(
        when(_any(lower, "passw", "secret", "token", "apikey", "api_key"), _matches(whole, ASSIGN, 0, 2, MIN_ASSIGN)),
        when(_any(whole, "AKIA"), _matches(whole, ACCESS, 1, 0, MIN_ACCESS)),
        _matches(whole, HEX, 2),
    )
    added = F.concat(
        when(vendor, _matches(whole, VENDOR, 3)),
        when(_any(whole, "://"), _matches(whole, ADDRESS, 4, 1)),
        when(_any(lower, "bearer"), _matches(whole, BEARER, 5, 1)),
    )
    return docs.withColumn("_found", F.sort_array(F.concat(base, added)))


def _any(of: Column, *words: str) -> Column:
    """Whether a string holds any of some fixed strings."""
    return reduce(lambda a, b: a | b, map(of.contains, words))


def _hash(value: Column) -> Column:
    return F.sha2(value, 256)


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per candidate value (hashed): its distinct repositories and owners over the whole corpus.

    Counting is by (value, repository) and (value, owner) first, so a value in a third of all rows is
    spread over the tasks. NULL repositories and owners count as one each.
    """
    each = found.select(F.explode("_found.value").alias("value"), repository.alias("repository"), owner.alias("owner"))
    each = each.select(_hash(F.col("value")).alias("hash"), F.coalesce(F.col("repository").cast("string"), F.lit("")).alias("repository"), F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"))
    return each.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))


def judge(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Add ``_spans``: the candidates with ``example``, true for widely copied values; ``found`` must be a written table.

    Base kinds stay whatever the verdict; of the added kinds only values that belong to few owners
    stay, and only where no base match overlaps them. Texts with the same candidates share the look-up, which
    is one row per distinct list of candidate values, so copies cost nothing and row keys are not needed.
    """
    with_some = found.filter(F.size("_found") > 0)
    examples = ownership(with_some, repository, owner).filter(
        (F.col("repositories") >= EXAMPLE_REPOSITORIES) & (F.col("owners") >= EXAMPLE_OWNERS)).select(F.col("hash").alias("_hash"))
    listed = F.transform("_found", lambda x: _hash(x["value"]))
    keyed = with_some.withColumn("_list", F.sha2(F.array_join(listed, ","), 256))
    lists = keyed.groupBy("_list").agg(F.first(listed).alias("_hashes")).select("_list", F.explode(F.array_distinct("_hashes")).alias("_hash"))
    copied = materialise(lists.join(examples, "_hash").groupBy("_list").agg(F.collect_set("_hash").alias("_copied")), "secret-examples")
    known = keyed.join(copied.withColumnRenamed("_list", "_l"), F.col("_list") == F.col("_l"), "left")
    is_example = lambda x: F.coalesce(F.array_contains("_copied", _hash(x["value"])), F.lit(False))
    marked = F.transform("_found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), is_example(x).alias("example")))
    base = lambda x: x["kind"] < BASE_KINDS
    clear = lambda x: ~F.exists("_found", lambda y: base(y) & (y["start"] < x["end"]) & (x["start"] < y["end"]))
    wanted = known.withColumn("_spans", F.filter(marked, lambda x: base(x) | (~x["example"] & clear(x)))).drop("_list", "_l", "_copied")
    return wanted.unionByName(found.filter(F.size("_found") == 0).withColumn("_spans", F.array().cast(SPANS)))


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def redact(text: str, spans: str) -> Column:
    """The text with its live-looking spans replaced; overlapping spans are replaced as one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(F.concat(acc["out"], gap, F.lit(REDACTED)).alias("out"), s["end"].alias("at"))
        merged = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when((s["start"] >= acc["at"]), fresh).otherwise(merged)

    return F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)))


@query("op9_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a repository is a source and language, its owner the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    found = materialise(candidates(docs).drop("text"), "secret-candidates")
    judged = judge(found, F.concat_ws("/", "source", "lang"), F.col("source"))
    of_kind = lambda k: F.size(F.filter("_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("_spans", lambda x: x["kind"] < BASE_KINDS)
    return judged.select(
        "doc_id", *(of_kind(i).alias(f"n_{KINDS[i]}") for i in range(BASE_KINDS)), F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"), F.size(F.filter("_spans", lambda x: x["example"])).cast("long").alias("n_example"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with live-looking secrets replaced in the text; widely copied examples stay.

    NULL and empty texts stay as they are; every other column, whatever its name, passes unchanged.
    """
    columns = docs.columns
    found = materialise(candidates(docs.select(F.struct(*columns).alias("_row"), "lang", "source", "text")), "secret-documents")
    judged = judge(found, F.concat_ws("/", "source", "lang"), F.col("source")).withColumn("_live", F.filter("_spans", lambda x: ~x["example"]))
    cut = F.size("_live") > 0
    changed = {"text": F.when(cut, redact("text", "_live")).otherwise(F.col("text"))}
    out = judged.withColumn("_new", changed["text"])
    fields = {"text": F.col("_new"), "n_chars": F.when(cut, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*(fields.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns))
