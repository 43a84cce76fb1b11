"""Reading and writing files: tolerant CSV, optional sources, JSON lists, sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import materialise

EXTRA = "_extra"
FILE = "_file"
START = "_start"


def parse_csv_lines(df: DataFrame, line: str, schema: StructType, keep: Sequence[str] = ()) -> DataFrame:
    """CSV text lines to columns: too long lines are dropped, short ones padded with NULL.

    One overflow field behind the schema tells the two apart, since both count as malformed.
    """
    names = [f"__{i}" for i in range(len(schema.fields))]
    ddl = ", ".join(f"`{c}` string" for c in [*names, EXTRA])
    record = F.inline(F.array(F.from_csv(F.col(line), ddl, {"mode": "PERMISSIVE"})))
    parsed = df.select(*keep, record).where(F.col(EXTRA).isNull())
    return parsed.select(*keep, *[F.col(c).try_cast(f.dataType).alias(f.name) for c, f in zip(names, schema.fields)])


def _fields(line: Column, width: int) -> Column:
    """The first ``width`` fields of a CSV line."""
    ddl = ", ".join(f"`__{i}` string" for i in range(width))
    record = F.from_csv(line, ddl, {"mode": "PERMISSIVE", "escape": '"'})  # a doubled quote is a quote
    return F.transform(F.array(record), lambda r: F.array(*[r[f"__{i}"] for i in range(width)]))[0]


def _records(raw: DataFrame) -> DataFrame:
    """Lines put together to records where a quoted field goes over line breaks: ``value``, file and place (split and line), written once.

    The number of quotes before a line tells whether it begins a record. They are counted split by split first; a second pass
    over the text knows what came before each split, joins lines inside it, and leaves only pieces of records that go over
    a split's end to be put together. Only files that have a line with an odd number of
    quotes take part. Where a file's quotes don't balance, one of them is stray, and its lines stay records.
    """
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    counted = raw.withColumn("__q", quotes.cast("long")).groupBy(FILE, START).agg(F.sum("__q").alias("__q"), F.max(F.col("__q") % 2).alias("__odd"))
    file = Window.partitionBy(FILE)
    before = F.coalesce(F.sum("__q").over(file.orderBy(START).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    splits = counted.select(FILE, START, before.alias("__before"), ((F.max("__odd").over(file) == 1) & (F.sum("__q").over(file) % 2 == 0)).alias("__joined"))
    joined = {(r[0], r[1]): r[2] for r in splits.where("__joined").collect()}  # one row a split, as Spark's own list of them
    if not joined:
        return materialise(raw.withColumn("__line", F.monotonically_increasing_id()), "csv-records")
    places = f"`{FILE}` string, `{START}` long, __line long"
    pieces = raw.select(F.col("value").cast("binary").alias("value"), FILE, START).mapInArrow(_joiner(joined), f"value binary, {places}, __goes_on boolean, __open boolean")
    pieces = materialise(pieces.withColumn("value", F.col("value").cast("string")), "csv-records")
    cut = pieces.where("__goes_on or __open")
    numbered = cut.withColumn("__record", F.sum((~F.col("__goes_on")).cast("long")).over(Window.partitionBy(FILE).orderBy(START, "__line")))
    whole = numbered.groupBy(FILE, "__record").agg(F.array_sort(F.collect_list(F.struct(START, "__line", "value"))).alias("__p"))
    whole = whole.select(F.array_join(F.transform("__p", lambda x: x["value"]), "\n").alias("value"), FILE, F.col("__p")[0][START].alias(START), F.col("__p")[0]["__line"].alias("__line"))
    return pieces.where("not __goes_on and not __open").select("value", FILE, START, "__line").unionByName(materialise(whole, "csv-cut"))


def _joiner(joined: dict[tuple[str, int], int]):
    """Lines, in the order of their splits, to records; a split's first piece may go on with a record of the split before, its last may stay open."""
    names = ["value", FILE, START, "__line", "__goes_on", "__open"]

    def emit(values: pa.Array, begins: np.ndarray, split: tuple[str, int], line: int, goes_on: bool, is_open: bool) -> pa.RecordBatch:
        n = len(begins)
        lists = pa.ListArray.from_arrays(pa.array([*begins, len(values)], pa.int32()), values)
        flag = lambda at, on: pa.array(np.arange(n) == (at if on else -1))
        return pa.RecordBatch.from_arrays(
            [pc.binary_join(lists, pa.scalar(b"\n", pa.binary())), pa.repeat(split[0], n), pa.repeat(pa.scalar(split[1], pa.int64()), n),
             pa.array(begins + line, pa.int64()), flag(0, goes_on), flag(n - 1, is_open)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, waiting, line, quotes, goes_on = None, None, 0, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = {e for c in (1, 2) for e in pc.run_end_encode(batch.column(c)).run_ends.to_pylist()}
            start = 0
            for end in sorted(ends):
                values, here = batch.column(0).slice(start, end - start), (batch.column(1)[start].as_py(), batch.column(2)[start].as_py())
                start = end
                if here != split:
                    if waiting is not None:
                        yield emit(waiting, np.zeros(1, np.int64), split, line, goes_on, quotes % 2 == 1)
                    split, waiting, line, quotes = here, None, 0, joined.get(here, 0)
                    goes_on = quotes % 2 == 1
                if here not in joined:
                    yield emit(values, np.arange(len(values)), here, line, False, False)
                    line += len(values)
                    continue
                n = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)
                begin = (quotes + np.cumsum(n) - n) % 2 == 0
                quotes += int(n.sum())
                if waiting is None:
                    begin[0] = True  # the split's first piece
                else:
                    values, begin = pa.concat_arrays([waiting, values]), np.concatenate([np.arange(len(waiting)) == 0, begin])
                begins = np.flatnonzero(begin)
                last = int(begins[-1])  # whether that record is whole is not known yet
                if last:
                    yield emit(values.slice(0, last), begins[:-1], here, line, goes_on, False)
                    goes_on = False
                waiting, line = values.slice(last), line + last
        if waiting is not None:
            yield emit(waiting, np.zeros(1, np.int64), split, line, goes_on, quotes % 2 == 1)

    return run


def read_csv_safe(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> DataFrame:
    """CSV files with a header, read by column name; UTF-8 or else Latin-1 file by file, bad lines skipped.

    Each file's own first line says where its columns are, so files may order them differently, have
    others, or lack some (NULL). Lines with more fields than their file's header are dropped, shorter
    ones padded with NULL. The text source keeps the raw bytes, so a file is Latin-1 when any of its
    lines is not valid UTF-8. Headers and verdicts are one aggregate per file, joined back by file
    name; only the largest number of columns is read on the driver. Quoted fields may hold line breaks,
    except in files whose quotes don't balance. Repeated header names give the first column of that name.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START))
    # headers, width and fields are read from the records; the tables of one row a file are written, so that the planner knows their size
    raw = _records(raw)
    per_file = raw.groupBy(FILE).agg(F.bool_and(F.is_valid_utf8("value")).alias("__utf8"), F.min(F.when(F.col(START) == 0, F.col("__line"))).alias("__head"))
    decoded = lambda c: F.when(F.col("__utf8"), F.col(c)).otherwise(F.decode(F.col(c).cast("binary"), "ISO-8859-1"))
    firsts = raw.where(F.col(START) == 0).join(materialise(per_file, "csv-files"), FILE).where(F.col("__line") == F.col("__head"))
    heads = materialise(firsts.select(FILE, "__utf8", "__head", F.regexp_replace(decoded("value"), "[\ufeff\r]", "").alias("__first")), "csv-heads")
    widest = heads.agg(F.max(F.length(F.regexp_replace("__first", "[^,]", "")))).first()[0]
    width = max(len(schema.fields), (widest or 0) + 1) + 1
    heads = heads.withColumn("__names", F.transform(_fields(F.col("__first"), width), lambda x: F.trim(x)))
    # fields of a line beyond the file's own last named column make it too long
    heads = heads.withColumn("__n", F.size(F.filter("__names", lambda x: x.isNotNull()))).select(FILE, "__utf8", "__head", "__names", "__n")
    is_head = (F.col(START) == 0) & (F.col("__line") == F.col("__head"))
    lines = raw.join(heads, FILE).where(~is_head).withColumn("__line", F.regexp_replace(decoded("value"), "\r$", ""))
    # exploded, as a filter on the fields would read them again
    parsed = lines.where(F.trim("__line") != "").select("__names", "__n", F.explode(F.array(_fields(F.col("__line"), width))).alias("__f"))
    fits = parsed.where(~F.exists(F.slice("__f", F.col("__n") + 1, F.lit(width)), lambda x: x.isNotNull()))
    field = lambda name: F.get(F.col("__f"), F.array_position("__names", F.lit(name)).cast("int") - 1)
    return fits.select(*[field(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_optional(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", **options: str) -> DataFrame:
    """The table at ``path``, or an empty one of the same schema when there is none."""
    try:
        return spark.read.format(fmt).options(**options).schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _typed(item: Column, numbers: Sequence[str]) -> list[Column]:
    return [F.coalesce(item[c].try_cast("double"), F.lit(0.0)).alias(c) for c in numbers]


def match_rows(df: DataFrame, keep: Sequence[str], items: str, date: str, numbers: Sequence[str]) -> DataFrame:
    """A list of all-text match records to typed rows; unreadable numbers become 0."""
    rows = df.select(*keep, F.explode(items).alias("__m"))
    return rows.select(*keep, F.try_to_timestamp(F.col("__m")[date]).alias(date), *_typed(F.col("__m"), numbers))


def match_schema(date: str, numbers: Sequence[str]) -> str:
    return "array<struct<" + ",".join(f"`{c}`:string" for c in (date, *numbers)) + ">>"


def parse_match_json(df: DataFrame, keep: Sequence[str], json: str, date: str, numbers: Sequence[str]) -> DataFrame:
    """:func:`match_rows` over a column of JSON text."""
    items = df.select(*keep, F.from_json(json, match_schema(date, numbers)).alias("__items"))
    return match_rows(items, keep, "__items", date, numbers)


def read_match_json(spark: SparkSession, path: str, date: str, numbers: Sequence[str], id_name: str = "player_id") -> DataFrame:
    """One JSON file per entity holding its list of matches; the file name carries the entity's id."""
    schema = StructType([StructField(c, StringType()) for c in (date, *numbers)])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.regexp_extract("_metadata.file_name", r"(\d+)\.json$", 1).cast("bigint").alias(id_name), F.struct("*").alias("m"))
    return rows.select(id_name, F.try_to_timestamp(F.col("m")[date]).alias(date), *_typed(F.col("m"), numbers))


def league_rows(df: DataFrame, item: str, keep: Sequence[str], numbers: Sequence[str], id_name: str = "id") -> DataFrame:
    """Season aggregates from all-text records; records without a readable id are dropped.

    An absent number is 0; one unreadable number makes all numbers of its record NULL.
    """
    m = F.col(item)
    unreadable = F.lit(False)
    for c in numbers:
        unreadable = unreadable | (m[c].isNotNull() & m[c].try_cast("double").isNull())
    value = lambda c: F.when(~unreadable, F.coalesce(m[c].try_cast("double"), F.lit(0.0)))
    out = df.select(m[id_name].try_cast("bigint").alias(id_name), *[m[c].alias(c) for c in keep], *[value(c).alias(c) for c in numbers])
    return out.where(F.col(id_name).isNotNull())


def parse_league_json(df: DataFrame, json: str, keep: Sequence[str], numbers: Sequence[str], id_name: str = "id") -> DataFrame:
    schema = "array<struct<" + ",".join(f"`{c}`:string" for c in (id_name, *keep, *numbers)) + ">>"
    return league_rows(df.select(F.explode(F.from_json(json, schema)).alias("m")), "m", keep, numbers, id_name)


def read_league_json(spark: SparkSession, path: str, keep: Sequence[str], numbers: Sequence[str], id_name: str = "id") -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in (id_name, *keep, *numbers)])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return league_rows(raw.select(F.struct("*").alias("m")), "m", keep, numbers, id_name)


def find_col(columns: Sequence[str], *fragments: str) -> str | None:
    """First column whose name holds all fragments, whatever the case."""
    wanted = [f.lower() for f in fragments]
    return next((c for c in columns if all(f in c.lower() for f in wanted)), None)


def select_resolved(df: DataFrame, keep: Sequence[str], wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Columns found by name fragments under new names, NULL where nothing matches."""
    found = {name: find_col(df.columns, *parts) for name, parts in wanted.items()}
    cols = [F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("double").alias(n) for n, c in found.items()]
    return df.select(*[F.col(f"`{c}`") for c in keep], *cols)


def ingest_new(src: DataFrame, manifest: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows not collected before."""
    return src.join(manifest.select(*key).distinct(), list(key), "left_anti")


def coverage_report(manifest: DataFrame, source: str, season: str, ok: str) -> DataFrame:
    """Collected and expected parts per source and season, with a verdict."""
    out = manifest.groupBy(source, season).agg(
        F.count(F.when(F.col(ok), 1)).alias("n_ok"), F.count(F.lit(1)).alias("n_total"))
    verdict = F.when(F.col("n_ok") == F.col("n_total"), "OK").when(F.col("n_ok") > 0, "PARTIAL").otherwise("FAILED")
    return out.withColumn("status", verdict)


def coverage_matrix(manifest: DataFrame, source: str, season: str, ok: str, sources: Sequence[str]) -> DataFrame:
    """Seasons by sources: whether anything is there."""
    return manifest.groupBy(season).pivot(source, list(sources)).agg(F.coalesce(F.bool_or(ok), F.lit(False))).fillna(False, list(sources))


def file_manifest(spark: SparkSession, path: str, name: str = r"([^/=]+)=([^/]+)/") -> DataFrame:
    """One row per file below ``path``, from the files themselves: ``file``, ``keys``, ``n_bytes``, ``changed`` and ``ok``.

    ``keys`` maps the names to the values in the folders of its path, as ``name`` finds them; a file is ``ok`` if it has
    any bytes; of an empty one the time is unknown. Contents are not read. Markers and hidden files are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    # a scan passes over empty files, but the listing, which Spark holds on the driver anyway, has them
    listed = [(unquote(f).replace("file:///", "file:/", 1),) for f in files.inputFiles()]
    every = spark.createDataFrame(listed, "file string").join(files, F.col("file") == F.col("path"), "left")
    found = F.map_from_arrays(F.regexp_extract_all("file", F.lit(name), F.lit(1)), F.regexp_extract_all("file", F.lit(name), F.lit(2)))
    size = F.coalesce("length", F.lit(0).cast("long"))
    return every.select("file", found.alias("keys"), size.alias("n_bytes"), F.col("modificationTime").alias("changed"), (size > 0).alias("ok"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Write a table by partition; rows are clustered first, so a partition is few files, and a hot
    partition is split by adaptive execution rather than written by one task.

    Only the partitions that have rows in ``df`` are replaced, the others stay: files are written
    aside and published at the end, so writing again gives the same table, and a write that fails
    leaves the old one. Without ``partition_by`` the whole table is replaced.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
