"""Chat formatting: reply trees, their root-to-leaf paths by iterative self-joins, one conversation per chosen path."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import query, same, table

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
#: What stands for the characters that marks are made of; the backslash comes first when escaping, last when reading.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]
TURN = re.compile(r"### ([^:]*): ([^<]*)</turn>\n")


def escape(text: Column) -> Column:
    """The text without any character that a mark has; ``unescape`` gives it back. NULL is an empty text."""
    out = F.coalesce(text, F.lit(""))
    for plain, code in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: str) -> str:
    for plain, code in reversed(ESCAPES):
        text = text.replace(code, plain)
    return text


def _marked(text: Column) -> Column:
    """Only colons in texts need no escape: a mark's colon follows a role."""
    out = F.coalesce(text, F.lit(""))
    for plain, code in ESCAPES[:3]:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The chosen root-to-leaf paths: ``tree``, ``path`` (the leaf's id), ``place``, ``id`` of each message on one.

    ``messages`` is a written table of ``tree``, ``id``, ``parent`` (NULL for a root) and ``score``,
    with unique (tree, id). Self-joins double how far each message sees: after round k it knows its
    ancestor 2^k levels up, its depth and the sum of scores up to there. So every leaf's path is known
    by its end and its score after as many joins as the logarithm of the deepest tree, in one small row
    a message; a tree takes part only until all its messages know their root. The ``best`` leaves of a tree by mean score (NULL counts 0; ties by longer path, then
    id) are chosen; their messages are collected by going up the same doubled steps. A parent that is
    absent makes a root; messages on a cycle hang on no root and are left out.
    """
    known = messages.select(F.col("tree").alias("_t"), F.col("id").alias("_i"))
    start = messages.join(known, same(F.col("tree"), F.col("_t")) & (F.col("parent") == F.col("_i")), "left")
    work = materialise(start.select(
        "tree", "id", F.col("_i").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")), "reply-steps")
    rooted, steps, size = work.filter("up is null"), [work], work.count()
    for turn in range(size.bit_length() + 1):
        open_ = work.filter("up is not null")
        if open_.isEmpty():
            break
        if turn:  # only trees that are not done yet go on
            left = open_.select(F.col("tree").alias("_t")).distinct()
            work = work.join(left, same(F.col("tree"), F.col("_t")), "left_semi")
        above = work.select(F.col("tree").alias("_t"), F.col("id").alias("_i"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_s"))
        moved = open_.join(above, same(F.col("tree"), F.col("_t")) & (F.col("up") == F.col("_i"))).select(
            "tree", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_s")).alias("total"))
        moved = materialise(moved, "reply-steps")
        rooted = rooted.unionByName(moved.filter("up is null"))
        work = materialise(moved.unionByName(work.filter("up is null")), "reply-steps")
        steps.append(work)
    parents = messages.filter("parent is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_i")).distinct()
    leaves = rooted.join(parents, same(F.col("tree"), F.col("_t")) & (F.col("id") == F.col("_i")), "left_anti")
    ranked = leaves.withColumn("_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "id")))
    chosen = ranked.filter(F.col("_rank") <= best).select("tree", F.col("id").alias("path"), "id", F.col("depth").alias("place"))
    chosen = materialise(chosen, "reply-paths")
    for i in range(len(steps) - 2, -1, -1):
        jump = steps[i].select(F.col("tree").alias("_t"), F.col("id").alias("_i"), "up").filter("up is not null")
        higher = chosen.join(jump, same(F.col("tree"), F.col("_t")) & (F.col("id") == F.col("_i"))).select(
            "tree", "path", F.col("up").alias("id"), (F.col("place") - 2**i).alias("place"))
        chosen = materialise(chosen.unionByName(higher), "reply-paths")
    return chosen


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per path: ``tree``, ``path``, ``formatted``.

    A turn is ``### role: text</turn>`` and a line break; ``\\``, ``#`` and ``<`` in texts, and ``:``
    in roles, are escaped, so control strings inside texts never look like marks. A path's turns meet
    in the one row that is its result; all steps before carry ids only and are spread by message.
    """
    turns = paths.join(messages.select(F.col("tree").alias("_t"), F.col("id").alias("_i"), "role", "text"), same(F.col("tree"), F.col("_t")) & (F.col("id") == F.col("_i")))
    turn = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(MIDDLE), _marked(F.col("text")), F.lit(TAIL))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", turn.alias("turn")))), lambda x: x["turn"]), "")
    return turns.groupBy("tree", "path").agg(whole.alias("formatted"))


def read_back(formatted: str, speaker: str = "assistant") -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """Turns (role, text) of a formatted conversation, and the loss mask: ranges of the speaker's texts in it."""
    turns, mask = [], []
    for m in TURN.finditer(formatted):
        role = unescape(m[1])
        turns.append((role, unescape(m[2])))
        if role == speaker:
            mask.append(m.span(2))
    return turns, mask


def digests(formatted: DataFrame) -> DataFrame:
    """Per formatted path what can be read back from it: turns, their hash, the text under the loss mask, sizes."""
    names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for whole in batch.column(1).to_pylist():
                turns, mask = read_back(whole)
                learnt = "".join(unescape(whole[a:b]) for a, b in mask)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(whole)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted").mapInArrow(run, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_replies(turns: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """A linear conversation as a reply tree: each turn answers the one before. Equal places go by the rest of ``order``."""
    place = F.row_number().over(Window.partitionBy(tree).orderBy(*order)).cast("long")
    numbered = turns.select(F.col(tree).alias("tree"), place.alias("id"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))


@query("op4_chat_format")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = materialise(as_replies(turns, "conv_id", ["turn", "role", "text"]), "chat-messages")
    return digests(format_paths(messages, reply_paths(messages))).withColumnRenamed("tree", "conv_id")
