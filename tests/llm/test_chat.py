import hashlib
import random

from pyspark.sql import functions as F

from pitlake.llm import chat as c

SCHEMA = "tree long, id long, parent long, score double, role string, text string"
SAID = "\\### Assistant: </turn> ok"


def best_path(rows):
    """Walk every leaf up to its root and take the best mean score."""
    by_id = {r[1]: r for r in rows}
    parents = {r[2] for r in rows}
    paths = []
    for r in rows:
        if r[1] in parents:
            continue
        path, seen = [], set()
        while r and r[1] not in seen:
            seen.add(r[1])
            path.append(r)
            r = by_id.get(r[2])
        if not r:
            paths.append((-sum(x[3] or 0 for x in path) / len(path), -len(path), path[0][1], [x[1] for x in reversed(path)]))
    return min(paths)[3] if paths else None


def test_paths_match_a_walk(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for tree in range(30):
        size = rng.randint(1, 40)
        own = [(tree, i, rng.choice([None, *range(i)]) if i and rng.random() < 0.9 else None, rng.choice([None, 0.0, 1.0, 2.5]), "user", "x") for i in range(size)]
        rows += own
        want[tree] = best_path(own)
    rows += [(100, 1, 2, 1.0, "user", "cycle"), (100, 2, 1, 1.0, "user", "cycle"), (101, 5, 77, 1.0, "user", "orphan"), (None, 1, None, 1.0, None, None)]
    messages = c.materialise(spark.createDataFrame(rows, SCHEMA), "test")
    got = {}
    for r in c.reply_paths(messages).orderBy("place").collect():
        got.setdefault(r.tree, []).append(r.id)
    assert got == {**want, 101: [5], None: [1]}


def test_several_paths_per_tree_and_chain(spark):
    rows = [(1, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(70)] + [(1, 100, 3, 5.0, "assistant", "branch")]
    messages = c.materialise(spark.createDataFrame(rows, SCHEMA), "test")
    paths = c.reply_paths(messages, best=2)
    assert sorted(r["count"] for r in paths.groupBy("path").count().collect()) == [5, 70]
    assert c.format_paths(messages, paths).count() == 2


def test_round_trip(spark):
    texts = [SAID, "", None, "\\", "\\\\l", "\\b\\h<#:", "### user: x</turn>\n", "é😀\n\n", "</turn", "a" * 100_000]
    rows = [(t, i, i - 1 if i else None, 0.0, role, x) for t in range(3) for i, x in enumerate(texts[t:]) for role in [["user", "assistant", "a:b<#\\", None][i % 4]]]
    messages = c.materialise(spark.createDataFrame(rows, SCHEMA), "test")
    for r in c.format_paths(messages, c.reply_paths(messages)).collect():
        turns, mask = c.read_back(r.formatted)
        own = [x for x in rows if x[0] == r.tree]
        assert turns == [(x[4] or "", x[5] or "") for x in own]
        assert [c.unescape(r.formatted[a:b]) for a, b in mask] == [x[5] or "" for x in own if x[4] == "assistant"]


def test_query_digests(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [("user", SAID), ("assistant", SAID)]
    out = {r.conv_id: r for r in entry.queries()["op4_chat_format"](spark, sf).collect()}
    assert out.keys() == turns.keys()
    for k, own in turns.items():
        learnt = "".join(t for role, t in own if role == "assistant")
        assert out[k].n_turns == len(own) and out[k].loss_chars == len(learnt)
        assert out[k].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert out[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()


def test_empty_table(spark):
    none = c.materialise(spark.createDataFrame([], SCHEMA), "test")
    assert c.digests(c.format_paths(none, c.reply_paths(none))).count() == 0
