import random

from hypothesis import given, settings, strategies as st

from mailspark.llm import reply_trees as rt

CONTROL = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|", "\\", "n>", "\n", "assistant", "é", "<n>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), CONTROL), CONTROL), max_size=6))
def test_round_trip(turns):
    text, spans = rt.format_turns(turns)
    assert rt.read_turns(text) == turns
    assert [rt.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert all("<|" not in rt.escape(t) for _, t in turns)


def brute(rows, branches):
    """{tree: [(leaf, [nodes])]} by following parents."""
    nodes = {(t, n): (p, s or 0) for t, n, p, _, _, s in rows}
    parents = {(t, p) for t, _, p, _, _, _ in rows}
    found = {}
    for t, n in nodes:
        if (t, n) in parents:
            continue
        path, at, seen = [], n, set()
        while at is not None and (t, at) in nodes and at not in seen:
            seen.add(at)
            path.append(at)
            at = nodes[(t, at)][0]
        if at in seen:
            continue
        mean = sum(nodes[(t, x)][1] for x in path) / len(path)
        found.setdefault(t, []).append((-mean, n, path[::-1]))
    return {t: [(n, p) for _, n, p in sorted(f)[:branches]] for t, f in found.items()}


def test_paths_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for tree in range(12):
        for node in range(rng.choice([1, 2, 9, 40])):
            parent = None if node == 0 or rng.random() < 0.05 else rng.randrange(max(0, node - 3), node)
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None]), rng.choice(["hi", None, "x<|y"]),
                         rng.choice([None, 1.0, 2.0, 5.0])))
    rows += [(50, 1, 2, "user", "cycle", 1.0), (50, 2, 1, "user", "cycle", 1.0), (50, 3, 2, "user", "into it", 1.0),
             (51, 5, 99, "user", "lost parent", 1.0)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    for branches in (1, 3):
        got = {}
        for r in rt.branch_paths(messages, branches).collect():
            got.setdefault(r.tree, {}).setdefault(r.leaf, []).append((r.pos, r.node))
        got = {t: {leaf: [n for _, n in sorted(p)] for leaf, p in leaves.items()} for t, leaves in got.items()}
        assert got == {t: dict(p) for t, p in brute(rows, branches).items()}
    out = rt.format_branches(messages).collect()
    assert {r.tree for r in out} == set(brute(rows, 1))


def test_conversations_with_nulls(spark):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "q"), (1, 1, "user", "q"), (None, 0, None, "x"), (None, None, "user", None)]
    c = spark.createDataFrame([(*r, "clash", "clash") for r in rows],
                              "conv_id long, turn long, role string, text string, node string, tree string")
    got = {r.tree: rt.read_turns(r.formatted) for r in rt.format_branches(rt.chain_messages(c)).collect()}
    assert got == {"1": [("user", "q"), ("user", "q"), ("assistant", "")], "": [("", "x"), ("user", "")]}
    assert rt.format_branches(rt.chain_messages(c.filter("false"))).count() == 0


def test_query_on_awkward_rows(spark, tmp_path):
    """Null ids beside -2, null turns, repeated rows, a long conversation and extra columns, against the SQL."""
    import duckdb
    rows = [(-2, 0, "user", "a"), (-2, 1, "assistant", "b<|im_end|>"), (None, 0, "user", "c"), (None, 1, "assistant", "d"),
            (None, None, "assistant", None), (3, None, None, "x"), (3, 5, "assistant", "y"), (3, 5, "assistant", "y"), (4, 0, "system", "")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k} " * 3) for k in range(3000)]
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, node string, tree string") \
        .repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in rt.op4_reply_trees(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(got, key=repr) == sorted(con.execute(rt.ORACLE).fetchall(), key=repr)
    assert {r[0]: r[1] for r in got} == {-2: 2, None: 3, 3: 3, 4: 1, 9: 3000, -1: 2}
