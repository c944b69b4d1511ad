"""Inputs on which a query once failed or differed from its SQL."""

import duckdb
import pytest

from strandweave.plans.registry import ORACLES, QUERIES


def held(spark, folder, name, **tables):
    """Rows of a query and of its SQL on ``tables``: SQL of their rows."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"CREATE TABLE {t} AS {sql}")
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLES[name]).df()
    return (sorted(f[sorted(f.columns)].itertuples(index=False, name=None)) for f in (got, want))


def test_votes_without_weight(spark, tmp_path):
    # customer 1: one path, no weight; 2: two alike, no weight; 3: no weight, two statuses; 4: weight on one; 5: one path with weight
    orders = "SELECT * FROM (VALUES (3::BIGINT, 1::BIGINT, 'F'), (6, 2, 'O'), (9, 2, 'O'), (12, 3, 'F'), (15, 3, 'O'), (18, 4, 'F'), (19, 4, 'O'), (20, 5, 'P')) t(o_orderkey, o_custkey, o_orderstatus)"
    got, want = held(spark, tmp_path, "weighted_votes", orders=orders)
    assert got == want == [(4, "AAAAGGGAAAAAA"), (5, "AAAATTTAAAAAA")]


def brute(rows):
    """a, b -> distance of rows (sequence, unitig, length); rows without a sequence are one that has none itself."""
    size = {u: w for _, u, w in rows}
    sets = {s: {u for x, u, _ in rows if x == s} for s, _, _ in rows}
    total = lambda s: sum(size[u] for u in s)
    return {(a, b): 1 - total(sets[a] & sets[b]) / total(sets[a]) for a in sets if a is not None for b in sets if sets[a] & sets[b]}


@pytest.mark.parametrize("kind, step", [("bigint", 1), ("int", 30_000), ("bigint", 1 << 40), ("string", 1)])
def test_containment_of_any_ids(spark, kind, step):
    from strandweave.operators import distances as D

    name = lambda s: s if s is None else f"s{s}" if kind == "string" else (s - 9) * step
    rows = [(name(s), u, u % 7 + 1) for s in [*range(20), None] for u in range(60) if (s if s is not None else 3) * u % 11 < 3 + u % 4 for _ in range(2)]
    got = D.containment(spark.createDataFrame(rows, f"s {kind}, u int, w int"), [], "s", "u", "w")
    found, want = {(r.a, r.b): r.dist for r in got.collect()}, brute(rows)
    assert found == pytest.approx(want) and got.count() == len(found)
    both = {(r.a, r.b): r.dist for r in D.symmetric(got, []).collect()}
    assert both == pytest.approx({(a, b): max(d, want[b, a]) for (a, b), d in want.items() if b is not None})


def lines(folder):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT x % 15 AS l_suppkey, x * x % 40 AS l_partkey FROM range(600) t(x)) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT x AS p_partkey, (x % 50)::INT AS p_size FROM range(40) t(x)) TO '{folder}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT x AS s_suppkey, (x % 4)::INT AS s_nationkey FROM range(15) t(x)) TO '{folder}/supplier.parquet' (FORMAT parquet)")


def pair_shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "a#" in x and "b#" in x]


@pytest.mark.parametrize("name", ["symmetric_distance", "containment", "containment_qc"])
def test_no_shuffle_of_pairs(spark, tmp_path, name):
    lines(tmp_path)
    assert not pair_shuffles(QUERIES[name](spark, str(tmp_path)))


def shuffled_rows(df):
    """Rows of each shuffle of the plan that has run."""
    plan, out = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name.startswith("Exchange"):
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(name)
        plan += [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("name", ["containment", "containment_qc"])
def test_lists_are_shuffled_once_per_block(spark, tmp_path, name):
    # nine parts occur, each with five suppliers; once there was a row for each of both
    lines(tmp_path)
    df = QUERIES[name](spark, str(tmp_path))
    df.collect()
    assert 0 < max(shuffled_rows(df)) <= 9


@pytest.mark.parametrize("kind, step", [("bigint", 1), ("int", 30_000), ("bigint", 1 << 40), ("string", 1)])
@pytest.mark.parametrize("pairs, sent", [(1, 1), (20, 50), (1000, 1 << 20)])
def test_containment_in_many_blocks(spark, monkeypatch, kind, step, pairs, sent):
    from strandweave.operators import distances as D

    monkeypatch.setattr(D, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(D, "SENT", sent)
    name = lambda s: f"s{s}" if kind == "string" else (s - 9) * step
    rows = {g: [(name(s), u, u % 7 + 1) for s in range(20 if g else 6) for u in range(30) if s * u % 11 < 3 + u % 4] for g in (None, 0, 1, 2)}
    made = spark.createDataFrame([(g, *r) for g in rows for r in rows[g]], f"g int, s {kind}, u int, w int")
    got = D.containment(made, ["g"], "s", "u", "w").collect()
    want = {(g, *p): d for g in (0, 1, 2) for p, d in brute(rows[g]).items()}
    assert {(r.g, r.a, r.b): r.dist for r in got} == pytest.approx(want) and len(got) == len(want)


@pytest.mark.parametrize("name", ["containment", "symmetric_distance", "containment_qc"])
def test_many_lists_in_a_row_of_the_shuffle(spark, tmp_path, name):
    # 3000 parts with about 20 of 4000 suppliers each; once there was a row for each part
    con = duckdb.connect()
    con.execute(f"COPY (SELECT (hash(x) % 3000)::BIGINT AS l_partkey, (hash(x + 100000) % 4000)::BIGINT AS l_suppkey FROM range(60000) t(x)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT x AS p_partkey, (x % 50)::INT AS p_size FROM range(3000) t(x)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT x AS s_suppkey, (x % 4)::INT AS s_nationkey FROM range(4000) t(x)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    assert 0 < max(shuffled_rows(df)) <= 300


@pytest.mark.parametrize("kind, unit", [("int", 1), ("double", 0.5)])
@pytest.mark.parametrize("pairs, packed, summed", [(1, 1, 1), (200, 7, 5), (1 << 26, 1 << 10, 100)])
def test_containment_without_some_lengths(spark, monkeypatch, kind, unit, pairs, packed, summed):
    from strandweave.operators import distances as D

    for k, v in (("BLOCK_PAIRS", pairs), ("PACKED", packed), ("SUMMED", summed)):
        monkeypatch.setattr(D, k, v)
    length = lambda u: None if u % 5 == 0 else u % 4 * unit
    rows = [(s, u, length(u)) for s in range(25) for u in range(40) if s == 0 or (s * u + s) % 13 < 3]
    rows += [(30, 100, None), (31, 100, None), (30, 101, 2 * unit), (31, 102, unit)]
    made = spark.createDataFrame(rows, f"s int, u int, w {kind}")
    got = {(r.a, r.b): r.dist for r in D.containment(made, [], "s", "u", "w").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE TABLE ps (a INT, u INT, w {kind})")
    con.executemany("INSERT INTO ps VALUES (?, ?, ?)", rows)
    want = con.execute("SELECT x.a, y.a, 1.0::DOUBLE - sum(x.w)::DOUBLE / nullif(any_value(t), 0)::DOUBLE FROM ps x JOIN ps y USING (u) JOIN (SELECT a, sum(w) AS t FROM ps GROUP BY 1) t ON t.a = x.a GROUP BY 1, 2").fetchall()
    want = {(a, b): d for a, b, d in want}
    assert got.keys() == want.keys() and any(d is None for d in want.values())
    assert all(got[p] == (d if d is None else pytest.approx(d)) for p, d in want.items())


def plain_upgma(ids, far):
    """(height, a, b) of every merge by the least of all pairs, and the nodes."""
    members, node, fresh, out = {i: [i] for i in ids}, {i: i for i in ids}, max(ids), {}
    mean = {(a, b): far.get((a, b), 1.0) for a in ids for b in ids if a < b}
    while len(members) > 1:
        (a, b), d = min(mean.items(), key=lambda x: (x[1], x[0]))
        fresh += 1
        out[fresh] = (node[a], node[b], d / 2)
        na, nb = len(members[a]), len(members[b])
        for c in members:
            if c not in (a, b):
                mean[min(a, c), max(a, c)] = (na * mean[min(a, c), max(a, c)] + nb * mean.pop((min(b, c), max(b, c)))) / (na + nb)
        del mean[a, b], node[b]
        members[a] += members.pop(b)
        node[a] = fresh
    return out


@pytest.mark.parametrize("share", [0.02, 0.1, 0.5, 1.0])
@pytest.mark.parametrize("steps", [3, 1000])
def test_trees_of_stored_pairs(share, steps):
    import random

    from strandweave.operators.trees import upgma

    rng = random.Random(f"{share} {steps}")
    ids = sorted(rng.sample(range(200), 45))
    far = {(a, b): rng.randint(1, steps) / steps for a in ids for b in ids if a < b and rng.random() < share}
    tree = upgma(ids, far, missing=1.0)
    want = plain_upgma(ids, far)
    assert {n: (*tree.kids[n], tree.height[n]) for n in tree.kids} == want and tree.root == max(want)
    every = {(a, b): far.get((a, b), 1.0) for a in ids for b in ids if a < b}
    assert upgma(ids, every) == tree


def test_tree_of_many_contigs_with_few_links():
    """Once all pairs of them were held, 18 million."""
    import tracemalloc

    from strandweave.operators.trees import upgma

    tracemalloc.start()
    tree = upgma(list(range(6000)), {(a, a + 1): 0.1 for a in range(0, 6000, 2)}, missing=1.0)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and len(tree.cut(0.2)) == 3000
    tracemalloc.stop()


def test_pairs_of_many_contigs_per_file(spark, tmp_path):
    supplier = "SELECT x AS s_suppkey, (x // 120)::INT AS s_nationkey, (x * 37 % 1009)::DOUBLE AS s_acctbal FROM range(360) t(x)"
    got, want = held(spark, tmp_path, "clustered_pairs", supplier=supplier)
    assert got == want and len(got) == 360
