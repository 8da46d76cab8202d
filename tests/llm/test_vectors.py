import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeweave.llm import groups, neighbours, trees
from lodeweave.llm.robust_graph import RobustGraph


def clustered(n, centres, d=32, noise=0.2, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(centres, size=n)] + rng.normal(size=(n, d)) * noise
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def components(near):
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        if (new == label).all():
            return label
        label = new


def test_bisecting_limits():
    x = clustered(500, 20).astype(np.float32)
    leaves = trees.bisect(x, 60)
    assert sorted(np.concatenate(leaves)) == list(range(500)) and max(map(len, leaves)) <= 60
    same = trees.bisect(np.ones((50, 4), np.float32) / 2, 10)
    assert len(same) == 1  # rows that cannot be told apart stay together


def test_link_is_exact():
    x = clustered(400, 60, noise=0.45).astype(np.float32)
    want = components(x.astype(float) @ x.astype(float).T >= 0.85)
    assert (groups.link(x, 0.85) == want).all()


def test_cross_links():
    x = clustered(300, 40, noise=0.45).astype(np.float32)
    near = x.astype(float) @ x.astype(float).T >= 0.85
    near[:120, :120] = near[120:, 120:] = False
    np.fill_diagonal(near, True)
    assert (groups.cross(x[:120], x[120:], 0.85, block=50) == components(near)).all()


def test_roots_do_not_depend_on_the_order_of_arrival():
    x = clustered(300, 40, noise=0.18).astype(np.float32)
    cell = np.arange(300) % 3 - 1  # rows of a small key (-1), then the two cells of a meeting
    t = pa.table({
        "key": np.where(cell < 0, 5, 6), "low": np.where(cell < 0, -1, 0).astype(np.int32), "high": np.where(cell < 0, -1, 1).astype(np.int32), "me": cell.astype(np.int32),
        "rep": [f"i{i:03}" for i in range(300)], "vec": pa.array([r.tobytes() for r in x], pa.binary()),
    })
    want = {tuple(r.values()) for r in groups.stars_of(t, 0.85).to_pylist()}
    assert len(want) > 100 and {final for *_, final in want} == {True, False}
    for seed in range(3):
        mixed = t.take(np.random.default_rng(seed).permutation(300))
        assert {tuple(r.values()) for r in groups.stars_of(mixed, 0.85).to_pylist()} == want


def _frame(spark, x, keys="r"):
    rows = [(f"i{i:04}", "r" if i % 3 else "q", "l", [float(v) for v in row], 1.0) for i, row in enumerate(x)]
    rows += [("null", "r", "l", None, 1.0), ("zero", "r", "l", [0.0] * x.shape[1], 1.0), ("nan", "r", "l", [float("nan")] * x.shape[1], 1.0), (None, "r", "l", [float(v) for v in x[0]], 1.0)]
    # extra columns have names that the operator also uses
    return spark.createDataFrame(rows, "id string, repo string, lang string, vec array<double>, cell double").withColumn("key", F.lit(0)).withColumn("rep", F.lit("x")).withColumn("root", F.lit("y"))


def test_groups_against_brute_force_with_cells(spark):
    x = clustered(600, 40, noise=0.18)
    x[10:20] = x[9]  # copies
    df = _frame(spark, x)
    want = set()
    for rem in (True, False):
        at = np.array([i for i in range(600) if bool(i % 3) == rem])
        label = components(x[at] @ x[at].T >= 0.85)
        for k in set(label):
            m = at[label == k]
            if len(m) >= 3:
                want |= {(f"i{a:04}", f"i{b:04}") for a in m for b in m if a < b}
    for cell_rows in (4096, 150, 7):  # one cell, cells that a tree cuts, and at least fifty of them
        got = groups.similarity_groups(df, "id", "vec", ["repo", "lang"], cell_rows=cell_rows)
        assert set(map(tuple, groups.group_pairs(got).collect())) == want
    top = groups.describe(groups.similarity_groups(df, "id", "vec", ["repo", "lang"], with_vectors=True), ["repo", "lang"], top=2)
    assert top.filter("member_rank > 2").count() == 0 and top.filter("similarity_score < 0.5").count() == 0


def test_groups_of_empty_and_null_keys(spark):
    df = _frame(spark, clustered(9, 1))
    assert groups.similarity_groups(df.limit(0), "id", "vec", ["repo"]).count() == 0
    nulls = df.withColumn("repo", F.lit(None).cast("string")).filter("id like 'i%'")
    assert groups.similarity_groups(nulls, "id", "vec", ["repo"]).count() == 9


def test_graph_recall():
    x = clustered(3000, 300).astype(np.float32)
    g = RobustGraph(x, 16, 24)
    q = np.arange(0, 3000, 10)
    ids, _ = g.search(x[q], beam=16, entry=q.astype(np.int32), expand=4)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -2
    top = np.argsort(-s, axis=1)[:, :5]
    assert (ids[:, :, None] == top[:, None, :]).any(1).mean() >= 0.95


def test_nearest_recall_copies_and_edge_cases(spark):
    x = clustered(900, 120)
    x[100:110] = x[99]
    df = _frame(spark, x)
    got = {tuple(r) for r in neighbours.nearest(df, "id", "vec", shard_rows=300).select("id", "neighbour").collect()}
    s = np.round(x @ x.T, 7)
    np.fill_diagonal(s, -2)
    want = {(f"i{i:04}", f"i{j:04}") for i in range(900) for j in sorted(np.nonzero(s[i] >= 0.85)[0], key=lambda j: (-s[i, j], j))[:5]}
    assert len(got & want) / len(want) >= 0.97
    copies = {b for a, b in got if a == "i0105"}
    assert copies == {"i0099", "i0100", "i0101", "i0102", "i0103"}  # ties go to the smaller ids
    assert neighbours.nearest(df.limit(0), "id", "vec").count() == 0
    one = neighbours.nearest(df.filter("id = 'i0000'"), "id", "vec")
    assert one.count() == 0
