"""Operators on small cases; queries against their SQL are in test_oracle.py."""

import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.functions import text as X
from lodeweave.operators import chunker, cluster, debt, detectors, graph, review, rules, tables, vectors
from lodeweave.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_components_chain_ties_loops_and_nulls(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q"), ("x", "y")]
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "src string, dst string"))))
    assert {got[f"n{i}"] for i in range(31)} == {"n0"} and got["x"] == got["y"] == "x" and "z" not in got and "q" not in got
    assert graph.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("path,want", [("FILE.PY", "python"), ("a/b.tsx", "tsx"), ("header.h", "c"), ("README.md", None), ("Dockerfile", None), ("no_extension", None)])
def test_routing(spark, path, want):
    assert spark.range(1).select(X.language_of(F.lit(path))).first()[0] == want


@pytest.mark.parametrize(
    "path,text,want",
    [("vendor/a.py", "x", True), (".venv/a.py", "x", True), ("x/migrations/0001_initial.py", "x", True), ("a_pb2.py", "x", True), ("tests.py", "x", True), ("Button.test.tsx", "x", True),
     ("attestation.py", "x", False), ("contest/views.py", "x", False), ("a.py", "y" * 507, True), ("a.py", "", False), ("a.py", None, False)],
)
def test_skip(spark, path, text, want):
    df = spark.createDataFrame([(path, text)], "p string, t string")
    assert df.select(X.should_skip("p", "t")).first()[0] is want


def test_lines_split_like_splitlines(spark):
    for t in ("a\r\nb\x0bc d\n", "", "\n", "a", "a\n\n", "x\x85y\x1cz"):
        got = spark.createDataFrame([(t,)], "t string").select(X.lines("t")).first()[0]
        assert got == t.splitlines()


def test_tokens_and_similarity(spark):
    one = spark.range(1)
    name = lambda n: set(one.select(X.name_tokens(F.lit(n))).first()[0])
    assert name("list_branches") == {"branches"} and name("fetchPrFiles") == {"fetch", "files"} and name("handle") == set()
    code = F.lit("def total_price():\n    return amount_sum  # note\n")
    t = X.code_tokens(code, F.lit("python"))
    assert one.select(X.jaccard(t, t)).first()[0] == 1.0
    empty = X.code_tokens(F.lit("# only a comment"), F.lit("python"))
    assert one.select(X.jaccard(t, empty)).first()[0] is None
    assert one.select(X.blended_similarity(F.lit(0.8), F.lit(1.0), F.lit("x"))).first()[0] == 0.86
    assert one.select(X.blended_similarity(F.lit(0.8), F.lit(None), F.lit(""))).first()[0] is None
    assert one.select(X.blended_similarity(F.lit(0.8), F.lit(None), F.lit(""), stored=False)).first()[0] == 0.8
    assert one.select(X.entropy(F.lit("")), X.entropy(F.lit("aabb"))).first() == (0.0, 1.0)


def test_findings(spark):
    code = "\n".join(
        ['password = "hunter22x"', 'api_key = "your_api_key_here"', '# password = "hunter22x"', "x = eval(y)", "z = eval(w)  # nosec", "import random; random.choice(a)", "subprocess.run(a, shell=True)", "subprocess.run([a])",
         "yaml.load(f)", "yaml.load(f, Loader=yaml.SafeLoader)", 'cur.execute("SELECT * FROM t WHERE a = " + b)', "return redirect(request.args['next'])"]
    )
    df = spark.createDataFrame([("a", "python", code), ("b", "python", None)], "id string, language string, t string")
    got = {(r.detector, r.line_number) for r in detectors.findings(df, "t", "language", "id").collect()}
    assert got == {("HARDCODED_SECRET", 1), ("DANGEROUS_FUNCTION", 4), ("INSECURE_RANDOM", 6), ("DANGEROUS_FUNCTION", 7), ("DANGEROUS_FUNCTION", 9), ("SQL_INJECTION", 11), ("OPEN_REDIRECT", 12)}


def test_missing_auth(spark):
    code = "@app.route('/a')\ndef a(): pass\n\n@app.get('/b')\n@login_required\ndef b(): pass\n"
    got = detectors.missing_auth(spark.createDataFrame([("x", code), ("y", "@app.route(")], "id string, t string"), "t", "id")
    assert rows(got) == [("x", 1, "a")]


def test_rules(spark):
    c = [("a", "function", 1, 50, 10.9, "my_function"), ("b", "function", 1, 51, 11.0, "myFunction"), ("c", "method", 1, 2, 21.0, "__init__"), ("d", "class", 1, 99, 50.0, "Bad")]
    df = spark.createDataFrame([(*x, "python") for x in c], "chunk_id string, chunk_type string, start_line int, end_line int, complexity_score double, chunk_name string, language string")
    got = {(r.chunk_id, r.rule_name, r.severity) for r in rules.chunk_violations(df, {"naming_conventions": {"python": "snake_case"}}).collect()}
    assert got == {("b", "MAX_FUNCTION_LINES", "medium"), ("b", "MAX_COMPLEXITY", "medium"), ("c", "MAX_COMPLEXITY", "high"), ("b", "NAMING_CONVENTION", "low"), ("d", "NAMING_CONVENTION", "low")}
    f = spark.createDataFrame([("f", "python", "import pickle\nfrom pickle import loads\nimport pickle.x\nimport pickled")], "id string, language string, t string")
    assert rows(rules.forbidden_imports(f, "t", {"python": ["pickle"], "java": ["x"]}, "id")) == [("f", 1, "pickle"), ("f", 2, "pickle"), ("f", 3, "pickle")]
    assert rules.checked_config({"rules": {"max_complexity": "x", "max_function_lines": -5, "forbidden_imports": []}, "scoring_weights": {"complexity": 1.5}})["max_function_lines"] == 1
    assert rules.checked_config(None)["max_complexity"] == 10


def test_velocity_and_inflection(spark):
    s = [("r", f"c{i}", "f", v) for i, v in enumerate([1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 9.0])]
    scores = spark.createDataFrame(s, "repo_id string, commit_id string, file_path string, total_score double")
    commits = spark.createDataFrame([(f"c{i}", i, f"s{i}") for i in range(8)], "commit_id string, committed_at int, sha string")
    v = debt.inflections(debt.velocity(scores, commits))
    assert [r.commit_id for r in v.filter("is_inflection").collect()] == ["c7"]
    assert v.filter("commit_id = 'c0'").first().velocity == 0
    before = spark.createDataFrame([("r", "f", 0.5)], "repo_id string, file_path string, total_score double")
    assert debt.velocity(scores, commits, before).filter("commit_id = 'c0'").first().velocity == 0.5


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(12, 16))
    x = np.concatenate([c[i % 12] + rng.normal(size=16) * 0.25 for i in range(150)]).reshape(150, 16)
    df = spark.createDataFrame([(f"i{i:03}", "r", "l", v.tolist()) for i, v in enumerate(x)] + [("n", "r", "l", None), ("z", "r", "l", [0.0] * 16)], "id string, repo_id string, language string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.85
    core = near.sum(1) >= 3
    label = np.where(core, np.arange(150), 999)
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], 999).min(1), 999)
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None, :], label[None, :], 999).min(1)
    want = {f"i{i:03}": f"i{border[i]:03}" for i in range(150) if border[i] < 999}
    assert {r.id: r.cluster for r in cluster.dbscan(df, "id", "v").collect()} == want
    assert vectors.neighbour_edges(df, "id", "v", ("repo_id", "language"), 0.15, block=20).distinct().count() == (np.triu(near, 1)).sum()


def test_top_k_ties_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0])], "id long, v array<double>")
    assert rows(vectors.top_k(df, df.filter("id = 1"), "id", "v", k=2).select("id", "cosine")) == [(2, 1.0), (3, 1.0)]
    assert vectors.top_k(df.limit(0), df.limit(0), "id", "v").count() == 0


def test_added_lines(spark):
    p = [("a", "@@ -1,1 +1,3 @@\n x\n+y\n+z"), ("b", "@@ -1 +2 @@\n+a\n@@ -9 +12 @@\n+b"), ("c", "@@ -1,2 +1,2 @@\n x\n-y"), ("d", None)]
    assert rows(review.added_lines(spark.createDataFrame(p, "id string, p string"), "p", "id")) == [("a", 2), ("a", 3), ("b", 2), ("b", 12)]


def test_gate_and_health(spark):
    cols = "chunk_id string, file_path string, chunk_name string, language string, start_line int, end_line int, raw_code string"
    c = [("q", "apps/a/x.py", "load_price", "python", 1, 20, "def load_price(): price"), ("same_app", "apps/a/y.py", "load_price", "python", 1, 20, "p"), ("long", "b/y.py", "load_price", "python", 1, 90, "p"), ("ok", "b/z.py", "price_load", "python", 1, 40, "def price_load(): price"), ("other", "b/w.py", "draw_map", "python", 1, 20, "p")]
    pairs = spark.createDataFrame([("q", x[0], 0.99) for x in c[1:]], "query_id string, id string, cosine double")
    assert [r.id for r in review.semantic_duplicates(pairs, spark.createDataFrame(c, cols)).collect()] == ["ok"]
    f = spark.createDataFrame([("p", "critical")] * 3 + [("p", "odd"), ("o", "critical")] + [("o", "high")] * 9, "pr_id string, severity string")
    assert rows(review.health_score(f, "pr_id")) == [("o", 0), ("p", 40)]


def test_duplicates_behind_many_near_rows_of_no_use(spark):
    """A twin elsewhere is found, however many closer functions of the same file and app fail the gate."""
    near = lambda i: [1.0, 0.001 * i]
    c = [("q", "apps/a/x.py", near(0))] + [(f"f{i:03}", "apps/a/x.py", near(1)) for i in range(40)] + [(f"g{i:03}", f"apps/a/y{i}.py", near(2)) for i in range(40)]
    c += [(f"t{i}{k}", f"b/z{i}.py", near(3 + i)) for i in range(7) for k in "ab"] + [("far", "b/w.py", [0.0, 1.0])]
    df = spark.createDataFrame([("r", i, p, "load_price", "python", 1, 20, "def load_price(): price", v) for i, p, v in c], "repo_id string, chunk_id string, file_path string, chunk_name string, language string, start_line int, end_line int, raw_code string, embedding array<double>")
    pairs = vectors.pairs_within(review.without_copies(df), df.filter("chunk_id = 'q'"), "chunk_id", "embedding", ("repo_id", "language"), 0.03, "file_path")
    assert rows(review.semantic_duplicates(pairs, df).select("id")) == [(f"t{i}a",) for i in range(5)]


def test_impact_of_each_commit_with_stored_representative(spark):
    """Each commit has its own five, represented by the stored member of highest similarity, not by a joining chunk."""
    joined = spark.createDataFrame([(f"n{c}{k}", f"k{k}", "r", f"c{c}") for c in range(3) for k in range(6)], "chunk_id string, cluster_id string, repo_id string, commit_id string")
    clusters = spark.createDataFrame([(f"k{k}", 2 + k, 1, "python", "", "c0" if k else None) for k in range(6)], "cluster_id string, chunk_count int, file_count int, language string, label string, origin_commit_id string")
    members = spark.createDataFrame([(f"k{k}", f"m{k}{i}", 0.5 + i / 10) for k in range(5) for i in range(3)], "cluster_id string, chunk_id string, similarity_score double")
    chunks = spark.createDataFrame([(f"m{k}{i}", f"name{k}{i}") for k in range(5) for i in range(3)], "chunk_id string, chunk_name string")
    commits = spark.createDataFrame([("c0", "0123456789")], "commit_id string, sha string")
    got = review.debt_impact(joined, clusters, members, chunks, commits)
    assert rows(got.select("commit_id", "rank", "cluster_id", "representative")) == [(f"c{c}", k + 1, f"k{k}", f"name{k}2") for c in range(3) for k in range(5)]
    assert {(r.cluster_id, r.origin_sha) for r in got.collect()} == {("k0", None)} | {(f"k{k}", "01234567") for k in range(1, 5)}


def test_backfill_cuts_the_lines_of_the_chunk(spark):
    whole = "import os\r\n\r\n" + "\r\n".join(f"x{i} = {i}" for i in range(20)) + "\r\n \r\n"
    c = [("w", "module", 1, 22, whole), ("late", "function", 10, 12, None), ("end", "function", 22, 99, None), ("blank", "class", 2, 2, None), ("has", "function", 1, 1, "import os")]
    df = spark.createDataFrame([("r", "c", "a.py", *x) for x in c] + [("r", "c2", "a.py", "no_file", "function", 1, 2, None)], "repo_id string, commit_id string, file_path string, chunk_id string, chunk_type string, start_line int, end_line int, raw_code string")
    assert rows(tables.backfill_code(df)) == [("end", "x19 = 19"), ("late", "x7 = 7\nx8 = 8\nx9 = 9")]


def test_signature():
    body, good = b"{}", "sha256=" + hmac.new(b"k", b"{}", hashlib.sha256).hexdigest()
    assert review.signature_valid("k", body, good) and not review.signature_valid("", body, good) and not review.signature_valid("k", body, good[7:]) and not review.signature_valid("k", b"x", good)


def test_keyed_tables(spark):
    t = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([("a", 5), ("b", 7), ("b", 6), (None, 1)], "k string, v int")
    assert rows(tables.insert_if_absent(t, new, ["k"], ["v"])) == [("b", 6)]
    assert rows(tables.update_by_key(t.filter("k = 'a'"), new.filter("k = 'a'"), ["k"], ["v"])) == [("a", 5)]
    assert tables.delete_where(t, F.col("k") == "a").count() == 1


def test_stream_routes_and_dedup(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    e = [("1", "ping", "{}"), ("2", "pull_request", '{"action": "opened"}'), ("2", "pull_request", '{"action": "opened"}'), ("3", "pull_request", '{"action": "labeled"}'), ("4", "push", "{}"), ("5", "star", "{}")]
    spark.createDataFrame([(*x, "2024-01-01T00:00:00Z") for x in e], "delivery_id string, event string, payload string, received_at string").coalesce(1).write.mode("overwrite").json(str(src))
    q = events.process_new(events.routed(events.read_events(spark, str(src))), str(out), ["delivery_id"], lambda d: d.select("delivery_id", "route"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert dict(rows(spark.read.parquet(str(out)))) == {"1": "pong", "2": "pull_request", "3": "ignored", "4": "push", "5": "ignored"}


def test_chunker(spark):
    code = "class A:\n    def m(self):\n        if x and y:\n            return 1\n        else:\n            return 2\n\n\ndef f():\n    def g():\n        pass\n"
    assert chunker.python_chunks(code) == [("A", "class", 1, 6, 4), ("m", "function", 2, 6, 4), ("f", "function", 9, 11, 1)]
    assert [c[0] for c in chunker.python_chunks(code, "review")] == ["A", "m", "f", "g"]
    df = spark.createDataFrame([("a.py", code), ("vendor/a.py", code), ("b.py", "def ("), ("c.go", "func"), ("d.py", None)], "p string, t string")
    got = chunker.chunk_files(df, "p", "t", "p")
    assert rows(got.select("p", "chunk_name", "start_line")) == [("a.py", "A", 1), ("a.py", "f", 9), ("a.py", "m", 2)]
    assert got.filter("chunk_name = 'f'").first().raw_code == "def f():\n    def g():\n        pass"


def test_match_identities(spark):
    stored = spark.createDataFrame([("k1", "r", "l", [1.0, 0.0], 3, "h"), ("k2", "r", "l", [0.0, 1.0], 3, "h"), ("k3", "q", "l", [1.0, 0.0], 3, "h")], "cluster_id string, repo_id string, language string, centroid array<double>, chunk_count int, centroid_hash string")
    fresh = spark.createDataFrame([("a", "r", "l", [1.0, 0.05]), ("b", "r", "l", [1.0, 1.0])], "new_id string, repo_id string, language string, centroid array<double>")
    assert {r.new_id: r.continues for r in cluster.match_identities(fresh, stored).collect()} == {"a": "k1", "b": None}
