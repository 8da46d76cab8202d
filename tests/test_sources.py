"""Scans, incremental runs, vectors and sinks on small cases."""

import numpy as np
from pyspark.sql import functions as F

from lodeweave.functions import scalars
from lodeweave.operators import debt, review, tables
from lodeweave.sources import commits as C
from lodeweave.sources import config


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commits_after_checkpoint(spark):
    c = spark.createDataFrame([("r", f"c{i}", f"s{i}", i) for i in range(5)] + [("q", "d0", "t0", 0)] + [("n", "e0", "u0", 0)], "repo_id string, commit_id string, sha string, committed_at int")
    at = spark.createDataFrame([("r", "s2"), ("q", "lost"), ("n", None)], "repo_id string, last string")
    assert rows(C.commits_after(c, at, "last").select("commit_id", "ordinal")) == [("c3", 4), ("c4", 5), ("d0", 1), ("e0", 1)]


def test_debt_in_two_runs_is_debt_in_one(spark):
    chunks = spark.createDataFrame([("r", f"c{i}", "f.py", f"k{i}", "python", float(i * i)) for i in range(6)], "repo_id string, commit_id string, file_path string, chunk_id string, language string, complexity_score double")
    commits = spark.createDataFrame([(f"c{i}", i, f"s{i}") for i in range(6)], "commit_id string, committed_at int, sha string")
    none = spark.createDataFrame([], "chunk_id string, cluster_id string")
    broken = spark.createDataFrame([("r", "c4", "f.py")], "repo_id string, commit_id string, file_path string")
    old, new = chunks.filter("commit_id < 'c3'"), chunks.filter("commit_id >= 'c3'")
    whole = debt.velocity(debt.debt_scores(chunks, none, broken), commits).select("commit_id", "velocity")
    second = debt.debt_run(debt.debt_scores(old, none, broken), new, none, broken, commits).select("commit_id", "velocity")
    assert rows(second) == [r for r in rows(whole) if r[0] >= "c3"]


def test_vectors_from_cache_and_model(spark):
    c = spark.createDataFrame([("a", "x y", [1.0, 0.0]), ("b", "x y", None), ("c", "z z w", None), ("d", "  ", None), ("e", None, None), ("f", "z z w", None)], "chunk_id string, raw_code string, embedding array<float>")
    got = {r.chunk_id: (r.origin, r.embedding) for r in C.embed_missing(c, C.hashed_words_model).collect()}
    assert got["b"] == ("cache", [1.0, 0.0]) and got["d"] == ("blank", None) and "e" not in got
    assert got["c"] == got["f"] and got["c"][0] == "model" and abs(np.linalg.norm(got["c"][1]) - 1) < 1e-5


def test_statuses_files_and_latest(spark):
    r = spark.createDataFrame([("1", "open"), ("2", "merged"), ("3", "analyzing"), ("4", "open")], "pr_id string, status string")
    snap = spark.createDataFrame([("1", "closed"), ("2", "open"), ("3", "merged")], "pr_id string, status string")
    assert rows(C.synced_statuses(r, snap)) == [("1", "closed"), ("2", "merged"), ("3", "merged"), ("4", "open")]
    f = spark.createDataFrame([("a", "added"), ("b", "removed"), ("c", None)], "f string, s string")
    assert rows(C.changed_files(f, "s").select("f", "change")) == [("a", "A")]
    t = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("k", 2, "a")], "k string, t int, v string")
    assert rows(C.latest(t, ["k"], "t", "v")) == [("k", 2, "a")]


def test_rule_files(tmp_path):
    p = tmp_path / "rules.yml"
    p.write_text("rules:\n  max_function_lines: 7\n")
    assert config.rules_from_file(str(p))["max_function_lines"] in (7, 50)  # 50 where no YAML library is installed
    assert config.rules_from_yaml(": : [")["max_complexity"] == 10 and config.rules_from_file(str(tmp_path / "no"))["max_complexity"] == 10


def test_append_and_dead_letters(spark, tmp_path):
    e = spark.createDataFrame([("1", "t", "failed", "Debt", "boom", 1), ("2", "t", "failed", "debt", "bang", 2), ("3", "u", "failed", "x", "", 1), ("4", "u", "completed", "x", "", 2), ("5", "", "failed", "x", "", 3)], "event_id string, task_id string, status string, stage string, error_message string, created_at int")
    d = tables.dead_letters(e)
    assert rows(d) == [("t", "debt", "bang", 2)]
    for _ in range(2):
        tables.append(d, str(tmp_path / "failed"), ["task_id"])
    assert spark.read.parquet(str(tmp_path / "failed")).count() == 1
    ids = spark.range(100).select(F.col("id").cast("string"))
    assert rows(tables.seeded_sample(ids, "id", 10, 42)) == rows(tables.seeded_sample(ids.repartition(7), "id", 10, 42)) != rows(tables.seeded_sample(ids, "id", 10, 43))


def test_scalars_and_finding_forms(spark):
    one = spark.createDataFrame([(0.299, "2024-01-01T00:00:00Z", "http://github.com/a")], "g double, t string, u string")
    got = one.select(scalars.growth_colour("g"), scalars.bubble_radius("g"), scalars.percent("g"), scalars.iso_timestamp("t").isNotNull(), scalars.url_allowed("u")).first()
    assert (got[0], round(got[1], 3), *got[2:]) == ("amber", 17.96, 29, True, False)
    assert one.select(scalars.envelope(F.struct("g", F.lit(None).cast("string").alias("n")))).first()[0] == '{"success":true,"data":{"g":0.299,"n":null},"meta":{},"error":null}'
    dup = spark.createDataFrame([("p", "f", 0.869, 3)], "pr_id string, chunk_name string, similarity double, start_line int")
    assert rows(review.duplicate_findings(dup, "pr_id")) == [("p", "duplicate", "medium", "Duplicate logic: f (86% match)", 3)]
    imp = spark.createDataFrame([("p", 0.31, "high", None)], "pr_id string, growth double, severity string, representative string")
    assert rows(review.impact_findings(imp, "pr_id")) == [("p", "debt_impact", "high", "Accelerates pattern '' by ~31%", None)]
