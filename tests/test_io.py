"""JSON-lines sources: missing files, blank and malformed lines, old key names."""

from dataclinic.session import ensure_checkpoint_dir
from dataclinic.sources import logs as LG


def _write(spark, lines, name):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def test_missing_file_gives_empty_frame(spark):
    r = LG.read_runs(spark, "/nonexistent/dataclinic/log.jsonl")
    assert r.count() == 0 and "episode" in r.columns


def test_blank_and_malformed_lines_are_skipped_and_counted(spark):
    path = _write(spark, ['{"episode": 1, "reward": 0.5, "task": "t"}', "", "{oops", '{"episode": 2, "reward": -0.1}'],
                  "io-mixed")
    raw = LG.read_runs(spark, path)
    assert LG.corrupt_count(raw).first()["corrupt_lines"] == 1
    n = LG.normalize(raw).orderBy("episode").collect()
    assert [(r["episode"], r["reward"], r["level"], r["success"]) for r in n] == [(1, 0.5, 0, False), (2, -0.1, 0, False)]


def test_old_step_log_keys_are_mapped(spark):
    path = _write(spark, ['{"step": 10, "stage": "easy", "mean_total_reward": 0.2, "mean_env_reward": 0.07}',
                          '{"step": 20, "stage": "easy", "mean_total_reward": 0.3, "mean_env_reward": 0.01}'], "io-old")
    n = LG.normalize(LG.read_runs(spark, path)).orderBy("episode").collect()
    assert [(r["episode"], r["task"], r["reward"], r["accuracy_gain"], r["success"]) for r in n] == [
        (0, "easy", 0.2, 0.07, True), (1, "easy", 0.3, 0.01, False)]


def test_mixed_folder_takes_defaults_per_file(spark):
    import uuid
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-two-{uuid.uuid4().hex[:8]}"
    for name, lines in (("old", ['{"step": 1, "stage": "a", "mean_total_reward": 0.2, "mean_env_reward": 0.07}'] * 2),
                        ("new", ['{"episode": 7, "task": "b", "level": 2, "reward": 0.9, "accuracy_gain": 0.0, "success": true}'])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{base}/{name}")
    n = LG.normalize(LG.read_runs(spark, f"{base}/*")).select("task", "episode", "level", "reward", "success", "run_id")
    rows = sorted(tuple(r) for r in n.collect())
    assert [r[:5] for r in rows] == [("a", 0, 0, 0.2, True), ("a", 1, 0, 0.2, True), ("b", 7, 2, 0.9, True)]
    assert len({r[5] for r in rows}) == 2 and all(r[5].startswith("part-") for r in rows)


def _runs(spark, n):
    d = spark.range(n * 5).selectExpr("CASE WHEN id < 5 THEN NULL ELSE id DIV 5 - 3 END AS run_id", "id % 5 + 1 AS episode")
    return d.selectExpr("run_id", "episode", "concat('{\"step\": ', episode * 7 + coalesce(run_id, 1000), '}') AS value")


def _in_files(spark, path):
    """Each file's values in the order of its lines."""
    files = {}
    for r in LG.read_runs(spark, path).orderBy("_file", "_pos").collect():
        files.setdefault(r["_file"], []).append((r["_pos"], r["step"]))
    return files


def _wanted(n):
    return sorted([(e, e * 7 + (1000 if r is None else r)) for e in range(1, 6)] for r in [None, *range(-2, n - 3)])


def test_one_file_a_run_without_a_folder_a_run(spark):
    import os
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/io a%20b-{uuid.uuid4().hex[:8]}"
    LG.write_runs(_runs(spark, 60), path, files_a_folder=20)
    assert sorted(_in_files(spark, path).values()) == _wanted(60)
    folders = [f for f in os.listdir(path) if f != "_temporary"]
    assert len(folders) < 10 and os.listdir(f"{path}/_temporary") == []
    assert all(1 <= len(os.listdir(f"{path}/{f}")) <= 20 for f in folders)


def test_runs_go_to_other_stores_by_sparks_writer(spark):
    import os
    import uuid
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-store-{uuid.uuid4().hex[:8]}"
    os.makedirs(folder)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./store", f"file://{folder}")
    LG.write_runs(_runs(spark, 8), "viewfs://runs/store/log")
    assert sorted(_in_files(spark, "viewfs://runs/store/log").values()) == _wanted(8)


def test_io2_normalize_writes_no_folder_a_run(spark, sf, monkeypatch):
    import os

    from dataclinic.plans.catalog import load_all
    paths, read = [], LG.read_runs
    monkeypatch.setattr(LG, "read_runs", lambda s, path: paths.append(path) or read(s, path))
    n = load_all()[0]["io2_normalize"](spark, sf).count()
    runs = spark.read.parquet(f"{sf}/events.parquet").select("user_id")
    files = [(d, f) for d, _, fs in os.walk(paths[0].replace("file:", "")) for f in fs if f.endswith(".jsonl")]
    assert n == runs.count() and len(files) == runs.distinct().count() > len({d for d, _ in files})


def test_positions_over_split_files_without_a_window_over_rows(spark):
    path = _write(spark, [f'{{"step": {i}, "mean_total_reward": 0.5}}' for i in range(3000)], "io-split")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = LG.read_runs(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    rows = [(r["_pos"], r["step"]) for r in raw.collect()]
    assert sorted(rows) == [(i + 1, i) for i in range(3000)]
    plan = LG.normalize(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and plan.count("Window [") == 1  # rows, splits, keys of files
