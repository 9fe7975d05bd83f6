"""The task fold against its transition table, on random histories; log rules on the reference's own cases."""

import random

from eventloom import schemas
from eventloom.functions.udfs import resolved, workflow
from eventloom.operators import dag, folds, log
from eventloom.sources import tables


def replay(history):
    s = None
    for kind, e, w in history:
        if kind == "TaskSubmitted":
            s = ["QUEUED", e, 0, ""]
            continue
        if s is None or s[0] in ("SUCCEEDED", "FAILED"):
            continue
        free = s[1] == 0 and s[2] == 0
        if kind == "TaskStarted":
            if free if e == 0 else e > s[2] and e >= s[1]:
                s[0], s[3] = "RUNNING", w
                s[1] = e or s[1]
        elif kind == "TaskRedelivered":
            s[2] = max(s[2], e)
            if e == 0 or e >= s[1]:
                s[0], s[3] = "QUEUED", ""
        elif free if e == 0 else s[0] == "RUNNING" and e == s[1] and e > s[2]:
            s[0], s[3] = ("SUCCEEDED" if kind == "TaskCompleted" else "FAILED"), w
    if s and s[0] == "RUNNING":
        s[0], s[3] = "QUEUED", ""
    return s


def test_random_histories_and_checkpoints(spark):
    rng, rows, want = random.Random(7), [], {}
    for t in range(300):
        history = [(rng.choice(schemas.TASK_EVENT_TYPES), rng.randrange(4), f"w{rng.randrange(3)}") for _ in range(rng.randrange(1, 14))]
        if rng.random() < 0.9:
            history[0] = ("TaskSubmitted", 0, "")
        rows += [(f"t{t}", i + 1, k, e, w, None, None) for i, (k, e, w) in enumerate(history)]
        if (s := replay(history)) is not None:
            want[f"t{t}"] = tuple(s)
    events = spark.createDataFrame(rows, schemas.TASK_EVENTS)
    pick = lambda df: {r.task_id: (r.status, r.epoch, r.fence, r.worker_id) for r in df.collect()}
    assert pick(folds.tasks(events)) == want
    assert pick(folds.tasks(events.where("seq > 5"), folds.folded(events.where("seq <= 5"), "task_id"))) == want
    assert pick(folds.tasks(events.repartition(5).orderBy("worker_id"))) == want


def test_dedup_keeps_first_payload(spark):
    empty = spark.createDataFrame([], schemas.LOG)
    new = spark.createDataFrame([("task:1", None, "TaskSubmitted", "submit-1", '{"x":1}', 1), ("task:1", None, "TaskSubmitted", "submit-1", '{"x":2}', 2), ("", None, "a", "", "", 3), ("task:1", None, "a", "", "", 4)], schemas.LOG).drop("seq")
    got = [(r.seq, r.duplicate, r.payload) for r in log.append(empty, new, "timestamp_ms").orderBy("timestamp_ms").collect()]
    assert got == [(1, False, '{"x":1}'), (1, True, '{"x":2}'), (2, False, "")]


def test_trim_and_compaction(spark):
    rows = spark.createDataFrame([("actor:trim", i, "ActorCommandApplied", "", "x" * 64, i) for i in range(1, 6)], schemas.LOG).withColumn("length", log.F.lit(100)).withColumn("segment_id", log.F.expr("(seq - 1) div 3"))
    kept = spark.createDataFrame([("actor:trim", 4)], schemas.RETENTION)
    assert [r.seq for r in log.live(rows, kept).orderBy("seq").collect()] == [4, 5]
    s = log.stream_stats(rows, kept).first()
    assert (s.first_seq, s.next_seq, s.compactable_records) == (4, 6, 3)
    plan = {r.segment_id: r.action for r in log.compaction_plan(log.segment_stats(rows, kept), 1).collect()}
    assert plan == {0: "delete", 1: "skip"}
    moved = log.trim(kept, spark.createDataFrame([("actor:trim", 2), ("nobody", 3)], "stream_id string, before_seq bigint"), log.stream_stats(rows, kept))
    assert [(r.stream_id, r.trim_before) for r in moved.collect()] == [("actor:trim", 4)]


def test_ewma_truncates(spark):
    df = spark.createDataFrame([([10, 20, 30, 40],), ([42],), ([],)], "v array<bigint>")
    assert [r[0] for r in df.select(folds.ewma(log.F.col("v"))).collect()] == [24, 42, None]
    df = spark.createDataFrame([([-10, -5],), ([2**53 + 1, 2**53 + 1],)], "v array<bigint>")
    assert [r[0] for r in df.select(folds.ewma(log.F.col("v"))).collect()] == [-8, 2**53 + 1]


def test_actor_owner_is_the_last_that_a_record_names(spark):
    rows = [("a", 1, "ActorOwnershipGranted", "w1", 1, 0, 0, None, 0), ("a", 2, "ActorCommandApplied", "w2", 3, 0, 1, "x", 0), ("a", 3, "ActorCommandFailed", "", 0, 2, 2, None, 0), ("a", 4, "ActorSnapshotCreated", "", 0, 0, 0, "snap", 1), ("a", 5, "ActorCommandSubmitted", "w9", 9, 5, 0, None, 0)]
    events = spark.createDataFrame(rows, schemas.ACTOR_EVENTS)
    assert [tuple(r) for r in folds.actors(events).collect()] == [("a", "w2", 3, 5, 2, "x", 2)]
    assert [tuple(r) for r in folds.actors(events, use_snapshot=True).collect()] == [("a", "w1", 1, 5, 2, "snap", 1)]


def test_graph_errors(spark):
    steps = spark.createDataFrame([("ok", "a", []), ("ok", "b", ["a"]), ("loop", "a", ["b"]), ("loop", "b", ["a"]), ("lost", "a", ["x"])], "workflow_id string, step_id string, depends_on array<string>")
    last = spark.createDataFrame([("ok", "b"), ("loop", "a"), ("lost", "z"), ("none", "a")], "workflow_id string, result_step_id string")
    got = {r.workflow_id: r.errors for r in dag.validated(steps, last).collect()}
    assert got == {"ok": "", "loop": "cycle", "lost": "missing result step,unknown dependency", "none": "empty,missing result step"}


def test_traced_workflow():
    @workflow
    def chain(w, text):
        v = w.step("embed", text)
        w.step("embed", text)
        return w.step("answer", v, top=[v])

    d = chain("hello")
    assert [s["step_id"] for s in d["steps"]] == ["embed", "embed_2", "answer"]
    assert d["steps"][2]["depends_on"] == ["embed"] and d["result_step_id"] == "answer"
    assert resolved(d["steps"][2]["args"], {"embed": "vec"}) == ["vec"]


def test_report_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"name": "a", "exit_code": 0, "duration_sec": 1.5, "log": "l"}\nnot json\n\n')
    (tmp_path / "e.env").write_text("A = 1\nB=x=y\nnothing\n")
    (tmp_path / "b.txt").write_text("BenchmarkAssign/depth-8 \t 100\t 554.3 ns/op\t 12 B/op\t 3 allocs/op\nok\n")
    got = [(r.name, r.exit_code, r.log) for r in tables.statuses(spark, str(tmp_path / "s.jsonl")).collect()]
    assert got == [("a", 0, "l"), ("invalid", 1, "not json")]
    assert {(r.key, r.value) for r in tables.environment(spark, str(tmp_path / "e.env")).collect()} == {("A", "1"), ("B", "x=y")}
    assert [tuple(r) for r in tables.benchmarks(spark, str(tmp_path / "b.txt")).collect()] == [("BenchmarkAssign/depth-8", 554.3, 12, 3)]
