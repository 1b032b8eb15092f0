"""Small tables between the steps of an operator don't cost a task for each shuffle partition."""

from plumbline.llm.components import components


def tasks_of(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_components_with_many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)] + [(0, i) for i in range(2, 200, 2)], "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        roots, tasks = tasks_of(spark, "few-tasks", lambda: {r.id: r.root for r in components(links).collect()})
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert roots == {i: 0 if i < 200 else i - i % 2 for i in range(400)}
    assert tasks < 700, tasks
