import numpy as np

from cellarbook.llm import boosting


def test_levels_of_trees_take_few_tasks_whatever_the_shuffle_partitions(spark):
    """Each of 120 levels had a task for every shuffle partition where Spark does not join them."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 50, (300, 3)).astype(float)
    y = (x[:, 0] + rng.normal(0, 9, 300) > 25).astype(int)
    rows = [(r.tolist(), 0, False, int(v)) for r, v in zip(x, y, strict=True)]
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        table = spark.createDataFrame(rows, "x array<double>, kind int, apart boolean, y int").coalesce(2)
        context.setJobGroup("fit of trees", "test")
        model, _ = boosting.fit_rows(table, 3, lambda df: df.coalesce(2).cache())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("fit of trees") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert boosting.ROUNDS * boosting.DEPTH * 3 < tasks < boosting.ROUNDS * boosting.DEPTH * 12
    alone = boosting.fit(x, y)
    assert len(alone.leaves) == len(model.leaves) == boosting.ROUNDS
    for name in ("features", "cuts", "leaves"):
        assert np.array_equal(getattr(alone, name), getattr(model, name))
