"""Memory of one task where a query takes several slices of the folded log."""

import pytest

from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
SLICED = "ckpt_chain_apply compaction_live_set compaction_preserves compaction_copy_to_tail tier_read tier_delete_masks_cold tier_gated_read tier_sizes tier_keep_hot".split()


def most_memory(spark, name: str) -> int:
    """The most execution memory that a task of the query took, in bytes."""
    sc = spark.sparkContext
    sc.setJobGroup(f"memory of {name}", name)
    registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    kept, tracker, most = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    for stage in {s for j in tracker.getJobIdsForGroup(f"memory of {name}") for s in tracker.getJobInfo(j).stageIds}:
        tasks = kept.taskList(stage, 0, 1000)
        metrics = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
        most = max([most] + [m.get().peakExecutionMemory() for m in metrics if m.isDefined()])
    return most


@pytest.mark.parametrize("name", SLICED)
def test_no_task_holds_several_folds(spark, name):
    one = most_memory(spark, "kv_snapshot_latest")
    assert 0 < most_memory(spark, name) < 2 * one
