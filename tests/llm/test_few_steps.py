"""What the driver of a run has to keep: a step's tasks each report to it, whatever they hold."""

import random

from ledgerloom.llm import jaccard


def test_chains_of_near_copies_take_few_steps(spark):
    """Chains, in each of which only neighbours are alike, are contracted by the tasks that read the links."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1000 * c + i, " ".join(words[300 * c + 4 * i : 300 * c + 4 * i + 50])) for c in range(5) for i in range(40)]
    r.shuffle(rows)
    sc = spark.sparkContext
    sc.setJobGroup("chains", "chains")
    try:
        found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text").collect()
        jobs = sc.statusTracker().getJobIdsForGroup("chains")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {x["id"]: x["component_id"] for x in found} == {i: i // 1000 * 1000 for i, _ in rows}
    assert len(jobs) < 100, len(jobs)
