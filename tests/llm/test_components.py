import random

from pyspark.sql import functions as F

from blockloom.llm import components


def brute_roots(links):
    of = {n: n for link in links for n in link}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        of[high] = low
    return {n: root(n) for n in of}


def test_components_by_few_tasks(spark, monkeypatch):
    """Each task costs disk (a line of the log, shuffle files), so a round deals its edges a few times only."""
    rng = random.Random(4)
    links = [(i + 1, i) for i in range(0, 60)] + [(100, n) for n in range(101, 160)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(100)]
    links = [(a, b) for a, b in links if a != b]
    cuts, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or cut(df))
    edges = spark.createDataFrame(links, "a long, b long").repartition(4)
    spark.sparkContext.setJobGroup("components", "components")
    roots = components.connected_components(edges)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.a: r.root for r in roots.collect()} == brute_roots(links)
    assert roots.where(F.col("a") == F.col("root")).count() == len(set(brute_roots(links).values()))
    rounds = len(cuts) - 1
    assert tasks <= 12 * rounds  # 14 and more where each side of each join is dealt by itself
