"""Worked examples of classifier calls."""

from kineplate.operators import classifier as K

SCHEMA = "pos int, sample string, crop long, t int, label boolean"


def frame(spark, *labels, crop=1, sample="A"):
    return [(0, sample, crop, t, label) for t, label in enumerate(labels)]


def test_clean_latches_death(spark):
    rows = spark.createDataFrame(frame(spark, True, True, False, True), SCHEMA)
    assert [r.label for r in K.clean_monotone(rows).orderBy("t").collect()] == [True, True, False, False]


def test_death_time_is_last_alive_frame(spark):
    rows = frame(spark, True, True, True, False, False) + frame(spark, False, False, crop=2) + frame(spark, True, False, crop=3)
    got = {r.crop: r.death_time for r in K.death_times(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


def test_repeated_frames_count_together(spark):
    rows = [(0, "A", 1, 0, True), (0, "A", 1, 1, True), (0, "A", 1, 1, False), (0, "A", 1, 2, True), (0, "A", 1, 3, True), (0, "A", 1, 4, True)]
    assert K.death_times(spark.createDataFrame(rows, SCHEMA)).first().death_time == 4  # 5 of 6
    assert K.death_times(spark.createDataFrame(rows[:4], SCHEMA)).first().death_time == 0  # 3 of 4 and 2 of 3 are too few, the first alive frame is the first one


def test_kill_curve(spark):
    deaths = spark.createDataFrame([(0, "A", k, d) for k, d in enumerate([10, 5, 3])], "pos int, sample string, crop int, death_time int")
    got = {r.t: r.n_alive for r in K.kill_curve(deaths).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 2, 5: 2, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    assert K.kill_curve(deaths.withColumn("death_time", deaths.death_time * 0)).count() == 0


def test_plan_sorts_once_and_has_no_python(spark):
    rows = spark.createDataFrame(frame(spark, True, False), SCHEMA)
    plan = K.death_times(K.clean_monotone(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1
