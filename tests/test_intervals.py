import random

from lodestone.operators.intervals import merge_intervals, speaker_periods

SCHEMA = "k long, s long, e long, kind string"


def brute(rows):
    out, by = set(), {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, xs in by.items():
        periods = []
        for s, e in sorted(xs):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out |= {(k, "period", a, b) for a, b in periods} | {(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])}
    return out


def check(spark, rows, shard):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = [tuple(r) for r in merge_intervals(df, ["k"], "s", "e", shard).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_nested_touching_and_spanning(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 2, 5), (1, 25, 95), (1, 97, 98), (2, -30, -5), (2, -5, 3), (3, 4, 4), (3, 9, 2), (4, None, 3), (None, 1, 2), (1, 25, 95)]
    for shard in (1, 7, 10, 1000):
        check(spark, rows, shard)


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), s := rng.randint(-200, 400), s + rng.choice([0, 1, 2, 3, 8, 30, 120])) for _ in range(400)]
    for shard in (10, 64):
        check(spark, rows, shard)


def test_empty_and_bad_times(spark):
    assert merge_intervals(spark.createDataFrame([], SCHEMA), ["k"], "s", "e").count() == 0
    df = spark.createDataFrame([(1, "a", float("nan"), 2.0), (1, "a", 1.0, float("inf")), (1, "a", 0.0004, 0.0006), (1, "a", 1.0000000001, 2.0)], "conv_id long, speaker string, start_time double, end_time double")
    assert sorted(tuple(r)[2:] for r in speaker_periods(df).collect()) == [("gap", 1, 1000), ("period", 0, 1), ("period", 1000, 2000)]
