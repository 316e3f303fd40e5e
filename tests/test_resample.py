import hashlib

import numpy as np
import pytest

import tidemark as tm
import tidemark.operators.resample as R
from helpers import plan_of, series

VALUES = {"A": [100.0, 110.0, 99.0, 120.0, 118.0, 90.0, 130.0], "B": [50.0, 55.0, 40.0]}


def backtest(spark, values=None):
    rows = [(f"2022-01-{3 + i:02d}", s, v) for s, vs in (values or VALUES).items() for i, v in enumerate(vs)]
    return series(spark, "equity", *rows)


def curves_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.system, r.run), {})[r.step] = r.equity
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def expected(values, system, run, seed):
    changes = [0.0] + [b / a - 1 for a, b in zip(values, values[1:])]
    if run:
        key = [hashlib.md5(f"{seed}|{run}|{system}|{i}".encode()).hexdigest() for i in range(len(values))]
        changes = [changes[i] for i in sorted(range(len(values)), key=lambda i: key[i])]
    return values[0] * np.cumprod([1 + c for c in changes])


@pytest.mark.parametrize("runs", [0, 3, 9, 10, 25])
def test_every_run_is_the_seeded_permutation(spark, runs):
    got = curves_of(tm.permutation_resample(backtest(spark), runs, seed=7))
    assert set(got) == {(s, r) for s in VALUES for r in range(runs + 1)}
    for (s, r), curve in got.items():
        assert curve == pytest.approx(expected(VALUES[s], s, r, 7), abs=1e-4)
        assert curve[-1] == pytest.approx(VALUES[s][-1], abs=1e-3)
    assert got[("A", 0)] == VALUES["A"]


def test_gaps_keep_the_last_equity(spark):
    got = curves_of(tm.permutation_resample(backtest(spark, {"A": [100.0, None, 120.0, 0.0, 60.0]}), 0))
    # No change over the gap; a change from zero counts as none.
    assert got[("A", 0)] == [100.0, 100.0, 120.0, 0.0, 0.0]


def test_one_job_equals_the_two_steps(spark):
    b = backtest(spark)
    for merge in (False, True):
        steps = tm.drawdown_episodes(tm.permutation_resample(b, 12, 3), merge)
        assert sorted(steps.collect()) == sorted(tm.resampled_episodes(b, 12, 3, merge).collect())


def test_episodes_against_brute_force(spark):
    want = {}
    for (s, r), curve in curves_of(tm.permutation_resample(backtest(spark), 12, 3)).items():
        for i, v in enumerate(curve):
            peak = max(curve[:i + 1])
            if v < peak:
                pct, days = want.get((s, r, peak), (0, 0))
                want[(s, r, peak)] = (max(pct, abs((v / peak - 1) * 100)), days + 1)
    got = {(r.system, r.run, r.equity_high): (r.pct, r.days)
           for r in tm.resampled_episodes(backtest(spark), 12, 3).collect()}
    assert got == want


def test_curves_are_shuffled_once(spark):
    plan = plan_of(tm.resampled_episodes(backtest(spark), 100))
    # The stored returns are spread by blocks of runs; nothing after that.
    assert plan.count("Exchange") == 1 and plan.count("REPARTITION_BY_NUM") == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("rows, systems, runs, cores", [(5 * 2500, 5, 100, 8), (1500 * 2500, 1500, 100, 8), (1500 * 2500, 1500, 100, 4000), (1, 1, 0, 8),
                                                        (0, 0, 10, 8), (10 ** 9, 3, 100, 200), (10 ** 7, 10 ** 6, 100, 64)])
def test_blocks_and_partitions_follow_from_the_rows(rows, systems, runs, cores):
    per_block, partitions = R.block_plan(rows, systems, runs, cores)
    groups = max(systems, 1) * -(-(runs + 1) // per_block)
    assert 1 <= per_block <= runs + 1 and 1 <= partitions <= groups
    assert groups >= R.GROUPS_PER_CORE * cores or per_block == 1  # all cores have work
    assert per_block == 1 or per_block * rows / systems <= R.ROWS_PER_TASK
    assert rows * (runs + 1) / partitions <= R.ROWS_PER_TASK or partitions == groups


def test_the_setting_for_shuffles_does_not_matter(spark):
    setting = "spark.sql.shuffle.partitions"
    before, curves = spark.conf.get(setting), []
    for n in ("1", "3"):
        spark.conf.set(setting, n)
        try:
            df = tm.permutation_resample(backtest(spark), 40, 3)
            curves.append((df.rdd.getNumPartitions(), curves_of(df)))
        finally:
            spark.conf.set(setting, before)
    assert curves[0] == curves[1] and curves[0][0] >= 8
