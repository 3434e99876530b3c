import os
import sys

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridweave.functions import lanes, registers
from gridweave.operators import graph, harness, moves, particles, track
from gridweave.sources import generators
from gridweave.streaming import series

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def serial(counts, steps, repeat=1):
    counts = list(counts)
    for _ in range(repeat):
        for s, d in steps:
            if counts[s] > 0:
                counts[d] += 1
                counts[s] -= 1
    return counts


def move_frames(spark, counts, steps):
    c = spark.createDataFrame(list(enumerate(counts)), "cell int, n long")
    m = spark.createDataFrame([(k, s, d) for k, (s, d) in enumerate(steps)], "seq long, src int, dest int")
    return c, m


def test_guarded_moves_by_hand(spark):
    c, m = move_frames(spark, [1, 0, 5], [(0, 1), (0, 2), (2, 2), (1, 0)])
    assert [r["n"] for r in moves.guarded_moves(c, m).orderBy("cell").collect()] == [1, 0, 5]


@FEW
@given(seed=st.integers(0, 999), repeat=st.integers(0, 3))
def test_guarded_moves_equal_serial(spark, seed, repeat):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 3, 6).tolist()
    steps = [tuple(map(int, x)) for x in rng.integers(0, 6, (40, 2))]
    c, m = move_frames(spark, counts, steps)
    got = [r["n"] for r in moves.guarded_moves(c, m, repeat).orderBy("cell").collect()]
    assert got == serial(counts, steps, repeat) and sum(got) == sum(counts)


def test_independent_groups_give_the_same_result(spark):
    counts, steps = [2, 0, 1, 0, 3, 0], [(0, 1), (2, 3), (1, 0), (4, 5), (3, 2), (0, 1)]
    c, m = move_frames(spark, counts, steps)
    grouped = moves.independent_groups(m)
    assert grouped.select("grp").distinct().count() == 3
    cells = c.join(grouped.select(F.explode(F.array("src", "dest")).alias("cell"), "grp").distinct(), "cell")
    assert [r["n"] for r in moves.guarded_moves(cells, grouped).orderBy("cell").collect()] == serial(counts, steps)


def test_generated_moves_stay_in_range(spark):
    far = generators.moves(spark, 500, 100, 1, spread=10).select(((F.col("dest") - F.col("src") + 150) % 100 - 50).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert far[0] >= -10 and far[1] <= 10
    assert generators.counters(spark, 1000).agg(F.sum("n")).first()[0] == 499500
    assert generators.jobs(spark).count() == 10


def test_balls_keep_out_of_the_hole(spark):
    b = generators.balls(spark, 500, 0.01, 5).cache()
    assert particles.without_hole(b).count() == 500
    x = b.agg(F.min("x"), F.max("y"), F.max(F.abs("vx"))).first()
    assert x[0] >= 0.0099 and x[1] <= 0.9901 and x[2] <= 0.25
    assert particles.by_location(b, 0.01).count() == 500
    assert particles.occupancy(b, 0.01).agg(F.count_distinct("id")).first()[0] <= 500


@FEW
@given(seed=st.integers(0, 99), radius=st.sampled_from([0.01, 0.05, 0.2]))
def test_grid_pairs_equal_theta(spark, seed, radius):
    b = generators.balls(spark, 120, 0.01, seed).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).cache()
    want = {tuple(r) for r in particles.pairs_by_theta(b, radius).collect()}
    rows = particles.pairs(b, radius).select("id1", "id2").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_steps_agree_without_shared_balls_and_conserve_energy(spark):
    rows = [(0, 0.5, 0.5, 0.1, 0.0), (1, 0.515, 0.5, -0.1, 0.0), (2, 0.001, 0.2, -0.1, 0.0), (3, 0.8, 0.8, 0.0, 0.0), (4, 0.8, 0.8, 0.1, 0.1)]
    b = spark.createDataFrame(rows, "id long, x double, y double, vx double, vy double")
    a = particles.step(b, 0.01, 0.01, 0.0).orderBy("id").toPandas()
    e = particles.exact_step(b, 0.01, 0.01, 0.0).orderBy("id").toPandas()
    np.testing.assert_allclose(a.to_numpy(float), e.to_numpy(float), atol=1e-12)
    assert a["vx"].tolist()[:3] == [-0.1, 0.1, 0.1]
    assert particles.simulate(b, 0.01, 0.01, 2).count() == 5


def cluster(n, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": rng.permutation(n), **{c: rng.normal(0.0, spread, n) for c in ("x", "y", "vx", "vy")}})


def one_by_one(balls, radius, t, strength):
    part = balls.sort_values(["id", "x", "y", "vx", "vy"])
    x, v = part[["x", "y"]].to_numpy(float), part[["vx", "vy"]].to_numpy(float)
    flip = ((x < radius) & (v < 0)) | ((x > 1 - radius) & (v > 0))
    v[flip] = -v[flip]
    for k in range(len(x)):
        for m in range(k + 1, len(x)):
            d = x[k] - x[m]
            gap = d[0] * d[0] + d[1] * d[1]
            if gap < 4 * radius * radius:
                e = v[k] - v[m]
                along = d[0] * e[0] + d[1] * e[1]
                if gap > 0 and along <= 0:
                    v[k], v[m] = v[k] - along / gap * d, v[m] + along / gap * d
                v[m] = v[m] - strength * d
    return np.column_stack((part["id"], x + v * t, v))


@pytest.mark.parametrize("chunks", [None, (7, 50, 100), (64, 1, 1)])
def test_exact_step_equals_a_loop_over_all_pairs(monkeypatch, chunks):
    for name, size in zip(("ROWS", "CANDIDATES", "PAIRS"), chunks or ()):
        monkeypatch.setattr(particles, name, size)
    for n, radius, seed in ((150, 0.02, 0), (150, 0.1, 1), (60, 1.0, 2), (150, 1e-6, 3), (1, 0.1, 4)):
        b = cluster(n, seed)
        b.loc[n // 2 :: 9, ["x", "y"]] = b.loc[0, ["x", "y"]].to_numpy()  # several on one point
        b.loc[n // 3 :: 11, "id"] = 5
        b.loc[n // 2 :: 13, "x"] = [np.nan, np.inf, 1e300, -1e17][seed % 4]
        b.loc[n // 4 :: 17, "vy"] = np.nan
        with np.errstate(all="ignore"):
            np.testing.assert_array_equal(particles._exact(b, radius, 0.01, 1e-3).to_numpy(float), one_by_one(b, radius, 0.01, 1e-3))


def test_exact_step_of_balls_in_a_row():
    b = pd.DataFrame({"id": np.arange(300), "x": np.arange(300) * 0.003, "y": 0.5, "vx": 0.1, "vy": 0.0})
    b.loc[0, "vx"] = 1.0
    np.testing.assert_array_equal(particles._exact(b, 0.002, 0.01, 0.0).to_numpy(float), one_by_one(b, 0.002, 0.01, 0.0))


def test_exact_step_takes_few_statements_for_many_pairs():
    b, lines = cluster(2000, 0), 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(lambda frame, event, arg: count if frame.f_code.co_filename == particles.__file__ else None)
    try:
        particles._exact(b, 0.05, 0.01, 1e-5)
    finally:
        sys.settrace(before)
    at = b[["x", "y"]].to_numpy()
    pairs = int(np.triu(((at[:, None] - at) ** 2).sum(axis=2) < 0.01, 1).sum())
    assert pairs > 200_000 and lines < pairs / 5


def test_exact_step_leaves_balls_without_a_place_alone(spark):
    rows = [(0, None, 0.5, 0.1, 0.0), (1, None, 0.5, -0.1, 0.0), (2, 0.5, 0.5, 0.1, 0.0), (3, 0.505, 0.5, -0.1, 0.0)]
    b = spark.createDataFrame(rows, "id long, x double, y double, vx double, vy double")
    got = {r["id"]: (r["x"], r["vx"], r["vy"]) for r in particles.exact_step(b, 0.01, 0.0, 1e-5).collect()}
    assert got[0] == (None, 0.1, 0.0) and got[1] == (None, -0.1, 0.0)
    assert got[2][1] == pytest.approx(-0.1) and got[3][1] == pytest.approx(0.1, abs=1e-6)
    assert particles.exact_step(b.limit(0), 0.01, 0.01).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 100), (200, 200)], "a long, b long"))
    got = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100 and got[200] == 200


def test_ema_and_kalman_equal_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k % 3), int(k), None if k == 7 else float(v)) for k, v in enumerate(rng.normal(size=50))]
    df = spark.createDataFrame(rows, "u long, k long, v double")
    want = {}
    for u, _, v in rows:
        if v is not None:
            want[u] = v if u not in want else 0.9 * want[u] + 0.1 * v
    got = {r["u"]: r["ema"] for r in track.ema(df, "u", ["k"], "v").collect()}
    assert got == pytest.approx(want)
    assert {r["u"]: r["n"] for r in track.kalman_scalar(df, "u", ["k"], "v").collect()} == {0: 17, 1: 16, 2: 16}


def test_kalman_track_beats_raw_measurements(spark):
    rng = np.random.default_rng(1)
    a, push, s, rows, truth = track.motion(0.01), np.array([0, 0, 0, 0, 0, -9.81 * 0.01]), np.array([0, 0, 2, 15, 3.5, 4.0]), [], []
    for k in range(120):
        truth.append(s[:3])
        rows.append((0, k, *map(float, s[:3] * [1, 5, 5] + rng.normal(size=3))))
        s = a @ s + push + np.concatenate((np.zeros(3), rng.normal(size=3) * [0.25, 0.25, 0.1]))
    df = spark.createDataFrame(rows, "id long, k int, mx double, my double, mz double")
    got = track.kalman_track(df, "id", [0, 0, 2, 15, 3.5, 4]).orderBy("k").toPandas()[["x", "y", "z"]].to_numpy()
    raw = np.array(rows)[:, 2:] / [1, 5, 5]
    rmse = lambda x: np.sqrt(((x - truth) ** 2).mean(axis=0))
    assert (rmse(got) < rmse(raw)).all()


def test_prediction_is_the_matrix_recurrence(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 15.0, 3.5, 4.0)], "id long, x double, y double, z double, vx double, vy double, vz double")
    got = track.predict(df, "id", 5, drag=0.1).orderBy("k").toPandas().iloc[:, 2:].to_numpy()
    s = np.array([0, 0, 2, 15, 3.5, 4.0])
    for row in got:
        np.testing.assert_allclose(row, s)
        s = track.motion(0.01, 0.1) @ s + [0, 0, 0, 0, 0, -0.0981]


def test_frame_rates_restart_after_each_bucket(spark):
    df = spark.createDataFrame([(1, k, 0.5) for k in range(7)], "u long, k int, s double")
    got = track.frame_rates(df, "u", ["k"], "s", 0.9).orderBy("bucket").collect()
    assert [(r["frames"], r["elapsed"], r["rate"]) for r in got] == [(2, 1.0, 2.0)] * 3


def test_harness(spark):
    df = spark.range(6).select(F.col("id").alias("job"), F.col("id").cast("double").alias("x"))
    assert [r["result"] for r in harness.ordered_map(df, "job", "x", lambda x: x * x, 3).collect()] == [0, 1, 4, 9, 16, 25]
    times = harness.tune(spark, {"a": lambda g, w: g * w}, [8, 16], [4])
    assert times.count() == 2 and harness.speed_up(4.0, 2.0) == 2.0
    assert harness.busy_work(0.0)(3) == 3
    assert harness.metrics(spark, fps=30.0).first()["value"] == 30.0


def test_lane_semantics(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, nan, -0.0, 4.0, -5.0, 6.0, 7.0, 8.0], [2.0, 1.0, 0.0, 0.0, nan, 6.0, 1.0, 9.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(lanes.less_than(a, b), lanes.greater_than(a, b), lanes.signs(a), lanes.div(a, b), lanes.make(*[F.lit(float(k)) for k in range(8)]), lanes.splat(F.lit(1.5))).first()
    assert got[0] == [True, False, False, False, False, False, False, True]
    assert got[1] == [False, False, False, True, False, False, True, False]
    assert got[2] == 0b10100 and got[3][3] is None and got[4] == [7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0] and got[5] == [1.5] * 8
    assert df.select(lanes.store(a)).count() == 8
    got = df.select(registers.least_of(a, b), registers.compare(a, b, "unord"), registers.compare(a, b, "nlt"), registers.masked_load(b, lanes.less_than(a, b)), registers.masked_store(a, b, lanes.less_than(a, b))).first()
    assert got[0][1] == 1.0 and got[1] == [False, True, False, False, True, False, False, False] and got[2][1] is True
    assert got[3] == [2.0, 0, 0, 0, 0, 0, 0, 9.0] and got[4][0] == 2.0 and got[4][7] == 9.0


def test_register_families(spark):
    df = spark.createDataFrame([([float(k) for k in range(8)], [float(10 * k) for k in range(8)], [True] * 4 + [False] * 4, [0.5, 1.5, -0.5, 2.5] * 2)], "a array<float>, b array<float>, m array<boolean>, r array<float>")
    a, b, m, r = map(F.col, "abmr")
    one = lambda c: df.select(c).first()[0]
    assert one(registers.addsub(a, b)) == [0, 11, -18, 33, -36, 55, -54, 77]
    assert one(registers.hadd(a, b)) == [1, 5, 10, 50, 9, 13, 90, 130]
    assert one(registers.hsub(a, b)) == [-1, -1, -10, -10, -1, -1, -10, -10]
    assert one(registers.dot(a, b, 0xF1)) == [140, 0, 0, 0, 1260, 0, 0, 0]
    assert one(registers.blend(a, b, m)) == [0, 10, 20, 30, 4, 5, 6, 7]
    assert one(registers.rounded(r)) == [0, 2, 0, 2] * 2 and one(registers.rounded(r, "zero")) == [0, 1, 0, 2] * 2
    assert one(registers.convert(r, "int")) == [0, 2, 0, 2] * 2 and one(registers.convert(r, "int", True)) == [0, 1, 0, 2] * 2
    assert one(registers.unpack(a, b, True)) == [2, 20, 3, 30, 6, 60, 7, 70]
    assert one(registers.permute(a, F.array(*map(F.lit, [7, 0, 7, 0, 1, 1, 2, 2])))) == [7, 0, 7, 0, 1, 1, 2, 2]
    assert one(registers.permute_halves(a, b, 0x83)) == [40, 50, 60, 70, 0, 0, 0, 0]
    assert one(registers.duplicate(a, True)) == [1, 1, 3, 3, 5, 5, 7, 7]
    assert one(registers.extract_half(a, 1)) == [4, 5, 6, 7] and one(registers.insert_half(a, registers.extract_half(b, 0), 1)) == [0, 1, 2, 3, 0, 10, 20, 30]
    assert one(registers.test(m, m, "z")) is False and one(registers.test(m, m, "c")) is True and one(registers.test(m, m, "nzc")) is False
    assert one(registers.reciprocal(b))[0] is None and one(registers.reciprocal_sqrt(F.array(F.lit(4.0)))) == [0.5] and one(registers.filled(F.lit(2), 3, "int")) == [2, 2, 2]
    ints = df.select(registers.bits(F.array(F.lit(6), F.lit(5)), F.array(F.lit(3), F.lit(3)), "andnot"), registers.bits(F.array(F.lit(6)), F.array(F.lit(3)), "xor")).first()
    assert ints[0] == [1, 2] and ints[1] == [5]
    assert one(registers.greatest_of(a, b))[1] == 10


def test_streams_carry_state_between_triggers(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, rows in enumerate(([(1, 0, 1.0), (1, 1, 2.0)], [(1, 2, 3.0), (2, 0, 5.0)])):
        pd.DataFrame(rows, columns=["u", "k", "v"]).to_json(src / f"{k}.json", orient="records", lines=True)
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files of one moment have no order
    stream = spark.readStream.schema("u long, k long, v double").option("maxFilesPerTrigger", 1).json(str(src))
    for name, df in (("s_ema", series.ema(stream, "u", "k", "v")), ("s_kal", series.kalman_scalar(stream, "u", "k", "v"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = {(r["u"], r["k"]): r["ema"] for r in spark.table("s_ema").collect()}
    assert got == pytest.approx({(1, 0): 1.0, (1, 1): 1.1, (1, 2): 1.29, (2, 0): 5.0})
    assert spark.table("s_kal").count() == 4
    assert series.rate_by_window(spark.createDataFrame([], "ts timestamp"), "ts").count() == 0


@pytest.mark.parametrize(("q", "r", "p0"), [(1e-2, 1.0, 1.0), (0.0, 2.0, 1.5), (0.5, 1e-3, 0.0), (0.0, 1.0, 0.0)])
def test_kalman_scalar_equals_a_loop(spark, q, r, p0):
    values = {1: [3.0], 2: [float((7 * k) % 11) for k in range(400)], 3: [None, 1.0, float("nan"), 2.0]}
    df = spark.createDataFrame([(u, k, v) for u, vs in values.items() for k, v in enumerate(vs)], "u long, k long, v double")
    got = {x["u"]: x for x in track.kalman_scalar(df, "u", ["k"], "v", q, r, p0).collect()}
    for u, vs in values.items():
        vs = [v for v in vs if v is not None and v == v]
        m, p = vs[0], p0
        for z in vs[1:]:
            gain = (p + q) / (p + q + r)
            m, p = m + gain * (z - m), (1 - gain) * (p + q)
        assert got[u]["n"] == len(vs)
        assert got[u]["m"] == pytest.approx(m, abs=1e-9)
        assert got[u]["p"] == pytest.approx(p, abs=1e-9)


def test_series_of_no_rows(spark):
    df = spark.createDataFrame([], "u long, k long, v double")
    assert track.kalman_scalar(df, "u", ["k"], "v").count() == track.ema(df, "u", ["k"], "v").count() == 0


def test_simulate_adapts_its_step(spark):
    b = spark.createDataFrame([(1, 0.2, 0.2, 0.1, 0.0), (2, 0.8, 0.8, 0.0, -0.2)], "id long, x double, y double, vx double, vy double")
    ticks = iter([0.0, 0.5, 1.0, 1.1])
    got = {r["id"]: (r["x"], r["y"]) for r in particles.simulate(b, 0.01, 0.01, 2, 0.1, lambda: next(ticks)).collect()}
    whole = 0.01 + (0.9 * 0.01 + 0.1 * 0.5)
    assert got[1] == pytest.approx((0.2 + 0.1 * whole, 0.2))
    assert got[2] == pytest.approx((0.8, 0.8 - 0.2 * whole))
