import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridweave.functions import scalar as S
from gridweave.operators import escape, index, neighbor, reduce, regions
from gridweave.sources import arrays, generators

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def pixels(spark, image):
    rows = [(int(i), int(j), float(image[i, j])) for i in range(image.shape[0]) for j in range(image.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, v float")


@FEW
@given(h=st.integers(1, 9), w=st.integers(1, 9), n=st.integers(1, 4), tile=st.integers(4, 5), seed=st.integers(0, 99))
def test_median_equals_numpy(spark, h, w, n, tile, seed):
    image = np.random.default_rng(seed).random((h, w)).astype(np.float32)
    got = arrays.to_dense(neighbor.median_3x3(pixels(spark, image), n, tile, passes_per_shuffle=2))
    assert (got.astype(np.float32) == neighbor.numpy_median(image, n)).all()


def test_median_stripe_gives_every_step_th_row(spark):
    image = np.arange(35, dtype=np.float32).reshape(7, 5)
    got = neighbor.median_3x3(pixels(spark, image), offset=1, step=3).select("i").distinct().toPandas()
    assert sorted(got["i"]) == [1, 4]


def test_halo_must_fit_a_tile(spark):
    with pytest.raises(ValueError):
        neighbor.with_halo(pixels(spark, np.zeros((1, 1))), 2, 3)


def flood(v, connectivity):
    h, w = v.shape
    label = np.where(v > 0, np.arange(h * w).reshape(h, w), h * w)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    changed = True
    while changed:
        changed = False
        for y in range(h):
            for x in range(w):
                for dy, dx in steps:
                    a, b = y + dy, x + dx
                    if v[y, x] > 0 and 0 <= a < h and 0 <= b < w and v[a, b] > 0 and label[a, b] < label[y, x]:
                        label[y, x] = label[a, b]
                        changed = True
    return label


@FEW
@given(h=st.integers(1, 9), w=st.integers(1, 9), connectivity=st.sampled_from([4, 8]), tile=st.integers(2, 4), seed=st.integers(0, 99))
def test_regions_equal_flood_fill(spark, h, w, connectivity, tile, seed):
    v = (np.random.default_rng(seed).random((h, w)) < 0.6).astype(np.float32)
    maze = pixels(spark, v).select(F.col("j").alias("x"), F.col("i").alias("y"), "v")
    got = regions.label_regions(maze, w, h, connectivity, tile).select(F.col("y").alias("i"), F.col("x").alias("j"), "label")
    assert (arrays.to_dense(got, "label") == flood(v, connectivity)).all()


def test_small_maze_has_two_regions(spark):
    v = np.array([[1, 1, 0, 1], [1, 0, 0, 1], [0, 1, 1, 1]], dtype=np.float32)
    maze = pixels(spark, v).select(F.col("j").alias("x"), F.col("i").alias("y"), "v")
    assert reduce.count_labels(regions.label_regions(maze, 4, 3), F.lit(12)).first()[0] == 2


def test_escape_borders(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, None, 0.0), (3, 0.3, 0.5)], "id int, re double, im double").coalesce(1)
    for form in ("arrow", "expression"):
        v1 = [r[0] for r in rows.orderBy("id").select(escape.escape_time(F.col("re"), F.col("im"), 1, 511, form)).collect()]
        v2 = [r[0] for r in rows.orderBy("id").select(escape.escape_time(F.col("re"), F.col("im"), 2, 100, form)).collect()]
        assert v1[:3] == [511, 0, None] and v2[0] == 99 and v2[1] == 2 and v2[2] is None


def test_escape_forms_agree(spark):
    grid = generators.coords(spark, -0.5 + 0j, 3.0, 24)
    for version in (1, 2):
        a, b = (escape.escape_time(F.col("re"), F.col("im"), version, 40, f) for f in ("arrow", "expression"))
        assert grid.select(a.alias("a"), b.alias("b")).where("a <> b").isEmpty()


def test_coords_span_the_square(spark):
    got = generators.coords(spark, 1 + 2j, 4.0, 5).agg(F.min("re"), F.max("re"), F.min("im"), F.max("im"), F.count("*")).first()
    assert tuple(got) == (-1.0, 3.0, 0.0, 4.0, 25)


def test_partition_sums_keep_empty_partitions(spark):
    from itertools import chain

    parts = [[], [2], [], [4]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(parts)), 4).flatMap(lambda x: [(v,) for v in x[1]]), "v long")
    assert [r["total"] for r in reduce.sum_physical_partitions(df).orderBy("part").collect()] == [0, 2, 0, 4]
    rows = spark.createDataFrame([(k, v) for k, p in enumerate(parts) for v in p], "p int, v long")
    assert [r["total"] for r in reduce.sum_partitions(rows, F.col("p"), 4, F.col("v")).orderBy("part").collect()] == [0, 2, 0, 4]
    assert list(chain(*parts)) == [2, 4]


def test_all_sums_agree(spark):
    v = generators.uniform(spark, 1000, 3).cache()
    for parts in (reduce.sum_strided(v, 7), reduce.sum_blocked(v, 7, 1000), reduce.sum_tree(v), reduce.sum_tree(v, 3, levels=2)):
        assert reduce.relative_error(parts, v) < 1e-9


def test_index_by_numbers_in_order(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k")).repartition(7)
    got = index.index_by(df, "k").orderBy("k").collect()
    assert [r["idx"] for r in got] == list(range(100))
    assert index.with_index(spark.range(0)).count() == 0


def test_arrays_and_series_are_read(spark, tmp_path):
    image = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.savez(tmp_path / "a.npz", image=image)
    np.save(tmp_path / "m.npy", image.astype(np.int32))
    got = arrays.read_array(spark, str(tmp_path / "a.npz"), "image")
    assert (arrays.to_dense(got) == image).all()
    assert (arrays.to_dense(arrays.read_array(spark, str(tmp_path / "m.npy"), kind="int")) == image).all()
    assert (arrays.to_dense(arrays.subsample(got)) == image[::2, ::2]).all()
    assert (arrays.to_dense(arrays.crop(got, 1, 3, 1, 3)) == image[1:3, 1:3]).all()
    assert np.allclose(arrays.draw_counts(got), np.log1p(image))
    assert arrays.write_pgm(image).startswith(b"P5 4 3 255\n")
    (tmp_path / "t.txt").write_text("1, 2\n3 ,4\n5,6\n")
    rows = arrays.read_series(spark, str(tmp_path / "t.txt"), ["a", "b"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)]


def test_clamped_fetch_at_the_edges(spark):
    image = np.arange(6, dtype=np.float32).reshape(2, 3)
    got = arrays.to_dense(neighbor.fetch_clamped(pixels(spark, image), -1, 1, 2, 3), "near")
    assert (got == [[1, 2, 2], [1, 2, 2]]).all()


def test_small_scalars(spark):
    got = spark.range(1).select(S.ceil_div(9, 8), S.round_up(9, 8), S.wrap(F.lit(-3), 10), S.masked_sqrt(F.lit(9.0)), S.masked_sqrt(F.lit(4.0)), S.z_order(F.lit(3), F.lit(1)), S.log_intensity(F.lit(0), False)).first()
    assert tuple(got) == (2, 16, 7, 0.0, 2.0, 7, None)


def test_best_and_scatter_settle_ties(spark):
    t = spark.createDataFrame([("b", 1, 2.0), ("a", 9, 2.0), ("c", 1, 3.0)], "kind string, g int, seconds double")
    assert tuple(reduce.best(t).first()) == ("a", 9, 2.0)
    p = spark.createDataFrame([(0, 5, 1), (0, 7, 1), (0, 9, 0)], "c int, id int, o int")
    assert [tuple(r) for r in reduce.scatter(p, ["c"], "id", "o").collect()] == [(0, 7)]


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    import random

    from gridweave.operators import graph

    rng = random.Random(4)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(None, 1)]
    df = spark.createDataFrame(links, "a long, b long")
    few = {tuple(r) for r in graph.components(df).collect()}
    monkeypatch.setattr(graph, "FEW", 10)
    assert {tuple(r) for r in graph.components(df).collect()} == few and (1100, 1000) in few
    assert graph.components(df.limit(0)).count() == 0


def test_null_and_nan_pixels_are_background(spark):
    from gridweave.operators import regions

    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (2, 0, float("nan")), (3, 0, 2.0), (0, 1, 1.0)], "x int, y int, v double")
    assert {(r["x"], r["y"]): r["label"] for r in regions.label_regions(df, 4).collect()} == {(0, 0): 0, (1, 0): 8, (2, 0): 8, (3, 0): 3, (0, 1): 0}
