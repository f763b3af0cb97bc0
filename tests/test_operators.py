import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions import prepare
from nearfold.operators import cells, knn, metrics, predict, ranges, split, tune
from nearfold.plans import sessions
from nearfold.plans.config import KnnConfig
from nearfold.sources import text


def points(spark, rows):
    return spark.createDataFrame(rows, "id bigint, coords array<bigint>")


def some(spark, n, d, seed, first=0):
    r = random.Random(seed)
    return points(spark, [(first + i, [r.randrange(200) for _ in range(d)]) for i in range(n)])


def test_repair(spark):
    df = spark.createDataFrame([("abc",), ("-9999",), ("NaN",), (None,), ("-9998.5",), (" 7 ",), ("Infinity",)], "v string")
    got = [r.x for r in df.select(prepare.repaired(F.trim("v")).alias("x")).collect()]
    assert got[:4] == [0, 0, 0, 0] and got[4:6] == [-9998.5, 7.0]


def test_quantize_cuts_towards_zero(spark):
    df = spark.createDataFrame([([0.29, -0.29, 1.99],)], "f array<double>")
    assert df.select(prepare.quantized(F.col("f")).alias("q")).first().q == [2, -2, 19]


def test_scaling_once_or_compounded(spark):
    df = spark.createDataFrame([([10.0],)], "f array<double>")
    assert df.select(prepare.scaled(F.col("f"), [29.0], 1)[0].alias("x")).first().x == 290
    assert df.select(prepare.scaled(F.col("f"), [29.0], 1, compound=True)[0].alias("x")).first().x == 8410


def test_shift_vectors_are_seeded():
    a = prepare.shift_vectors(3, 4, 5)
    assert a == prepare.shift_vectors(3, 4, 5) and a[0] == [0] * 4 and all(0 <= x <= 10000 for v in a for x in v)


def test_rates_and_ranks():
    assert ranges.sample_rate(27296, 0.003) == 1.0
    assert round(ranges.sample_rate(244169, 0.003), 3) == 0.455
    assert ranges.padding(15, 0.003, 244169) == 7
    assert [ranges.estimator_index(i, 100, 0.1, 8) for i in range(1, 9)] == [1, 3, 4, 5, 6, 8, 9, 10]
    assert min(ranges.estimator_index(i, 5, 0.2, 8) for i in range(1, 9)) == 1
    with pytest.raises(ValueError):
        ranges.sample_rate(0, 0.1)


def brute(r, s, k):
    return {rid: [(x[1], x[0]) for x in sorted((sum((a - b) ** 2 for a, b in zip(p, q)), sid) for sid, q in s)[:k]] for rid, p in r}


def test_exact_with_ties(spark):
    r, s = [(1, [0, 0]), (2, [5, 5])], [(10, [1, 0]), (11, [0, 1]), (12, [-1, 0]), (13, [5, 6])]
    got = {}
    for e in knn.exact_knn(points(spark, r), points(spark, s), 2, 2).orderBy("rid", "rank").collect():
        got.setdefault(e.rid, []).append((e.sid, e.d2))
    assert got == brute(r, s, 2)


@pytest.mark.parametrize("curve", ["z", "gray", "hilbert"])
def test_cuts_do_not_change_the_join(spark, curve):
    r, s = some(spark, 60, 3, 1), some(spark, 300, 3, 2, 1000)
    vectors = prepare.shift_vectors(2, 3, 3, 100)
    whole, cut = (knn.approximate_knn(r, s, 4, vectors, 3, 9, curve, p) for p in (None, 7))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


@pytest.mark.parametrize("spread", [3, 40, 10**8])
def test_exact_neighbours_over_many_cells(spark, monkeypatch, spread):
    """Copies of points, far rows of R, more visitors than a cell's rows are dealt to, ids of two kinds: as by force."""
    for name, size in (("CELL_ROWS", 16), ("VISITS", 20), ("PAIRS", 64)):
        monkeypatch.setattr(cells, name, size)
    rnd = random.Random(spread)
    at = lambda: [rnd.randint(-spread, spread) for _ in range(3)]
    r = [(i, at()) for i in range(120)] + [(200 + i, [spread * 2, 0, -spread]) for i in range(30)]
    s = [(f"s{i}", at()) for i in range(500)] + [(f"t{i}", [1, 1, 1]) for i in range(60)]
    found = knn.exact_knn(spark.createDataFrame(r, "id int, coords array<bigint>"), spark.createDataFrame(s, "id string, coords array<bigint>"), 5, 3)
    want = [(i, j, d, n + 1) for i, a in r for n, (d, j) in enumerate(sorted((sum((x - y) ** 2 for x, y in zip(a, b)), j) for j, b in s)[:5])]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_exact_neighbours_never_list_all_pairs(spark, monkeypatch):
    """What is kept for each row of R doesn't grow with S, and neither does the number of cells that it visits."""
    monkeypatch.setattr(cells, "CELL_ROWS", 64)
    rnd = random.Random(5)
    rows = [(i, [rnd.randint(0, 10**6) for _ in range(2)]) for i in range(6300)]
    r, s = (spark.createDataFrame(x, "id int, coords array<bigint>") for x in (rows[:300], rows[300:]))
    found = knn.exact_knn(r, s, 3, 2)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    tree = cells.Tree(np.array([c for _, c in rows[300:]]), 3, 64)
    at, bound = np.array([c for _, c in rows[:300]]), np.array([x.d2 for x in found.filter("rank = 3").orderBy("rid").collect()])
    assert tree.cells > 100 and len(tree.within(at, bound)[0]) < 3 * 300


def test_recall_grows_with_shifts_and_k_of_all_is_exact(spark):
    r, s = some(spark, 40, 2, 1), some(spark, 120, 2, 2, 1000)
    truth = knn.exact_knn(r, s, 3, 2)
    vectors = prepare.shift_vectors(4, 2, 3, 300)
    got = [knn.recall(knn.approximate_knn(r, s, 3, vectors[:m], 2, 10), truth).first().recall for m in (1, 2, 4)]
    assert got == sorted(got) and got[-1] > 0.8
    every = knn.approximate_knn(r, s, 120, vectors[:1], 2, 10)
    assert every.count() == 40 * 120


def test_wide_codes_join_alike(spark):
    r, s = some(spark, 30, 2, 1), some(spark, 90, 2, 2, 1000)
    narrow, wide = (knn.approximate_knn(r, s, 3, [[0, 0]], 2, bits, partitions=p) for bits, p in ((10, None), (40, 5)))
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, wide.collect()))


def vote(spark, d2, labels, k=3):
    edges = spark.createDataFrame([(1, i, d, i + 1) for i, d in enumerate(d2)], "rid bigint, sid bigint, d2 bigint, rank int")
    s = spark.createDataFrame(list(enumerate(labels)), "id bigint, label int")
    return predict.classify(edges, s, [1, 2]).first()


def test_votes(spark):
    equal = vote(spark, [4, 4, 4], [1, 1, 2])
    assert equal.predicted == 1 and equal.p_1 == pytest.approx(2 / 3, abs=1e-6)
    weighted = vote(spark, [0, 1, 4], [1, 2, 2])
    assert weighted.predicted == 1 and weighted.p_1 == pytest.approx(2 / 3, abs=1e-6)
    assert vote(spark, [4, 4], [2, 1]).predicted == 1
    assert vote(spark, [9], [2]).n_neighbors == 1


def test_regression_mean(spark):
    edges = spark.createDataFrame([(1, i, 1, i) for i in range(3)], "rid bigint, sid bigint, d2 bigint, rank int")
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "id bigint, value double")
    assert predict.regress(edges, s).first().predicted == 2.0


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, 2, 2), (2, 2, 1), (3, 1, 2), (4, 1, 1)], "id bigint, predicted int, real int")
    assert metrics.accuracy(pairs).first().accuracy == 50.0
    f = metrics.f_measure(pairs).first()
    assert (f.precision, f.recall, f.f_measure) == (0.5, 0.5, 0.5)
    none = metrics.f_measure(pairs.withColumn("predicted", F.lit(1)).withColumn("real", F.lit(1))).first()
    assert none.precision is None
    values = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 2.0), (3, 3.0, 5.0)], "id bigint, predicted double, real double")
    assert metrics.rmse(values).first().rmse == pytest.approx((5 / 3) ** 0.5, abs=1e-6)
    assert metrics.rmse(values, exclude_zero=True).first().rmse == pytest.approx(2**0.5, abs=1e-6)
    truth = values.select("id", F.col("real").alias("value"))
    assert metrics.r_squared(values, truth, "value").first().r_squared == pytest.approx(1 - 5 / (38 / 3), abs=1e-5)


def test_folds_and_splits(spark):
    rows = spark.range(10)
    folded = split.with_fold(rows, ["id"], 3)
    assert [folded.filter(F.col("fold") == k).count() for k in range(3)] == [3, 3, 3]
    r, s = split.fold_pair(folded, 0)
    assert r.count() == 3 and s.count() == 7
    r, s = split.positional(rows, ["id"])
    assert [x.id for x in r.collect()] == [9] and s.count() == 9
    nulls = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, c boolean")
    r, s = split.by_condition(nulls, F.col("c"))
    assert [x.id for x in r.collect()] == [2] and sorted(x.id for x in s.collect()) == [1, 3]
    dated = spark.createDataFrame([("M0000000001-2014-06-16",), ("short",)], "id string").select(split.id_date(F.col("id")).alias("d")).collect()
    assert str(dated[0].d) == "2014-06-16" and dated[1].d is None


def test_numbering_is_the_same_for_any_parts(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)] + [(5, 500), (None, 501)], "a int, b int")
    got = [sorted((r.b, r.rn, r.n) for r in split.numbered(rows, ["a", "b"], p).collect()) for p in (1, 7, 50)]
    assert got[0] == got[1] == got[2]


def test_split_by_time_reads_only_columns_that_are_there(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    for part in split.positional(events, ["ts", "event_id"]):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("!")]  # so Spark marks what misses a column
    r, s = (p.agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n")).first() for p in split.positional(events, ["ts", "event_id"]))
    assert s.n == events.count() * 9 // 10 and r.n + s.n == events.count() and s.high <= r.low


def test_range_routing_covers_each_row_once(spark):
    s = some(spark, 200, 2, 9)
    coded = knn.coded(s, [[0, 0], [3, 5]], 2, 10)
    bounds = ranges.range_bounds(coded, [50, 100, 150, 200])
    assert ranges.route(coded, bounds).count() == coded.count()
    wide = ranges.padded_bounds(bounds, coded, 5)
    assert ranges.route(coded, wide).count() > coded.count()


def test_samples(spark):
    rows = spark.range(2000).withColumn("src", (F.col("id") % 2).cast("int"))
    drawn = ranges.bernoulli(rows, {0: 0.0, 1: 0.5}, "src", 3)
    assert drawn.filter("src = 0").count() == 0 and 400 < drawn.count() < 600
    assert 150 < ranges.hash_sample(rows, "id", 0.1).count() < 250


def test_tuner():
    search = tune.Search(population=12, generations=15, seed=3)
    domain = (9, 9, 9, 9, 9, 9, 30)
    best, value, history = tune.genetic(lambda g: -sum((x - 4) ** 2 for x in g[:6]) - (g[6] - 20) ** 2, domain, search)
    assert history == sorted(history) and value >= history[0]
    low, least, falling = tune.genetic(lambda g: sum(g), domain, replace(search, larger_is_better=False))
    assert falling == sorted(falling, reverse=True)
    r = random.Random(1)
    elite = (1, 2, 3, 4)
    for _ in range(50):
        child = tune.mutate(elite, (5,) * 4, 1, r)
        assert elite == (1, 2, 3, 4) and sum(abs(a - b) for a, b in zip(child, elite)) <= 1
        assert all(x in (1, 9) for x in tune.crossover((1,) * 4, (9,) * 4, r))


def test_text_sources(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    with open(path, "w") as f:
        f.write("id,a,b,value,class\nx1,1,oops,2.5,1.6\nx2,-9999,NaN,,2\nx3,3\n")
    rows = {r.id: r for r in text.read_rows(spark, path, 2, 2, 3).collect()}
    assert rows["x1"].features == [1.0, 0.0] and rows["x1"].label == 2 and rows["x1"].value == 2.5
    assert rows["x2"].features == [0.0, 0.0] and rows["x2"].value == 0.0
    assert rows["x3"].features == [3.0, 0.0]
    vectors = prepare.shift_vectors(3, 4, 5)
    text.write_shifts(spark, vectors, str(tmp_path / "shifts"))
    assert text.read_shifts(spark, str(tmp_path / "shifts")) == vectors
    bounds = spark.createDataFrame([(0, 0, None, 5), (0, 1, 5, None)], "shift int, pid int, low bigint, high bigint")
    text.write_ranges(bounds, str(tmp_path / "ranges"))
    assert sorted(map(str, text.read_ranges(spark, str(tmp_path / "ranges")).collect())) == sorted(map(str, bounds.collect()))
    lines = text.regression_lines(spark.createDataFrame([(1, 2.5)], "rid bigint, predicted double"), spark.createDataFrame([(1, 3.0)], "id bigint, value double"))
    text.write_lines(lines, str(tmp_path / "lines"), files=1)
    back = text.read_results(spark, str(tmp_path / "lines")).first()
    assert (back.rid, back.real, back.predicted) == ("1", 3.0, 2.5)


def test_cross_validation_and_sessions(spark, tmp_path):
    r = random.Random(4)
    rows = spark.createDataFrame([(i, [float(r.randint(0, 9) + 20 * (i % 2)), float(r.randint(0, 9))], i % 2 + 1) for i in range(40)], "id bigint, features array<double>, label int")
    config = KnnConfig(k=3, dimension=2, bits=20, partitions=2, folds=4, max_shift=50)
    scores = sessions.cross_validate(rows, ["id"], config).collect()
    assert [s.accuracy for s in scores] == [100.0] * 4
    q, s = split.by_condition(rows, F.col("id") % 5 == 0)
    sessions.phase1(q, s, config, str(tmp_path))
    sessions.phase2(spark, config, str(tmp_path))
    three = sessions.phase3(spark, config, str(tmp_path))
    assert sorted(map(tuple, three.collect())) == sorted(map(tuple, sessions.run(q, s, config).collect()))


def test_settings_are_checked():
    for wrong in ({"epsilon": 0}, {"scale_domain": (1,)}, {"curve": "peano"}, {"k": 0}, {"task": "rank"}, {"scale": (1.0,)}):
        with pytest.raises(ValueError):
            KnnConfig(**wrong)


def test_top_k_is_cut_before_the_shuffle(spark):
    edges = some(spark, 5, 2, 1).select(F.col("id").alias("rid"), F.col("id").alias("sid"), F.col("id").alias("d2"))
    plan = knn.nearest(edges, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("curve", ["z", "hilbert"])
def test_incomplete_points_are_near_nothing(spark, curve):
    r, s = [(1, [5, 5]), (2, None), (3, [1, None])], [(10, [1, 1]), (11, [9, 9]), (12, None), (13, [None, 5]), (14, [5, 5, 5]), (15, [])]
    for found in (knn.exact_knn(points(spark, r), points(spark, s), 5, 2), knn.approximate_knn(points(spark, r), points(spark, s), 5, [[0, 0], [3, 1]], 2, 6, curve, 3)):
        assert sorted((e.rid, e.sid) for e in found.collect()) == [(1, 10), (1, 11)]
    empty = points(spark, [])
    assert knn.approximate_knn(empty, points(spark, s), 2, [[0, 0]], 2, 6, curve, 3).count() == 0
    assert knn.approximate_knn(points(spark, r), empty, 2, [[0, 0], [1, 1]], 2, 6, curve, 3).count() == 0


def test_coordinates_beyond_the_bits(spark):
    far = knn.coded(points(spark, [(1, [99, 3]), (2, [15, 3]), (3, [-7, 2]), (4, [0, 2])]), [[0, 0]], 2, 4)
    z = {r.id: r.z for r in far.collect()}
    assert z[1] == z[2] and z[3] == z[4]
    rows = spark.createDataFrame([(i, [float(i), 0.0], 1) for i in range(30)], "id bigint, features array<double>, label int")
    config = KnnConfig(k=2, dimension=2, bits=8, shifts=1, partitions=2, epsilon=0.1)
    with pytest.raises(ValueError):
        sessions.run(rows, rows, config)
    assert sessions.run(rows, rows, replace(config, bits=9)).count() == 30
    with pytest.raises(ValueError):
        sessions.run(rows, rows, replace(config, bits=9, shifts=2, max_shift=300))


def test_sampled_cuts_do_not_change_the_join(spark):
    r, s = some(spark, 50, 2, 1), some(spark, 400, 2, 2, 1000)
    whole, cut = (knn.approximate_knn(r, s, 4, [[0, 0], [31, 7]], 2, 9, "z", p, e) for p, e in ((1, None), (6, 0.1)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    both = knn.coded(s.withColumn("is_r", F.col("id") % 3 == 0), [[0, 0]], 2, 9)
    bounds = ranges.sampled_bounds(both, 6, 0.1).first().bounds
    assert bounds == sorted(bounds) and 3 <= len(bounds) <= 5


def test_padding_by_force(spark):
    r, s = some(spark, 60, 2, 4), some(spark, 150, 2, 5, 1000)
    cr, cs = (knn.coded(x, [[0, 0], [9, 40]], 2, 9) for x in (r, s))
    bounds = ranges.range_bounds(cr, [20, 40, 60])
    codes = {k: sorted(x.z for x in cs.filter(F.col("shift") == k).collect()) for k in (0, 1)}

    def moved(shift, code, reach):
        at = next((i for i, z in enumerate(codes[shift]) if code is not None and z >= code), None)
        return None if at is None or not 0 <= at + reach < len(codes[shift]) else codes[shift][at + reach]

    want = sorted(str((b.shift, b.pid, moved(b.shift, b.low, -7), moved(b.shift, b.high, 7))) for b in bounds.collect())
    assert sorted(str(tuple(b)) for b in ranges.padded_bounds(bounds, cs, 7).collect()) == want


def test_partitions_hold_one_range_in_order(spark):
    coded = knn.coded(some(spark, 300, 2, 9), [[0, 0], [3, 5]], 2, 10)
    laid = ranges.partitioned(ranges.route(coded, ranges.range_bounds(coded, [75, 150, 225, 300])), 4).select("shift", "pid", "z", F.spark_partition_id().alias("p")).collect()
    assert all(len({x.p for x in laid if (x.shift, x.pid) == key}) == 1 for key in {(x.shift, x.pid) for x in laid})
    assert all((a.shift, a.pid, a.z) <= (b.shift, b.pid, b.z) for a, b in zip(laid, laid[1:]) if a.p == b.p)


def test_numbering_by_text(spark, monkeypatch):
    monkeypatch.setattr(split, "SAMPLE", 20)
    rows = spark.createDataFrame([(f"M{i * 37 % 101}", i) for i in range(101)] + [("M5", 500), (None, 501), ("", 502)], "a string, b int")
    placed = split.numbered(rows, ["a", "b"], 8)
    want = {b: k + 1 for k, (_, b) in enumerate(sorted(((a is not None, a or ""), b) for a, b in [(r.a, r.b) for r in rows.collect()]))}
    assert {r.b: r.rn for r in placed.collect()} == want
    assert split.numbered(rows.limit(0), ["a", "b"]).count() == 0


def test_ragged_rows_keep_all_features(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0], 1.0, 1), ("b", [1.0, 2.0], 1.0, 1), ("c", None, 1.0, 2)], "id string, features array<double>, value double, label int")
    text.write_rows(rows, str(tmp_path / "rows"))
    back = {r.id: r.features for r in text.read_rows(spark, str(tmp_path / "rows"), 2, 2, 3).collect()}
    assert back == {"a": [1.0, 0.0], "b": [1.0, 2.0], "c": [0.0, 0.0]}
    text.write_rows(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.csv(str(tmp_path / "none"), header=True, schema="id string").count() == 0


def test_tuning_finds_the_feature_that_tells(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(i, [float(i % 2), float(r.randint(0, 30))], i % 2 + 1) for i in range(40)], "id bigint, features array<double>, label int")
    config = KnnConfig(k=3, dimension=2, bits=20, partitions=2, folds=2, shifts=1, epsilon=0.2, scale_domain=(400, 1))
    best, score, history = sessions.tuned(rows, ["id"], config, tune.Search(population=3, generations=1, seed=1))
    assert score == 100.0 and len(best.scale) == 2 and history[0] <= score


def test_tables_need_a_shared_folder():
    from nearfold.sources import tables

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        tables.shared_dir(Cluster())


def test_released_tables_are_gone(spark):
    from nearfold.sources import tables

    kept = tables.materialize(spark.range(5))
    path = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 5 and os.path.exists(path)
    tables.release(kept)
    assert not os.path.exists(path)
