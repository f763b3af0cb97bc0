from pyspark.sql import functions as F

from nearfold.operators import split
from nearfold.plans import sessions
from nearfold.plans.config import KnnConfig
from nearfold.streaming.scoring import Scorer, score_stream


def test_stream_scores_like_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7 + 30 * (i % 2)), float(i % 5)], i % 2 + 1) for i in range(60)], "id bigint, features array<double>, label int")
    r, s = split.by_condition(rows, F.col("id") % 6 == 0)
    config = KnnConfig(k=3, dimension=2, bits=20, partitions=2, max_shift=50, epsilon=0.1)
    queries = r.select("id", "features")
    for k in range(2):
        queries.filter(F.pmod(F.col("id"), F.lit(12)) == 6 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = score_stream(stream, s, config, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = sessions.run(queries, s, config)
    assert got.select("batch").distinct().count() == 2
    assert sorted((x.rid, x.predicted) for x in got.collect()) == sorted((x.rid, x.predicted) for x in want.collect())


def test_query_rows_beyond_the_training_set_have_true_distances(spark, tmp_path):
    s = spark.createDataFrame([(1, [10.0, 10.0], 1), (2, [14.0, 15.0], 2)], "id bigint, features array<double>, label int")
    config = KnnConfig(k=2, dimension=2, bits=20, partitions=2, max_shift=50, epsilon=0.1)
    batch = spark.createDataFrame([(7, [0.0, 15.0]), (8, [90.0, 15.0]), (9, None)], "id bigint, features array<double>")
    scorer = Scorer(s, config, str(tmp_path))
    want = {7: 1, 8: 2}  # squared 125 and 196; at the bound of S it would be 25 and 16
    for _ in range(2):
        assert {x.rid: x.predicted for x in scorer.predictions(batch).collect()} == want
    assert {x.rid: x.predicted for x in sessions.run(batch, s, config).collect()} == want
