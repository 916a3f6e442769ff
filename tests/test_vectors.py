import math
import random

import pytest
from pyspark.sql import functions as F

import lexigrid
from lexigrid.functions import vectors


def test_cosine_edge_rules(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([1.0, 2.0], [2.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").withColumn("i", F.monotonically_increasing_id())
    got = [r[0] for r in df.orderBy("i").select(vectors.cosine_sim(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and math.isnan(got[2]) and math.isnan(got[3])
    assert got[4] is None and got[5] == pytest.approx(0.8)


def test_cosine_is_symmetric_bounded_and_one_on_itself(spark):
    rng = random.Random(3)
    rows = [([rng.uniform(-1, 1) for _ in range(8)], [rng.uniform(-1, 1) for _ in range(8)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    sim = vectors.cosine_sim
    for ab, ba, aa in df.select(sim(F.col("a"), F.col("b")), sim(F.col("b"), F.col("a")), sim(F.col("a"), F.col("a"))).collect():
        assert ab == pytest.approx(ba) and -1 - 1e-9 <= ab <= 1 + 1e-9 and aa == pytest.approx(1.0)


def test_sql_functions(spark):
    lexigrid.register(spark)
    row = spark.sql("""SELECT cosine_sim(array(3.0D, 4.0D), array(3.0D, 4.0D)) s, cosine_distance(array(1.0D, 0.0D), array(0.0D, 1.0D)) d,
        l2_normalize(array(3.0D, 4.0D)) u, l2_normalize(array(0.0D)) z, embed_dim('tri128') n, embed_dim('nope') x,
        token_count('a b  c') t, token_count(NULL) tn, strip_accents('Été') e, embed('tri64', NULL) v""").first()
    assert row.s == pytest.approx(1.0) and row.d == pytest.approx(1.0) and row.z == [0.0]
    assert row.u == pytest.approx([0.6, 0.8]) and (row.n, row.x, row.t, row.tn, row.e, row.v) == (128, None, 5, None, "Ete", None)


def test_unknown_model_is_an_error(spark):
    lexigrid.register(spark)
    with pytest.raises(Exception, match="unknown model"):
        spark.sql("SELECT embed('nope', 'x')").collect()


def test_mean_vector(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [7.0, 7.0])], "g string, vec array<float>")
    got = {r.g: r.vec for r in vectors.mean_vector(df, ["g"]).collect()}
    assert got == {"a": [2.0, 4.0], "b": [7.0, 7.0]}


def test_mean_vector_of_long_uneven_vectors(spark):
    """Parts of ``PART`` places: lengths that differ, missing numbers, empty and missing vectors."""
    long = [float(i) for i in range(70)]
    rows = [("a", long), ("a", [2.0, None]), ("a", None), ("a", []), ("b", []), ("c", None), (None, [1.0] * 33)]
    df = spark.createDataFrame(rows, "g string, vec array<float>")
    got = {r.g: (r.vec, r.n) for r in vectors.mean_vector(df, ["g"], count="n").collect()}
    assert got == {"a": ([1.0, *long[1:]], 3), None: ([1.0] * 33, 1)}
