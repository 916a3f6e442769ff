import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.functions import text
from lexigrid.operators import encode


def _col(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_strip_accents(spark):
    got = _col(spark, ["München", "São Paulo", "Shqipërisë", "ét", "ø ł", "plain", None], text.strip_accents)
    assert got == ["Munchen", "Sao Paulo", "Shqiperise", "et", "ø ł", "plain", None]


def test_python_normaliser_agrees(spark):
    values = ["Ünï", "ABC", "é", "Straße", "ÅÄÖ"]
    assert _col(spark, values, text.normalize_term) == [text.text_normalizer()(v) for v in values]


def test_replace_first(spark):
    values = ["cy_2022_tco2e", "a_2021_b_2022", "2020", "x_2019", "none", "y_1850_z"]
    got = _col(spark, values, lambda s: text.replace_first(s, text.YEAR_TOKEN, "_YYYY_"))
    assert got == ["cy_YYYY_tco2e", "a_YYYY_b_2022", "_YYYY_", "x_YYYY_", "none", "y_1850_z"]


def test_name_variants(spark):
    got = _col(spark, ["City of St Ives", "Carrick-on-Shannon", "Mt. Ida"], text.name_variants)
    assert got[0] == ["city of st ives", "st ives", "saint ives"]
    assert got[1] == ["carrick-on-shannon", "carrick on shannon"]
    assert got[2] == ["mt. ida", "mount ida"]


def test_token_count(spark):
    assert _col(spark, ["a b", "", " x ", None], text.token_count) == [4, 2, 3, None]


def _by_hand(s, dim):
    out = np.zeros(dim)
    p = f" {s} "
    for i in range(len(p) - 2):
        out[int(hashlib.md5(p[i:i + 3].encode()).hexdigest()[:8], 16) % dim] += 1
    return out


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_ngrams_by_hand(texts):
    got = encode.HashedNgrams("t", 32).raw(texts)
    assert got.shape == (len(texts), 32)
    for row, s in zip(got, texts):
        assert (row == _by_hand(s, 32)).all()


def test_long_batches_are_cut(monkeypatch):
    texts = ["abc def"] * 20 + ["x" * 50]
    whole = encode.DEFAULT.raw(texts)
    monkeypatch.setattr(encode, "CHARS_PER_CHUNK", 10)
    assert (encode.DEFAULT.raw(texts) == whole).all()


def test_embed_null_and_length(spark):
    df = spark.createDataFrame([("Été",), (None,), ("",), ("ete",)], "s string").withColumn("i", F.monotonically_increasing_id())
    rows = encode.encode(df, "s").orderBy("i").collect()
    assert rows[1].vec is None and set(rows[2].vec) == {0.0} and rows[0].vec == rows[3].vec
    assert math.isclose(sum(x * x for x in rows[0].vec), 1.0, rel_tol=1e-6)


def test_pluggable_encoder(spark):
    class Length:
        name, dim = "length", 2

        def raw(self, texts):
            return np.array([[len(t), 1.0] for t in texts]).reshape(-1, 2)

    df = spark.createDataFrame([("aaaa",)], "s string")
    assert encode.encode(df, "s", Length()).first().vec == pytest.approx([4 / 17 ** 0.5, 1 / 17 ** 0.5])


@pytest.mark.parametrize("n,c", [(0, 4), (3, 4), (4, 4), (5, 4), (6, 4), (7, 4), (20, 4), (20, 5), (9, 1)])
def test_window_count(spark, n, c):
    starts = spark.range(1).select(encode.window_starts(F.lit(n), c)).first()[0]
    want, offset, stride = [], 0, max(c // 2, 1)
    while True:  # windows until one reaches the end of the text
        want.append(offset)
        if offset + c >= n:
            break
        offset += stride
    assert starts == want
    assert len(starts) == (1 if n <= c else math.ceil((n - c) / stride) + 1)


def test_encoding_windows_is_the_mean(spark):
    s = " ".join(f"w{i}" for i in range(11))
    df = spark.createDataFrame([(1, s), (2, None)], "k int, s string")
    got = {r.k: r.vec for r in encode.encode(df, "s", n_ctx=4).collect()}
    wins = [r.window_text for r in encode.text_windows(df.where("k = 1"), ["k"], "s", 4).orderBy("window_no").collect()]
    assert len(wins) == 5 and got[2] is None
    assert got[1] == pytest.approx(list(encode.unit_rows(encode.DEFAULT.raw(wins).mean(axis=0, keepdims=True))[0]))


def test_packing(spark):
    rng = random.Random(1)
    rows = [(s, i * 1000, rng.choice([1, 3, 5, 9, 40, 0])) for s in ("a", "b", None) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, i int, n int")
    for shard in (["s"], []):
        frame = df if shard else df.where("s = 'a'")
        got = {(r.s if shard else "a", r.i): r.bin_no for r in encode.pack_texts(frame, shard, "i", "n", 12).collect()}
        assert len(got) == frame.count()
        for s in ("a", "b", None) if shard else ("a",):
            bin_no, used = -1, 0
            for _, i, n in sorted(r for r in rows if r[0] == s):
                if bin_no < 0 or used + n > 12:
                    bin_no, used = bin_no + 1, 0
                used += n
                assert got[(s, i)] == bin_no


def test_sparse_ids_share_a_bin(spark):
    df = spark.range(0, 20000, 1000).withColumn("n", F.lit(10))
    assert {r.bin_no for r in encode.pack_texts(df, [], "id", "n", 2048).collect()} == {0}
    assert encode.pack_texts(df.limit(0), [], "id", "n", 2048).count() == 0



def test_models(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    got = {r.model: len(r.vec) for r in encode.encode_models(df, "s", list(encode.DEFAULT_ENCODERS.values())).collect()}
    assert got == {r.model_name: r.model_dim for r in encode.model_table(spark, list(encode.DEFAULT_ENCODERS.values())).collect()}


def test_texts_of_a_batch_are_encoded_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(encode, "CHARS_PER_CHUNK", 10)
    lists = pa.array([["abcd", "ef"], ["ghi"], [], ["x" * 30], ["a"], ["b"]])
    assert [part.to_pylist() for part in encode._slices(lists)] == [[["abcd", "ef"], ["ghi"], []], [["x" * 30]], [["a"], ["b"]]]
    encoders = list(encode.DEFAULT_ENCODERS.values())
    few = encode._encoded(pa.array([["abcd", "ef"], None, [], ["xyz" * 9], ["a"]]), encoders)
    monkeypatch.undo()
    assert [x.to_pylist() for x in few] == [x.to_pylist() for x in encode._encoded(pa.array([["abcd", "ef"], None, [], ["xyz" * 9], ["a"]]), encoders)]
    plan = encode.encode_models(spark.createDataFrame([("a",)], "s string"), "s", encoders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # one worker for all encoders
