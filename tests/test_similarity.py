import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import ann, components, similarity
from lexigrid.plans import all_queries

DIM = 8


def _unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


@pytest.fixture(scope="module")
def data():
    """300 rows; two thirds in one group; clustered, with exact copies and a zero vector."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, DIM))
    m = (middle[rng.integers(0, 6, 300)] + 0.4 * rng.normal(size=(300, DIM))).astype(np.float32)
    m[40:60] = m[40]
    m[99] = 0
    groups = ["hot" if i % 3 else f"g{i % 7}" for i in range(300)]
    return groups, m


@pytest.fixture(scope="module")
def df(spark, data):
    groups, m = data
    return spark.createDataFrame([(i, g, [float(x) for x in v]) for i, (g, v) in enumerate(zip(*data))],
                                 "id int, g string, vec array<float>").cache()


@pytest.fixture(scope="module")
def sims(data):
    u = _unit(data[1].astype(np.float64))
    return np.round(u @ u.T, similarity.DIGITS)


@pytest.mark.parametrize("rows_per_block", [1000, 32])
@pytest.mark.parametrize("grouped", [False, True])
def test_pairs_above(df, data, sims, rows_per_block, grouped):
    groups, m = data
    got = {tuple(r) for r in similarity.pairs_above(df, "id", 0.9, ["g"] if grouped else None, rows_per_block=rows_per_block)
           .select("key_a", "key_b", "n_a", "n_b").collect()}
    # copies are one entry per group: expand them again and compare with all pairs
    rep = {}
    for i in range(300):
        rep.setdefault(((groups[i] if grouped else ""), m[i].tobytes()), []).append(i)
    by_rep = {v[0]: v for v in rep.values()}
    expanded = set()
    for a, b, n_a, n_b in got:
        assert len(by_rep[a]) == n_a and len(by_rep[b]) == n_b
        pairs = itertools.combinations(by_rep[a], 2) if a == b else itertools.product(by_rep[a], by_rep[b])
        expanded |= {tuple(sorted(p)) for p in pairs}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300)
            if sims[i, j] >= 0.9 and (not grouped or groups[i] == groups[j])}
    assert expanded == want


@pytest.mark.parametrize("rows_per_block", [1000, 32])
@pytest.mark.parametrize("at_least", [None, 0.8])
def test_best_neighbour(df, data, sims, rows_per_block, at_least):
    groups, _ = data
    got = {(r.id, r["rank"]): (r.neighbour, r.score) for r in similarity.best_neighbour(
        df, "id", ["g"], at_least=at_least, rows_per_block=rows_per_block, k=2).collect()}
    want = {}
    for i in range(300):
        others = sorted((-sims[i, j], j) for j in range(300) if j != i and groups[i] == groups[j]
                        and (at_least is None or sims[i, j] >= at_least))
        for rank, (s, j) in enumerate(others[:2], 1):
            want[(i, rank)] = (j, pytest.approx(-s))
    assert got == want


@pytest.mark.parametrize("rows_per_block", [1000, 32])
@pytest.mark.parametrize("n", [250, 50])
def test_top_pairs(df, sims, rows_per_block, n):
    # the copies tie at 1.0 in 190 pairs
    got = [(r.key_a, r.key_b) for r in similarity.top_pairs(df, "id", n, rows_per_block=rows_per_block).collect()]
    want = sorted((-sims[i, j], i, j) for i in range(300) for j in range(i + 1, 300))[:n]
    assert got == [(i, j) for _, i, j in want]


def _brute_components(sims, groups, threshold):
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(300):
        for j in range(i + 1, 300):
            if sims[i, j] >= threshold and groups[i] == groups[j]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(300)]
    return {i: r for i, r in enumerate(roots) if roots.count(r) > 1}


@pytest.mark.parametrize("rows_per_block", [1000, 32])
def test_components_equal_union_find(df, data, sims, rows_per_block):
    found = similarity.links(df, "id", 0.85, ["g"], rows_per_block=rows_per_block)
    # links never outgrow the rows that each task holds
    got = {r.node: r.component for r in components.connected_components(found).collect()}
    assert got == _brute_components(sims, data[0], 0.85)


def test_similar_components_in_groups(df, data, sims):
    got = {r.id: r.cluster_id for r in components.similar_components(df, "id", 0.85, ["g"]).collect()}
    # ids are compared as text when groups prefix them, so only the partition is compared
    want = _brute_components(sims, data[0], 0.85)
    parts = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    assert parts(got) == parts(want)


def test_long_chain_settles(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    comps = components.connected_components(edges)
    assert comps.select("component").distinct().count() == 1 and comps.count() == 201


def test_star_keeps_lone_rows(spark):
    df = spark.createDataFrame([("t1", "a", [1.0, 0.0]), ("t1", "b", [1.0, 0.1]), ("t2", "x", [1.0, 0.0])],
                               "t string, c string, vec array<float>")
    got = {(r.t, r.c): r.cluster_id for r in components.star_clusters(df, "c", 0.65, ["t"]).collect()}
    assert got == {("t1", "a"): "a", ("t1", "b"): "a", ("t2", "x"): "x"}


@pytest.mark.parametrize("bound", [50_000, 10])
def test_nearest_both_ways(df, sims, data, monkeypatch, bound):
    monkeypatch.setattr(similarity, "SMALL_MATRIX_ROWS", bound)
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", 64)
    groups, _ = data
    corpus = df.select(F.col("id").alias("cid"), "g", "vec", (F.col("id") * 2).alias("twice"))
    for group in ([], ["g"]):
        got = {}
        src = corpus if group else corpus.drop("g")
        for r in similarity.nearest(df, src, 3, ["id"], "cid", corpus_cols=["twice"], group=group).collect():
            got[(r.id, r["rank"])] = (r.cid, r.twice)
        want = {}
        for i in range(300):
            best = sorted((-sims[i, j], j) for j in range(300) if not group or groups[i] == groups[j])[:3]
            want.update({(i, n): (j, 2 * j) for n, (_, j) in enumerate(best, 1)})
        assert got == want


@pytest.mark.parametrize("bound", [50_000, 5])
def test_search_both_ways(df, sims, monkeypatch, bound):
    monkeypatch.setattr(similarity, "SMALL_MATRIX_ROWS", bound)
    probes = df.where("id < 7").select(F.col("id").alias("pid"), "vec")
    got = {(r.pid, r["rank"]): r.id for r in similarity.search(df, probes, 4, "pid", "id").collect()}
    want = {(i, n): j for i in range(7) for n, (_, j) in enumerate(sorted((-sims[i, j], j) for j in range(300))[:4], 1)}
    assert got == want


def test_mean_similarity_is_the_pair_mean(df, data):
    groups, m = data
    u = _unit(m.astype(np.float64))
    got = {r.id: r.avg_sim for r in similarity.mean_similarity(df, ["id"], ["g"]).collect()}
    for i in range(300):
        mine = [j for j in range(300) if groups[j] == groups[i] and j != i]
        assert got[i] == pytest.approx(float(np.mean(u[mine] @ u[i])), abs=2e-6)


def test_mean_similarity_of_a_lone_row_is_null(spark):
    df = spark.createDataFrame([("a", 1, [1.0])], "g string, id int, vec array<float>")
    assert similarity.mean_similarity(df, ["id"], ["g"]).first().avg_sim is None


def test_join_groups_spreads_a_large_side(spark, df, monkeypatch):
    rows = df.select("id", "g")
    per_group = rows.groupBy("g").agg(F.count("*").alias("n")).where("g <> 'g1'")
    want = sorted(tuple(r) for r in rows.join(per_group, "g", "left").select("g", "id", "n").collect())
    monkeypatch.setattr(similarity, "fits", lambda side: False)
    assert sorted(tuple(r) for r in similarity.join_groups(rows, per_group, ["g"], "left").select("g", "id", "n").collect()) == want


def test_cells_prune_what_cannot_match(df):
    wide = similarity._pair_tasks(df, "id", "vec", [], None, 16).count()
    tight = similarity._pair_tasks(df, "id", "vec", [], 0.97, 16).count()
    assert tight < wide


def test_ann_recall(df, sims):
    probes = df.select(F.col("id").alias("pid"), "vec")
    found = ann.cell_search(df.select("id", "vec"), probes, 5, "pid", "id", n_cells=12, n_look=4).collect()
    hit = sum(r.id in {j for _, j in sorted((-sims[r.pid, j], j) for j in range(300))[:5]} for r in found)
    assert hit / 1500 > 0.8


def _shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_size_of_the_corpus_changes_no_answer(spark, monkeypatch):
    """Repeated and NULL keys, groups, ties: the same rows whether the corpus is broadcast or cut into blocks."""
    corpus = spark.createDataFrame([("g1", "bank", "money", [1.0, 0.0]), ("g1", "bank", "river", [0.9, 0.1]), ("g2", "bank", "river", [0.0, 1.0]),
                                    ("g1", "tree", "wood", [0.0, 1.0]), ("g1", None, "none", [0.5, 0.5]), (None, "x", "y", [1.0, 1.0]), ("g1", "tie", "a", [1.0, 0.0])],
                                   "grp string, ck string, sense string, vec array<double>")
    probes = spark.createDataFrame([("g1", "p", [1.0, 0.1]), ("g1", "p", [0.0, 1.0]), ("g2", None, [1.0, 1.0]), ("g1", None, [0.4, 0.5]), (None, "q", [1.0, 0.0])],
                                   "grp string, pk string, vec array<double>")
    sides = (probes.drop("grp"), corpus.drop("grp"))

    def all_answers():
        return [_shown(similarity.nearest(*sides, k, ["pk"], "ck", corpus_cols=["sense"])) for k in (1, 3, 9)] + \
            [_shown(similarity.nearest(probes, corpus, k, ["pk"], "ck", corpus_cols=["sense"], group=["grp"])) for k in (1, 2)] + \
            [_shown(similarity.search(corpus.select("ck", "vec"), probes.select("pk", "vec"), k, "pk", "ck")) for k in (1, 3)]

    small = all_answers()
    monkeypatch.setattr(similarity, "SMALL_MATRIX_ROWS", 1)
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", 2)
    assert all_answers() == small
    assert len(small[0]) == 5 and len(small[1]) == 15 and len(small[3]) == 4


def test_vectors_of_one_column_have_one_length(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0])], "k int, vec array<double>")
    with pytest.raises(Exception, match="one length"):
        similarity.best_neighbour(df, "k").collect()


def test_components_in_groups_keep_numeric_keys_and_null_groups(spark):
    rows = [(g, k, [1.0, 0.0]) for g in ("a", None, "b\u0001c") for k in (9, 10, 100)] + [("a", 5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, k long, vec array<double>")
    got = {(r.g, r.k): r.cluster_id for r in components.similar_components(df, "k", 0.9, ["g"]).collect()}
    want = {(g, k): 9 for g in ("a", "b\u0001c") for k in (9, 10, 100)}
    assert {key: v for key, v in got.items() if key[0] is not None} == want


def test_cells_leave_out_the_probe_itself(spark):
    df = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(9)], "id long, vec array<double>")
    found = ann.cell_search(df, df.withColumnRenamed("id", "pid"), 3, "pid", "id", same_keys=True).collect()
    assert len(found) == 27 and all(r.pid != r.id for r in found)


def test_recall_of_ann_join_at_its_defaults(spark):
    """Against the exact neighbours, on vectors of the kind the query runs over and on more even ones."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    emb = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    probes = emb.withColumnRenamed("vec_id", "probe_id")
    exact = {(r.probe_id, r.vec_id) for r in similarity.nearest(probes, emb, 4, ["probe_id"], "vec_id")
             .where("probe_id <> vec_id").withColumn("n", F.expr("row_number() over (partition by probe_id order by score desc, vec_id)"))
             .where("n <= 3").collect()}
    found = [(r.probe_id, r.vec_id) for r in all_queries()["ann_join"](spark, folder).collect()]
    assert len(exact) == 3 * emb.count() and len(set(found)) == len(found)
    assert len(exact.intersection(found)) >= 0.9 * len(exact)


def test_looks_grow_with_the_number_of_cells(spark):
    """Vectors without any clusters: the share of cells searched must not fall as their number grows."""
    rng = np.random.default_rng(17)
    for rows in (300, 3000):
        x = rng.normal(size=(rows, 16))
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
        probes = df.where("id % 10 = 0").withColumnRenamed("id", "pid")
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        sims = np.round(u @ u.T, 6)
        np.fill_diagonal(sims, -2)
        found = ann.cell_search(df, probes, 5, "pid", "id", same_keys=True).collect()
        best = {i: set(np.argsort(-sims[i], kind="stable")[:5].tolist()) for i in range(0, rows, 10)}
        assert sum(r.id in best[r.pid] for r in found) >= 0.9 * 5 * len(best)


def test_certified_search_is_exact_and_reads_few_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8))
    rows = [(k, (centres[k % 20] + 0.05 * rng.normal(size=8)).tolist()) for k in range(600)] + [(600 + k, [0.0] * 8) for k in range(3)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    probes = df.where("id % 20 = 1 or id >= 600").withColumnRenamed("id", "pid")
    found = ann.certified_search(df, probes, 4, "pid", "id", n_cells=24, width=2, same_keys=True).collect()
    x = np.array([v for _, v in rows])
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    scores = np.round(x @ x.T, 6)
    want = {}
    for p in (r.pid for r in probes.collect()):
        order = sorted((k for k in range(len(rows)) if k != p), key=lambda k: (-scores[p, k], k))[:4]
        want[p] = [(k, float(scores[p, k])) for k in order]
    got = {}
    for r in sorted(found, key=lambda r: (r.pid, r.rank)):
        got.setdefault(r.pid, []).append((r.id, r.score))
    assert {p: [k for k, _ in v] for p, v in got.items()} == {p: [k for k, _ in v] for p, v in want.items()}
    assert all(abs(a - b) < 1e-6 for p in want for (_, a), (_, b) in zip(got[p], want[p]))
    assert np.mean([r.cells_read for r in found if r.pid < 600]) < 8
    assert ann.certified_search(df.limit(0), probes, 4, "pid", "id").count() == 0


def test_rows_are_sent_to_a_bounded_number_of_blocks(df, sims, monkeypatch):
    """However many rows a block could be cut into, a row meets a fixed number of blocks and nothing is lost."""
    sent = similarity._pair_tasks(df, "id", "vec", [], None, 4).count()
    assert sent <= 300 * (similarity.BLOCKS + similarity.PIVOTS)
    got = [(r.key_a, r.key_b) for r in similarity.top_pairs(df, "id", 250, rows_per_block=4).collect()]
    assert got == [(i, j) for _, i, j in sorted((-sims[i, j], i, j) for i in range(300) for j in range(i + 1, 300))[:250]]
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", 4)
    assert similarity._block_counts(df, [], "vec").first()["_nb"] <= similarity.CROSS_BLOCKS
    monkeypatch.setattr(similarity, "BLOCK_CELLS", 20 * len(df.first()["vec"]))
    assert similarity._block_counts(df, [], "vec").first()["_nb"] == 15


def test_best_neighbours_of_many_tiles_are_folded(df, sims, monkeypatch):
    defaults = similarity._in_tasks.__defaults__
    monkeypatch.setattr(similarity._in_tasks, "__defaults__", (*defaults[:-1], 10))
    got = {r.id: r.neighbour for r in similarity.best_neighbour(df, "id", rows_per_block=8).collect()}
    assert got == {i: min((-sims[i, j], j) for j in range(300) if j != i)[1] for i in range(300)}


def test_mean_similarity_keeps_no_vectors(df, monkeypatch):
    kept = []
    keep = similarity.keep
    monkeypatch.setattr(similarity, "keep", lambda x: kept.append(x.columns) or keep(x))
    assert similarity.mean_similarity(df, ["id"], ["g"]).count() == 300
    assert kept and not any("vec" in columns for columns in kept)


def test_certified_search_sends_probes_a_bounded_number_of_times(spark, monkeypatch):
    """Vectors without clusters, whose bounds rule out little: few looks by cell, the rest in blocks of cells, and still exact."""
    x = np.random.default_rng(8).normal(size=(400, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    looks, cross = [], similarity.cross_blocks
    monkeypatch.setattr(similarity, "cross_blocks", lambda probes, *a: looks.append(probes.count()) or cross(probes, *a))
    found = ann.certified_search(df, df.withColumnRenamed("id", "pid"), 3, "pid", "id", n_cells=50, width=2, same_keys=True).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(u @ u.T, 6)
    want = {(i, n): j for i in range(400) for n, j in enumerate(sorted((j for j in range(400) if j != i), key=lambda j: (-scores[i, j], j))[:3], 1)}
    assert {(r.pid, r["rank"]): r.id for r in found} == want
    assert sum(looks) <= 400 * 3 * 2 and max(r.cells_read for r in found) > 6


def test_certified_search_by_cells_and_by_blocks_gives_repeated_rows_alike(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(150, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] * 2, "id long, vec array<double>")
    ask = lambda: _shown(ann.certified_search(df, df.withColumnRenamed("id", "pid"), 3, "pid", "id", n_cells=40, width=2, same_keys=True).drop("cells_read"))
    blocks = ask()
    monkeypatch.setattr(similarity, "CROSS_BLOCKS", 1000)
    assert blocks == ask() and len(blocks) == 450


def test_top_pairs_leave_out_what_cannot_be_among_them(spark, monkeypatch):
    """Copies make a floor; the pairs compared are few, and ties, groups and rows of zeros come out as by brute force."""
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(400, 8))
    vectors[300:310], vectors[310], vectors[311] = vectors[:10], 0.0, vectors[0] * 3
    rows = [(i, "a" if i % 5 else "b", [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (1_000, "a", None)], "id long, g string, vec array<double>")
    unit = vectors / np.maximum(np.sqrt((vectors ** 2).sum(axis=1, keepdims=True)), 1e-300)
    scores = np.round(unit @ unit.T, 6)
    pairs = [(-scores[i, j], rows[i][1], i, j) for i in range(400) for j in range(i + 1, 400)]
    seen, scored = [], similarity._pair_tasks
    monkeypatch.setattr(similarity, "_pair_tasks", lambda *a: seen.append(scored(*a)) or seen[-1])
    for group, n in (([], 7), ([], 40), (["g"], 5)):
        want = sorted((s, *([g] if group else []), i, j) for s, g, i, j in pairs if not group or rows[i][1] == rows[j][1])[:n]
        got = [(-r.score, *[r[g] for g in group], r.key_a, r.key_b) for r in similarity.top_pairs(df, "id", n, group, rows_per_block=8).collect()]
        assert got == want
    met = seen[0].groupBy("_lo", "_hi").agg(F.count_if(F.col("_mine") == F.col("_lo")).alias("a"), F.count_if(F.col("_mine") == F.col("_hi")).alias("b"))
    assert met.agg(F.sum(F.expr("if(_lo = _hi, a * (a - 1) / 2, a * b)"))).first()[0] < 400 * 399 / 2


def test_tiles_left_out_hold_no_pair():
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.normal(size=(40, 6)), 20, axis=0) + rng.normal(size=(800, 6)) * 0.02
    unit = similarity._unit_rows(rows)
    at = rng.permutation(800)
    for lo, hi in ((at, at), (at[:500], at[500:])):
        met = similarity._near_tiles(rows, lo, hi, 16, similarity._angle_limit(0.999))
        covered = {(min(i, j), max(i, j)) for x, y, same in met for i in x.tolist() for j in y.tolist() if i != j}
        want = {(min(i, j), max(i, j)) for i in lo.tolist() for j in hi.tolist() if i != j and round(unit[i] @ unit[j], 6) >= 0.999}
        assert want <= covered and sum(len(x) * len(y) for x, y, _ in met) < len(lo) * len(hi) / 3


def test_best_in_tiles_is_exact_for_ties_and_zeros(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", 16)
    base = rng.integers(0, 3, (30, 8)).astype(np.float32)
    a, b = base[rng.integers(0, 30, 70)], np.concatenate([base[rng.integers(0, 30, 100)], rng.normal(size=(50, 8)).astype(np.float32)])
    a[3] = b[5] = 0
    b[7, 2] = np.nan  # hides its own scores only
    order = rng.permutation(len(b))
    raw = np.round(similarity._unit_rows(a) @ similarity._unit_rows(b).T, 6)
    ranked = [[j for j in np.lexsort((order, -row)).tolist() if not np.isnan(row[j])] for row in raw]
    for k in (1, 3, 40):
        r, c, v = similarity._best_in_tiles(a, b, order, k)
        for i in range(len(a)):
            assert c[r == i].tolist() == ranked[i][:k] and (v[r == i] == raw[i][ranked[i][:k]]).all()
