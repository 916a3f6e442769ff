import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import catalog, encode, evaluate, factoring, fuzzy, places, profile, ranking, sets
from lexigrid.sources import files, tables


@pytest.fixture(scope="module")
def columns(spark):
    months = [m for n, _, t in sets.ENUMERATIONS if n == "months_long" for m in t]
    rows = [("city", "lib", m.title(), "Number", None, i + 2, "9999-12-31") for i, m in enumerate(months)]
    rows += [("city", "lib", "branch", "Text", "Library branch", 1, "9999-12-31"), ("city", "lib", "old", "Text", "", 99, "2020-01-01"),
             ("city", "solo", "only", "Text", "", 1, "9999-12-31"), ("city", "tri", "q1_total", "Number", None, 1, "9999-12-31"),
             ("city", "tri", "NE", "Text", None, 2, "9999-12-31"), ("city", "tri", "zz", "Text", None, 3, "9999-12-31")]
    df = spark.createDataFrame(rows, "domain string, resource_id string, field_name string, data_type string, "
                                     "description string, ordinal_position int, tt_end string")
    return catalog.current(df)


def test_listed_columns(spark):
    got = catalog.listed_columns(spark, "date, customer ,bananas").orderBy("ordinal_position").collect()
    assert [tuple(r) for r in got] == [("date", 1), ("customer", 2), ("bananas", 3)]


def test_closed_versions_are_dropped(columns):
    assert columns.where("field_name = 'old'").count() == 0


def test_containment_by_strategy(spark, columns):
    known = sets.enumerations(spark)
    got = {}
    for s in sets.STRATEGIES:
        probes = sets.probe_terms(columns, catalog.TABLE, "field_name", s)
        for r in sets.containment(probes, known, catalog.TABLE).collect():
            got[(s, r.resource_id, r.domain_name)] = (r.containment, r.n_matches, r.n_terms)
    assert got[("whole", "lib", "months_long")] == (round(12 / 13, 6), 12, 13)
    assert ("whole", "tri", "quarters") not in got and got[("tokens", "tri", "quarters")] == (0.25, 1, 4)
    assert got[("whole", "tri", "compass")][1] == 1 and got[("whole", "tri", "us_states_abbrev")][1] == 1
    at_once = {(r.strategy, r.resource_id, r.domain_name): (r.containment, r.n_matches, r.n_terms)
               for r in sets.containment_by_strategy(columns, known, catalog.TABLE, "field_name").collect()}
    assert at_once == got


def test_stripping(spark, columns):
    known = sets.enumerations(spark)
    left = {r.field_name for r in sets.strip_matched(columns, known, "field_name").collect()}
    assert left == {"branch", "only", "q1_total", "zz"}
    names = {(r.field_name, r.n) for r in sets.unrecognised(columns, known, "field_name").collect()}
    assert names == {("branch", 1), ("only", 1), ("q1_total", 1), ("zz", 1)}


def test_best_level_is_null_without_match(spark):
    terms = spark.createDataFrame([("country", "ireland"), ("city", "ireland"), ("city", "paris")], "domain_name string, term string")
    vals = spark.createDataFrame([("Ireland",), ("Paris",), ("Nowhere",)], "v string")
    got = {r.v: (r.best_level, r.score) for r in sets.best_level(vals, "v", terms, places.LEVELS).collect()}
    assert got == {"Ireland": ("country", 1.0), "Paris": ("city", 1.0), "Nowhere": (None, 0.0)}


def test_packed_sets_hold_every_term(spark):
    known = sets.enumerations(spark)
    stored = sets.packed_store(known)
    sizes = {r.domain_name: r.n for r in stored.groupBy("domain_name").agg(F.sum("n_members").alias("n")).collect()}
    assert sizes == {r.domain_name: r.n for r in known.groupBy("domain_name").agg(F.count_distinct("term").alias("n")).collect()}
    over = sets.packed_overlap(stored.withColumnRenamed("domain_name", "p"), stored, "p").collect()
    assert {(r.p, r.domain_name): r.n_shared for r in over}[("months_long", "months_long")] == 12
    many = spark.range(300_000).select(F.lit("d").alias("domain_name"), F.col("id").cast("string").alias("term"))
    assert sets.packed_store(many).agg(F.sum("n_members")).first()[0] == 300_000


def test_insert_if_absent(spark):
    have = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in sets.insert_if_absent(have, new, ["k"]).collect()] == [("b", 2)]


def test_texts(columns):
    one = columns.where("resource_id = 'tri'")
    assert catalog.table_text(one, F.concat_ws(".", "domain", "resource_id")).first().table_text == \
        "city.tri: q1_total (Number), NE (Text), zz (Text)"
    notes = {r[0]: r[1] for r in columns.select("field_name", catalog.column_text(
        F.col("domain"), F.col("resource_id"), F.col("field_name"), F.col("description"))).collect()}
    assert notes["branch"] == "city.lib.branch (Library branch)" and notes["only"] == "city.solo.only" and notes["zz"] == "city.tri.zz"


def test_target_tables(columns):
    assert [(r.resource_id, r.n_cols, r.n_numeric, r.n_text) for r in catalog.target_tables(columns, 2, 20, 1).collect()] == [("lib", 13, 12, 1)]
    one = catalog.target_tables(columns, 1, 20, 2, sampled=True, seed=1).orderBy("rn").collect()
    assert one == catalog.target_tables(columns.repartition(7), 1, 20, 2, sampled=True, seed=1).orderBy("rn").collect()


def test_medium_types(spark):
    df = spark.createDataFrame([(k,) for k in [*catalog.MEDIUM_TYPES, "Weird"]], "t string")
    got = {r[0]: r[1] for r in df.select("t", catalog.medium_type(F.col("t"))).collect()}
    assert got["Weird"] == "other" and got["MultiLine"] == "geo" and got["Percent"] == "number" and len(got) == 18


def test_topic_overlap_finds_all(spark):
    rng = random.Random(2)
    topic_sets = {f"t{i:03d}": frozenset(rng.sample(range(12), rng.randint(1, 9))) for i in range(120)}
    topic_sets |= {f"u{i:03d}": frozenset(range(4)) for i in range(60)}  # one third are copies
    df = spark.createDataFrame([(k, f"w{x}") for k, s in topic_sets.items() for x in s], "t string, w string")
    reps = {}
    for k in sorted(topic_sets):
        reps.setdefault(topic_sets[k], []).append(k)
    for ratio in (0.3, 0.5, 0.8):
        got = {(r.table_a, r.table_b): (r.tables_a, r.tables_b, r.n_shared) for r in catalog.topic_overlap(df, "t", "w", ratio).collect()}
        want = {}
        for a, b in itertools.combinations(sorted(reps, key=lambda s: reps[s][0]), 2):
            if round(len(a & b) / len(a | b), 6) >= ratio:
                want[(reps[a][0], reps[b][0])] = (len(reps[a]), len(reps[b]), len(a & b))
        assert got == want


def test_path_texts(spark):
    df = spark.createDataFrame([("s", "d", "t", "a, b")], "server string, db string, tab string, cols string")
    got = {(r.level, r.text) for r in catalog.path_texts(df, ["server", "db", "tab"], "cols").collect()}
    assert got == {("server", "s"), ("db", "s.d"), ("tab", "s.d.t: a, b")}


def test_path_texts_keep_null_levels(spark):
    df = spark.createDataFrame([("s", None, "t", "a")], "server string, db string, tab string, cols string")
    got = {(r.level, r.text) for r in catalog.path_texts(df, ["server", "db", "tab"], "cols").collect()}
    assert got == {("server", "s"), ("db", "s."), ("tab", "s..t: a")}


def test_drift(spark):
    df = spark.createDataFrame([("a", 1, "x", 2), ("a", 2, "y", 1), ("a", 5, "x", 3), ("a", 5, "y", 4), ("b", 2, "x", 1)], "k string, n int, i string, c int")
    assert sorted(tuple(r) for r in catalog.drift(df, ["k"], "n", "i", "c").collect()) == [("a", 2, 0.0), ("a", 5, 0.8)]


def test_rows_of_top_groups(spark):
    df = spark.createDataFrame([(g, k) for g, n in (("a", 2), ("b", 3), ("c", 3), ("d", 1)) for k in range(n)], "g string, k int")
    assert {r.g for r in catalog.of_top_groups(df, ["g"], 2).collect()} == {"b", "c"}


def test_fixed_factors(spark):
    names = ["cy_2022_tco2e", "cy_2005_tco2e", "_2005_2022_change_tco2e", "sector", "fy_x"]
    f = factoring.fixed_factors(spark.createDataFrame([(n,) for n in names], "field_name string").withColumn("t", F.lit(1)))
    assert [tuple(r) for r in factoring.measure_years(f, ["t"]).collect()] == [(1, "tco2e", 2005, 2022, 2)]
    assert [tuple(r) for r in factoring.change_columns(f, ["t"]).collect()] == [(1, "tco2e", "2005 to 2022", "_2005_2022_change_tco2e")]
    assert {r.field_name for r in factoring.unmatched(f).collect()} == {"sector", "fy_x"}


def test_year_templates(spark):
    df = spark.createDataFrame([("t", n) for n in ["a_2020_x", "a_2021_x", "b_2020", "b_2020_2021", "plain"]], "t string, field_name string")
    f = factoring.temporal_factors(df)
    assert [tuple(r) for r in factoring.year_templates(f, ["t"]).collect()] == [("t", "a{year}x", 2, 2020, 2021, "2020, 2021")]
    assert tuple(factoring.temporal_counts(f, ["t"]).first()) == ("t", 4, 1, 2, 3)


def test_suffix_stems(spark):
    df = spark.createDataFrame([("t", n) for n in ["phone_1", "phone_2", "phone_3", "fax_1", "x"]], "t string, field_name string")
    assert [tuple(r) for r in factoring.suffix_stems(df, ["t"]).collect()] == [("t", "phone", 3, 1, 3)]


def test_unpivot_recipe(spark):
    vecs = {"date": [1, 0, 0, 0], "customer": [0, 1, 0, 0], "bananas": [0, 0, 1, 0], "apples": [0, 0, 1, .1], "kiwi": [0, 0, 1, .2], "mango": [0, 0, 1, .3]}
    cols = spark.createDataFrame([("t", k, [float(x) for x in v]) for k, v in vecs.items()], "t string, c string, vec array<float>")
    tax = spark.createDataFrame([("fruit", "food", [0.0, 0.0, 1.0, 0.1]), ("country", "region", [1.0, 1.0, 0.0, 0.0])],
                                "category string, hypernym string, vec array<float>")
    row = factoring.unpivot_recipe(cols, ["t"], "c", tax, 0.7).first()
    recipe = json.loads(row.unpivot_recipe)
    assert recipe["category_name"] == "fruit" and recipe["category_hypernym"] == "food" and 0.9 < recipe["confidence"] <= 1
    assert recipe["instance_columns"] == ["apples", "bananas", "kiwi", "mango"] and recipe["pivot_columns"] == ["customer", "date"]
    assert recipe["suggested_schema"] == ["customer", "date", "fruit", "quantity"]


def test_unpivot_years(spark):
    wide = spark.createDataFrame([("a", 1.0, 2.0)], "k string, cy_2020_qty double, cy_2021_qty double")
    got = [tuple(r) for r in factoring.unpivot_years(wide, ["k"], wide.columns[1:]).orderBy("year").collect()]
    assert got == [("a", "qty", 2020, 1.0), ("a", "qty", 2021, 2.0)]


def test_hierarchy_with_gaps(spark):
    co = spark.createDataFrame([("IE", "IRL", "Ireland", "EU", "1"), ("XX", "XXX", "Blank", "EU", "")], "iso string, iso3 string, country string, continent string, geonameid string")
    a1 = spark.createDataFrame([("IE.C", "Connacht", 2)], "code string, name string, geonameid int")
    a2 = spark.createDataFrame([("IE.C.L", "Leitrim", 3)], "code string, name string, geonameid int")
    pl = spark.createDataFrame([(4, "Carrick-on-Shannon", "PPL", "IE", "C", "L"), (5, "Nowhere", "PPL", "ZZ", None, None), (6, "Sligo", "PPL", "IE", "C", None)],
                               "geonameid int, place_name string, feature_code string, country_code string, admin1_code string, admin2_code string") \
        .withColumn("place_ascii", F.col("place_name"))
    full = places.hierarchy(pl, co, a1, a2)
    got = {r.geonameid: r.full_path for r in full.collect()}
    assert got == {4: "Ireland > Connacht > Leitrim > Carrick-on-Shannon", 5: None, 6: "Ireland > Connacht > Sligo"}
    assert tuple(places.coverage(full).first()) == (3, 2, 2, 1)
    alt = spark.createDataFrame([(1, "Éire"), (2, "Connaught"), (4, "Carrick"), (77, "Lost")], "geonameid int, alt_name string")
    levels = places.alt_levels(alt, co, a1, a2, pl)
    assert {(r.alt_name, r.level, r.source) for r in levels.collect()} == {("Éire", "country", "IE"), ("Connaught", "admin1", "IE.C"), ("Carrick", "city", "PPL")}
    terms = places.level_terms(co, a1, a2, pl, levels)
    assert {r.term for r in terms.where("domain_name = 'country'").collect()} == {"ireland", "ie", "irl", "eire", "blank", "xx", "xxx"}
    rows = spark.createDataFrame([("Sligo", "Connaught", "Eire"), ("City of Sligo", "?", "Ireland"), ("Sligoo", "?", "?")], "name string, sub string, country string")
    flags = places.match_flags(rows, {"city_match": ("name", "city"), "country_match": ("country", "country"), "admin1_match": ("sub", "admin1")}, terms)
    stats = places.match_stats(flags, ["city_match", "country_match", "admin1_match"]).first()
    assert (stats.n_rows, stats.n_city_match, stats.n_country_match, stats.n_admin1_match, stats.n_all, stats.n_any, stats.n_none) == (3, 1, 2, 1, 1, 2, 1)
    assert stats.pct_country_match == 66.7
    lv = {(r.column_name, r.level): r.containment for r in places.column_levels(rows, {"c": "country", "n": "name"}, terms).collect()}
    assert lv[("c", "country")] == 0.667 and lv[("n", "city")] == 0.333 and lv[("n", "country")] == 0.0
    found = {r.name: (r.pass_no, r.geonameid, r.band) for r in places.resolve(rows, "name", F.lit("Ireland > Connacht"), full).collect()}
    assert found["Sligo"] == (1, 6, "exact") and found["City of Sligo"] == (2, 6, "very strong") and found["Sligoo"][:2] == (3, 6)
    texts = {r.geonameid: r.text for r in places.place_texts(co, a1, a2, full).collect()}
    assert texts[3] == "Ireland > Connacht > Leitrim" and texts[2] == "Ireland > Connacht" and 5 not in texts


def test_homonyms_and_alternate_names(spark):
    pl = spark.createDataFrame([(1, "Paris", "France > Paris"), (2, "Paris", "USA > Texas > Paris"), (3, "Paris", "USA > Ohio > Paris"), (4, "Lyon", "France > Lyon"),
                                (5, "Lost", None)], "geonameid int, place_name string, full_path string")
    alt = spark.createDataFrame([(1, "Lutetia"), (2, "Little Lutetia"), (99, "Nowhere")], "geonameid int, alt_name string")
    rows = spark.createDataFrame([("Paris", "USA"), ("Paris", "USA > Ohio"), ("PARIS", "France"), ("Paris", "Spain"), ("Lutetia", "France"), ("City of Lyon", "France"),
                                  ("Lyyon", "France"), ("Xyz", "Spain")], "name string, at string")
    found = {(r.name, r.context): (r.pass_no, r.geonameid, r.confidence, r.n_candidates) for r in
             places.resolve(rows, "name", F.col("at"), pl, alt_names=alt).collect()}
    assert found[("Paris", "USA")] == (1, 2, 1.0, 2) and found[("Paris", "USA > Ohio")] == (1, 3, 1.0, 1)
    assert found[("PARIS", "France")] == (1, 1, 1.0, 1) and found[("Paris", "Spain")] == (1, 1, 0.8, 3)
    assert found[("Lutetia", "France")] == (1, 1, 1.0, 1) and found[("City of Lyon", "France")] == (2, 4, 0.95, 1)
    assert found[("Lyyon", "France")][:2] == (3, 4)
    # no place is in Spain: the nearest of all, with what a match elsewhere keeps of its confidence
    number, place, sure, n = found[("Xyz", "Spain")]
    assert number == 4 and place in (1, 2, 3, 4) and 0 <= sure <= places.ELSEWHERE and n == 1


def test_every_name_asked_gets_a_row(spark):
    pl = spark.createDataFrame([(1, "Paris", "France > Paris"), (4, "Lyon", "France > Lyon")], "geonameid int, place_name string, full_path string")
    rows = spark.createDataFrame([("Paris", None), ("Lyyon", None), ("Lyyon", "Frnce"), (None, "France"), (None, None), ("Paris", "France"), ("Paris", "France")],
                                 "name string, at string")
    found = {(r.name, r.context): (r.pass_no, r.geonameid, r.band) for r in places.resolve(rows, "name", F.col("at"), pl).collect()}
    assert len(found) == rows.distinct().count() == places.resolve(rows, "name", F.col("at"), pl).count()
    assert found[("Paris", None)][:2] == (1, 1) and found[("Lyyon", None)][:2] == (4, 4) and found[("Lyyon", "Frnce")][:2] == (4, 4)
    assert found[(None, "France")] == found[(None, None)] == (None, None, "unresolved")
    nowhere = places.resolve(rows, "name", F.col("at"), pl.limit(0)).collect()
    assert len(nowhere) == 6 and all(r.band == "unresolved" for r in nowhere)


def test_evaluation_keeps_symbols_apart_by_domain(spark):
    sym = spark.createDataFrame([("m", "x", "may", [1.0, 0.1]), ("m", "y", "may", [1.0, 0.1]), ("m", "y", "june", [0.0, 1.0])],
                                "model string, true_domain string, symbol string, vec array<float>")
    dom = spark.createDataFrame([("m", "x", [1.0, 0.0]), ("m", "y", [0.0, 1.0]), ("other", "z", [1.0, 0.1, 0.0])],
                                "model string, predicted_domain string, vec array<float>")
    m = evaluate.predictions(sym, dom, 2)
    assert m.count() == 6
    acc = evaluate.accuracy(m).first()
    assert (acc.total, acc.top1_correct, acc.topk_correct) == (3, 2, 3)
    assert [tuple(r)[:4] for r in evaluate.misclassified(m).collect()] == [("m", "y", "may", "x")]
    assert {(r.true_domain, r.m_correct, r.out_of) for r in evaluate.domain_accuracy(m, ["m"]).collect()} == {("x", 1, 1), ("y", 1, 2)}
    assert evaluate.score_gap(m).first().avg_gap > 0


def test_spread_is_exact(spark):
    vals = [round(i * 0.001, 6) for i in range(101)] * 3
    df = spark.createDataFrame([("m", v) for v in vals], "g string, v double")
    assert tuple(evaluate.spread(df, ["g"], "v").first()) == ("m", 0.0, 0.01, 0.025, 0.05, 0.075, 0.1)


def test_table_profile(spark):
    rows = [("d", "t", "dimension", "string", "a", 0.9)] * 3 + [("d", "t", "dimension", "number", x, 0.9) for x in "bcd"] + \
        [("d", "t", "measure_candidate", "geo", "z", 0.9), ("d", "t", "measure_candidate", "date", "low", 0.1)]
    df = spark.createDataFrame(rows, "domain string, resource_id string, role string, medium_type string, topic string, topic_score double")
    r = profile.table_profile(df).first()
    assert (r.n_dim, r.n_meas, r.n_string, r.n_number, r.n_date, r.n_geo, r.n_bool) == (6, 2, 3, 3, 1, 1, 0)
    assert (r.dim_topics, r.meas_topics) == ("a, b, c", "z")


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"))
    for fn in (lambda d: ranking.stratified_sample(d, ["g"], ["id"], 4), lambda d: ranking.sample_rows(d, ["id"], 9)):
        assert sorted(fn(df).collect()) == sorted(fn(df.repartition(11)).collect())


# ---------------------------------------------------------------- sources and sinks


def test_tsv_csv_and_cities(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('# no note\tx\ty\t1\nIE.C\tConn"acht\tConnacht\t7\n')
    got = [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "a.tsv"), files.ADMIN_SCHEMA).collect()]
    assert got == [("# no note", "x", "y", 1), ("IE.C", 'Conn"acht', "Connacht", 7)]
    assert files.read_tsv(spark, str(tmp_path / "a.tsv"), files.ADMIN_SCHEMA, comment="#").count() == 1
    (tmp_path / "c.csv").write_text('name,country,geonameid\n"Foo, Bar",Ireland,5\n')
    assert tuple(files.read_csv(spark, str(tmp_path / "c.csv")).first()) == ("Foo, Bar", "Ireland", 5)
    row = {str(i): "x" for i in range(19)} | {"0": "9", "1": "Paris", "4": "48.8", "5": "2.3", "6": "P", "14": "2000000"}
    small, other = row | {"14": "10"}, row | {"6": "H"}
    spark.createDataFrame([row, small, other]).write.parquet(str(tmp_path / "cities"))
    got = files.read_cities(spark, str(tmp_path / "cities")).collect()
    assert [(r.geonameid, r.name, r.latitude, r.population) for r in got] == [(9, "Paris", 48.8, 2000000)]


def test_documents(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"categories": [
        {"synset_id": "s1", "category": "fruit", "hypernym": "food", "depth": 3, "gloss": "ripe"}, {"category": "x", "depth": 1}]}))
    got = files.read_taxonomy(spark, str(tmp_path / "t.json")).collect()
    assert tuple(got[0]) == ("s1", "fruit", "food", 3, "ripe") and got[1].gloss is None
    (tmp_path / "d.json").write_text(json.dumps({"domains": [{"domain_name": "c", "domain_label": "country", "source": "w", "member_count": 2,
        "members": [{"label": "Austria", "alt_labels": ["at", "Republic of Austria"]}, {"label": "Aruba"}]}]}))
    rows = files.read_domains(spark, str(tmp_path / "d.json"))
    assert [(r.label, r.alt_label) for r in rows.collect()] == [("Austria", "at"), ("Austria", "Republic of Austria"), ("Aruba", None)]
    assert {r.term for r in files.domain_terms(rows).collect()} == {"austria", "at", "republic of austria", "aruba"}


def test_bindings(spark):
    cases = [{"label": {"value": "Gold"}, "symbol": {"value": "Au"}, "altLabels": {"value": " aurum , , gold"}},
             {"label": {"value": "Euro"}, "code": {"value": "EUR"}, "symbol": {"value": "EUR"}}, {"label": {"value": "None"}}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(cases)], "i int, b string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(files.members_from_bindings(F.col("b"))).collect()]
    assert got == [("Gold", ["Au", "aurum", "gold"]), ("Euro", ["EUR"]), ("None", [])]


def test_vector_store(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "PPL", "a"), (1, 1, "PPL", "a"), (1, 2, "PPL", "a"), (2, 1, "PPL", "b")],
                               "geonameid int, model_id int, feature_code string, feature_name string")
    stored = tables.write_store(encode.encode(df, "feature_name"), str(tmp_path / "store"))
    assert stored.count() == 3 and {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()} == {"model_id=1", "model_id=2"}
    back = stored.withColumn("vec", tables.unpack(F.col("embedding_b64"), 64)).where("geonameid = 2").first()
    assert back.vec == encode.encode(df, "feature_name").where("geonameid = 2").first().vec
    with pytest.raises(Exception, match="65 numbers"):
        stored.select(tables.unpack(F.col("embedding_b64"), 65)).collect()


def test_append_and_backfill(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    tables.append_if_absent(spark.createDataFrame([("a", 5), ("b", 2)], "k string, v int"), path, ["k"])
    got = spark.read.parquet(path)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("b", 2)]
    assert sorted(r.w for r in tables.backfill(got, "w", F.upper("k")).collect()) == ["A", "B"]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_terms_misses_no_pair(spark):
    draw = random.Random(5)
    terms = {"".join(draw.choice("abc") for _ in range(n)) for n in [1, 2, 3, 4, 5, 6, 8, 12, 20, 22, 23, 24, 25, 26, 27, 30, 45] for _ in range(4)}
    asked = {"", "ab", "zzzzzz"}
    for term in sorted(terms):
        for edits in (0, 1, 2, 3):
            name = term
            for _ in range(edits):
                at = draw.randrange(len(name) + 1)
                name = name[:at] + draw.choice(["", "a", "ab"]) + name[at + draw.choice([0, 1]):]
            asked.add(name)
    known = spark.createDataFrame([("g", x) for x in sorted(terms)] + [("h", "zzzzzz"), (None, "ab"), ("g", None)], "g string, term string")
    rows = spark.createDataFrame([("g", x) for x in sorted(asked)] * 2 + [("g", None), (None, "ab"), ("other", "ab")], "g string, name string")
    got = {(r["g"], r["name"]): (r["term"], r["distance"], r["n_terms"]) for r in fuzzy.nearest_terms(rows, "name", known, "term", ["g"]).collect()}
    want = {}
    for name in asked:
        reach = 0 if len(name) < 3 else 1 if len(name) < 6 else 2
        near = sorted((_edits(name, x), x) for x in terms if _edits(name, x) <= reach)
        if near:
            want["g", name] = (near[0][1], near[0][0], sum(d == near[0][0] for d, _ in near))
    assert got == want
    assert fuzzy.nearest_terms(rows, "name", known.limit(0), "term", ["g"]).count() == 0
    assert fuzzy.nearest_terms(rows.limit(0), "name", known, "term", ["g"]).count() == 0


def test_levels_are_looked_up_inside_the_one_above(spark):
    co = spark.createDataFrame([("1", "Freedonia", "FRE", "X", "10"), ("2", "Sylvania", "SYL", "X", "20")],
                               "iso string, country string, iso3 string, continent string, geonameid string")
    a1 = spark.createDataFrame([("1.a", "North", 11), ("2.a", "North", 21)], "code string, name string, geonameid long")
    a2 = spark.createDataFrame([("2.a.x", "Lakes", 22)], "code string, name string, geonameid long")
    ci = spark.createDataFrame([(100, "Springfield", "1", "a", None), (200, "Springfield", "2", "a", "x"), (201, "Somewhere", "9", None, None)],
                               "geonameid long, place_name string, country_code string, admin1_code string, admin2_code string")
    rows = spark.createDataFrame([("Sylvannia", "Nroth", "Lakes", "Sprngfield"), ("Freedonia", "North", None, "SPRINGFIELD"), ("nowhere", None, None, "springfeld"),
                                  ("Freedonia", "South", "Lakes", "springfield"), (None, None, None, None), ("Freedonia", None, None, "Somewhere"),
                                  (None, None, None, "Somewhere"), ("Freedonia", "North", None, "SPRINGFIELD")],
                                 "country string, admin1 string, admin2 string, city string")
    got = places.resolve_levels(rows, {lv: lv for lv in places.LEVELS}, places.units(co, a1, a2, ci)).collect()
    ids = {(r["country"], r["admin1"], r["city"]): [r[f"{lv}_id"] for lv in places.LEVELS] for r in got}
    assert len(got) == 7
    assert ids == {("Sylvannia", "Nroth", "Sprngfield"): [20, None, 22, 200], ("Freedonia", "North", "SPRINGFIELD"): [10, 11, None, 100],
                   ("nowhere", None, "springfeld"): [None, None, None, 100], ("Freedonia", "South", "springfield"): [10, None, None, 100],
                   (None, None, None): [None] * 4, ("Freedonia", None, "Somewhere"): [10, None, None, None], (None, None, "Somewhere"): [None, None, None, 201]}


def test_recipes_are_read_and_applied(spark):
    good = json.dumps({"category_name": "year", "instance_columns": ["y1", "y2", "y2", "gone"], "pivot_columns": ["who"]})
    bad = [None, "no json", "{}", json.dumps({"category_name": "x", "instance_columns": []}), json.dumps({"instance_columns": ["y1"]})]
    recipes = spark.createDataFrame([("t", "c0", good)] + [("t", f"b{i}", b) for i, b in enumerate(bad)] + [("unused", "c0", good)],
                                    "tab string, cluster_id string, unpivot_recipe string")
    read = factoring.read_recipes(recipes, ["tab"])
    assert {r["cluster_id"]: r["problem"] for r in read.collect() if r["tab"] == "t"} == {
        "c0": None, "b0": "no recipe", "b1": "not a recipe", "b2": "not a recipe", "b3": "no instance columns", "b4": "no category"}
    wide = spark.createDataFrame([("t", 1, '{"y1": 5, "y2": "five", "who": "me", "other": 1}'), ("t", 2, '{"y1": null, "who": [1, 2]}'), ("t", 3, "{}"),
                                  ("t", 4, None), ("no recipe", 5, '{"y1": 5}'), ("t", 1, '{"y1": 5, "y2": "five", "who": "me", "other": 1}')],
                                 "tab string, row long, cells string").withColumn("cells", F.parse_json("cells"))
    long = factoring.apply_recipes(wide, read, ["tab"], ["row"])
    got = sorted((r["row"], r["category"], r["instance"], r["kind"], r["q"], r["who"]) for r in long.select(
        "*", F.schema_of_variant("quantity").alias("kind"), F.coalesce(F.col("quantity").cast("string"), F.lit("-")).alias("q"),
        F.to_json(F.col("pivots")["who"]).alias("who")).collect())
    assert got == [(1, "year", "y1", "BIGINT", "5", '"me"')] * 2 + [(1, "year", "y2", "STRING", "five", '"me"')] * 2 + [(2, "year", "y1", "VOID", "-", "[1,2]")]
    assert factoring.apply_recipes(wide.limit(0), read, ["tab"], ["row"]).count() == 0
    assert factoring.apply_recipes(wide, read.limit(0), ["tab"], ["row"]).count() == 0


def test_topic_overlap_of_random_sets(spark):
    draw = random.Random(11)
    tables = {}
    for i in range(150):
        topics = set(draw.sample(range(60), draw.randrange(1, 40)))
        tables[f"t{i:03}a"] = topics
        tables[f"t{i:03}b"] = {draw.randrange(60) if draw.random() < 0.06 else x for x in topics}
    df = spark.createDataFrame([(k, f"w{x}") for k, xs in tables.items() for x in xs], "t string, w string")
    names = {}
    for k in sorted(tables):
        names.setdefault(frozenset(tables[k]), k)
    for ratio in (0.5, 0.8, 1.0):
        want = {(a, b) for x, a in names.items() for y, b in names.items() if a < b and round(len(x & y) / len(x | y), 6) >= ratio}
        got = [(r.table_a, r.table_b) for r in catalog.topic_overlap(df, "t", "w", ratio).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_topic_overlap_makes_few_candidates(spark):
    """Sets out of few common topics: what meets by a key is near the number of answers, not the number of pairs."""
    draw = random.Random(2)
    df = spark.createDataFrame([(f"t{i}", f"w{x}") for i in range(600) for x in draw.sample(range(100), 30)], "t string, w string")
    found = catalog.topic_overlap(df, "t", "w", 0.8)
    assert found.count() == 0
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Join Inner") == 1  # candidates are compared where they meet
    assert "strategy=merge" in joined


def test_keys_of_names_are_made_once_for_all_groups(spark, monkeypatch):
    keyed, seen, plans, cut = fuzzy._keyed, [], [], fuzzy.cut_lineage
    monkeypatch.setattr(fuzzy, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    monkeypatch.setattr(fuzzy, "_keyed", lambda rows, *a: seen.append((rows.columns, rows.count())) or keyed(rows, *a))
    known = spark.createDataFrame([(g, t) for g in range(9) for t in ("springfield", "shelbyville")], "g long, term string")
    rows = spark.createDataFrame([(g, t) for g in range(9) for t in ("sprinfield", "shelbyvlle")], "g long, name string")
    got = fuzzy.nearest_terms(rows, "name", known, "term", ["g"]).collect()
    assert len(got) == 18 and {(r["name"], r["term"], r["distance"]) for r in got} == {("sprinfield", "springfield", 1), ("shelbyvlle", "shelbyville", 1)}
    assert all("g" not in columns and n <= 2 for columns, n in seen)
    # keys are many times their texts, which the planner does not see: no side of their join may be broadcast
    assert all("strategy=merge" in p for p in plans if "Generate" in p) and any("Generate" in p for p in plans)


def test_a_name_of_one_token_is_one_row(spark):
    cols = spark.createDataFrame([("d", 1, x) for x in ("may", "x_may", "_", "", None, "MAY")], "domain string, resource_id long, field_name string")
    known = sets.enumerations(spark)
    for least in (0, 1, 4):
        got = {(r["strategy"], r["domain_name"]): (r["n_matches"], r["n_terms"]) for r in sets.containment_by_strategy(
            cols, known, catalog.TABLE, "field_name", least).collect()}
        want = {(s, r["domain_name"]): (r["n_matches"], r["n_terms"]) for s in sets.STRATEGIES
                for r in sets.containment(sets.probe_terms(cols, catalog.TABLE, "field_name", s, least), known, catalog.TABLE).collect()}
        assert got == want


def test_topic_overlap_of_common_topics_meets_in_blocks(spark, monkeypatch):
    """Large sets out of few topics agree on parts by chance: by keys, hundreds of partners met each set here."""
    draw = random.Random(7)
    tables = {f"t{i:04}": {x for x in range(i % 3 * 20, i % 3 * 20 + 24) if draw.random() < 0.9} for i in range(900)}
    df = spark.createDataFrame([(k, f"w{x}") for k, xs in tables.items() for x in xs] + [(None, "w1"), ("t0001", None)], "t string, w string")
    names = {}
    for k in sorted(tables):
        names.setdefault(frozenset(tables[k]), []).append(k)
    want = {(x[0], y[0]): (len(x), len(y), len(a), len(b), len(a & b)) for a, x in names.items() for b, y in names.items()
            if x[0] < y[0] and round(len(a & b) / len(a | b), 6) >= 0.8}
    monkeypatch.setattr(catalog, "TILE_SETS", 100)
    found = catalog.topic_overlap(df, "t", "w", 0.8)
    assert "strategy=merge" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [((r.table_a, r.table_b), (r.tables_a, r.tables_b, r.n_a, r.n_b, r.n_shared)) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_shared_topics_are_exact_where_topics_are_folded(monkeypatch):
    draw = np.random.default_rng(4)
    sets = [np.sort(draw.choice(9_000, n, replace=False)) for n in draw.integers(1, 120, 150)]
    sets += [np.unique(np.where(draw.random(len(s)) < 0.1, draw.integers(0, 9_000, len(s)), s)) for s in sets]
    sets.sort(key=len)
    k = np.array([len(s) for s in sets])
    side = k, np.cumsum(k) - k, np.concatenate(sets)
    monkeypatch.setattr(catalog, "TILE_SETS", 70)
    least = 0.5
    i, j, n = catalog._shared(side, side, least / (1 + least))
    want = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(300) for b in range(a + 1, 300)}
    got = {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), n.tolist()) if a < b}
    assert all(want[p] == c for p, c in got.items())
    assert {p for p, c in want.items() if c and c / (k[p[0]] + k[p[1]] - c) >= least} <= set(got)


def test_only_tables_of_pairs_are_compared(spark):
    cols = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("b", [3.0, 0.0]), ("c", [1.0, 1.0]), (None, [1.0, 0.0])], "t string, vec array<double>")
    pairs = spark.createDataFrame([("a", "b")], "table_a string, table_b string")
    mine = catalog.of_pairs(cols, pairs, "t")
    assert sorted(r.t for r in mine.collect()) == ["a", "a", "b"]
    assert [r.col_sim for r in catalog.pair_similarity(pairs, mine, "t").collect()] == [0.5]


def test_names_of_a_group_meet_without_sending_keys(spark, monkeypatch):
    """Groups of which a text is in few: only texts are sent, in blocks where a group is large, and all pairs are found."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("ab") for _ in range(draw.choice([4, 7, 9, 23, 25, 28])))
    terms = {(g, word()) for g in "xyz" for _ in range(60 if g == "x" else 8)}
    asked = {(draw.choice("xyzw"), w[:1] + draw.choice(["", "a", "bb"]) + w[2:]) for _, w in sorted(terms) for _ in range(2)}
    known, rows = spark.createDataFrame(sorted(terms), "g string, term string"), spark.createDataFrame(sorted(asked), "g string, name string")
    want = {}
    for g, name in asked:
        near = sorted((_edits(name, x), x) for h, x in terms if h == g and _edits(name, x) <= (0 if len(name) < 3 else 1 if len(name) < 6 else 2))
        if near:
            want[g, name] = (near[0][1], near[0][0], sum(d == near[0][0] for d, _ in near))
    keyed, made = fuzzy._keyed, []
    monkeypatch.setattr(fuzzy, "_keyed", lambda *a: made.append(1) or keyed(*a))
    monkeypatch.setattr(fuzzy, "TEXTS_PER_BLOCK", 16)
    monkeypatch.setattr(fuzzy, "KEYS_AT_ONCE", 500)
    for times, by_keys in ((1_000, False), (0, True)):
        monkeypatch.setattr(fuzzy, "TIMES_SENT", times)
        got = fuzzy.nearest_terms(rows, "name", known, "term", ["g"]).collect()
        assert len(got) == len(want) and {(r["g"], r["name"]): (r["term"], r["distance"], r["n_terms"]) for r in got} == want
        assert bool(made) == by_keys
