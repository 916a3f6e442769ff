"""Operators on whole texts against brute force: fingerprints and links, byte pairs, quality rules, LM scores."""

import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigrid.llm import backoff, bpe, quality_rules, simhash
from lexigrid.llm.common import table

FOLDER = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, FOLDER, "documents")


def simple_fingerprint(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def simple_components(prints, radius=3):
    """prints: {id: fingerprint}; {id: smallest id reachable}."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= radius:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(documents):
    rows = simhash.near_duplicates(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = {i: simple_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == simple_components(prints)


@given(st.lists(st.integers(0, 63), min_size=0, max_size=3, unique=True), st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
@settings(max_examples=300, deadline=None)
def test_masks_cover_every_pair_in_the_radius(places, x, free):
    y = x
    for p in places:
        y ^= 1 << p
    assert any(x & m == y & m for m in simhash.covering_masks())
    if all(free >> p & 1 for p in places):  # masks over some of the bits as well
        assert any(x & m == y & m for m in simhash.covering_masks(free))


def test_large_buckets_are_dealt_again_without_loss(spark):
    # fingerprints that share most bits: every one falls into a few large buckets
    values = sorted({(k * 2654435761 % 4096) | (k % 7) << 40 for k in range(600)})
    frame = spark.createDataFrame([(v, v) for v in values], "fp long, key long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(frame, "key", "fp", max_bucket=16).collect()}
    assert got == simple_components({v: v for v in values})


def test_near_duplicates_of_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_one_row_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 7]
    assert simhash.keep_one(odd.limit(0)).count() == 0


SAMPLES = ["", None, "Hello, WORLD!  it's   42 don't", "naïve café ÉÈ ñandú größe ΣΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "日本語 テスト 你好",
           "x" * 500, "\x1ca\x1db\x85c\xa0d", "é ́x", "</w> a</w>b", "🙂🙃 emoji!!??", "1234567 8.9e-10", "​zero line"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.FragmentEncoder(bpe.read_spec(FILE))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def assert_same(encoder, library, text):
    ids, tokens = encoder.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, np.int32).tolist() == want
    assert tokens == library.decode(want, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_fragments_give_the_library_s_ids(encoder, library, text):
    assert_same(encoder, library, text)


def test_cuts_are_where_no_token_joins(encoder):
    parts = encoder.fragments("Ã©Ãª")
    assert "".join(parts) == "Ã©Ãª"
    for a, b in zip(parts, parts[1:]):
        assert not any(a[-1] + b[0] in t for t in encoder.tokenizer.get_vocab())


def test_encoded_table(spark, docs_of, documents, library):
    docs = docs_of([(k, t) for k, t in enumerate(SAMPLES)]).select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    encoded = {(r["doc_id"], r["decoded"]): r["ids"] for r in bpe.encode_with_file(docs, FILE).collect()}
    digests = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"]): r["n_tokens"] for r in
               bpe.digests(bpe.encode_with_file(docs, FILE)).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert encoded[r["doc_id"], text] == ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert digests[r["doc_id"], sha(" ".join(map(str, ids))), sha(text)] == len(ids)


def test_encoding_odd_rows(odd):
    assert bpe.digests(bpe.encode_with_file(odd, FILE)).count() == odd.count()
    assert bpe.encode_with_file(odd.limit(0), FILE).count() == 0


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = collections.Counter(windows)
    repeated = {k + i for k, w in enumerate(windows) if times[w] > 1 for i in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_base_counts(documents, odd):
    for docs in (documents, odd):
        texts = collections.defaultdict(list)
        for r in docs.collect():
            texts[r["doc_id"]].append(base_counts(r["text"]))
        got = collections.defaultdict(list)
        for r in quality_rules.judge(docs).collect():
            counts = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
            got[r["doc_id"]].append(counts)
            assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
            assert not (r["base_failed"] and r["kept"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum(0.5 * a * math.log2(a / c) for a, c in zip(p, m) if a) + sum(0.5 * b * math.log2(b / c) for b, c in zip(q, m) if b))
    row = spark.createDataFrame([(p, q, p)], "p array<double>, q array<double>, r array<double>")
    got = row.select(quality_rules.divergence("p", "q").alias("d"), quality_rules.divergence("p", "r").alias("e")).first()
    assert abs(got["d"] - want) < 1e-12 and got["e"] == 0


def test_rules_reject_junk_and_keep_labelled_quality(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality_rules.judge(table(spark, folder, "documents"))
    labels = table(spark, folder, "labels").dropDuplicates(["doc_id"])
    rows = judged.join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.995 * len(good)
    assert sum(not r["kept"] for r in junk) >= 0.8 * len(junk)


def test_rules_keep_the_table_s_columns(odd):
    kept = quality_rules.keep_sound(odd)
    assert kept.columns == odd.columns
    assert [r["doc_id"] for r in kept.collect()] == []  # too short, or repeated windows
    assert quality_rules.keep_sound(odd.limit(0)).count() == 0


def test_rules_keep_what_they_judge_sound(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    twice = docs.unionByName(docs.where("doc_id % 5 = 0")).withColumns({"_lang": F.lit("x"), "kept": F.lit(False), "n_words": F.col("doc_id")})
    sound = sorted(r["doc_id"] for r in quality_rules.judge(twice).where("kept").collect())
    kept = quality_rules.keep_sound(twice)
    assert kept.columns == twice.columns and 0 < len(sound) < twice.count()
    assert sorted(r["doc_id"] for r in kept.collect()) == sound
    assert kept.exceptAll(twice).count() == 0


def test_one_of_each_group_stays(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    twice = docs.unionByName(docs.where("doc_id % 3 = 0")).withColumn("own_key", F.lit(1))
    named = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.keep_one(twice)
    assert kept.columns == twice.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(named.values()))
    assert kept.exceptAll(twice).count() == 0


def simple_backoff(texts, order):
    words = [WORD.findall(lowered(t)) for t in texts]
    own = [[collections.Counter(tuple(w[k - n + 1 : k + 1]) for k in range(n - 1, len(w))) for n in range(1, order + 1)] for w in words]
    whole = [sum((o[n] for o in own), collections.Counter()) for n in range(order)]
    total = sum(map(len, words))
    out = []
    for w, mine in zip(words, own):
        rest, score, backed = total - len(w), 0.0, 0
        count = lambda g: whole[len(g) - 1][g] - mine[len(g) - 1][g] if g else rest  # noqa: B023, E731
        for k in range(len(w)):
            longest = min(order, k + 1)
            for n in range(longest, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if count(g) > 0:
                    score += math.log(count(g) / count(g[:-1])) + (longest - n) * math.log(0.4)
                    break
            else:
                n = 0
                score += longest * math.log(0.4) - math.log(rest + 1)
            backed += n < longest
        out.append((len(w), score, backed))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(documents, order):
    docs = documents.orderBy("doc_id").limit(120).collect()
    frame = documents.sparkSession.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    want = dict(zip([r["doc_id"] for r in docs], simple_backoff([r["text"] for r in docs], order)))
    got = {r["doc_id"]: r for r in backoff.score(frame, order=order, block_bytes=30_000, bucket_bytes=50_000).collect()}
    assert set(got) == set(want)
    for key, (n, score, backed) in want.items():
        assert got[key]["n_words"] == n and got[key]["n_backed_off"] == backed
        assert abs(got[key]["log_score"] - score) < 1e-5 * max(1, abs(score))


def test_backoff_of_odd_rows(odd):
    rows = backoff.score(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["n_words"], r["log_score"], r["mean_log_score"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, 0.0, None)}
    assert backoff.score(odd.limit(0)).count() == 0


def test_registered_language_model_counts_trigrams(documents):
    """At the production defaults; a salad of the corpus's bigrams must score below a text of its trigrams."""
    salad, real = "b c a b x c a b c x", "a b c a b c a b c x"
    texts = ["a b x", "b c x", "c a x", "a b c a b c x", "a b c a b c a b", salad, real]
    frame = documents.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in backoff.score(frame).collect()}
    for k, (n, score, backed) in enumerate(simple_backoff(texts, 3)):
        assert (got[k]["n_words"], got[k]["n_backed_off"]) == (n, backed) and abs(got[k]["log_score"] - score) < 1e-5
    assert got[5]["log_score"] < got[6]["log_score"]


@given(st.lists(st.integers(0, 2**64 - 1)))
@settings(max_examples=200, deadline=None)
def test_packed_numbers_come_back(values):
    x = np.array(values, np.uint64)
    assert backoff.unpacked(backoff.packed(x), len(x)).tolist() == values
