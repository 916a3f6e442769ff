"""Language-model scores by stupid backoff, computed relationally.

Documents are dealt to blocks by a hash.  A block's distinct n-grams are dealt on, by their own hash, to the buckets
of the count table; a bucket adds up what all blocks sent and gives the totals back; each block joins them to the
n-grams of its documents and sums per document.  An n-gram comes once from a block however often it occurs, so
frequent ones make no hot key.  Texts travel compressed, hashes sorted, as the gaps between them, and counts in the bytes
that they need; answers are what other blocks have, so small.  Nothing is rounded or left out.

The model of a document is the rest of the corpus: its own n-grams are taken out of the counts.  The score of a word is
its n-gram's count over its context's; without such a count the context is shortened and the score multiplied by ALPHA.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import short_batches

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 8 << 20     # of text that one task holds with its n-grams
BUCKET_BYTES = 8 << 20    # of text whose n-grams make one bucket of the count table
SEED = 23
_TOTAL = np.uint64(0x5EED)  # stands for "any word": its count is that of all words


def words_of(text: str | None) -> list[bytes]:
    """Words parted by ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(left: np.ndarray, right: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of an n-gram from the hashes of its beginning and its last word."""
    salt = np.uint64(order * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + salt)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of the bytes that the largest of them needs, lowest bytes first."""
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes([planes]) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    """The ``size`` numbers that ``packed`` made ``data`` of."""
    out = np.zeros((size, 8), np.uint8)
    if size:
        raw = pa.decompress(data[1:], decompressed_size=size * data[0], codec="zstd", asbytes=True)
        out[:, : data[0]] = np.frombuffer(raw, np.uint8).reshape(-1, size).T
    return out.view("<u8").ravel()


def pressed(texts: pa.Array) -> pa.Array:
    """Each text compressed, after its length in bytes."""
    raw = texts.cast(pa.large_binary()).to_pylist()
    return pa.array([len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in raw], pa.binary())


def unpressed(column: pa.ChunkedArray) -> pa.Array:
    """The texts that ``pressed`` took."""
    read = lambda d: pa.decompress(d[8:], decompressed_size=int.from_bytes(d[:8], "little"), codec="zstd", asbytes=True)
    return pa.array([read(d) for d in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def _asked(grams: Grams, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block asks for, by bucket and hash: the order of its n-grams, their buckets, hashes and counts."""
    hashes = np.concatenate([*grams.hashes, np.array([_TOTAL])])
    times = np.concatenate([*grams.occurrences(), [len(grams.doc)]])
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((hashes, bucket))
    return by, bucket[by], hashes[by], times[by]


class Grams:
    """The n-grams of a block: for each order the hash of every distinct one, and which one ends at each word."""

    def __init__(self, texts, order: int):
        vocabulary: dict[bytes, int] = {}
        parts, lengths = [], []
        for t in texts:
            found = words_of(t.as_py())
            lengths.append(len(found))
            parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int64, len(found)))
        self.lengths = np.array(lengths, np.int64)
        words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in vocabulary), np.uint64, len(vocabulary))
        self.doc = np.repeat(np.arange(len(lengths)), self.lengths)
        place = np.arange(len(words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.hashes, self.at = [hashes], [words]
        for n in range(2, order + 1):
            at = np.full(len(words), -1, np.int64)          # no n-gram of this order ends here
            ends = np.nonzero(place >= n - 1)[0]
            start, last = self.at[-1][ends - 1], words[ends]
            code, at[ends] = np.unique(start * max(len(vocabulary), 1) + last, return_inverse=True)
            before, after = np.divmod(code, max(len(vocabulary), 1))
            self.hashes.append(_mixed(self.hashes[-1][before], hashes[after], n))
            self.at.append(at)

    def occurrences(self) -> list[np.ndarray]:
        """How often each distinct n-gram occurs in the block, by order."""
        return [np.bincount(at[at >= 0], minlength=len(h)) for at, h in zip(self.at, self.hashes)]

    def own(self, n: int) -> np.ndarray:
        """At each word: how often the n-gram of order ``n`` that ends there occurs in its document."""
        at = self.at[n - 1]
        out = np.zeros(len(at), np.int64)
        there = np.nonzero(at >= 0)[0]
        _, back, times = np.unique(self.doc[there] * max(len(self.hashes[n - 1]), 1) + at[there], return_inverse=True, return_counts=True)
        out[there] = times[back]
        return out


def log_scores(grams: Grams, totals: list[np.ndarray], all_words: int) -> tuple[np.ndarray, np.ndarray]:
    """log score of every word, and the order of the n-gram that gave it (0: none); ``totals`` count whole n-grams."""
    n_words = len(grams.doc)
    score, used = np.zeros(n_words), np.zeros(n_words, np.int64)
    rest = all_words - grams.lengths[grams.doc]                # words of all other documents
    others = []                                               # of each order: occurrences in other documents
    for n, (at, total) in enumerate(zip(grams.at, totals), 1):
        there = at >= 0
        counted = np.zeros(n_words, np.int64)
        counted[there] = total[at[there]]
        others.append(np.where(there, counted - grams.own(n), 0))
    longest = np.select([at >= 0 for at in reversed(grams.at)], list(range(len(grams.at), 0, -1)), 0)
    open_ = np.ones(n_words, bool)
    for n in range(len(grams.at), 0, -1):
        hit = open_ & (others[n - 1] > 0)
        k = np.nonzero(hit)[0]
        context = others[n - 2][k - 1] if n > 1 else rest[k]
        score[k] = np.log(others[n - 1][k] / context) + (longest[k] - n) * math.log(ALPHA)
        used[k] = n
        open_ &= ~hit
    k = np.nonzero(open_)[0]                                   # words that no other document has
    score[k] = longest[k] * math.log(ALPHA) - np.log(rest[k] + 1.0)
    return score, used


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES,
          bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """key, n_words, log_score (sum over the words), mean_log_score and n_backed_off of every row.

    A word that no other document has scores ALPHA to the number of shortenings over one more than their words.  Null and
    blank texts have no words, score 0 and a null mean.  Repeated rows are documents of their own, so they vouch for each
    other; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = -(-size // block_bytes) or 1, -(-size // bucket_bytes) or 1
    kind = docs.schema[key].dataType.simpleString()
    # the row's own text is part of the hash, so that rows of one key spread
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "key", "text"), F.lit(blocks)))
    short_batches(docs)
    texts = dealt.withColumn("text", F.arrow_udf(pressed, "binary")("text")).repartition(blocks, "block")

    def ask(table: pa.Table) -> pa.Table:
        _, bucket, hashes, times = _asked(Grams(unpressed(table.column("text")), order), buckets)
        names, starts = np.unique(bucket, return_index=True)
        spans = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(bucket)])]
        rest = hashes // np.uint64(buckets)                     # with the bucket it is the whole hash
        return pa.table({"bucket": pa.array(names, pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * len(names), pa.int64()),
                         "size": pa.array([s.stop - s.start for s in spans], pa.int32()),
                         "grams": pa.array([packed(np.diff(rest[s], prepend=np.uint64(0))) for s in spans], pa.binary()),
                         "n": pa.array([packed(times[s]) for s in spans], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        read = lambda c: [unpacked(x.as_py(), n) for x, n in zip(table.column(c), sizes)]
        _, back = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in read("grams")]), return_inverse=True)
        times = np.concatenate(read("n")).astype(np.int64)
        total = np.zeros(back.max() + 1, np.int64)
        np.add.at(total, back, times)
        others = np.split(total[back] - times, np.cumsum(sizes)[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "size": table.column("size"),
                         "n": pa.array([packed(x) for x in others], pa.binary())})

    def give(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(unpressed(table.column("text")), order)
        by, _, _, times = _asked(grams, buckets)
        answers = answers.sort_by("bucket")
        others = [unpacked(x.as_py(), n) for x, n in zip(answers.column("n"), answers.column("size").to_pylist())]
        totals = np.empty(len(by), np.int64)
        totals[by] = np.concatenate(others).astype(np.int64) + times
        per_order = np.split(totals[:-1], np.cumsum([len(h) for h in grams.hashes])[:-1])
        scores, used = log_scores(grams, per_order, int(totals[-1]))
        n_docs = len(grams.lengths)
        backed = used < np.select([at >= 0 for at in reversed(grams.at)], list(range(order, 0, -1)), 0)
        return pa.table({"key": table.column("key"), "n_words": pa.array(grams.lengths),
                         "log_score": pa.array(np.round(np.bincount(grams.doc, weights=scores, minlength=n_docs), 6)),
                         "n_backed_off": pa.array(np.bincount(grams.doc, weights=backed, minlength=n_docs).astype(np.int64))})

    asked = texts.groupBy("block").applyInArrow(ask, "bucket long, block long, size int, grams binary, n binary")
    counted = asked.groupBy("bucket").applyInArrow(add, "block long, bucket long, size int, n binary")
    out = texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        give, f"key {kind}, n_words long, log_score double, n_backed_off long")
    return out.select(F.col("key").alias(key), "n_words", "log_score", F.round(F.col("log_score") / F.nullif("n_words", F.lit(0)), 6)
                      .alias("mean_log_score"), "n_backed_off")
