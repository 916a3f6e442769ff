"""Text to vectors, with any encoder, in Arrow batches.

An encoder has ``name``, ``dim`` and ``raw(list[str]) -> float matrix``.  Windows of long
texts are encoded one by one, averaged and brought to unit length in the same task, so
encoding never shuffles.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.text import normalize_term, text_normalizer, words
from lexigrid.session import cut_lineage

CHARS_PER_CHUNK = 1_000_000  # a chunk's n-grams are held at once, some hundred bytes a character


class Encoder(Protocol):
    name: str
    dim: int

    def raw(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Counts of hashed character n-grams (padded by blanks) or of hashed words.

    The bucket of a gram is the number in the first eight hex digits of its MD5, modulo
    ``dim``: the same in every engine and process.
    """

    def __init__(self, name: str = "tri64", dim: int = 64, unit: str = "char", n: int = 3):
        if unit not in ("char", "word") or not 1 <= n <= 3:
            raise ValueError("unit is 'char' or 'word', n is 1 to 3")
        self.name, self.dim, self.unit, self.n = name, dim, unit, n

    def _bucket(self, gram: str) -> int:
        return int(hashlib.md5(gram.encode("utf-8")).hexdigest()[:8], 16) % self.dim

    def raw(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        count = self._count_chars if self.unit == "char" else self._count_words
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHARS_PER_CHUNK):
                size += len(texts[stop])
                stop += 1
            out[start:stop] = count(texts[start:stop])
            start = stop
        return out

    def _histogram(self, rows: np.ndarray, grams: pa.DictionaryArray, spell, n_texts: int) -> np.ndarray:
        buckets = np.array([self._bucket(spell(g)) for g in grams.dictionary.to_pylist()], dtype=np.int64)
        flat = rows * self.dim + buckets[grams.indices.to_numpy()]
        return np.bincount(flat, minlength=n_texts * self.dim).reshape(n_texts, self.dim)

    def _count_chars(self, texts: list[str]) -> np.ndarray:
        padded = [f" {t} " for t in texts]
        lengths = np.array([len(t) for t in padded])
        codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(lengths)
        per_text = np.maximum(lengths - self.n + 1, 0)
        rows = np.repeat(np.arange(len(texts)), per_text)
        if not len(rows):
            return np.zeros((len(texts), self.dim))
        within = np.arange(len(rows)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        at = np.repeat(ends - lengths, per_text) + within
        packed = np.zeros(len(rows), dtype=np.int64)
        for k in range(self.n):
            packed |= codes[at + k] << (21 * k)
        grams = pa.array(packed).dictionary_encode()
        mask = (1 << 21) - 1

        def spell(g: int) -> str:
            return "".join(chr((g >> (21 * k)) & mask) for k in range(self.n))

        return self._histogram(rows, grams, spell, len(texts))

    def _count_words(self, texts: list[str]) -> np.ndarray:
        lists = [re.findall(r"[^ \t\n\r\f]+", t) for t in texts]
        per_text = np.array([len(ws) for ws in lists])
        if not per_text.sum():
            return np.zeros((len(texts), self.dim))
        rows = np.repeat(np.arange(len(texts)), per_text)
        grams = pa.array([w for ws in lists for w in ws], pa.string()).dictionary_encode()
        return self._histogram(rows, grams, lambda w: w, len(texts))


# Encoders that can be told apart in an evaluation: fixed values.
DEFAULT_ENCODERS = {e.name: e for e in (
    HashedNgrams("tri64", 64), HashedNgrams("tri128", 128), HashedNgrams("word64", 64, "word", 1))}
DEFAULT = DEFAULT_ENCODERS["tri64"]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one as float32; zero rows stay zero."""
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=np.zeros_like(matrix, dtype=np.float64), where=length > 0).astype(np.float32)


def to_lists(matrix: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A matrix as an Arrow list column; rows not valid become NULL."""
    dim = matrix.shape[1]
    if valid is None or valid.all():
        offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * dim, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))
    sizes = np.concatenate([[0], np.cumsum(np.where(valid, dim, 0))]).astype(np.int32)
    offsets = pa.array(sizes, pa.int32(), mask=np.append(~valid, False))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix[valid].ravel()))


def _slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Rows in order, so few at a time that their texts are within ``CHARS_PER_CHUNK`` bytes (a longer row comes alone)."""
    texts = np.concatenate([[0], np.cumsum(pa.compute.binary_length(lists.flatten()).fill_null(0).to_numpy(zero_copy_only=False))])
    ends = texts[np.cumsum(lists.value_lengths().to_numpy())]
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + CHARS_PER_CHUNK, "right")), start + 1)
        yield lists.slice(start, stop - start)
        start = stop


def _encoded(batch: pa.ListArray, encoders: list[Encoder]) -> list[pa.Array]:
    """Under each encoder the vector of every text, given as a list of windows."""
    valid = batch.is_valid().to_numpy(zero_copy_only=False)
    lists = batch.drop_null()
    pooled = [np.zeros((len(lists), e.dim)) for e in encoders]
    at = 0
    for part in _slices(lists):
        counts, texts = part.value_lengths().to_numpy(), part.flatten().to_pylist()
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            for encoder, rows in zip(encoders, pooled):
                rows[at:at + len(part)][some] = np.add.reduceat(encoder.raw(texts), starts, axis=0) / counts[some, None]
        at += len(part)
    found = []
    for encoder, rows in zip(encoders, pooled):
        out = np.zeros((len(batch), encoder.dim), dtype=np.float32)
        out[valid] = unit_rows(rows)
        found.append(to_lists(out, valid))
    return found


def vector_of(windows: Column, encoder: Encoder) -> Column:
    """Unit vector of each text given as an array of windows (NULL array, NULL vector)."""

    @F.arrow_udf("array<float>")
    def encode_windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _encoded(batch, [encoder])[0]

    return once(encode_windows)(windows)


def vectors_of(windows: Column, encoders: list[Encoder]) -> Column:
    """``vector_of`` under several encoders: a struct with the fields e0, e1, ...  One worker reads each text once for all."""

    @F.arrow_udf("struct<" + ",".join(f"e{i}:array<float>" for i in range(len(encoders))) + ">")
    def encode_windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.StructArray.from_arrays(_encoded(batch, encoders), names=[f"e{i}" for i in range(len(encoders))])

    return once(encode_windows)(windows)


def once(udf):
    """Keep the planner from computing a costly function again in the filters it derives."""
    return udf.asNondeterministic()


def window_starts(n_tokens: Column, n_ctx: int) -> Column:
    """Start offsets of windows of ``n_ctx`` tokens with half overlap, up to the text's end."""
    stride = max(n_ctx // 2, 1)
    extra = F.ceil((n_tokens - F.lit(n_ctx)) / F.lit(stride)).cast("int")
    last = F.greatest(F.lit(0), extra)
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * F.lit(stride))


def token_windows(tokens: Column, n_ctx: int) -> Column:
    """The windows themselves, tokens joined by one blank.  ``tokens`` should be a plain column."""
    return F.transform(window_starts(F.size(tokens), n_ctx),
                       lambda s: F.array_join(F.slice(tokens, s + 1, n_ctx), " "))


def embed(text: Column, encoder: Encoder = DEFAULT) -> Column:
    """Unit vector of a whole text; NULL stays NULL."""
    return vector_of(F.when(text.isNotNull(), F.array(normalize_term(text))), encoder)


def encode(df: DataFrame, text: str, encoder: Encoder = DEFAULT, n_ctx: int | None = None,
           out: str = "vec") -> DataFrame:
    """Add each text's vector; with ``n_ctx``, longer texts are the mean of their windows."""
    if n_ctx is None:
        return df.withColumn(out, embed(F.col(text), encoder))
    # tokens in a column of their own: the windows refer to them many times
    tokens = df.withColumn("_tokens", words(normalize_term(F.col(text))))
    windows = tokens.withColumn("_windows", F.when(F.col("_tokens").isNotNull(), token_windows(F.col("_tokens"), n_ctx)))
    return windows.withColumn(out, vector_of(F.col("_windows"), encoder)).drop("_tokens", "_windows")


def encode_models(df: DataFrame, text: str, encoders: list[Encoder], out: str = "vec") -> DataFrame:
    """One row per input row and encoder, with the column ``model``."""
    cols = df.columns
    plain = F.when(F.col(text).isNotNull(), F.array(normalize_term(F.col(text))))
    pairs = [F.struct(F.lit(e.name).alias("model"), F.col(f"_v.e{i}").alias(out)) for i, e in enumerate(encoders)]
    return (df.withColumn("_v", vectors_of(plain, encoders)).withColumn("_m", F.explode(F.array(*pairs)))
            .select(*cols, F.col("_m.model").alias("model"), F.col(f"_m.{out}").alias(out)))


def model_table(spark: SparkSession, encoders: list[Encoder]) -> DataFrame:
    """Provenance: model_id, model_name, model_dim."""
    rows = [(i + 1, e.name, e.dim) for i, e in enumerate(encoders)]
    return spark.createDataFrame(rows, "model_id int, model_name string, model_dim int")


def text_windows(df: DataFrame, key: list[str], text: str, n_ctx: int) -> DataFrame:
    """One row per window: key, window_no, start_token, n_tokens, window_text."""
    tokens = df.select(*key, words(F.col(text)).alias("_t"))
    starts = tokens.select(*key, "_t", F.posexplode(window_starts(F.size("_t"), n_ctx)).alias("window_no", "start_token"))
    window = F.slice("_t", F.col("start_token") + 1, n_ctx)
    return starts.select(*key, "window_no", "start_token", F.size(window).alias("n_tokens"),
                         F.array_join(window, " ").alias("window_text"))


def pack_texts(df: DataFrame, shard: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """Fill bins of at most ``budget`` tokens with each shard's texts in order; an oversize text goes alone.

    Returns shard, order, tokens and ``bin_no`` (from 0 in each shard).  ``order`` is unique in a shard.

    Filling is sequential, but what a stretch of texts does depends only on how full the open bin is at its
    start, and only the texts before its first new bin depend on that.  So every stretch is summed up alone: for
    each text that may open its first new bin, how many bins follow and how full the last one ends.  A scan over
    the summaries, one short row per stretch, hands each stretch its entry, and the stretches are filled at once.
    """
    rows = df.select(*shard, F.col(order).alias("_o"), F.col(tokens).cast("long").alias("_n"))
    ranged = rows.repartitionByRange(*[F.col(c) for c in [*shard, "_o"]])
    placed = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    kinds = {c: placed.schema[c].dataType.simpleString() for c in [*shard, "_o"]}
    head = "".join(f"`{c}` {kinds[c]}, " for c in shard)

    def lead(t: pa.Table, n: int) -> dict[str, pa.Array]:
        return {c: t.column(c).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in shard}

    def sums(t: pa.Table) -> np.ndarray:
        return np.cumsum(t.sort_by("_o").column("_n").to_numpy())

    def following(ends: np.ndarray) -> np.ndarray:
        """For a bin that begins with each text, the text that opens the next one."""
        before = np.concatenate([[0], ends[:-1]])
        return np.maximum(np.searchsorted(ends, before + budget, "right"), np.arange(len(ends)) + 1)

    def summary(t: pa.Table) -> pa.Table:
        ends = sums(t)
        nxt, m = following(ends), len(ends)
        opened, fill = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        for j in range(m - 1, -1, -1):
            k = nxt[j]
            opened[j] = 1 + opened[k]
            fill[j] = fill[k] if k < m else ends[-1] - (ends[j - 1] if j else 0)
        first = min(int(np.searchsorted(ends, budget, "right")) + 1, m)  # texts that may open the first new bin
        listed = lambda x: pa.array([x[:first].tolist()], pa.list_(pa.int64()))
        return pa.table({**lead(t, 1), "_part": t.column("_part").combine_chunks().slice(0, 1), "_ends": listed(ends),
                         "_opened": listed(opened), "_fill": listed(fill), "_all": pa.array([int(ends[-1])])})

    def entries(t: pa.Table) -> pa.Table:
        t = t.sort_by("_part")
        used, bins, at = None, 0, []
        for ends, opened, fill, whole in zip(*(t.column(c).to_pylist() for c in ("_ends", "_opened", "_fill", "_all"))):
            at.append((used, bins))
            j = 0 if used is None else int(np.searchsorted(ends, budget - used, "right"))
            if j < len(ends):
                bins, used = bins + opened[j], fill[j]
            else:
                used += whole
        return pa.table({**lead(t, len(at)), "_part": t.column("_part"), "_used": pa.array([u for u, _ in at], pa.int64()),
                         "_bins": pa.array([b for _, b in at], pa.int64())})

    def fill_bins(t: pa.Table, entry: pa.Table) -> pa.Table:
        t = t.sort_by("_o")
        ends = sums(t)
        nxt, used = following(ends), entry.column("_used")[0].as_py()
        cuts, j = [], 0 if used is None else int(np.searchsorted(ends, budget - used, "right"))
        while j < len(ends):
            cuts.append(j)
            j = int(nxt[j])
        bin_no = entry.column("_bins")[0].as_py() - 1 + np.searchsorted(cuts, np.arange(len(ends)), "right")
        return pa.table({**{c: t.column(c) for c in shard}, order: t.column("_o"), tokens: t.column("_n"), "bin_no": pa.array(bin_no, pa.int64())})

    keys = [*shard, "_part"]
    short = placed.groupBy(*keys).applyInArrow(
        summary, f"{head}_part int, _ends array<long>, _opened array<long>, _fill array<long>, _all long")
    # without shard columns all summaries make one group: a row for each partition
    entry = short.withColumn("_one", F.lit(0)).groupBy(*(shard or ["_one"])).applyInArrow(entries, f"{head}_part int, _used long, _bins long")
    return placed.groupBy(*keys).cogroup(entry.groupBy(*keys)).applyInArrow(
        fill_bins, f"{head}`{order}` {kinds['_o']}, `{tokens}` long, bin_no long")


def register(spark: SparkSession, encoders: dict[str, Encoder] | None = None) -> None:
    """SQL names ``embed``, ``embed_dim`` and ``token_count``."""
    known = dict(encoders or DEFAULT_ENCODERS)
    normalize = text_normalizer()

    @F.arrow_udf("array<float>")
    def embed_text(model: pa.Array, text: pa.Array) -> pa.Array:
        models, texts = model.to_pylist(), text.to_pylist()
        out: list = [None] * len(texts)
        for name in sorted({m for m in models if m is not None}):
            if name not in known:
                raise ValueError(f"unknown model: {name}")
            at = [i for i, m in enumerate(models) if m == name and texts[i] is not None]
            raw = known[name].raw([normalize(texts[i]) for i in at])
            for i, row in zip(at, unit_rows(raw)):
                out[i] = row
        return pa.array(out, pa.list_(pa.float32()))

    spark.udf.register("embed", embed_text)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_count(s STRING) RETURNS INT RETURN "
              "CASE WHEN s IS NOT NULL THEN size(filter(split(s, '[ \\\\t\\\\n\\\\r\\\\f]+'), w -> length(w) > 0)) + 2 END")
    cases = " ".join(f"WHEN '{n}' THEN {e.dim}" for n, e in known.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION embed_dim(model STRING) RETURNS INT RETURN CASE model {cases} END")
