"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that training sees.  The share of positives in the unlabelled
text (the class prior) is estimated first: the purest end of a provisional ranking is filled with positives, so the
ratio of unlabelled to positive mass there is the prior.  Then a small network minimises the unbiased risk, whose
estimate of the negative part is held at zero or above, so that it can't overfit by denying the positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm.common import short_batches

MAX_POSITIVES = 20_000    # bounds of the training sample, drawn by a hash of the key
MAX_UNLABELLED = 40_000
HIDDEN = 24
EPOCHS = 60
BATCH = 1024
RATE = 0.01
DECAY = 1e-4
SEED = 7
PURE_TOP = 0.20           # the prior's estimate looks at rankings cut at this share of the positives or more
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".", b",", b"!?", b"|",
            b"#*$%&<>", b"'\"()[]{}/-:;_=+@~^`\\"]
_CLASS_OF = np.full(256, len(_CLASSES), np.intp)
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[np.frombuffer(_chars, np.uint8)] = _k
N_FEATURES = len(_CLASSES) + 1 + 10


def features_of(text: str | None) -> np.ndarray:
    """Shares of character classes, and how long, varied and repetitive the words and lines are."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    words = raw.split()
    n = len(words)
    if not n:
        return out
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[: len(_CLASSES) + 1] = np.sqrt(np.bincount(_CLASS_OF, weights=per_byte, minlength=len(_CLASSES) + 1) / len(raw))
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [s for s in raw.split(b"\n") if s.strip()]
    same_next = sum(map(bytes.__eq__, words, words[1:])) / n
    pairs = n - 1
    distinct_pairs = len(set(zip(words, words[1:]))) / pairs if pairs else 1.0
    short = float((lengths <= 3).mean())
    heads = sum(w[:1].isupper() for w in words) / n
    out[len(_CLASSES) + 1 :] = [
        np.log1p(n) / 10, lengths.mean() / 10, lengths.std() / 10, len(set(words)) / n, distinct_pairs, same_next,
        short, heads, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10]
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    flat = np.concatenate([features_of(t.as_py()) for t in texts]) if len(texts) else np.zeros(0)
    ends = np.arange(0, len(flat) + 1, N_FEATURES, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def features(text: Column) -> Column:
    return _features(text)


class Network:
    """One hidden layer; ``margin`` is positive where a text looks like a trusted one."""

    def __init__(self, sample: np.ndarray, seed: int = SEED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.mean, self.scale = sample.mean(axis=0), sample.std(axis=0) + 1e-3
        self.parts = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.parts]
        self.steps = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.parts[0] + self.parts[1])
        return z, h, h @ self.parts[2] + self.parts[3][0]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[2]

    def step(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step along the gradient whose slope in each row's margin is given."""
        back = slope[:, None] * self.parts[2] * (1 - h * h)
        grads = [z.T @ back, back.sum(axis=0), h.T @ slope, slope.sum(keepdims=True)]
        self.steps += 1
        for p, g, m in zip(self.parts, grads, self.moments):
            g = g + DECAY * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= RATE * (m[0] / (1 - 0.9 ** self.steps)) / (np.sqrt(m[1] / (1 - 0.999 ** self.steps)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = EPOCHS) -> Network:
    """Minimise the non-negative risk with the logistic loss; without a prior, tell positives from unlabelled."""
    net = Network(np.vstack([positive, unlabelled]))
    rng = np.random.default_rng(SEED)
    batches = max(1, -(-max(len(positive), len(unlabelled)) // BATCH))
    for _ in range(epochs):
        p_order = np.array_split(rng.permutation(len(positive)), batches)
        u_order = np.array_split(rng.permutation(len(unlabelled)), batches)
        for pi, ui in zip(p_order, u_order):
            if not len(pi) or not len(ui):
                continue
            z, h, m = net.forward(np.vstack([positive[pi], unlabelled[ui]]))
            np_, nu = len(pi), len(ui)
            up = _sigmoid(m)                       # slope of log(1 + e^m), the loss of calling a row negative
            slope = np.zeros(np_ + nu)
            if prior is None:
                slope[:np_], slope[np_:] = (up[:np_] - 1) / np_, up[np_:] / nu
            else:
                loss = np.logaddexp(0, m)
                negative = loss[np_:].mean() - prior * loss[:np_].mean()
                if negative >= 0:
                    slope[:np_] = prior * (up[:np_] - 1) / np_ - prior * up[:np_] / np_
                    slope[np_:] = up[np_:] / nu
                else:                              # the estimate has gone below zero: climb back
                    slope[:np_], slope[np_:] = prior * up[:np_] / np_, -up[np_:] / nu
            net.step(z, h, slope)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows: the least ratio of the two masses over the top of the ranking.

    Half of the rows train the provisional ranking, the other half are counted.
    """
    net = fit(positive[::2], unlabelled[::2], None, epochs=15)
    p, u = np.sort(net.margin(positive[1::2])), np.sort(net.margin(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0.0, 1 - PURE_TOP, 81))
    p_top = 1 - np.searchsorted(p, cuts, "left") / len(p)
    u_top = 1 - np.searchsorted(u, cuts, "left") / len(u)
    slack = np.sqrt(np.log(40) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)   # by which both shares may err
    return float(np.clip(((u_top + slack) / p_top).min() - slack, 0.05, 0.99))


def sample(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` rows at most, in the order of a hash of their key; exact when there are fewer."""
    return rows.withColumn("_u", F.xxhash64(F.lit(SEED), "key")).orderBy("_u", "key").limit(n).drop("_u")


def train(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text") -> Network | None:
    """A network from the documents named in ``positives`` and from unlabelled ones, both bounded samples.

    None without any positive or any document.
    """
    keys = docs.select(F.col(key).alias("key")).distinct()
    good = sample(keys.join(positives.select(F.col(key).alias("key")).distinct(), "key", "left_semi"), MAX_POSITIVES)
    some = sample(keys.where("key is not null"), MAX_UNLABELLED)
    wanted = good.withColumn("p", F.lit(True)).unionByName(some.withColumn("p", F.lit(False)))
    once = wanted.groupBy("key").agg(F.bool_or("p").alias("good"), F.bool_or(~F.col("p")).alias("web"))
    rows = (docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))
            .join(F.broadcast(once), "key")  # at most MAX_POSITIVES + MAX_UNLABELLED keys
            .dropDuplicates(["key"]).select("good", "web", features(F.col("_text")).alias("f")))
    table = rows.toArrow()
    values = table.column("f").combine_chunks()
    if not len(values):
        return None
    x = np.array(values.flatten()).reshape(-1, N_FEATURES)
    positive, unlabelled = x[np.array(table.column("good"), bool)], x[np.array(table.column("web"), bool)]
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    order = np.lexsort(positive.T), np.lexsort(unlabelled.T)   # the result doesn't depend on the order of collected rows
    rng = np.random.default_rng(SEED)
    positive, unlabelled = positive[rng.permutation(order[0])], unlabelled[rng.permutation(order[1])]
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, net: Network | None, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the network's score from 0 to 1; 0.5 everywhere without a network."""
    if net is None:
        return docs.withColumn(column, F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        x = np.vstack([features_of(t.as_py()) for t in texts])
        return pa.array(np.round(_sigmoid(sent.value.margin(x)), 9))

    return docs.withColumn(column, scores(F.col(text)))


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """True for the rows whose key's CRC-32 falls into the fold that training never sees."""
    return F.crc32(key.cast("string").cast("binary")) % folds == fold


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score and predicted of every row.

    Only texts are scored, so equal texts get equal scores; null and empty ones are scored like any other.  A key
    with several labels is trusted if all of them are 1; null labels and null keys are not.  Without positives every
    score is 0.5.  Repeated rows stay, an empty table gives none, other columns are not read.
    """
    short_batches(docs)
    trusted = (labels.select(F.col(key).alias(key), F.col(label).alias("_label")).where(F.col(key).isNotNull() & ~held_out(F.col(key)))
               .groupBy(key).agg(F.min("_label").alias("_least")).where("_least = 1").select(key))
    net = train(docs, trusted, key, text)
    scored = score(docs.select(F.col(key).alias(key), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"),
                               F.col(text).alias("_text")), net, "_text")
    return scored.select(key, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
