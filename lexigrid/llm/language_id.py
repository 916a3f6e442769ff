"""Language identification by fusing evidence: text, declared language, and the address a document comes from.

Text evidence is the likelihood of a document's letter trigrams under each language's trigram shares, which are
counted over the whole corpus, smoothed towards the shares over all languages.  One more class, ``other``, stands for
languages without a model: it is likelier than a text's best language where the text falls short of what that
language's own texts reach, by more than half the way to what the nearest other language would and by more than chance
moves so short a text.  The declared language is a noisy witness whose reliability is estimated.  The prior of a host is
smoothed towards the prior of its address suffix, and that one towards the corpus.  All counts behind these are grouped
aggregations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import lookup, short_batches
from lexigrid.session import cut_lineage

BINS = 1 << 14            # trigrams are hashed to so many counts
MIN_DOCS = 3              # texts that must declare a language before it gets a model, however many others there are
MIN_TRIGRAMS = 20         # of a text, for evidence that it is of no model's language
SPREAD = 10.0             # three deviations of a trigram's nats: a short text may be so far off its language's level
MOST_LANGUAGES = 256      # models that are broadcast; texts of the others keep the language that they declare
OTHER = "other"
BACKGROUND = 200.0        # trigrams that the shares over all languages count as in the model of one
EFFECTIVE = 60.0          # trigrams overlap, so a text counts as no more than so many independent ones
STRENGTH = 20.0           # documents that the parent's prior stands for when a host's is smoothed
MIN_POSTERIOR = 0.5
MIN_FIT = 0.5             # nats per trigram by which a text must beat evenly spread trigrams
_BLOCK = 1 << 20          # trigrams counted at once
# bytes that are no letters all count as a space
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigram_bins(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text that hold a letter."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_LETTERS), np.uint8)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    b = raw.astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[code != 0x202020]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def languages_of(docs: DataFrame, text: str, declared: Column, min_docs: int = MIN_DOCS, most: int = MOST_LANGUAGES) -> list[str]:
    """Languages that at least ``min_docs`` texts declare; the ``most`` frequent ones, should there be more."""
    counts = docs.select(declared.alias("l"), F.col(text).alias("t")).where("l is not null and l <> '' and t is not null").groupBy("l").count()
    return sorted(r["l"] for r in counts.where(F.col("count") >= min_docs).orderBy(F.desc("count"), "l").limit(most).collect())


def count_trigrams(docs: DataFrame, text: str, declared: Column, languages: list[str]) -> np.ndarray:
    """Trigrams by [language, bin] over every document that declares one of the languages."""
    place = {name: k for k, name in enumerate(languages)}

    def count(batches):
        sums = np.zeros((len(languages), BINS), np.int64)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name in place and body.is_valid:
                    sums[place[name]] += np.bincount(trigram_bins(body.as_py()), minlength=BINS)
        at, bins = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bins, pa.int32()), pa.array(sums[at, bins])],
                                         ["language", "bin", "n"])

    rows = docs.select(declared.alias("l"), F.col(text).alias("t")).mapInArrow(count, "language int, bin int, n long")
    seen = rows.groupBy("language", "bin").agg(F.sum("n").alias("n")).toArrow()   # MOST_LANGUAGES * BINS rows at most
    counts = np.zeros((len(languages), BINS))
    counts[np.asarray(seen.column("language")), np.asarray(seen.column("bin"))] = np.asarray(seen.column("n"))
    return counts


class Model:
    """log P(trigram bin | language), and per language the level below which a text is rather of another."""

    def __init__(self, counts: np.ndarray):
        total = counts.sum(axis=1, keepdims=True)
        shares = counts / np.maximum(total, 1)
        common = 0.9 * shares.mean(axis=0) + 0.1 / BINS
        common /= common.sum()
        self.logs = np.log((counts + BACKGROUND * common) / (total + BACKGROUND))
        p = np.exp(self.logs)
        reached = p @ self.logs.T                      # [texts of, model of]: nats per trigram expected
        own = np.diag(reached).copy()
        np.fill_diagonal(reached, -np.inf)
        nearest = np.maximum(reached.max(axis=1), -np.log(BINS))
        self.level = (own + nearest) / 2

    def score(self, text: str | None) -> np.ndarray:
        """Nats per trigram over an even spread, then the tempered log-likelihoods of the languages and of ``other``."""
        bins = trigram_bins(text or "")
        out = np.zeros(len(self.logs) + 2)
        if len(bins):
            sums = sum(self.logs[:, bins[k : k + _BLOCK]].sum(axis=1) for k in range(0, len(bins), _BLOCK))
            mean = sums / len(bins)
            best = mean.argmax()
            out[0] = mean[best] + np.log(BINS)
            # a few trigrams don't tell a language without a model from a rare word
            other = self.level[best] - SPREAD / np.sqrt(len(bins)) if len(bins) >= MIN_TRIGRAMS else mean.min()
            out[1:] = (np.append(mean, other) - mean[best]) * min(len(bins), EFFECTIVE)
        return out


def _evidence(docs: DataFrame, model: Model):
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES * BINS numbers at most

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return evidence


def host_of(address: Column) -> Column:
    """Lower-case host of a URL or of a bare host name; '' for null."""
    return F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1))


def suffix_of(host: Column) -> Column:
    """What follows the last dot of a host; '' without a dot."""
    return F.regexp_extract(host, "[.]([^.]+)$", 1)


def _sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("_share")[k]) for k in range(n)]).alias("_" + (by[0] if by else "all")),
                                 F.count("*").alias("_n_" + (by[0] if by else "all")))


def _softmax(logs: str) -> Column:
    top = F.array_max(logs)
    return F.transform(logs, lambda x: F.exp(x - top))


def _scaled(values: str) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.transform(values, lambda x: x / total)


class Evidence:
    """Everything that is estimated from a corpus: the trigram model, witnesses and priors."""

    def __init__(self, docs: DataFrame, text: str, declared: Column, address: Column):
        self.text, self.declared, self.address = text, declared, address
        short_batches(docs)
        self.languages = languages_of(docs, text, declared)
        self.known = bool(self.languages)
        if not self.known:
            return
        self.n = n = len(self.languages) + 1   # with ``other``, the last
        self.udf = _evidence(docs, Model(count_trigrams(docs, text, declared, self.languages)))
        rows = cut_lineage(self.shares(docs.select(*self._inputs(docs))))
        whole = _sums(rows, [], n).first()                                    # one row of so many numbers
        self.all, self.n_all = whole["_all"] or [0.0] * n, whole["_n_all"]
        self.witness = cut_lineage(_sums(rows, ["said"], n).drop("_n_said"))  # a row per declared value
        self.suffixes = cut_lineage(_sums(rows, ["suffix"], n))
        self.hosts = cut_lineage(_sums(rows, ["host", "suffix"], n))

    def _inputs(self, docs: DataFrame) -> list[Column]:
        host = host_of(self.address)
        return [F.coalesce(self.declared, F.lit("")).alias("said"), host.alias("host"), suffix_of(host).alias("suffix"),
                self.udf(F.col(self.text)).alias("_e")]

    def shares(self, rows: DataFrame) -> DataFrame:
        """Adds each row's fit, log-likelihoods and the shares of the languages by its text alone."""
        rows = rows.withColumns({"_fit": F.col("_e")[0], "_logs": F.slice("_e", 2, self.n)}).drop("_e")
        rows = rows.withColumn("_share", _softmax("_logs"))
        return rows.withColumn("_share", _scaled("_share"))

    def fuse(self, rows: DataFrame) -> DataFrame:
        """Adds language, posterior and fit to rows that ``shares`` has prepared.

        A document's own share is taken out of the counts of its host before they serve as its prior.
        """
        n = self.n
        width = 16 * n + 128
        out = lookup(rows, self.hosts, ["host", "suffix"], width)
        out = lookup(out, self.suffixes, ["suffix"], width)
        out = lookup(out, self.witness, ["said"], width)
        logs = []
        for k in range(n):
            at = lambda c: F.col(c)[k]  # noqa: B023, E731
            everywhere = (self.all[k] + 1) / (self.n_all + n)
            in_suffix = (at("_suffix") + STRENGTH * everywhere) / (F.col("_n_suffix") + STRENGTH)
            in_host = ((F.greatest(at("_host") - at("_share"), F.lit(0.0)) + STRENGTH * in_suffix)
                       / (F.col("_n_host") - 1 + STRENGTH))
            said = F.when(F.col("said") == "", F.lit(0.0)).otherwise(F.log((at("_said") + 1) / (self.all[k] + n + 1)))
            logs.append(at("_logs") + F.log(in_host) + said)
        out = out.withColumn("_post", F.array(*logs)).withColumn("_post", _softmax("_post")).withColumn("_post", _scaled("_post"))
        best = F.array_max("_post")
        names = F.array(*map(F.lit, [*self.languages, OTHER]))
        return out.withColumns({"language": F.get(names, (F.array_position("_post", best) - 1).cast("int")),
                                "posterior": best, "fit": F.col("_fit")})

    def identified(self, docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
        """``keep`` columns, language, posterior, fit and kept for every row of ``docs``."""
        rows = docs.select(*[c.alias(k) for k, c in keep.items()], *self._inputs(docs))
        out = self.fuse(self.shares(rows))
        # a text of no model's language is taken at its word where it declares such a language
        out = out.withColumn("_own", (F.col("language") == OTHER) & (F.col("said") != "") & ~F.col("said").isin(self.languages))
        out = out.withColumn("language", F.when(F.col("_own"), F.col("said")).otherwise(F.col("language")))
        told = (F.col("language") != OTHER) & (F.col("_own") | (F.col("fit") >= MIN_FIT)) & (F.col("posterior") >= MIN_POSTERIOR)
        return out.select(*keep, F.when(F.col("fit") != 0, F.col("language")).alias("language"),
                          F.when(F.col("fit") != 0, F.round("posterior", 6)).alias("posterior"),
                          F.round("fit", 6).alias("fit"), (told & (F.col("fit") != 0)).alias("kept"))


def has_letter(text: Column) -> Column:
    """As ``trigram_bins`` sees it: an ASCII letter or anything beyond ASCII."""
    return F.coalesce(text.rlike("[A-Za-z]|[^\\x00-\\x7F]"), F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: Column | None = None,
             address: Column | None = None) -> DataFrame:
    """key, language, posterior, fit and kept of every row; by default over documents.

    ``declared`` is the language that markup or metadata state, ``address`` a URL or host.  Texts without a letter (null
    and empty ones too) have no language and are not kept.  A null declared language or address is no evidence.  Texts of
    a language that too few texts declare for a model keep the language that they declare; without one they are
    ``other`` and not kept.  Where no language has a model, no row gets a language, and all with a letter are kept
    undecided.  An empty table gives no rows.  Repeated rows are told alike.
    """
    declared = F.col("lang") if declared is None else declared
    address = F.col("source") if address is None else address
    evidence = Evidence(docs, text, declared, address)
    if not evidence.known:
        return docs.select(F.col(key).alias(key), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(0.0).alias("fit"), has_letter(F.col(text)).alias("kept"))
    return evidence.identified(docs, {key: F.col(key)})


def identify_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The same for web pages: the language of the markup, the address suffix and the host come from the page."""
    markup = F.lower(F.regexp_extract(F.col(html), "(?i)<html[^>]*?\\slang\\s*=\\s*[\"']?([A-Za-z]{2,3})", 1))
    bare = F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    rows = pages.select(F.col(key).alias(key), bare.alias("_text"), F.nullif(markup, F.lit("")).alias("_said"),
                        F.col(url).alias("_url"))
    return identify(rows, key, "_text", F.col("_said"), F.col("_url"))


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The kept rows with the input's columns; ``lang`` becomes the identified language, if there is one."""
    evidence = Evidence(docs, text, F.col(lang), F.col(source))
    if not evidence.known:
        return docs.where(has_letter(F.col(text)))
    held = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    out = evidence.identified(docs, {h: F.col(c) for c, h in held.items()}).where("kept")
    return out.select(*[F.col("language" if c == lang else h).alias(c) for c, h in held.items()])
