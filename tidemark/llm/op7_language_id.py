"""Language identification by Bayesian evidence fusion.

Each language is a class, and so is "unknown" (``und``). Evidence that is combined by Bayes' rule:
- text: log-likelihood of all letter trigrams of the whole text under a smoothed model of each language (``und``: every
  trigram bucket alike), tempered since trigrams overlap;
- markup: the language that an ``<html lang=...>`` tag or a given column declares, trusted by ``TRUST``;
- address: the host's prior, smoothed towards its suffix's (the last label of the host), which is smoothed towards the
  overall one. These are sums of text posteriors by grouped aggregation, without the document's own share.

The trigram models are trained here on at most ``SAMPLE`` rows of each language that a column labels (those whose keys
hash lowest); their trigrams are counted by the workers, and the driver gets a count for each bucket and language.
Of equally likely languages the first in the alphabet is taken.

Null and empty texts, and texts without letters, have no text evidence; a document is ``und`` and not kept if ``und`` is
likeliest or nothing but the overall prior speaks for a language. A null host (or url) has the overall prior. Repeated
rows are judged alike. Very long texts are read whole. An empty table gives an empty result. Extra columns are not read; those of a filtered table
stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, blocks, located, on_all_cores, per_key, table, whole_text, with_locator, worker, written
from .rows import fetched, without

SAMPLE, BUCKETS = 1_000, 1 << 14
TEMPER, TRUST, UNKNOWN = 0.3, 0.9, 0.01
#: Documents that the prior above weighs as, for a host and for a suffix.
HOST_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0
_LETTER = np.array([chr(i).isalpha() for i in range(0x250)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams of the texts, and the index of the text of each. What is no letter reads as a space.

    A trigram belongs to the text of its middle letter; one space before and two after a text keep texts apart.
    """
    joined = " " + "  ".join(texts).lower() + "  "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # lower() may lengthen a text, so lengths are taken after it
    sizes = np.array([len(t.lower()) + 2 for t in texts]) if len(joined) != sum(map(len, texts)) + 2 * len(texts) + 1 else np.array([len(t) + 2 for t in texts])
    letter = np.where(points < 0x250, _LETTER[np.minimum(points, 0x24F)], True)
    c = np.where(letter, points, 32).astype(np.uint64)
    n = len(c) - 2
    take = letter[:n] | letter[1 : n + 1]
    take &= letter[1 : n + 1] | letter[2:]
    at = np.flatnonzero(take)
    h = c[at] * np.uint64(0x9E3779B97F4A7C15) + c[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 2] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(50)).astype(np.int32), np.searchsorted(np.cumsum(sizes), at, side="right")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, log-probabilities

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tempered, for each text: each language, then unknown; and how many trigrams it has."""
        bucket, text = trigrams(texts)
        counts = np.bincount(text, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.languages) + 1))
        for i in range(len(self.languages)):
            sums[:, i] = np.bincount(text, self.table[:, i][bucket], len(texts))
        sums[:, -1] = -counts * np.log(BUCKETS)
        return sums * TEMPER, counts


def model_of(counts: dict[str, np.ndarray]) -> Model:
    """counts: how often each bucket occurs in each language."""
    languages = sorted(counts)
    logs = [np.log((counts[x] + 0.1) / (counts[x].sum() + 0.1 * BUCKETS)) for x in languages]
    return Model(languages, np.array(logs, np.float32).reshape(len(languages), BUCKETS).T.copy())


def train(rows: list[tuple[str | None, str | None]]) -> Model:
    """rows: text, language. Rows without a language don't count."""
    counts: dict[str, np.ndarray] = {}
    for text, language in rows:
        if language:
            counts.setdefault(language, np.zeros(BUCKETS))
            counts[language] += np.bincount(trigrams([text or ""])[0], minlength=BUCKETS)
    return model_of(counts)


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, most: int = SAMPLE) -> Model:
    """A model trained on at most ``most`` rows of each language, whatever share of all rows it has. ``docs``: read from files."""
    arrow_batches(docs.sparkSession)
    label = F.col(f"`{label_col}`").cast("string")
    rows = with_locator(docs, label.alias("language"), F.xxhash64(F.col(f"`{id_col}`")).alias("h")).where("language <> ''")
    sizes = written(rows.groupBy("language").agg(F.count(F.lit(1)).alias("n")), "languages")
    # of a language with many rows a share that has enough; what is ranked is then bounded for each language
    share = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(2.0 * most * (1 << 30)) / F.col("n")
    order = Window.partitionBy("language").orderBy("h", "path", "row")
    chosen = per_key(rows, sizes, "language", F.col("row")).where(share).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    texts = fetched(docs, written(chosen.select("path", "row"), "sample"), label.alias("language"), whole_text(text_col).alias("text")).select("language", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in blocks(batch, 1):
                names = part.column(0).dictionary_encode()
                code = np.asarray(names.indices)
                bucket, text = trigrams(found)
                key, n = np.unique(code[text].astype(np.int64) * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(key // BUCKETS)), pa.array(key % BUCKETS), pa.array(n.astype(np.int64))], names=["language", "bucket", "n"])

    counted = texts.mapInArrow(worker(work), "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts = {r[0]: np.zeros(BUCKETS) for r in sizes.select("language").collect()}
    for language, bucket, n in counted.collect():  # at most BUCKETS rows a language
        counts[language][bucket] = n
    return model_of(counts)


def declared_in(text: Column) -> Column:
    """Two letters of the language that an html tag declares, or null."""
    found = F.regexp_extract(text, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)
    return F.when(text.rlike("<[Hh][Tt][Mm][Ll]"), F.nullif(F.lower(found), F.lit("")))


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str, host: Column, declared: Column | None) -> DataFrame:
    """path, row, doc_id, host, suffix, declared, n, text_ll of every row; rows move only if there are fewer splits than cores."""
    arrow_batches(docs.sparkSession)
    text = whole_text(text_col)
    says = declared_in(text) if declared is None else F.lower(F.substring(declared, 1, 2))
    inner = with_locator(docs, F.col(f"`{id_col}`").cast("long").alias("doc_id"), host.cast("string").alias("host"), says.alias("declared"), text.alias("text"))
    inner = on_all_cores(inner.select("path", "row", "doc_id", "host", "declared", "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(model.languages) + 1
        for batch in batches:
            for part, texts in blocks(batch, 5):
                sums, counts = model.log_likelihoods(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts.astype(np.int64)), lists], names=["path", "row", "doc_id", "host", "declared", "n", "text_ll"])

    return inner.mapInArrow(worker(work), "path string, row long, doc_id long, host string, declared string, n long, text_ll array<double>")


def _normalised(logs: Column) -> Column:
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """path, row, doc_id, lang, posterior, kept. rows: as ``scored`` gives them, on shared storage."""
    k = len(languages)
    uniform = [(1 - UNKNOWN) / k] * k + [UNKNOWN] if k else [1.0]
    flat = F.array(*map(F.lit, uniform))
    rows = rows.withColumn("suffix", F.regexp_extract(F.coalesce("host", F.lit("")), r"\.([^.]+)$", 1))
    rows = rows.withColumn("own", _normalised(F.zip_with("text_ll", flat, lambda x, p: x + F.log(p))))
    speaks = F.when(F.col("n") > 0, 1.0).otherwise(0.0)  # documents without letters say nothing about their host
    totals = lambda prefix: [F.sum(F.col("own")[i] * speaks).alias(f"{prefix}{i}") for i in range(k + 1)]
    by_host = written(rows.groupBy("host", "suffix").agg(*totals("h")), "hosts")
    by_suffix = by_host.groupBy("suffix").agg(*[F.sum(f"h{i}").alias(f"s{i}") for i in range(k + 1)])
    whole = [x or 0.0 for x in by_host.agg(*[F.sum(f"h{i}") for i in range(k + 1)]).first()]  # one row
    overall = F.array(*[F.lit((n + p * 10) / (sum(whole) + 10)) for n, p in zip(whole, uniform, strict=True)])
    pack = lambda prefix: F.array(*[F.coalesce(f"{prefix}{i}", F.lit(0.0)) for i in range(k + 1)])
    smoothed = lambda counts, up, weight: F.zip_with(counts, up, lambda n, p: (n + p * weight) / (F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) + weight))
    suffixes = by_suffix.select("suffix", smoothed(pack("s"), overall, SUFFIX_WEIGHT).alias("up"))
    hosts = written(by_host.join(suffixes, "suffix").where("host is not null").select("host", pack("h").alias("counts"), "up"), "priors")
    known = per_key(rows, hosts, "host", F.col("row"))
    without_own = F.zip_with("counts", "own", lambda n, o: F.greatest(n - o * speaks, F.lit(0.0)))
    prior = F.when(F.col("counts").isNotNull(), smoothed(without_own, F.col("up"), HOST_WEIGHT)).otherwise(overall)
    known = known.withColumn("prior", prior)
    markup = F.array(*[F.when(F.col("declared") == x, TRUST).when(F.col("declared").isin(languages), (1 - TRUST) / max(k - 1, 1)).otherwise(1.0) for x in languages], F.when(F.col("declared").isin(languages), (1 - TRUST) / max(k - 1, 1)).otherwise(1.0))
    logs = F.zip_with(F.zip_with("text_ll", "prior", lambda x, p: x + F.log(F.greatest(p, F.lit(1e-9)))), markup, lambda x, p: x + F.log(p))
    out = known.withColumn("posteriors", _normalised(logs))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    out = out.withColumn("best", best)
    evidence = (F.col("n") > 0) | F.coalesce(F.col("declared").isin(languages), F.lit(False)) | (F.aggregate(without_own, F.lit(0.0), lambda a, b: a + b) > 0)
    kept = (F.col("best") <= k) & F.coalesce(evidence, F.lit(False))
    lang = F.when(kept, F.element_at(F.array(*map(F.lit, [*languages, "und"])), F.col("best"))).otherwise("und")
    return out.select("path", "row", "doc_id", lang.alias("lang"), F.array_max("posteriors").alias("posterior"), kept.alias("kept"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, declared: Column | None = None, label_col: str = "lang", model: Model | None = None) -> DataFrame:
    """path, row, doc_id, lang, posterior, kept of every row. ``docs`` must be read from files, or is copied to some.

    Without a model, one is trained on a bounded sample of the rows that ``label_col`` labels.
    """
    docs = located(docs)
    if model is None:
        model = fit(docs, id_col, text_col, label_col)
    host = F.lit(None) if host is None else host
    return fuse(written(scored(docs, model, id_col, text_col, host, declared), "scored"), model.languages)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, **how) -> DataFrame:
    """``docs`` without the rows whose language is unknown."""
    docs = located(docs)
    return without(docs, identify(docs, id_col, text_col, host, **how).where("not kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address; their source stands for the host."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, host=F.col("source")).select("doc_id", "lang", F.round("posterior", 6).alias("posterior"), "kept")
