"""Quality scores by a byte-level convolutional network in numpy.

The UTF-8 bytes of the whole text are embedded; learned filters run over overlapping chunks of ``WIDTH`` bytes, one every
``STRIDE`` bytes from the first to the last; each filter's greatest response over the whole text is kept, and a logistic
unit combines these into one probability. Training is by Adam on the log loss, on at most ``SAMPLE`` labelled rows (those
whose ids hash lowest, each whole, as far as ``TRAIN_BYTES`` go round) that are not held out: a row is held out if the
CRC-32 of its id as text is 2 modulo 4. Nothing but the text enters a score. Very long texts are scored in whole.

Null text counts as empty; an empty text is one chunk of padding and has a score like any other. Without labelled rows
every score is 0.5. Null ids are not held out and don't train; of several labels of an id the greatest counts, of several
texts the first in order. Repeated rows get the same score. An empty table gives an empty result.
Extra columns stay, but for ones named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, blocks, on_all_cores, table, whole_text, worker, written

WIDTH, STRIDE, EMBED, FILTERS = 12, 4, 8, 32
SAMPLE, EPOCHS, BATCH, RATE, THRESHOLD = 4_000, 12, 32, 0.004, 0.7
#: Bytes of text that training takes; a row that would go beyond is left out.
TRAIN_BYTES = 64 << 20


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (0: padding, else byte + 1) of all texts, and the first and the last but one chunk of each text."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(c) for c in coded])
    chunks = np.maximum(-(-sizes // STRIDE), 1)
    room = chunks * STRIDE + WIDTH - STRIDE
    starts = np.cumsum(room) - room
    symbols = np.zeros(int(room.sum()), np.int16)
    for c, s in zip(coded, starts, strict=True):
        symbols[s : s + len(c)] = np.frombuffer(c, np.uint8)
        symbols[s : s + len(c)] += 1
    return symbols, starts // STRIDE, starts // STRIDE + chunks


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def chunks(self, symbols: np.ndarray) -> np.ndarray:
        flat = self.embed[symbols].ravel()
        n = (len(symbols) - WIDTH) // STRIDE + 1
        step = flat.itemsize
        return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * EMBED), (STRIDE * EMBED * step, step))

    def scores(self, texts: list[str]) -> np.ndarray:
        symbols, first, last = padded(texts)
        response = self.chunks(symbols) @ self.filters
        ends = np.column_stack([first, last]).ravel()
        if ends[-1] == len(response):
            ends = ends[:-1]
        pooled = np.maximum(np.maximum.reduceat(response, ends, axis=0)[::2] + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.offset, -30, 30).astype(float)))


def gradient(net: Network, symbols: np.ndarray, label: float, weight: float = 1.0) -> dict[str, np.ndarray]:
    """The log loss of one text, times ``weight``, by each parameter; by embed as positions (symbols) and values."""
    x = net.chunks(symbols)
    response = x @ net.filters
    best = response.argmax(0)
    pooled = np.maximum(response[best, np.arange(response.shape[1])] + net.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.offset, -30, 30)))
    d = np.float32((p - label) * weight)
    back = d * net.weights * (pooled > 0)
    at = best[:, None] * STRIDE + np.arange(WIDTH)
    return {"offset": d, "weights": d * pooled, "bias": back, "filters": x[best].T * back, "at": symbols[at], "embed": (net.filters.T * back[:, None]).reshape(-1, WIDTH, EMBED)}


def train(rows: list[tuple[str | None, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """rows: text, label 0 or 1."""
    rng = np.random.default_rng(seed)
    rows = [(t or "", int(y)) for t, y in rows if y is not None]
    net = Network(rng.normal(0, 0.5, (257, EMBED)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), 0.0)
    if not rows:
        net.weights[:] = 0
        return net
    mean = np.clip(np.mean([y for _, y in rows]), 0.01, 0.99)
    net.offset = float(np.log(mean / (1 - mean)))
    data = [padded([t])[0] for t, _ in rows]
    labels = np.array([y for _, y in rows], float)
    names = ("embed", "filters", "bias", "weights", "offset")
    moments = {n: [np.zeros_like(getattr(net, n), dtype=np.float32), np.zeros_like(getattr(net, n), dtype=np.float32)] for n in names}
    step, steps = 0, epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            grad = {n: np.zeros_like(getattr(net, n), dtype=np.float32) for n in names}
            for i in batch:
                one = gradient(net, data[i], labels[i], 1 / len(batch))
                np.add.at(grad["embed"], one.pop("at"), one.pop("embed"))
                for n, g in one.items():
                    grad[n] += g
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grad[n] - m)
                v += 0.001 * (grad[n] ** 2 - v)
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, getattr(net, n) - (float(move) if n == "offset" else move))
    return net


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network trained on a bounded sample of the labelled rows that are not held out."""
    usable = labels.where(~held_out(id_col) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    one_label = usable.groupBy(F.col(f"`{id_col}`").alias("id__")).agg(F.max(F.col(f"`{label_col}`")).cast("int").alias("label__"))
    chosen = one_label.orderBy(F.xxhash64("id__"), "id__").limit(SAMPLE).collect()
    if not chosen:
        return train([])
    place = {r["id__"]: i for i, r in enumerate(chosen)}
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], one_label.schema)  # SAMPLE rows at most
    texts = docs.select(F.col(f"`{id_col}`").alias("id__"), whole_text(text_col).alias("text__")).join(F.broadcast(ids), "id__")
    texts = written(texts.groupBy("id__").agg(F.min("text__").alias("text__"), F.max("label__").alias("label__")), "labelled")
    left, taken = TRAIN_BYTES, []
    for i, size in sorted(texts.select("id__", F.octet_length("text__")).collect(), key=lambda r: place[r[0]]):
        if size <= left:
            left -= size
            taken.append((i,))
    wanted = docs.sparkSession.createDataFrame(taken, ids.select("id__").schema)
    rows = texts.join(F.broadcast(wanted), "id__").collect()  # TRAIN_BYTES at most
    return train([(r["text__"], r["label__"]) for r in sorted(rows, key=lambda r: place[r["id__"]])])


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """Adds ``score`` to every row; no shuffle."""
    arrow_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "score"]
    names = [f"c{i}" for i in range(len(kept))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], whole_text(text_col).alias("text_"))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, inner.schema.fields[:-1], strict=True)] + [T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, len(names), 250_000):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(net.scores(texts))], names=[*names, "score"])

    return inner.mapInArrow(worker(work), schema).select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    # only the text and the id go through the workers; the id takes no part in the score
    scored = score(on_all_cores(docs), net).select("doc_id", F.round("score", 6).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
