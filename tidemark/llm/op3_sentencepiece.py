"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the vocabulary has a whitespace marker after another character, so no merge crosses the start of a
marked word: each marked word (its run of markers, then what follows up to the next marker) is segmented alone.
A worker keeps a table of distinct chunks; each is segmented by the library once, and the ids of all texts of a
block are put together by position with one gather. The table lives in the task: it needs no shuffle of words,
is rebuilt after an executor is lost, and starts anew when it outgrows its bound, which changes no result.

Null text counts as empty: no ids, decoded "". Repeated rows have the same ids; very long texts are encoded whole; an empty
table gives an empty result. Extra columns are kept, but for ones named like an output
(``ids``, ``n_tokens``, ``decoded``), which the output replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, blocks, on_all_cores, table, whole_text, worker

MARK = "▁"
MODEL = "piece_bpe_32k.model"
_CHUNK = re.compile(" +[^ ]*")
#: Bounds of a worker's table: chunks, and characters in them.
TABLE_CHUNKS, TABLE_CHARS = 200_000, 8_000_000


class ChunkTable:
    """chunk -> row; row -> ids and decoded text."""

    def __init__(self, model_path: str, most: int = TABLE_CHUNKS, chars: int = TABLE_CHARS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.most, self.chars = most, chars
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        bad = [p for i, p in enumerate(pieces) if re.search(f"[^{MARK}]{MARK}", p) and not self.sp.is_control(i)]
        if bad:
            raise ValueError(f"pieces cross whitespace markers, such as {bad[0]!r}; chunks can't be segmented alone")
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.texts: list[str] = []
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.held = 0

    def learn(self, chunks: set[str]) -> None:
        """Segments the chunks that the table lacks. The library puts the first marker itself."""
        if len(self.rows) + len(chunks) > self.most or self.held > self.chars:
            self.clear()
        new = [c for c in chunks if c not in self.rows]
        if not new:
            return
        # a marker alone ends a text; the library would take what follows it for an empty text
        ids = [x if c != " " else [self.sp.piece_to_id(MARK)] for c, x in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1), strict=True)]
        at = len(self.rows)
        self.rows.update((c, at + i) for i, c in enumerate(new))
        # decode() drops the marker that encode() put first, and only that one
        self.texts += [" " + x if c != " " else " " for c, x in zip(new, self.sp.decode(ids, num_threads=1), strict=True)]
        self.held += sum(map(len, new))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """ids of all texts one after the other, the offset of each text in them, decoded texts."""
        split = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self.learn(set().union(*split))
        rows = [list(map(self.rows.__getitem__, x)) for x in split]
        decoded = ["".join(map(self.texts.__getitem__, x))[1:] for x in rows]
        per_text = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter((r for x in rows for r in x), np.int64, int(per_text.sum()))
        n = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], n)]
        return ids, ends[np.concatenate([[0], np.cumsum(per_text)])], decoded


def encode(docs: DataFrame, text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Adds ``n_tokens`` long, ``ids`` array<int> and ``decoded`` string to every row."""
    arrow_batches(docs.sparkSession)
    outputs = ("n_tokens", "ids", "decoded")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    names = [f"c{i}" for i in range(len(kept))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], whole_text(text_col).alias("text_"))
    types = [f.dataType for f in inner.schema.fields[:-1]]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        chunks = ChunkTable(model_path or public_tokenizers.path(MODEL))
        for batch in batches:
            for part, texts in blocks(batch, len(names)):
                ids, ends, decoded = chunks.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(ends)), lists, pa.array(decoded, pa.string())], names=[*names, *outputs])

    out = inner.mapInArrow(worker(work), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], *outputs)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = on_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return digests(encode(docs))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
