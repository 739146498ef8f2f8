"""Near-duplicate classes by DartMinHash signatures and banded joining.

Signatures. A text is the weighted set of its word shingles (weight: how often it occurs). Each unit of weight of an
element owns a strip of the rank axis; hashed darts fall on it as a Poisson process (exponential gaps hashed from
element, unit and dart number, so every text sees the same darts on the same element). Darts below a rank bound that
follows the text's total weight are kept; each dart is hashed to one coordinate, and the earliest dart of a coordinate
is its value. If a coordinate stays empty, the bound is doubled. The work is about elements + k ln k darts a text, and
two texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Joining. Equal texts are one node. Nodes that share a band (``ROWS`` coordinates, ``BANDS`` bands) meet in a bucket.
No bucket is expanded into pairs: its members are compared exactly with one representative (a star), the one that meets
most others over all buckets, and links join nodes into components. Where a bucket still has several components, the metric settles it: the distances to the
representative of two linked texts differ by 1 - similarity at most, so the bucket is split at wider gaps; members whose
own shingles leave too little to share go; and what stays mixed gets representatives from its smallest components, four times as many in each round, against members that can share enough, until every bucket
has one component or all its members have been compared. No partner is left out and no count is capped. The links
found are a result too (``pairs``, and their number by document): they connect every class, without all pairs of it.

Texts of bucket members only are read again, by their places. Pairs are dealt by representative, sorted, and compared
as they stream by: the representative's text comes first and once for up to ``CHUNK`` members, so a representative of a
third of all texts is many tasks' and no side of a join is held in memory.

Null text counts as empty. Texts without words are classes of their equals. Repeated rows and repeated or null ids
are members like any other. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, blocks, located, mix, on_all_cores, table, whole_text, with_locator, worker, written
from .rows import fetched, without
from .shingles import shared_with, shingles, weighted, words

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Texts whose darts are thrown at once.
TEXTS = 256
#: Representatives that a mixed bucket gets in the first round; rounds go on until no bucket is mixed.
REPRESENTATIVES = 64
#: Members that are compared with one copy of their representative's text.
CHUNK = 500
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def dart_minhash(keys: np.ndarray, weights: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x k) and which texts have one. keys: text in the upper 20 bits, element below, in order.

    A weight's last, partial unit keeps the darts that fall below its height.
    """
    signature = np.zeros(texts * k, np.uint64)
    text = (keys >> np.uint64(44)).astype(np.int64)
    total = np.bincount(text, weights, texts)
    has = total > 0
    units = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(keys)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    height = np.minimum(np.asarray(weights, float)[at] - unit, 1.0)
    seed = mix(mix(keys[at] & np.uint64((1 << 44) - 1)) + unit.astype(np.uint64) * _GOLDEN)
    owner = text[at]
    bound = np.where(has, k * (np.log(k) + 4) / np.maximum(total, 1e-12), 0.0)
    todo = has.copy()
    while todo.any():
        live = np.flatnonzero(todo[owner])
        earliest = np.full(texts * k, np.inf)
        s, o, h = seed[live], owner[live], height[live]
        limit, rank, dart = bound[o], np.zeros(len(live)), 0
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(s):
            dart += int(_GOLDEN)
            u = mix(s + np.uint64(dart & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((u >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53)
            on = rank < limit
            s, o, h, limit, rank, u = s[on], o[on], h[on], limit[on], rank[on], u[on]
            value = mix(u ^ np.uint64(0xA0761D6478BD642F))
            slot = o * k + ((value >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            hit = (mix(value) >> np.uint64(11)).astype(float) * 2.0**-53 < h
            kept.append((slot[hit], rank[hit], value[hit]))
        slot, rank, value = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
        np.minimum.at(earliest, slot, rank)
        first = rank == earliest[slot]
        signature[slot[first]] = value[first]
        todo &= ~np.isfinite(earliest.reshape(texts, k)).all(1)
        bound = np.where(todo, bound * 2, bound)
    return signature.reshape(texts, k), has


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * _GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, text_col: str, id_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """node (SHA-256 of the text), doc_id, path, row, bands (null without words) of every row; rows move only if there are fewer splits than cores."""
    arrow_batches(docs.sparkSession)
    text = whole_text(text_col)
    inner = with_locator(docs, F.unhex(F.sha2(text.cast("binary"), 256)).alias("node"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    inner = on_all_cores(inner.select("node", "doc_id", "path", "row", "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, 4):
                keys, weights = weighted(*shingles(*words(texts), n))
                cut = [*range(0, len(texts), TEXTS), len(texts)]  # short texts have as many darts as long ones
                at = np.searchsorted(keys, np.asarray(cut, np.uint64) << np.uint64(44))
                signed = [dart_minhash(keys[i:j] - (np.uint64(a) << np.uint64(44)), weights[i:j], b - a, bands * rows) for a, b, i, j in zip(cut, cut[1:], at, at[1:], strict=False)]
                has = np.concatenate([h for _, h in signed])
                key = band_keys(np.concatenate([x for x, _ in signed]), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(key.ravel()), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=["node", "doc_id", "path", "row", "bands"])

    return inner.mapInArrow(worker(work), "node binary, doc_id long, path string, row long, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """a, b, sim, both, size_b of each pair, from whole texts: weighted Jaccard similarity, shared weight, weight of b. texts: nid, text."""
    parts = F.ceil(F.col("n") / CHUNK)
    loads = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", parts), "loads")
    heads = loads.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    heads = heads.join(texts, heads.a == texts.nid).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    members = pairs.join(loads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    members = members.join(texts, members.b == texts.nid).select("a", "part", "b", "text")
    dealt = heads.unionAll(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[np.ndarray, np.ndarray] | None = None  # of the representative whose members go on in the next block
        for batch in batches:
            for part, found in blocks(batch, 3, 250_000):
                keys, weights = weighted(*shingles(*words(found), n))
                at = np.searchsorted(keys, np.arange(len(found) + 1, dtype=np.uint64) << np.uint64(44))
                hashes = keys & np.uint64((1 << 44) - 1)
                sizes = np.diff(np.concatenate([[0], np.cumsum(weights)])[at])
                is_head = np.asarray(part.column(2).is_null())
                first = np.flatnonzero(is_head)
                both, size_a = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                for low, high in zip([0, *first.tolist()], [*first.tolist(), len(found)], strict=True):
                    if low < high and is_head[low]:
                        head = hashes[at[low] : at[low + 1]], weights[at[low] : at[low + 1]]
                        low += 1
                    if low < high:
                        both[low:high] = shared_with(*head, hashes[at[low] : at[high]], weights[at[low] : at[high]], at[low : high + 1] - at[low])
                        size_a[low:high] = head[1].sum()
                total = size_a + sizes
                sim = np.where(total > 0, both / np.maximum(total - both, 1), 0.0)
                rows = pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sim), pa.array(both), pa.array(sizes)], names=["a", "b", "sim", "both", "size_b"])
                yield rows.filter(pa.array(~is_head))

    return dealt.mapInArrow(worker(work), "a long, b long, sim double, both long, size_b long")


def shares(texts: DataFrame, n: int) -> DataFrame:
    """nid, token: a row for each unit of weight of each shingle of a text. texts: nid, text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in blocks(batch, 1, 250_000):
                keys, weights = weighted(*shingles(*words(found), n))
                at = np.repeat(np.arange(len(keys)), weights)
                unit = np.arange(len(at)) - np.repeat(np.cumsum(weights) - weights, weights)
                token = mix((keys[at] & np.uint64((1 << 44) - 1)) + unit.astype(np.uint64) * _GOLDEN)
                owner = part.column(0).to_numpy()[(keys[at] >> np.uint64(44)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(token.view(np.int64))], names=["nid", "token"])

    return texts.select("nid", "text").mapInArrow(worker(work), "nid long, token long")


def components(edges: DataFrame, most_rows: int | None = None) -> DataFrame:
    """nid, comp (least nid of its component) of every node of an edge. edges: a, b; ``most_rows``: of them, if known.

    Labels take the least label next to them, then jump to their label's label; a few rounds for star-like graphs.
    """
    most = None if most_rows is None else 2 * most_rows
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", most)
    labels = written(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("nid"), F.least("a", "l").alias("comp")), "labels", most)
    while True:
        near = both.join(labels, both.b == labels.nid).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.nid == near.a).select("nid", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("nid").alias("to"), F.col("comp").alias("over"))
        new = written(step.join(jump, "to", "left").select("nid", F.least("to", F.coalesce("over", "to")).alias("comp"), "was"), "labels", most)
        labels = new.select("nid", "comp")
        if new.where("comp <> was").isEmpty():
            return labels


class Classes:
    """Nodes, buckets, links and components of one set of documents, each a table on shared storage."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS):
        self.spark, self.n, self.similarity = docs.sparkSession, n, similarity
        docs = located(docs)
        self.sketch = written(sketches(docs, text_col, id_col, n, bands, rows), "sketch")
        first = F.min(F.struct("doc_id", "path", "row"))
        self.nodes = written(self.sketch.groupBy("node").agg(first.alias("at"), F.first("bands").alias("bands")).select(F.monotonically_increasing_id().alias("nid"), "node", "at", "bands"), "nodes")
        banded = self.nodes.select("nid", F.explode("bands").alias("key"))
        sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = written(banded.join(sizes, "key"), "shared")
        # the member that meets most others over all its buckets is the likeliest to have links to the rest
        central = shared.groupBy("nid").agg(F.sum("n").alias("meets"))
        stars = shared.join(central, "nid").groupBy("key").agg(F.max(F.struct("meets", (-F.col("nid")).alias("nid"))).alias("r"))
        self.members = written(shared.select("key", "nid").join(stars.select("key", (-F.col("r.nid")).alias("rep")), "key"), "buckets")
        self.n_members = self.members.count()
        ids = self.members.select("nid").distinct().join(self.nodes.select("nid", "at"), "nid").select("nid", F.col("at.path").alias("path"), F.col("at.row").alias("row"))
        ids = written(ids, "members", self.n_members)
        contents = fetched(docs, ids.select("path", "row"), whole_text(text_col).alias("text"))
        self.texts = written(contents.join(ids, ["path", "row"]).select("nid", "text"), "texts")
        self.rounds = 0
        self.comps = self._link()

    def links(self) -> DataFrame:
        return self.tested.where(F.col("sim") >= self.similarity)

    def _linked(self) -> DataFrame:
        """a, b, sim of each link once: two representatives may have met each other twice."""
        return self.links().groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))

    def pairs(self) -> DataFrame:
        """text_a, text_b, similarity: the links that hold the classes together, between different texts named by their text_id.

        Every class is connected by its links; pairs of one class that nothing had to compare are not among them.
        """
        of = lambda c: self.nodes.select(F.col("nid").alias(c), F.col("at.doc_id").alias(f"text_{c}"))
        return self._linked().join(of("a"), "a").join(of("b"), "b").select("text_a", "text_b", F.col("sim").alias("similarity"))

    def _mixed(self, known: DataFrame) -> DataFrame:
        """Members of the buckets that have several components."""
        several = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        return written(known.join(several, "key", "left_semi").select("key", "nid", "rep", "bin", "size", "with_rep", "rest", "comp"), "mixed", self.n_members)

    def _link(self) -> DataFrame:
        stars = self.members.where("nid <> rep").select(F.col("rep").alias("a"), F.col("nid").alias("b")).distinct()
        self.tested = written(similarities(stars, self.texts, self.n), "similarities")
        comps = components(self.links(), self.n_members)
        mixed = self._mixed(self._split().join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid")).withColumn("rest", F.col("size") - F.col("with_rep")))
        if not mixed.isEmpty():
            mixed = self._possible(mixed)
        many, gap = REPRESENTATIVES, self._gap()
        while not mixed.isEmpty():
            self.rounds += 1
            sized = mixed.join(mixed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")), ["key", "comp"])
            # of each of a few slices of a bucket, a member of the smallest component
            slices = sized.groupBy("key", F.pmod(F.xxhash64("nid"), F.lit(many)).alias("slice"))
            traits = ["comp", "nid", "bin", "size", "with_rep", "rest"]
            reps = slices.agg(F.min_by(F.struct(*traits), F.struct("n", F.xxhash64("nid"))).alias("r")).select("key", *[F.col(f"r.{c}").alias(f"r_{c}") for c in traits])
            reps = written(reps, "reps", self.n_members)
            pairs = mixed.join(reps, "key").where((F.col("comp") != F.col("r_comp")) & (F.abs(F.col("bin") - F.col("r_bin")) < gap) & self._can_link())
            pairs = pairs.select(F.least("r_nid", "nid").alias("a"), F.greatest("r_nid", "nid").alias("b")).distinct()
            known = self.tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            new = written(similarities(pairs.join(known, ["a", "b"], "left_anti"), self.texts, self.n), "similarities")
            self.tested = self.tested.union(new)  # one more table of files
            mixed = mixed.join(reps.select("key", F.col("r_nid").alias("nid")), ["key", "nid"], "left_anti")
            found = new.where(F.col("sim") >= self.similarity).select("a", "b")
            if not found.isEmpty():
                comps, to = self._merged(comps, found, new.count())
                mixed = mixed.join(to, mixed.comp == to.old, "left").withColumn("comp", F.coalesce("new", "comp"))
            mixed = self._mixed(mixed)
            many *= 4
        return comps

    def _can_link(self):
        """Whether a member and a bucket's new representative can share enough, by what each shares with the first one.

        They share at most the lesser of their shares of it, and the lesser of what else others may have of them (rest).
        """
        most = F.least("with_rep", "r_with_rep") + F.least("rest", "r_rest")
        return most * (1 + self.similarity) >= (F.col("size") + F.col("r_size")) * self.similarity - 1e-6

    def _possible(self, mixed: DataFrame) -> DataFrame:
        """Mixed buckets with ``rest`` less the shingles that no other text has, and without members that can't have a link there.

        A text of size x of which u is its own alone shares x - u at most; a similarity of t needs t / (1 + t) of both
        sizes. So partners have sizes from t * x to (x - u) * (1 + t) / t - x, and a member goes if the bucket has none.
        """
        ids = mixed.select("nid").union(mixed.select("rep")).distinct()
        counted = shares(self.texts.join(ids, "nid", "left_semi"), self.n)
        alone = counted.groupBy("token").agg(F.count(F.lit(1)).alias("texts"), F.min("nid").alias("nid")).where("texts = 1")
        alone = written(alone.groupBy("nid").agg(F.count(F.lit(1)).alias("alone")), "alone")
        placed = mixed.join(alone, "nid", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        placed = placed.withColumn("rest", F.col("rest") - F.col("alone"))
        t, x = self.similarity, F.col("size")
        bin_ = lambda v: F.floor(F.log(v) / np.log(1.02)).cast("int")
        most = (x - F.col("alone")) * ((1 + t) / t) - x
        high = F.when(most > 0, bin_(F.least(most, x / t) + 1e-6)).otherwise(-1)
        placed = placed.withColumns({"own": bin_(x), "low": bin_(x * t - 1e-6), "high": high})
        bins = placed.groupBy("key").agg(F.collect_set("own").alias("bins"))  # a few hundred bins at most
        return self._mixed(placed.join(bins, "key").where(F.exists("bins", lambda b: (b >= F.col("low")) & (b <= F.col("high")))))

    @staticmethod
    def _merged(comps: DataFrame, found: DataFrame, most_rows: int) -> tuple[DataFrame, DataFrame]:
        """Components with new links, and old -> new labels of those that changed."""
        of = lambda c: comps.select(F.col("nid").alias(c), F.col("comp").alias(f"comp_{c}"))
        ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
        ends = written(ends.select("a", "b", F.coalesce("comp_a", "a").alias("ca"), F.coalesce("comp_b", "b").alias("cb")), "ends", most_rows)
        to = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")), most_rows).select(F.col("nid").alias("old"), F.col("comp").alias("new"))
        single = ends.select(F.col("a").alias("nid"), F.col("ca").alias("comp")).union(ends.select(F.col("b").alias("nid"), F.col("cb").alias("comp"))).distinct()
        every = comps.union(single.join(comps, "nid", "left_anti"))
        return written(every.join(to, every.comp == to.old, "left").select("nid", F.coalesce("new", "comp").alias("comp")), "labels", comps.count() + 2 * most_rows), to

    def _gap(self) -> int:
        """Least difference in hundredths between distances to one text whose two texts can't be linked."""
        return int(np.ceil((1 - self.similarity) * 100 - 1e-9)) + 1

    def _split(self) -> DataFrame:
        """Buckets without their representatives, which have met all members, split where distances to it leave a gap that no link spans."""
        near = self.members.where("nid <> rep").join(self.tested, (F.col("rep") == F.col("a")) & (F.col("nid") == F.col("b")))
        near = near.select("key", "nid", "rep", F.floor((1 - F.col("sim")) * 100).cast("int").alias("bin"), F.col("size_b").alias("size"), F.col("both").alias("with_rep"))
        near = written(near, "distances", self.n_members)
        bins = near.groupBy("key").agg(F.sort_array(F.collect_set("bin")).alias("bins"))  # 101 bins at most
        starts = F.expr(f"filter(bins, (b, i) -> i = 0 or b - bins[i - 1] >= {self._gap()})")
        cut = bins.select("key", starts.alias("starts"))
        part = F.expr("size(filter(starts, s -> s <= bin))")
        return near.join(cut, "key").select(F.xxhash64("key", part).alias("key"), "nid", "rep", "bin", "size", "with_rep")

    def membership(self) -> DataFrame:
        """path, row, doc_id, class_id (least doc_id of the class), text_id (least doc_id of the equal texts), keeps (one row of a class), n_links (found from its text to others)."""
        ends = self._linked().select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count(F.lit(1)).alias("n_links"))
        nodes = self.nodes.join(self.comps, "nid", "left").join(ends, "nid", "left")
        nodes = nodes.select("node", "at", F.coalesce("comp", "nid").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        heads = nodes.groupBy("comp").agg(F.min("at").alias("head"))
        known = written(nodes.join(heads, "comp").select("node", "at", "head", "n_links"), "classes")
        rows = self.sketch.select("node", "doc_id", "path", "row").join(known, "node")
        keeps = (F.col("head.path") == F.col("path")) & (F.col("head.row") == F.col("row"))
        return rows.select("path", "row", "doc_id", F.col("head.doc_id").alias("class_id"), F.col("at.doc_id").alias("text_id"), keeps.alias("keeps"), "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns."""
    docs = located(docs)
    return without(docs, Classes(docs, id_col, text_col, **how).membership().where("not keeps"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classes(table(spark, sf_dir, "documents")).membership().select("doc_id", "class_id", "text_id", F.col("keeps").alias("kept"), "n_links")
