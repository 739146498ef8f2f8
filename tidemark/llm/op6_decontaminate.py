"""Benchmark decontamination by seeds one edit apart, stretches by bit vectors and exact edit verification.

Texts are compared in lower case with runs of white space as one space. A passage is a hit if its edit distance to the
whole item is at most (1 - ``SIMILARITY``) of the item's length, wherever it begins: white space has no part in it.

Seeds. Two windows of n letters that are one edit apart are equal once each has lost one letter, so every window has n
keys. An item's length says how long a stretch with one edit at most is in ``TARGET`` of all passages at the full
distance, its edits at random places (``seed_span``); a seed is the longest of ``SEEDS`` that it holds. What a
stretch is longer than its seed is left out between seeds in texts and in items, so that one pair of each such stretch is
still compared. Shorter items thus have shorter seeds, and more of them. A seed that an item and a text share is
dropped unless the item's ``WORD`` letters around it are within their part of the distance and three standard deviations
(for items of up to ``WORD`` letters: within the distance) by bit-parallel dynamic programming, all candidates side by
side. Every other candidate is verified exactly: the least edit distance of the whole item to any passage there. Tests
hold the recall by length, at distances up to the full one, against the target ``RECALL``.

Items of less than ``SHORT`` letters are found without loss: one of k + 1 pieces survives k edits, and the distance is
taken around each place of each piece. So many passages of a text may be near to such an item that only the nearest
count, and of equal ones those that begin and end with a word; every pair of a document and an item is found.

Items are taken in blocks of ``ITEMS``, each one index of bounded size that goes to the workers and is held against all
documents; nothing is shuffled.

Null and empty items match nothing; null text counts as empty. Repeated documents and items are reported as often as
they occur. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, blocks, located, on_all_cores, table, whole_text, with_locator, worker
from .rows import without

SIMILARITY, RECALL = 0.8, 0.95
#: Letters that a seed may have; the share of passages that seeds are chosen for, and how many are drawn to choose them.
SEEDS = (4, 6, 8, 10, 12)
TARGET, TRIALS = (1 + RECALL) / 2, 400
#: Letters that a machine word holds an item's stretch of; how far such a stretch may have moved against its seed.
WORD, DRIFT = 64, 12
PAD = SEEDS[-1] + 1
CHUNK, BITS = 65_536, 23
ITEMS, SHORT = 5_000, 32
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)])


def normalise(text: str) -> tuple[str, np.ndarray]:
    """The text in lower case with single spaces, and the position of each of its characters in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.where(points <= 0x3000, _SPACE[np.minimum(points, 0x3000)], False)
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return np.where(space, 32, points)[at].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eight-bit letters of texts, lower case and single spaces, padded after each; where texts start."""
    joined = ("\0" * PAD).join(texts) + "\0" * PAD
    low = joined.lower()
    if len(low) != len(joined):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.where(points <= 0x3000, _SPACE[np.minimum(points, 0x3000)], False)
    keep = ~space
    keep[1:] |= ~space[:-1]
    sizes = np.array([len(t) + PAD for t in texts])
    first = np.cumsum(sizes) - sizes
    kept_before = np.cumsum(keep)
    begin = np.where(first > 0, kept_before[first - 1], 0)
    # single spaces across texts can't merge: padding lies between them
    points = np.where(space, 32, points)[keep]
    letters = (points ^ (points >> np.uint32(8))).astype(np.uint8)
    return letters, begin


@functools.lru_cache(maxsize=4096)
def seed_span(size: int, most: int) -> int:
    """Letters of the longest stretch with one edit at most that ``TARGET`` of passages with ``most`` edits at random places have.

    Never less than what some piece of the item must keep wherever the edits are (pigeonhole).
    """
    least = max(1, size // (most // 2 + 1))
    if most < 2:
        return least
    rng = np.random.default_rng(size)
    edits = np.sort(rng.random((TRIALS, size)).argpartition(most - 1, axis=1)[:, :most], axis=1)
    edge = np.concatenate([np.full((TRIALS, 1), -1), edits, np.full((TRIALS, 1), size)], axis=1)
    return max(least, int(np.quantile((edge[:, 2:] - edge[:, :-2] - 1).max(axis=1), 1 - TARGET, method="lower")))


class Seeds:
    """Keys of all windows of ``n`` letters: each without one of its letters, so that windows one edit apart share a key."""

    def __init__(self, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.n, self.value = n, rng.integers(1, 1 << 32, 256, dtype=np.uint32)
        base = int(rng.integers(0, 1 << 31)) * 2 + 1
        self.power = [np.uint32(pow(base, i, 1 << 32)) for i in range(n)]

    def keys(self, letters: np.ndarray, step: int = 1) -> Iterator[np.ndarray]:
        """For each letter left out, the keys of the windows from every ``step``-th place on. The same array each time."""
        places = len(letters) - self.n + 1
        value = self.value.take(letters)
        change = value[:-1] - value[1:]
        key = np.zeros(-(-places // step), np.uint32)
        for i in range(1, self.n):
            key += value[i : i + places : step] * self.power[i - 1]
        yield key
        for i in range(self.n - 1):
            key += change[i : i + places : step] * self.power[i]
            yield key


class Table:
    """The seeds of those items that have seeds of ``n`` letters."""

    def __init__(self, n: int, step: int, letters: np.ndarray, at: np.ndarray, item: np.ndarray, shift: np.ndarray):
        """step: of the places in texts; at: where the seeds are in letters; shift: in their items."""
        self.seeds, self.step, self.item, self.shift = Seeds(n), step, item, shift
        keys = np.concatenate([k[at] for k in self.seeds.keys(letters)])
        both = np.unique((keys.astype(np.uint64) << np.uint64(32)) + np.tile(np.arange(len(at), dtype=np.uint64), n))
        self.known, self.first = np.unique((both >> np.uint64(32)).astype(np.uint32), return_index=True)
        self.first = np.append(self.first, len(both))
        self.window = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.bits = min(BITS, max(16, int(np.ceil(np.log2(128 * len(self.known) + 1)))))
        self.maybe = []
        for i in range(2):
            known = np.zeros(1 << self.bits, bool)
            known[self._slot(self.known, i)] = True
            self.maybe.append(np.packbits(known, bitorder="little"))

    def _slot(self, keys: np.ndarray, i: int) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) if i else keys) >> np.uint32(32 - self.bits)

    def _maybe(self, keys: np.ndarray, i: int) -> np.ndarray:
        slot = self._slot(keys, i)
        byte = self.maybe[i].take(slot >> np.uint32(3), mode="clip")
        return np.flatnonzero((byte >> (slot & np.uint32(7)).astype(np.uint8)) & np.uint8(1))

    def found(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows that share a key with an item's, and the numbers of those."""
        out, n = [np.zeros(0, np.int64)], self.seeds.n
        for begin in range(0, len(letters) - n + 1, CHUNK * self.step):  # what a chunk touches stays in the cache
            for keys in self.seeds.keys(letters[begin : begin + CHUNK * self.step + n - 1], self.step):
                at = self._maybe(keys, 0)
                at = at[self._maybe(keys[at], 1)]
                key = keys[at]
                row = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
                good = self.known[row] == key
                row, at = row[good], at[good]
                times = self.first[row + 1] - self.first[row]
                of = np.repeat(self.first[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                out.append(np.repeat(at * self.step + begin, times) * len(self.item) + self.window[of])
        return np.divmod(np.unique(np.concatenate(out)), len(self.item))


class Matcher:
    """One pattern: the least edit distance to any passage of a text, and where that passage ends (Myers' bit vectors)."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.mask = defaultdict(int)
        for i, c in enumerate(pattern):
            self.mask[c] |= 1 << i
        self.full, self.top = (1 << self.n) - 1, 1 << (self.n - 1)

    def scores(self, text: str) -> Iterator[int]:
        """For each letter, the least distance to any passage that ends with it."""
        positive, negative, score = self.full, 0, self.n
        get = self.mask.get
        for c in text:
            eq = get(c, 0)
            x = eq | negative
            d = (((eq & positive) + positive) ^ positive) | eq | negative
            up = negative | (~(d | positive) & self.full)
            down = positive & d
            if up & self.top:
                score += 1
            elif down & self.top:
                score -= 1
            up, down = (up << 1) & self.full, (down << 1) & self.full
            positive = down | (~(x | up) & self.full)
            negative = up & x
            yield score

    def best(self, text: str, enough: int = 1 << 30) -> tuple[int, int]:
        """May end early, with what it has found, once nothing of at most ``enough`` can follow."""
        least, end = self.n, 0
        hopeless = len(text) + enough  # the score falls by one a letter at most
        for j, score in enumerate(self.scores(text), 1):
            if score < least:
                least, end = score, j
            elif score + j > hopeless and least > enough:
                break
        return least, end


class Index:
    """Keys of the windows of a block of items. items: (item id, text)."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY):
        self.items = [(i, normalise(t or "")[0].strip()) for i, t in items]
        self.items = [(i, t) for i, t in self.items if t]
        self.similarity = similarity
        self.matchers: dict[int, tuple[Matcher, Matcher]] = {}
        self.short = [n for n, (_, t) in enumerate(self.items) if len(t) < SHORT]
        long = [n for n, (_, t) in enumerate(self.items) if len(t) >= SHORT]
        self.tables: list[Table] = []
        self.sizes = np.array([len(t) for _, t in self.items], np.int64)
        self.most = (self.sizes * (1 - similarity) + 1e-9).astype(np.int64)
        if not long:
            return
        letters, begin = _letters([self.items[n][1] for n in long])
        kinds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for first, n in zip(begin.tolist(), long, strict=True):
            size = int(self.sizes[n])
            like = min(size // 16 * 16, 512)  # no more is kept of longer ones
            span = min(seed_span(like, int(like * (1 - similarity) + 1e-9)), size)
            kind = max((k for k in SEEDS if k <= span), default=span)
            kinds[kind].append((first, n, span - kind + 1))
        for kind, those in sorted(kinds.items()):
            # a common stretch has ``span - kind + 1`` pairs of seeds side by side: if the steps in texts and in the item
            # have no common divisor and no greater product, one pair is compared
            step = min(room for _, _, room in those)
            shifts = []
            for _, n, room in those:
                own = max(k for k in range(1, room // step + 1) if math.gcd(k, step) == 1)
                shifts.append(np.arange(0, int(self.sizes[n]) - kind + 1, own))
            at = np.concatenate([first + shift for (first, _, _), shift in zip(those, shifts, strict=True)])
            item = np.repeat([n for _, n, _ in those], [len(shift) for shift in shifts])
            self.tables.append(Table(kind, step, letters, at, item, np.concatenate(shifts)))

        # what an item's stretch of WORD letters from every WORD / 2 has in common with a letter, as bits
        self.part = np.minimum(self.sizes, WORD)
        parts = np.where(self.sizes >= SHORT, -(-(self.sizes - self.part) // (WORD // 2)) + 1, 0)
        self.first_part = np.cumsum(parts) - parts
        self.mask = np.zeros((int(parts.sum()), 256), np.uint64)
        for first, n in zip(begin.tolist(), long, strict=True):
            for i in range(parts[n]):
                low = first + self._part(n, i)
                np.bitwise_or.at(self.mask[self.first_part[n] + i], letters[low : low + self.part[n]], np.uint64(1) << np.arange(self.part[n], dtype=np.uint64))
        usual = self.part * (1 - similarity)
        self.bound = np.minimum(self.most, np.ceil(usual + 3 * np.sqrt(usual * similarity)).astype(np.int64))

    def _part(self, item, i):
        """Where an item's i-th stretch begins."""
        return np.minimum(i * (WORD // 2), self.sizes[item] - self.part[item])

    def _near(self, letters: np.ndarray, place: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Which seeds' stretches of their items are within the stretch's bound near the place, by bit vectors side by side."""
        good = np.zeros(len(item), bool)
        i = np.maximum(shift + SEEDS[-1] // 2 - WORD // 4, 0) // (WORD // 2)
        i = np.minimum(i, -(-(self.sizes[item] - self.part[item]) // (WORD // 2)))
        begin = place - shift + self._part(item, i) - DRIFT
        one = np.uint64(1)
        for start in range(0, len(item), 4_096):
            part = slice(start, start + 4_096)
            row, at, size = self.first_part[item[part]] + i[part], begin[part], self.part[item[part]]
            top = (size - 1).astype(np.uint64)
            positive, negative = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
            score, least = size.astype(np.uint64), size.astype(np.uint64)
            x, d, up, down = (np.empty(len(at), np.uint64) for _ in range(4))
            mask, row = self.mask.ravel(), row * 256
            for step in range(int(size.max()) + 2 * DRIFT):
                eq = mask.take(row + letters.take(at + step, mode="clip"))
                np.bitwise_or(eq, negative, out=x)
                np.bitwise_and(eq, positive, out=d)
                d += positive
                d ^= positive
                d |= eq
                np.bitwise_or(d, positive, out=up)
                np.invert(up, out=up)
                up |= negative
                np.bitwise_and(positive, d, out=down)
                np.right_shift(up, top, out=d)
                d &= one
                score += d
                np.right_shift(down, top, out=d)
                d &= one
                score -= d
                np.minimum(least, score, out=least)
                up <<= one
                down <<= one
                np.bitwise_or(x, up, out=positive)
                np.invert(positive, out=positive)
                positive |= down
                np.bitwise_and(up, x, out=negative)
            good[part] = least.astype(np.int64) <= self.bound[item[part]]
        return good

    def candidates(self, texts: list[str]) -> dict[int, set[tuple[int, int]]]:
        """text -> (item, place in the normalised text where the item would start)."""
        found: dict[int, set[tuple[int, int]]] = defaultdict(set)
        if not self.tables or not texts:
            return found
        letters, begin = _letters(texts)
        for known in self.tables:
            place, window = known.found(letters)
            item, shift = known.item[window], known.shift[window]
            good = self._near(letters, place, item, shift)
            place, item, shift = place[good], item[good], shift[good]
            text = np.searchsorted(begin, place, side="right") - 1
            for t, i, p in zip(text.tolist(), item.tolist(), (place - begin[text] - shift).tolist(), strict=True):
                found[t].add((i, p))
        return found

    def _matcher(self, i: int) -> tuple[Matcher, Matcher]:
        if i not in self.matchers:
            self.matchers[i] = Matcher(self.items[i][1]), Matcher(self.items[i][1][::-1])
        return self.matchers[i]

    def _nearest(self, i: int, text: str) -> list[tuple[int, int, int]]:
        """Distance, start and end of the passages of a text that are nearest to a short item, within its distance."""
        pattern, most = self.items[i][1], int(self.most[i])
        size, regions = len(pattern), []
        cuts = [size * p // (most + 1) for p in range(most + 2)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):  # one of most + 1 pieces is left as it is
            at = text.find(pattern[low:high])
            while at >= 0:
                regions.append((max(0, at - low - most), at - low + size + most))
                at = text.find(pattern[low:high], at + 1)
        there, back = self._matcher(i)
        passages, begin, end = [], 0, -1
        for low, high in [*sorted(regions), (1 << 62, 0)]:
            if low <= end:
                end = max(end, high)
                continue
            for j, distance in enumerate(there.scores(text[begin : end + 1]) if end >= 0 else (), begin + 1):
                if distance <= most:
                    start = j - back.best(text[max(0, j - size - most) : j][::-1])[1]
                    glued = text[max(start - 1, 0) : start + 1].isalnum() * (start > 0) + text[j - 1 : j + 1].isalnum() * (j < len(text))
                    passages.append((distance, glued, start, j))
            begin, end = low, high
        passages.sort()
        out: list[tuple[int, int, int]] = []
        for distance, glued, start, stop in passages:
            if (distance, glued) == passages[0][:2] and all(stop <= s or start >= e for _, s, e in out):
                out.append((distance, start, stop))
        return out

    def hits(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """text, item id, distance, start, end (in the text as it is) of every passage that is near to an item."""
        found = self.candidates(texts)
        for t in sorted(found) if not self.short else range(len(texts)):
            text, at = normalise(texts[t])
            spans: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for i, place in sorted(found.get(t, ())):
                size = len(self.items[i][1])
                most = int(self.most[i])
                if any(s - most <= place <= s + most for _, s, _ in spans[i]):
                    continue
                low = max(0, place - most)
                passage = text[low : place + size + most]
                there, back = self._matcher(i)
                distance, end = there.best(passage, most)
                if distance <= most:
                    span = (distance, low + end - back.best(passage[:end][::-1])[1], low + end)
                    if span not in spans[i]:
                        spans[i].append(span)
            for i in self.short:
                spans[i] += self._nearest(i, text)
            for i, passages in sorted(spans.items()):
                for distance, start, end in passages:
                    yield t, self.items[i][0], distance, int(at[start]), int(at[end - 1]) + 1


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """path, row, doc_id, item_id, distance, start, end of every passage of a document that is near to an item."""
    arrow_batches(docs.sparkSession)
    docs = located(docs)
    inner = with_locator(docs, F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text")).select("path", "row", "doc_id", "text")
    inner = on_all_cores(inner)
    schema = "path string, row long, doc_id long, item_id long, distance int, start int, end int"
    names = ["path", "row", "doc_id", "item_id", "distance", "start", "end"]

    def work_with(block: list[tuple[int, str | None]]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block, similarity)
            for batch in batches:
                for part, texts in blocks(batch, 3):
                    rows = list(index.hits(texts))
                    if rows:
                        at, *columns = zip(*rows, strict=True)
                        doc = part.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*doc.columns[:3], pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], names=names)

        return worker(work)

    stream = items.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{item_text}`")).toLocalIterator()
    out = None
    while block := [(r[0], r[1]) for r in islice(stream, ITEMS)]:
        some = inner.mapInArrow(work_with(block), schema)
        out = some if out is None else out.union(some)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that have a passage near to an item."""
    docs = located(docs)
    return without(docs, contaminated(docs, items, **how).select("path", "row").distinct())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "start", "end")
