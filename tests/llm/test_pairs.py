"""Exact dedup, near-duplicates and decontamination against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op1_exact_dedup, op6_decontaminate, op10_minhash
from tidemark.llm import shingles as S

CLASHING = "doc_id long, text string, path string, row int, node string, digest string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "p", 1, "n", "d") for i, t in rows], CLASHING)


def test_op1_equals_sql(spark, sf_dir, same):
    same(op1_exact_dedup.op1_exact_dedup(spark, sf_dir), op1_exact_dedup.ORACLE_SQL)


def test_op1_splits_colliding_digests_by_bytes(spark, sf_dir, same):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = op1_exact_dedup.decide(docs, digest=lambda text: F.substring(text.cast("binary"), 1, 1))
    same(found.select("doc_id", "keep_id", "group_size", "kept"), op1_exact_dedup.ORACLE_SQL.replace(", sha256(d.text) AS text_sha256", ""))


def test_op1_edges(spark):
    docs = clashing(spark, [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, ""), (4, "x" * 300_000), (None, None)])
    rows = op1_exact_dedup.decide(docs).collect()
    groups = collections.Counter(r.text_sha256 for r in rows)
    assert len(rows) == 7 and sorted(groups.values()) == [1, 3, 3]
    assert all(sum(r.kept for r in rows if r.text_sha256 == g) == 1 for g in groups)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.keep_id for r in rows if r.text_sha256 == empty} == {3}
    kept = op1_exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert op1_exact_dedup.decide(docs.limit(0)).count() == 0


def test_op1_goes_on_from_its_state(spark):
    from tidemark.llm.common import written

    first, second = (written(spark.createDataFrame(rows, "doc_id long, text string"), "docs") for rows in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c")]))
    dedup = op1_exact_dedup.Deduplicator(spark)
    dedup.add(first)
    assert dedup.state().count() == 2
    dedup.add(second)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup.decisions(spark.read.parquet(*first.inputFiles(), *second.inputFiles())).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1)}


def bags(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", t.lower())
        out.append(collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else collections.Counter([tuple(w)] if w else []))
    return out


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def brute_classes(texts, t=0.8):
    """Index of the first member of each text's class."""
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    sets, first = bags(texts), {}
    for i, x in enumerate(texts):
        if x in first:
            head[i] = find(first[x])
            continue
        first[x] = i
        for j in first.values():
            if j != i and similarity(sets[i], sets[j]) >= t:
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return [find(i) for i in range(len(texts))]


def test_overlap_equals_counters():
    rng = random.Random(5)
    make = lambda: " ".join(rng.choice(["a", "bb", "Ccc", "é", "x_1", "-", "!!"]) for _ in range(rng.randrange(0, 40)))
    left, right = [make() for _ in range(200)], [make() for _ in range(200)]
    want = [similarity(a, b) for a, b in zip(bags(left), bags(right), strict=True)]
    assert np.allclose(S.jaccard(left, right, 5), want)
    assert np.allclose(S.jaccard(left, left, 5), [1.0 if sum(b.values()) else 0.0 for b in bags(left)])


def test_darts_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        agree = []
        for trial in range(20):
            common = rng.integers(0, 1 << 44, 400)
            own = rng.integers(0, 1 << 44, (2, int(400 * (1 - share) / (2 * share))))
            keys = [np.sort((np.uint64(i) << np.uint64(44)) | np.concatenate([common, own[i]]).astype(np.uint64)) for i in (0, 1)]
            signature, has = op10_minhash.dart_minhash(np.concatenate(keys), np.ones(sum(map(len, keys))), 2, 120)
            assert has.all()
            agree.append((signature[0] == signature[1]).mean())
        assert abs(np.mean(agree) - share) < 0.03


def test_darts_follow_weights():
    keys = np.array([1, 2, (1 << 44) | 1, (1 << 44) | 2], np.uint64)
    agree = []
    for i in range(60):
        signature, _ = op10_minhash.dart_minhash(keys + np.uint64(2 * i), np.array([1.0, 3.0, 1.0, 1.5]), 2, 120)
        agree.append((signature[0] == signature[1]).mean())
    assert abs(np.mean(agree) - 2.5 / 4) < 0.05


def test_op10_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = brute_classes([d.text for d in docs])
    got = {r.doc_id: r.class_id for r in op10_minhash.op10_minhash(spark, sf_dir).collect()}
    assert got == {d.doc_id: docs[i].doc_id for d, i in zip(docs, want, strict=True)}


def edited(rng, words, n):
    words = words[:]
    for _ in range(n):
        words[rng.randrange(len(words))] = f"q{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("edits", [2, 5, 8])
def test_op10_over_a_large_group_and_a_shared_passage(edits, spark):
    """Copies of one text with edits, of which many pairs are just under the bound, and texts that share half their words."""
    rng = random.Random(edits)
    base = [f"w{i}" for i in range(200)]
    passage = [f"p{i}" for i in range(80)]
    texts = [edited(rng, base, rng.randrange(edits + 1)) for _ in range(120)]
    texts += [" ".join(passage + [f"r{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(150)]
    texts += [texts[3], texts[130], "", " ".join(base[:3])]
    want = brute_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op10_minhash.Classes(docs)
    got = {r.doc_id: r.class_id for r in found.membership().collect()}
    assert got == dict(enumerate(want))
    pairs = found.tested.count()
    assert pairs < len(texts) ** 2 / 8
    holds_links(found, texts, want)


def holds_links(found, texts, want):
    """Links are between different texts, each once and as similar as it says; they connect every class, and are counted by text."""
    links = [(min(a, b), max(a, b), s) for a, b, s in found.pairs().collect()]
    sets = {i: bag for i, bag in enumerate(bags(texts))}
    assert len({x[:2] for x in links}) == len(links)
    assert all(texts[a] != texts[b] and similarity(sets[a], sets[b]) == pytest.approx(s) and s >= 0.8 for a, b, s in links)
    rows = found.membership().collect()
    head = {r.text_id: r.text_id for r in rows}
    for _ in links:
        for a, b, _ in links:
            head[a] = head[b] = min(head[a], head[b])
        if all(head[a] == head[b] for a, b, _ in links):
            break
    assert {r.doc_id: head[r.text_id] for r in rows} == dict(enumerate(want))
    degree = collections.Counter(x for a, b, _ in links for x in (a, b))
    assert all(r.n_links == degree[r.text_id] for r in rows)


def test_op10_splits_a_mixed_bucket(spark):
    """A chain a-b-c in which only neighbours are near enough, and a lone text in between."""
    base = [f"w{i}" for i in range(100)]
    step = lambda k: " ".join(base[4 * k :] + [f"n{i}" for i in range(4 * k)])
    texts = [step(k) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op10_minhash.Classes(docs, bands=60, rows=2)
    want = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in found.membership().collect()} == dict(enumerate(want))
    holds_links(found, texts, want)


def test_op10_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = clashing(spark, [(5, None), (6, ""), (7, "!!"), (8, "one two"), (8, "one two"), (None, "One, two"), (9, long), (10, long + " more")])
    rows = op10_minhash.Classes(docs).membership().collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.class_id].add(r.doc_id)
    assert by[5] == {5, 6} and by[7] == {7} and by[9] == {9, 10} and by[None] == {8, None}
    assert sum(r.keeps for r in rows) == 4
    kept = op10_minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert {r.doc_id: r.n_links for r in rows if r.doc_id not in (8, None)} == {5: 0, 6: 0, 7: 0, 9: 1, 10: 1}
    none = op10_minhash.Classes(docs.limit(0))
    assert none.membership().count() == 0 and none.pairs().count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 101), (101, 102)] + [(200, 200 + rng.randrange(1, 9)) for _ in range(6)]
    got = {r.nid: r.comp for r in op10_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[200] == 200
    assert op10_minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(pattern, text):
    """Least edit distance of the pattern to any passage."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_vectors_equal_dynamic_programming():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    for _ in range(200):
        pattern, text = word(rng.randrange(1, 30)), word(rng.randrange(0, 60))
        assert op6_decontaminate.Matcher(pattern).best(text)[0] == distance(pattern, text)
        least = op6_decontaminate.Matcher(pattern).best(text, 4)[0]
        assert least == distance(pattern, text) or (least > 4 and distance(pattern, text) > 4)


def test_op6_finds_all_exact_passages_and_no_others(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    plain = lambda t: " ".join(t.lower().split())
    want = {(d.doc_id, b.item_id) for d in docs for b in items if plain(b.text) in plain(d.text)}
    found = op6_decontaminate.op6_decontaminate(spark, sf_dir).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found}
    texts, by = {d.doc_id: d.text for d in docs}, {b.item_id: b.text for b in items}
    for r in found:
        passage = plain(texts[r.doc_id][r.start : r.end])
        assert distance(plain(by[r.item_id]), passage) == r.distance <= 0.2 * len(plain(by[r.item_id]))


def test_op6_recall_over_edited_passages(sf_dir):
    import pyarrow.parquet as pq

    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    host = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    index, rng = op6_decontaminate.Index([(b["item_id"], b["text"]) for b in items]), random.Random(6)
    near = hit = 0
    for n, b in enumerate(items * 2):
        rate, text = rng.choice([0.03, 0.08, 0.14]), []
        for c in b["text"]:
            text.append(c if rng.random() > rate else rng.choice(["", "q", c + "e"]))
        around = host[n][:600]
        planted = f"{around} {''.join(text)} {around}"
        pattern = op6_decontaminate.normalise(b["text"])[0].strip()
        is_near = op6_decontaminate.Matcher(pattern).best(op6_decontaminate.normalise(planted)[0])[0] <= int(0.2 * len(pattern) + 1e-9)
        is_hit = any(h[1] == b["item_id"] for h in index.hits([planted]))
        assert not is_hit or is_near
        near, hit = near + is_near, hit + is_hit
    assert near > 60 and hit >= op6_decontaminate.RECALL * near


@pytest.mark.parametrize("size", [12, 24, 32, 40, 56, 80, 110, 160, 300])
@pytest.mark.parametrize("kind", ["letters", "words"])
def test_op6_recall_by_length(sf_dir, size, kind):
    import pyarrow.parquet as pq

    rng = random.Random(size)
    whole = " ".join(op6_decontaminate.normalise(b["text"])[0] for b in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist())
    items = [whole[at : at + size].strip() for at in (rng.randrange(len(whole) - size) for _ in range(100))]
    index = op6_decontaminate.Index(list(enumerate(items)))
    near = hit = 0
    for n, item in enumerate(items):
        most = int(0.2 * len(item) + 1e-9)
        left, edited = rng.randrange(most * 2 // 3, most + 1), list(item)
        if kind == "letters":
            for at in rng.sample(range(len(item)), left):
                edited[at] = rng.choice(["", "q", item[at] + "e"])
        else:
            words = [(m.start(), m.end()) for m in re.finditer(r"\w+", item)]
            for low, high in rng.sample(words, len(words)):
                if high - low <= left:
                    left -= high - low
                    edited[low:high] = [rng.choice("bcdfgh") for _ in range(high - low)]
        text = f"some words before {''.join(edited)} and some after"
        is_near = op6_decontaminate.Matcher(item).best(text)[0] <= most
        is_hit = any(h[1] == n for h in index.hits([text]))
        assert not is_hit or is_near
        near, hit = near + is_near, hit + is_hit
    assert near > 80 and hit >= op6_decontaminate.RECALL * near


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x5200))), "abcdefghijklmnop"])
def test_op6_text_without_spaces(alphabet):
    rng = random.Random(9)
    run = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [run(rng.randrange(40, 200)) for _ in range(30)]
    index = op6_decontaminate.Index(list(enumerate(items)))
    for n, item in enumerate(items):
        edited = list(item)
        for at in rng.sample(range(len(item)), len(item) * 15 // 100):
            edited[at] = rng.choice(["", run(1), item[at] + run(1)])
        before = run(300)
        assert (0, n, 0, 300, 300 + len(item)) in list(index.hits([before + item + run(300)]))
        assert any(h[1] == n for h in index.hits([before + "".join(edited) + run(300)]))
    assert not list(index.hits([run(2000)]))


def test_op6_short_items_are_near_too():
    item = "what is the capital of france?"
    hits = lambda item, text: list(op6_decontaminate.Index([(7, item)]).hits([text]))
    assert hits(item, f"so: {item.replace('capital', 'capitol')} Paris") == [(0, 7, 1, 4, 34)]
    assert hits(item, "so: wat is teh capitl of frnce? Paris")[0][2] <= 6
    assert not hits(item, "so: where is the capitol of spain? Madrid")
    assert hits("short", "not shorty") == [(0, 7, 0, 4, 9)] and hits("short", "shorty shart") == [(0, 7, 0, 0, 5)]
    assert hits("short", "a shirt") == [(0, 7, 1, 2, 7)] and hits("short", "shorty and short") == [(0, 7, 0, 11, 16)]
    assert hits("法国的首都", "请问法国的首都是哪里") == [(0, 7, 0, 2, 7)] and not hits("abc", "ab c")
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    for _ in range(300):
        item, text = word(rng.randrange(1, 32)).strip() or "a", " ".join(word(rng.randrange(0, 90)).split())
        item = " ".join(item.split())
        least, found = distance(item, text), hits(item, text)
        assert bool(found) == (least <= int(0.2 * len(item) + 1e-9)) and all(h[2] == least for h in found)


def test_op6_edges(spark):
    fox = "the quick brown fox jumps over the lazy dog and runs away quickly"
    rows = [(1, None), (2, ""), (None, f"xx {fox.title()}\n yy".replace(" Fox", "  Fox")), (4, "short item. not shorty"), (5, "x" * 200_000 + f" {fox}".replace("the lazy", "a lazy")), (6, f"İ {fox} İ")]
    docs = clashing(spark, rows)
    items = spark.createDataFrame([(1, fox), (2, "short"), (2, "short"), (3, None), (4, ""), (5, "  ")], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id, r.distance) for r in op6_decontaminate.contaminated(docs, items).collect())
    assert found == [(0, 1, 0), (4, 2, 0), (4, 2, 0), (5, 1, 3), (6, 1, 0)]
    clean = op6_decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2]
    assert op6_decontaminate.contaminated(docs, items.limit(0)).count() == op6_decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_op6_takes_items_in_blocks(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, op6_decontaminate.op6_decontaminate(spark, sf_dir).collect()))
    monkeypatch.setattr(op6_decontaminate, "ITEMS", 7)
    assert sorted(map(tuple, op6_decontaminate.op6_decontaminate(spark, sf_dir).collect())) == whole
