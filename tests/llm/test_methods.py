"""Each method's own steps against a brute-force version, and that they decide."""

import collections
import html
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, op1_exact_dedup, op2_html_text, op4_sharding, op5_secrets, op7_language_id, op8_quality, op9_url_filter, op10_minhash
from tidemark.llm import rows as places

from .test_texts import brute_fill


@pytest.mark.parametrize("group_bytes", [32 << 20, 6_000])
def test_rows_by_place(group_bytes, spark, monkeypatch):
    monkeypatch.setattr(places, "GROUP_BYTES", group_bytes)
    docs = spark.range(100_000).repartition(3).selectExpr("id", "cast(id % 5 as string) as path", "id as row", "null as bits")
    docs = common.written(docs.withColumn("bits", F.col("bits").cast("string")), "docs")
    wanted = common.with_locator(docs, F.col("id")).where("id % 7 = 3").select("path", "row")
    got = places.fetched(docs, wanted, F.col("id"))
    assert got.columns == ["id", "path", "row"]
    assert sorted(r.id for r in got.collect()) == [i for i in range(100_000) if i % 7 == 3]
    left = places.without(docs, wanted)
    assert left.columns == docs.columns and sorted(r.id for r in left.collect()) == [i for i in range(100_000) if i % 7 != 3]
    assert places.without(docs, wanted.limit(0)).count() == 100_000 and places.fetched(docs, wanted.limit(0), F.col("id")).count() == 0


def test_scans_of_few_splits_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, cast(id % 10 as string)) as text")
    one = common.written(rows.coalesce(1), "docs")
    inner = common.with_locator(one, F.col("id"), F.col("text")).select("path", "row", "id", "text")
    dealt = common.on_all_cores(inner)
    assert dealt.columns == inner.columns and "RoundRobinPartitioning" in plan(dealt)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and max(sizes) - min(sizes) <= 1
    found = lambda df: sorted(map(repr, df.collect()))
    assert found(dealt) == found(inner)
    empty = common.on_all_cores(common.written(rows.limit(0), "docs"))
    assert empty.columns == rows.columns and empty.count() == 0
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:  # a split for each file
        for k in before:
            spark.conf.set(k, "1")
        many = common.written(rows.repartition(cores), "docs")
        assert common.on_all_cores(many) is many
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_text_but_the_wanted_is_shuffled(spark):
    docs = common.written(spark.range(1000).selectExpr("id", "repeat('x', 100) as text"), "docs")
    wanted = common.with_locator(docs, F.col("id")).where("id = 5").select("path", "row")
    plan = places.fetched(docs, wanted, F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_a_hot_key_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else "hot" if i % 2 else f"k{i % 30}") for i in range(2000)], "i long, k string")
    keys = common.written(spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(20)], "k string, v long"), "keys")
    want = {i: None if i % 11 == 0 else 1 if i % 2 else i % 30 if i % 30 < 20 else None for i in range(2000)}
    got = common.per_key(rows, keys, "k", F.col("i"))
    assert got.count() == 2000 and {r.i: r.v for r in got.collect()} == want


def test_op1_a_batch_that_is_added_again_counts_once(spark):
    docs = common.written(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string"), "docs")
    dedup = op1_exact_dedup.Deduplicator(spark)
    for _ in range(2):
        dedup.add(docs, batch="first")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in dedup.decisions(docs).collect()} == {(1, 3, 2), (2, 2, 1), (3, 3, 2)}


def test_op10_a_bucket_just_under_the_bound_takes_few_pairs(spark):
    """Texts of a similarity of 0.70 to 0.79 meet in buckets, and none is linked."""
    shared = [f"s{i}" for i in range(174)]
    texts = [" ".join(shared + [f"t{i}x{j}" for j in range(26)]) for i in range(150)]
    found = op10_minhash.Classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sims = [r.sim for r in found.tested.collect()]
    assert len(sims) > 100 and 0.70 < min(sims) and max(sims) < 0.79
    assert {(r.doc_id, r.class_id) for r in found.membership().collect()} == {(i, i) for i in range(150)}
    assert len(sims) < 20 * 150


def test_op10_pairs_of_a_hot_representative_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(op10_minhash, "CHUNK", 7)
    texts = [" ".join(f"w{j}" for j in range(i, i + 60)) for i in range(40)] + ["", "one two"]
    known = common.written(spark.createDataFrame(list(enumerate(texts)), "nid long, text string"), "texts")
    pairs = [(0, b) for b in range(1, 42)] + [(5, b) for b in range(6, 20)] + [(40, 3), (40, 41)]
    got = {(r.a, r.b): r for r in op10_minhash.similarities(spark.createDataFrame(pairs, "a long, b long"), known, 5).collect()}
    bag = [collections.Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) if t else collections.Counter() for t in texts]
    assert set(got) == set(pairs)
    for a, b in pairs:
        both, total = sum((bag[a] & bag[b]).values()), sum((bag[a] | bag[b]).values())
        assert got[a, b].both == both and got[a, b].size_b == sum(bag[b].values()) and got[a, b].sim == pytest.approx(both / max(total, 1))


def brute_tree(pages):
    """host, place -> importance and odds of parsed pages (host, places, blocks), by plain counting."""
    style, line, hints = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    chains = {}
    for host, places_, blocks in pages:
        for node, (s, meaning, hint) in places_.items():
            style[host, node, s] += 1
            hints[host, node].append((meaning, hint))
        for chain, text in blocks:
            text = text.lower().replace(host, "") if host else text
            line[host, chain[-1], text] += 1
            chains[chain[-1]] = chain

    def measured(style, line):
        out, content = {}, collections.defaultdict(list)
        for key in {k[:-1] for k in style}:
            n = [v for k, v in style.items() if k[:-1] == key]
            m = sum(n)
            entropy = -sum(x / m * math.log(x / m) for x in n) / math.log(m) if m > 1 else 1.0
            out[key] = [m, len(n), entropy]
        for key in {k[:-1] for k in line}:
            n, m = [v for k, v in line.items() if k[:-1] == key], out[key][0]
            new = sum(1 - min(math.log(x) / math.log(m), 1) if m > 1 else 1.0 for x in n) / len(n)
            for node in set(chains[key[-1]]):
                content[*key[:-1], node].append((new, sum(n)))
        imp = {}
        for key, (m, kinds, entropy) in out.items():
            below, part = content.get(key), op2_html_text.GAMMA**kinds
            imp[key] = (m, entropy if not below else (1 - part) * entropy + part * sum(a * n for a, n in below) / sum(n for _, n in below))
        return imp

    own = measured(style, line)
    pooled_style, pooled_line = collections.Counter(), collections.Counter()
    for (_, *key), n in style.items():
        pooled_style[tuple(key)] += n
    for (_, *key), n in line.items():
        pooled_line[tuple(key)] += n
    pooled, root, found = measured(pooled_style, pooled_line), op2_html_text.ROOT, {}
    for (host, node), (m, imp) in own.items():
        less = max(pooled[root,][1] - own[host, root][1], 0)
        w = op2_html_text.WEIGHT
        imp = ((m - 1) * min(imp + less, 1) + w * pooled[node,][1]) / (m - 1 + w)
        trust = min(max(math.log(max(m, pooled[node,][0]) / op2_html_text.UNSURE) / math.log(op2_html_text.SURE / op2_html_text.UNSURE), 0), 1)
        meaning, hint = np.mean(hints[host, node], axis=0)
        pull = min(max(op2_html_text.PULL * (imp - op2_html_text.MIDDLE), op2_html_text.DOWN), op2_html_text.UP)
        found[host, node] = imp, meaning + (1 - trust) * hint + trust * pull
    return found


def test_op2_tree_equals_brute_force(spark):
    pages = []
    for i in range(60):
        host = f"h{i % 7}.org"
        more = "<div class='menu'><p>same</p></div>" if i % 3 else f"<section><h2>{host} {i % 4}</h2><p>x</section>"
        pages.append((i, f"http://{host}/p", f"<body><nav>n{i % 5}</nav>{more}<div class='y'><p>text {i}<p>more {i // 2}</div>"))
    pages.append((99, None, None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.host, r.node): (r.imp, r.keep_odds) for r in op2_html_text.importance(common.written(op2_html_text.parse(df), "parsed")).collect()}
    parser = op2_html_text.Parser()
    want = brute_tree([((u or "//").split("/")[2], *parser.parse(h or "")) for _, u, h in pages])
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def renamed(spark, sf_dir):
    """Pages of one host on which every name and tag of a branch means nothing, and their articles."""
    rows, want = [], {}
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet").collect():
        own = re.search(r"://([^/]*)", r.url)[1]
        text = r.html.replace(own, "www.h.org").replace('class="ad"', 'class="k1"')
        for i, tag in enumerate(("nav", "article", "footer"), 2):
            text = re.sub(f"<{tag}>", f'<div class="k{i}">', text).replace(f"</{tag}>", "</div>")
        rows.append((r.page_id, "http://www.h.org/p", text))
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:h1|p|article)>", article)]
        want[r.page_id] = "\n".join(p for p in parts if p)
    return spark.createDataFrame(rows, "page_id long, url string, html string"), want


def test_op2_importance_decides_without_names(spark, sf_dir, monkeypatch):
    pages, want = renamed(spark, sf_dir)
    assert {r.page_id: r.text for r in op2_html_text.extract(pages).collect()} == want
    monkeypatch.setattr(op2_html_text, "PULL", 0.0)
    assert not any(r.text == want[r.page_id] for r in op2_html_text.extract(pages).collect())


def test_op2_takes_clashing_columns_and_odd_names(spark):
    rows = [(1, "http://h/1", "<article class='日本 a1'><p>x</article>", 1, 2, 3, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, places int, blocks int, rid int")
    r = op2_html_text.extract(pages).first()
    assert (r.text, r.host, r.places, r.blocks, r.rid) == ("x", 1, 2, 3, 4)
    parser = op2_html_text.Parser()
    assert parser.parse("<div class='a1'>x</div>")[0].keys() != parser.parse("<div class='a2'>x</div>")[0].keys()


def test_op4_fill_at_production_size():
    names = [f"shard-{i:05d}" for i in range(op4_sharding.SHARDS)]
    size, taken = op4_sharding.SIZE, {}
    orders = []
    for s in names:
        offset, skip = op4_sharding._number(f"offset:{s}") % size, op4_sharding._number(f"skip:{s}") % (size - 1) + 1
        orders.append(iter([(offset + skip * j) % size for j in range(size)]))
    turn = 0
    while len(taken) < size:
        slot = next(x for x in orders[turn % len(names)] if x not in taken)
        taken[slot] = turn % len(names)
        turn += 1
    assert op4_sharding.fill(names).tolist() == [taken[i] for i in range(size)]
    assert op4_sharding.fill(names[:5], 101).tolist() == brute_fill(names[:5], 101)


def test_op4_refuses_no_keys_and_takes_long_ones(spark):
    df = spark.createDataFrame([("x" * 300_000,), ("x" * 300_000,)], "k string")
    with pytest.raises(ValueError):
        op4_sharding.place(df, [])
    assert len({r.shard for r in op4_sharding.place(df, ["k"], ["a", "b"], 101).collect()}) == 1


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 5000])
def test_op5_running_sums(n, spark):
    sizes = [i % 7 for i in range(n)]
    row = spark.createDataFrame([(sizes,)], "s array<int>").select(op5_secrets.running(F.col("s")).alias("r")).first()
    assert row.r == [sum(sizes[:i]) for i in range(n)]


def test_op5_takes_time_in_proportion_to_the_matches(spark):
    took = {}
    for n in (2_000, 16_000, 160_000):
        docs = common.written(spark.createDataFrame([(1, "token=abcdef12 " * n)], "doc_id long, text string"), "docs")
        began = time.perf_counter()
        row = op5_secrets.patterns(docs).select(F.size("assign"), F.col("assign")[n - 1]["start"]).first()
        took[n] = time.perf_counter() - began
        assert tuple(row) == (n, 15 * (n - 1))
    assert took[160_000] < 25 * max(took[16_000], 0.2)


def test_op5_battery_equals_brute_force(spark):
    rng = random.Random(4)
    alphabets = {n: a for n, (a, _) in op5_secrets.ENCODINGS.items()}
    tokens = ["".join(rng.choice(a) for _ in range(rng.randrange(20, 90))) for a in alphabets.values() for _ in range(6)] + ["ab" * 20, "x" * 30, "hello-world-this-is-text", "====" * 6, "q=" * 12]
    rows = {r.token: r for r in op5_secrets.battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    for t in tokens:
        body = t.replace("=", "")
        if len(body) < 2:
            assert t not in rows
            continue
        name = next(n for n, a in alphabets.items() if set(body) <= set(a))
        k, n = len(alphabets[name]), len(body)
        v = np.array([alphabets[name].index(c) for c in body], float)
        chi = sum((np.sum(v == i) - n / k) ** 2 for i in range(k)) / (n / k)
        z_chi = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
        v -= (k - 1) / 2
        above = int(np.sum(v >= 0))
        mean = 2 * above * (n - above) / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int(np.sum((v[1:] >= 0) != (v[:-1] >= 0)))
        z_runs = (runs - mean) / math.sqrt(variance) if variance > 0 else math.sqrt(n)
        z_serial = np.sum(v[1:] * v[:-1]) / np.sum(v * v) * math.sqrt(n) if np.sum(v * v) else math.sqrt(n)
        r = rows[t]
        assert r.encoding == name and [r.z_chi, r.z_runs, r.z_serial] == pytest.approx([z_chi, z_runs, z_serial], abs=1e-6), t
        p = 3 * math.erfc(max(map(abs, (z_chi, z_runs, z_serial))) / math.sqrt(2))
        if abs(p - op5_secrets.REJECT) > 1e-4:
            assert p > op5_secrets.REJECT or r.level == 0


def test_op5_control_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(20, 200), max(0, int(rng.gauss(30, 40)))) for _ in range(800)]
    df = spark.createDataFrame([("x" * n, level) for n, level in rows], "token string, level int")
    got = {r["class"]: r.least for r in op5_secrets.discoveries(df).collect()}
    want = {}
    for c, low in enumerate(op5_secrets.CLASSES):
        high = [*op5_secrets.CLASSES, 10**9][c + 1]
        levels = sorted((x for n, x in rows if low <= n < high), reverse=True)
        p = [10 ** (-x / op5_secrets.STEP) for x in levels]
        last = max((i for i in range(len(p)) if p[i] <= op5_secrets.RATE * (i + 1) / len(p) and levels[i] > 0), default=None)
        if last is not None:
            want[c] = levels[last]
    assert got == want


def test_op7_fusion_equals_brute_force(spark):
    languages, rng = ["aa", "bb", "cc"], random.Random(3)
    rows = []
    for i in range(80):
        host = rng.choice([None, "x.de", "y.de", "z.fr", "w"])
        n = rng.choice([0, 5, 9])
        rows.append((f"p{i % 2}", i, i, host, rng.choice([None, "aa", "zz", "cc"]), n, [rng.uniform(-3, 0) * (n > 0) for _ in range(4)]))
    df = spark.createDataFrame(rows, "path string, row long, doc_id long, host string, declared string, n long, text_ll array<double>")
    got = {r.doc_id: r for r in op7_language_id.fuse(df, languages).collect()}
    M, flat = op7_language_id, np.array([0.99 / 3] * 3 + [0.01])
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    own = {r[2]: soft(np.array(r[6]) + np.log(flat)) * (r[5] > 0) for r in rows}
    total = sum(own.values())
    overall = (total + flat * 10) / (total.sum() + 10)
    suffix = lambda h: h.rpartition(".")[2] if h and "." in h else ""
    for r in rows:
        prior, evidence = overall, r[5] > 0 or r[4] in languages
        if r[3] is not None:
            peers = sum((own[x[2]] for x in rows if suffix(x[3]) == suffix(r[3])), np.zeros(4))
            up = (peers + overall * M.SUFFIX_WEIGHT) / (peers.sum() + M.SUFFIX_WEIGHT)
            counts = np.maximum(sum(own[x[2]] for x in rows if x[3] == r[3]) - own[r[2]], 0)
            prior = (counts + up * M.HOST_WEIGHT) / (counts.sum() + M.HOST_WEIGHT)
            evidence |= counts.sum() > 0
        markup = np.array([M.TRUST if x == r[4] else (1 - M.TRUST) / 2 for x in [*languages, None]]) if r[4] in languages else np.ones(4)
        posterior = soft(np.array(r[6]) + np.log(prior) + np.log(markup))
        best = int(posterior.argmax())
        want = [*languages, "und"][best] if evidence else "und"
        assert got[r[2]].lang == want and got[r[2]].posterior == pytest.approx(posterior.max()), r


def test_op7_learns_every_label_and_finds_tags_in_any_case(spark):
    rows = [(i, "der die und nicht auch einer werden", "de") for i in range(400)] + [(1000 + i, "ne pas sur les avec dans pour", "fr") for i in range(3)] + [(2000, "x", None), (2001, "y", "")]
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    model = op7_language_id.fit(docs, "doc_id", "text", "lang", most=50)
    assert model.languages == ["de", "fr"]
    all_rows = op7_language_id.train([(t, x) for _, t, x in rows])
    same = op7_language_id.train([("der die und nicht auch einer werden", "de")] * 50 + [(t, x) for _, t, x in rows if x == "fr"])
    assert all_rows.languages == model.languages and np.allclose(model.table, same.table)
    tags = spark.createDataFrame([('<HtMl LANG=fr>',), ("<html>",), (None,)], "text string")
    assert [r[0] for r in tags.select(op7_language_id.declared_in(F.col("text"))).collect()] == ["fr", None, None]


def test_op8_forward_equals_brute_force():
    net = op8_quality.train([("good words here", 1), ("bad ### words", 0)] * 10, epochs=2)
    for text in ("", "a", "some words, and more of them: éé", "x" * 200):
        data = [b + 1 for b in text.encode()]
        chunks = max(-(-len(data) // op8_quality.STRIDE), 1)
        data += [0] * (chunks * op8_quality.STRIDE + op8_quality.WIDTH - op8_quality.STRIDE - len(data))
        pooled = np.zeros(op8_quality.FILTERS)
        for f in range(op8_quality.FILTERS):
            responses = []
            for c in range(chunks):
                window = data[c * op8_quality.STRIDE : c * op8_quality.STRIDE + op8_quality.WIDTH]
                responses.append(sum(float(net.embed[b][e]) * float(net.filters[i * op8_quality.EMBED + e, f]) for i, b in enumerate(window) for e in range(op8_quality.EMBED)))
            pooled[f] = max(max(responses) + float(net.bias[f]), 0)
        z = float(pooled @ net.weights.astype(float)) + net.offset
        assert net.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_op8_gradient_equals_differences():
    rng = np.random.default_rng(2)
    net = op8_quality.train([("good words here", 1), ("bad ### words", 0)] * 4, epochs=1)
    for n in ("embed", "filters", "bias", "weights"):
        setattr(net, n, getattr(net, n).astype(float))
    symbols = op8_quality.padded(["some words, and more of them"])[0]
    loss = lambda: -math.log(net.scores(["some words, and more of them"])[0])
    grad = op8_quality.gradient(net, symbols, 1.0)
    embed = np.zeros_like(net.embed)
    np.add.at(embed, grad.pop("at"), grad["embed"])
    grad["embed"] = embed
    for name in ("embed", "filters", "bias", "weights"):
        values = getattr(net, name)
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in values.shape)
            if name == "embed":
                at = (int(rng.choice(symbols)), at[1])
            kept, h = values[at], 1e-5
            values[at] = kept + h
            up = loss()
            values[at] = kept - h
            down = loss()
            values[at] = kept
            assert (up - down) / (2 * h) == pytest.approx(float(grad[name][at]), abs=2e-3)


def test_op8_repeated_ids_and_a_byte_budget(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 20, "good text" if i % 2 else "bad ### text") for i in range(200)] + [(50, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, i % 2) for i in range(100)] + [(50, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(op8_quality, "train", lambda rows: seen.append(rows))
    monkeypatch.setattr(op8_quality, "TRAIN_BYTES", 1_000)
    for _ in range(2):
        op8_quality.fit(docs, labels)
    assert seen[0] == seen[1] and 10 <= len(seen[0]) <= 20
    assert all(text == ("good text" if label else "bad ### text") for text, label in seen[0])


def test_op9_blocks_branches_as_the_sql_does(spark, duck, tmp_path):
    """Branches good and bad at several depths, deep and long paths, a hot host of slugs, pages without labels."""
    rng, pages, labels = random.Random(12), [], []
    for i in range(3000):
        host = rng.choice(["h.org"] * 3 + ["g.net", "www.k.com", ""])
        a, b = rng.choice(["blog", "shop", "x" * 50, "deadbeefdeadbeef00"]), rng.choice(["new", "old", f"s{i}"])
        path = rng.choice([f"/{a}/{b}/{i}", f"/{a}/{i}", f"/{i}", f"/{a}/{b}/c{i % 3}/d/{'y' * (i % 60)}/{i}", f"/{rng.randrange(10**6):x}-{i}"])
        pages.append((i, f"http://{host}{path}?q=1" if rng.random() < 0.98 else None))
        if rng.random() < 0.7:
            bad = (a == "shop" and host == "h.org") or (b == "old" and host == "g.net") or rng.random() < 0.1
            labels.append((i, int(not bad), int(rng.random() < 0.02)))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duck.cursor()
    for t in ("pages", "labels"):
        con.execute(f"CREATE TEMP VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT page_id, host, path, rule, verdict, template FROM ({op9_url_filter.oracle_sql()})").fetchall()}
    got = {tuple(r) for r in op9_url_filter.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 3000
    blocked = {r[5] for r in got if r[4] == "block" and r[3] is None}
    assert blocked and {r[4] for r in got if r[1] == "h.org" and r[2].startswith("/blog/")} == {"allow"}
