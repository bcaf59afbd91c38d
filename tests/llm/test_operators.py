"""Each operator against brute force, and nulls, empty texts and tables, ties, repeats and extra columns."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from quarry.llm import binary, components, decontaminate, language, lines, maxent, nearcopies, packing, quality, simhash, suffixes, tokens, toxicity
from quarry.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, h string, core string, word string, label string"
WORDS = [f"w{i}" for i in range(300)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    out = [(i, text(rng, rng.randint(0, 120)), "en" if i % 3 else "de", f"s{i % 7}") for i in range(40)]
    out += [(100 + i, out[3][1], "en", f"s{i}") for i in range(6)]
    out += [(200, None, None, None), (201, "", "en", "s1"), (None, "null id has some words here", None, "s1"), (203, " \n\t ", "en", "s2"), (204, "x" * 5000, "en", "s2"), (205, text(rng, 4000), "de", "s3"), (3, out[3][1], "en", "s3")]
    out += [(300 + i, text(rng, 30) + "\n a shared line of words \n" + text(rng, 30), "de", f"t{i}") for i in range(14)]
    return [(a, b, c, d, len(b or ""), 1, "h", "c", "w", "l") for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")


def pairs(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_simhash(docs, empty):
    def fp(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    data = [(r[0], fp(r[1])) for r in rows()]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (data[i][1] ^ data[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(data))
    assert pairs(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id between 100 and 105").count() == 0


@pytest.mark.parametrize("stars, part, size, hub", [(6, 1024, 1 << 20, 4096), (0, 1024, 1 << 20, 4096), (0, 7, 1 << 20, 4096), (1, 3, 1 << 20, 1), (0, 1024, 2000, 1)])
def test_near_copies_equal_brute_force(spark, monkeypatch, stars, part, size, hub):
    for name, value in (("STARS", stars), ("PART", part), ("PART_BYTES", size), ("HUB", hub)):
        monkeypatch.setattr(nearcopies, name, value)
    rng = random.Random(11)
    data = []
    for k in range(30):
        w = text(rng, rng.randint(40, 150)).split()
        for j in range(4):
            x = list(w)
            for i in rng.sample(range(len(x)), j * len(x) // 60):
                x[i] = f"new{rng.randrange(10**6)}"
            data.append((len(data), " ".join(x)))
    data += [(1000, "one two"), (1001, "One  two"), (1002, "one two three"), (1003, ""), (1004, None), (1005, "a a a a a a a"), (1006, "a a a a a")]
    sets = [decontaminate.shingles((t or "").encode().lower().split()) for _, t in data]
    root = list(range(len(data)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if x == root[i] else x for x in root]
    want = {min(d for (d, _), r in zip(data, root) if r == k) for k in set(root)}
    got = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and len(want) < 100


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.5, 0.8, 1.0]), st.booleans())
def test_similar_sets_join_all_labels(seed, similarity, two):
    rng = random.Random(seed)
    base = [set(rng.sample(range(40), rng.randint(1, 20))) for _ in range(4)]
    sets = [set(rng.choice(base)) ^ set(rng.sample(range(40), rng.randint(0, 3))) | {rng.randrange(40)} for _ in range(25)]
    labels = np.array([rng.randrange(12) for _ in sets])
    side = np.array([rng.randrange(2) if two else 0 for _ in sets])
    two = len(set(side.tolist())) == 2
    good = lambda a, b: labels[a] != labels[b] and (not two or side[a] != side[b]) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])

    def joined(pairs):
        root = {x: x for x in labels.tolist()}
        for a, b in pairs:
            old, new = root[labels[a]], root[labels[b]]
            root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    got = nearcopies.similar([np.array(sorted(s), np.uint64) for s in sets], labels, side, similarity)
    assert all(good(a, b) for a, b in got)
    assert joined(got) == joined([(a, b) for a in range(25) for b in range(a) if good(a, b)]) and len(got) == len(set(labels.tolist())) - len(joined(got))


def test_hubs_are_shared_out(spark, monkeypatch):
    """A text that all others are compared with is sent to several tasks, and each pair is still judged once."""
    monkeypatch.setattr(nearcopies, "HUB", 10)
    base = text(random.Random(6), 60).split()
    texts = spark.createDataFrame([(i, " ".join([*base[: 60 - i % 9], *(f"n{i}x{j}" for j in range(i % 9))]).encode()) for i in range(100)], "node long, text binary")
    pairs = spark.createDataFrame([(i, 99) for i in range(99)], "a long, b long")
    got = nearcopies.verified(pairs, texts, 5, 0.8)
    sets = {r.node: decontaminate.shingles(r.text.split()) for r in texts.collect()}
    want = [(i, 99) for i in range(99) if len(sets[i] & sets[99]) >= 0.8 * len(sets[i] | sets[99])]
    assert sorted(tuple(r) for r in got.collect()) == want and 0 < len(want) < 99


def test_keep_one_takes_the_trie_joins_groups(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))
    fp = simhash.fingerprint(text.encode())
    longer = (" ".join([text, *(f"end{k}" for k in range(n))]) for n in range(1, 100))
    near = next(t for t in longer if 0 < (simhash.fingerprint(t.encode()) ^ fp).bit_count() <= simhash.ERRORS)
    spam = ["spam " * 300 + " ".join(f"{c}{k}" for k in range(100)) for c in "xy"]  # one fingerprint, unlike texts
    assert len({simhash.fingerprint(t.encode()) for t in spam}) == 1
    real = nearcopies.signatures
    monkeypatch.setattr(nearcopies, "signatures", lambda rows, size: real(rows, size).withColumn("bands", F.array(F.xxhash64("row"))))  # no bands meet
    data = [(1, text), (2, near), (3, "else " + text[:900]), (4, spam[0]), (5, spam[1])]
    got = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]


def test_tasks_of_near_dedup_need_one_worker(spark, docs, monkeypatch):
    """No stage runs a Python step on another's rows: an executor keeps every worker it ever needed, with what it holds."""
    most, real = [], components.written

    def steps(node, above=0):
        node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
        above = 0 if "Exchange" in node.nodeName() else above + (node.nodeName() == "MapInArrow")
        below = node.children()
        return max([above, *(steps(below.apply(k), above) for k in range(below.size()))])

    def seen(df, tag):
        most.append(steps(df._jdf.queryExecution().executedPlan()))
        return real(df, tag)

    for module in (simhash, nearcopies, components):
        monkeypatch.setattr(module, "written", seen)
    for out in (simhash.keep_one(docs), simhash.near_duplicates(docs)):
        seen(out, "out")
    assert max(most) == 1


def test_keep_one_chooses_rows(spark):
    rng = random.Random(12)
    a, b, c, d = (text(rng, 50) for _ in range(4))
    data = [(5, a), (5, a), (None, a), (7, b), (5, b), (3, b), (5, c), (None, d), (None, d), (None, None), (9, "")]
    got = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert pairs(got, "doc_id", "text") == Counter([(5, a), (3, b), (5, c), (None, d), (9, "")])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.lists(st.sets(st.integers(0, 63), max_size=5), max_size=12))
def test_trie_join(base, flips):
    fps = sorted({*base, *(base[k % len(base)] ^ sum(1 << b for b in f) for k, f in enumerate(flips))})
    a = np.array(fps, np.uint64)
    linked, root = simhash.spanning_links(np.zeros(len(a), np.int64), a)
    up = dict(zip(linked.tolist(), root.tolist()))
    group = list(range(len(a)))
    for _ in a:
        for i in range(len(a)):
            for j in range(len(a)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    same = {i: up.get(i, i) for i in range(len(a))}
    assert all((group[i] == group[j]) == (same[i] == same[j]) for i in same for j in same)


def test_hot_buckets_are_cut(spark):
    fps = [(k << 5) & 0x7FFFFFFF for k in range(400)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    one, cut = (components.connected_components(simhash.links(df, part=p)).groupBy("label").count().collect() for p in (10**6, 50))
    assert sorted(r["count"] for r in one) == sorted(r["count"] for r in cut)


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_block_choices_find_the_same_components(spark, blocks):
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(4)})
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                root = [root[i] if x == root[j] else x for x in root]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    label = {r.node: r.label for r in components.connected_components(simhash.links(df, blocks=blocks)).collect()}
    got = [label.get(x, x) for x in signed]
    assert len(set(root)) == len(set(got)) == len(set(zip(root, got)))


def test_more_fingerprints_take_longer_keys():
    assert [simhash.block_count(n) for n in (0, 10**6, 10**11, 10**12)] == [5, 5, 6, 7]
    for m in (5, 6, 7):
        assert all((x % (1 << 64)).bit_count() <= 64 * (m - 4) // m + m for x in simhash.masks(m))


def test_long_texts_are_counted_in_parts(monkeypatch):
    t = text(random.Random(9), 500).encode()
    whole = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "SHINGLES", 64)
    assert simhash.fingerprint(t) == whole


def test_clashing_columns(spark, docs, labels):
    extra = ["key", "_key", "_drop", "_id", "id", "h", "site", "pos", "l", "n_lines", "n_removed", "a.b", "good", "rep", "label"]
    d = docs.select("doc_id", "text", "source", "n_chars")
    for c in extra:
        d = d.withColumn(c, d["n_chars"])
    bench = spark.createDataFrame([(1, "a shared line of words", 1, 2)], "item_id long, text string, doc_id long, hit long")
    for out in (toxicity.drop_toxic(d, labels), lines.strip_lines(d, 8), simhash.keep_one(d), decontaminate.decontaminate(d, bench)):
        assert out.columns == d.columns and out.count() > 0
    out = lines.dedup_lines(d, 8)
    assert set(out.columns) == set(d.columns) and sum(r.n_removed for r in out.where("doc_id between 300 and 313").select("n_removed").collect()) == 13


def test_toxicity(spark, empty, labels):
    rng = random.Random(2)
    data = [(i, text(rng, 60) + (" scumbag" * (i % 2 == 0)), "en", "s") for i in range(400)] + [(500, None, None, None), (501, "", None, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(d, lab).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id < 400]
    assert len(out) == 402 and np.mean([r.predicted == (r.doc_id % 2 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.values())
    left = toxicity.drop_toxic(d, lab)
    assert left.columns == d.columns and left.count() == sum(r.predicted == 0 for r in out.values())
    assert toxicity.classify(empty, labels).count() == 0
    assert toxicity.classify(d, lab.limit(0)).count() == 402


def test_language(spark, empty):
    rng = random.Random(3)
    words = {"xx": ["the", "and", "house", "thing"], "yy": ["der", "und", "haus", "über"]}
    data = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k, "s") for i in range(200) for k in [("xx", "yy")[i % 2]]]
    d = spark.createDataFrame([*data, (900, None, None, None), (901, "12 34 !", "xx", None), (902, "", None, None)], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in language.identify(d).collect()}
    assert np.mean([out[i].lang_pred == k for i, _, k, _ in data if out[i].held_out]) > 0.95
    assert {out[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert language.identify(empty).count() == 0


def test_language_rules_and_network(spark):
    assert [language.has_letter(t) for t in ("½ ² 12", "", "!?", "ß", "1a", "ª", "日")] == [False, False, False, True, True, True, True]
    assert language.sampled("x" * 5000).shape == (6, 96) and language.sampled("").shape == (1, 96)
    rng = np.random.default_rng(4)
    n = language.FILTERS * len(language.WIDTHS)
    model = [rng.normal(0, 1, s).astype(np.float32) for s in ((256, language.DIM), (4 * language.DIM, n), (n,), (n, 3), (3,))]
    x = rng.integers(0, 256, (2, language.WINDOW)).astype(np.uint8)
    for row, got in zip(x, language.log_probabilities(model, x)):
        pooled = [max(sum(float(model[0][row[p + k], d]) * float(model[1][k * language.DIM + d, f]) for k in range(4) for d in range(language.DIM)) for p in range(language.WINDOW - 3)) + float(model[2][f]) for f in range(n)]
        z = [sum(max(h, 0) * float(model[3][f, k]) for f, h in enumerate(pooled)) + float(model[4][k]) for k in range(3)]
        want = [v - max(z) - np.log(sum(np.exp(u - max(z)) for u in z)) for v in z]
        assert np.allclose(got, want, atol=1e-3)
    data = [(1, "the house", "xx"), (None, "the house", "xx"), (2, "das haus", "yy"), (2, "das haus", "yy"), (3, "½ ² 12", "xx"), (4, "das haus " * 30_000, "yy")]
    d = spark.createDataFrame([(a, b, c, 1, 1) for a, b, c in data], "doc_id long, text string, lang string, h long, windows long")
    out = language.identify(d).collect()
    assert len(out) == 6 and {r.lang_pred for r in out if r.doc_id == 3} == {"und"} and all(0 <= r.score <= 1 for r in out)


def test_factorization_machine_scores_pairs(spark):
    rng = np.random.default_rng(3)
    model = (np.float32(0.1), rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), rng.normal(0, 1, (toxicity.BUCKETS, toxicity.FACTORS)).astype(np.float32), np.abs(rng.normal(0, 1, toxicity.BUCKETS)).astype(np.float32), 0.25)
    texts = ["a bad word here", "one", "", None, "a a a b", "Long text " * 2000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "one", 1), (1, "one", 1)], "doc_id long, text string, score long")
    got = Counter((r.doc_id, round(r.score, 4)) for r in toxicity.score(df, model).collect())
    want = Counter()
    for i, t in [*enumerate(texts), (None, "one"), (1, "one")]:
        ids, x = toxicity.features((t or "").encode(), toxicity._Terms())
        x = [float(a) * float(model[3][k]) for k, a in zip(ids, x)]
        y = float(model[0]) + sum(float(model[1][k]) * a for k, a in zip(ids, x))
        for p in range(len(ids)):
            for q in range(p):
                y += float(model[2][ids[p]] @ model[2][ids[q]]) * x[p] * x[q]
        want[i, round(float(1 / (1 + np.exp(-np.clip(y, -30, 30)))) if len(ids) else 0.25, 4)] += 1
    assert {k[0] for k in got} == {k[0] for k in want} and all(min(abs(k[1] - j[1]) for j in want if j[0] == k[0]) < 2e-3 for k in got)


def test_toxic_pairs_are_learnt(spark):
    rng = random.Random(8)
    data = []
    for i in range(1200):
        words = text(rng, 20).split()
        for word, odds in (("insult", 0.5), ("group", 0.5)):
            if rng.random() < odds:
                words.insert(rng.randrange(len(words)), word)
        data.append((i, " ".join(words), int("insult" in words and "group" in words)))
    d = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = list(toxicity.train(d, lab, "doc_id % 4 <> 2"))
    right = [np.mean([(r.score >= 0.5) == bool(data[r.doc_id][2]) for r in toxicity.score(d, tuple(m)).collect() if r.doc_id % 4 == 2]) for m in (model, [*model[:2], model[2] * 0, *model[3:]])]
    assert right[0] > 0.93 and right[0] > right[1] + 0.05


def test_rows_are_judged_one_by_one(spark):
    rng = random.Random(13)
    item, clean = text(rng, 30), text(rng, 40)
    data = [(1, clean), (1, clean + " " + item), (None, item), (None, clean), (2, None), (2, ""), (3, item + " " + clean * 50), (1, clean)]
    d = spark.createDataFrame([(a, b, i, "x") for i, (a, b) in enumerate(data)], "doc_id long, text string, `a.b` long, _text string")
    bench = spark.createDataFrame([(None, item), (4, item), (5, None)], "item_id long, text string")
    assert sorted(r["a.b"] for r in decontaminate.decontaminate(d, bench).collect()) == [0, 3, 4, 5, 7]
    assert pairs(decontaminate.search(d, bench), "doc_id", "item_id") == Counter((a, b) for a in (1, None, 3) for b in (None, 4))
    train_on = [(i, text(rng, 40) + (" scumbag" * (i % 5 == 0))) for i in range(100, 600)]
    more = [(None, text(rng, 40) + " scumbag"), (100, text(rng, 40) + " scumbag"), (100, text(rng, 40)), (None, text(rng, 40)), (7, None)]
    d = spark.createDataFrame([*train_on, *more], "doc_id long, text string")
    left = toxicity.drop_toxic(d, spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in train_on], "doc_id long, toxic int"))
    got = pairs(left, "doc_id", "text")
    assert not got[more[0]] and not got[more[1]] and got[more[2]] and got[more[3]] and got[more[4]]


@pytest.mark.parametrize("block, size", [(5, 1 << 20), (20_000, 2000)])
def test_benchmark_blocks(spark, docs, monkeypatch, block, size):
    bench = spark.createDataFrame([(i, rows()[i][1]) for i in range(0, 40, 3)], "item_id long, text string")
    want = pairs(decontaminate.search(docs, bench), "doc_id", "item_id", "n_shingles", "n_found"), decontaminate.decontaminate(docs, bench).count()
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    assert (pairs(decontaminate.search(docs, bench), "doc_id", "item_id", "n_shingles", "n_found"), decontaminate.decontaminate(docs, bench).count()) == want


def test_decontamination(spark, docs, empty):
    items = [(1, rows()[3][1]), (2, "not in any text at all here"), (3, None), (4, ""), (5, " ".join(rows()[7][1].split()[:40] + ["zz"] * 4)), (6, "a shared"), (6, "A SHARED LINE OF WORDS")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t, *_ in {(r[0], r[1]) for r in rows()}:
        own = decontaminate.shingles((t or "").encode().lower().split())
        for i, x in items:
            g = decontaminate.shingles((x or "").encode().lower().split())
            if g and len(g & own) >= 0.8 * len(g):
                want[d, i, len(g), len(g & own)] = 1
    assert pairs(decontaminate.search(docs, bench), "doc_id", "item_id", "n_shingles", "n_found") == want and want
    bad = {k[0] for k in want}
    assert decontaminate.decontaminate(docs, bench).count() == sum(r[0] not in bad for r in rows())
    assert decontaminate.search(empty, bench).count() == 0 and decontaminate.search(docs, bench.limit(0)).count() == 0


def test_lines(docs, empty):
    out = lines.dedup_lines(docs, min_sites=8)
    assert out.count() == docs.count() and lines.dedup_lines(empty).count() == 0
    hit = [r for r in out.where("doc_id between 300 and 313").collect()]
    assert sum(r.n_removed for r in hit) == 13 and sum("a shared line" in r.text for r in hit) == 1
    assert out.where("doc_id = 200 and text is null and n_lines = 0").count() == 1
    assert sum(r.n_removed for r in lines.dedup_lines(docs, min_sites=15).collect()) == 0
    strip = lines.strip_lines(docs, min_sites=8).where("doc_id between 300 and 313").collect()
    assert sorted(r.text for r in strip) == sorted(r.text for r in hit) and all(r.n_chars == len(r.text) for r in strip)
    assert all("shared line" not in r.text for r in lines.dedup_lines(docs, min_sites=8, keep_first=False).where("doc_id between 300 and 313").collect())


@pytest.mark.parametrize("hot", [1, 40, 10**9])
def test_hot_lines_are_sent(docs, monkeypatch, hot):
    want = pairs(lines.dedup_lines(docs, 3), "doc_id", "n_lines", "n_removed", "text")
    monkeypatch.setattr(lines, "HOT_LINES", hot)
    assert pairs(lines.dedup_lines(docs, 3), "doc_id", "n_lines", "n_removed", "text") == want


def test_quality(spark, docs, empty, labels):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b c a b", "x " * 300, "# | $ a\nb\na\n\n a", " ".join(f"p{i % 60} q" for i in range(400)), "é ü x y"])], "doc_id long, text string")

    def want(t):
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        g = list(zip(w, w[1:], w[2:]))
        c, cover = Counter(g), set()
        for i, x in enumerate(g):
            cover |= {i, i + 1, i + 2} if c[x] > 1 else set()
        ls = [x for x in (t or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        return len(w), sum(map(len, w)), sum((t or "").count(z) for z in "#*$%&|<>"), len(ls) - len(set(ls)), len(cover), failed

    for d in (docs, extra):
        texts = [(r.doc_id, r.text) for r in d.collect()]
        got = pairs(quality.filter_quality(d, labels), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == Counter((i, *want(t)) for i, t in texts)
    assert quality.filter_quality(empty, labels).count() == 0
    assert quality.filter_quality(docs, labels.limit(0)).where("base_failed and kept").count() == 0


def test_all_trusted_documents_count(spark, docs, monkeypatch):
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(205,), (None,), (999,)], "doc_id long")
    want = quality.log_ratios(docs, trusted)
    passes = []
    monkeypatch.setattr(quality, "ngrams_of", lambda x, f=quality.ngrams_of: (passes.append(1), f(x))[1])
    for most, expected in ((30, 1), (12, 2), (5, 2), (1, 2)):  # ids in one block, in two, and shuffled
        passes.clear()
        monkeypatch.setattr(quality, "MOST_TRUSTED", most)
        assert quality.log_ratios(docs, trusted) == want and len(set(want)) > 2 and len(passes) == expected


def test_ratio_and_verdict(docs, labels):
    def hashed(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return (h - (1 << 64) * (h >> 63)) % quality.BUCKETS

    def grams(t):
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]
        return [hashed(x) for x in w] + [hashed(*x) for x in zip(w, w[1:])]

    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    raw, target = Counter(), Counter()
    for r in rows():
        raw.update(grams(r[1]))
        target.update(grams(r[1]) if r[0] in good else [])
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    of = lambda g: sum(np.log((target[b] + 1) / m) - np.log((raw[b] + 1) / n) for b in g) / len(g) if g else 0.0
    seen = set()
    middle = sorted(r.ratio for r in quality.filter_quality(docs, labels).where("not base_failed").collect())
    least = middle[len(middle) // 2]
    for r in quality.filter_quality(docs, labels, least).collect():
        ratios = [of(grams(t)) for i, t, *_ in rows() if i == r.doc_id]
        assert min(abs(x - r.ratio) for x in ratios) < 1e-5
        assert r.kept == (not r.base_failed and r.ratio >= least)
        seen.add(r.kept)
    assert seen == {True, False}


def test_maxent(docs, empty):
    out = {r.doc_id: r for r in maxent.score_language(docs).collect()}
    learn = [r for r in rows() if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(w for r in learn for w in (r[1] or "").encode().lower().split() + [b""])
    n, v = sum(c.values()), len(c)
    for r in rows():
        w = (r[1] or "").encode().lower().split() + [b""]
        o = out[r[0]]
        assert (o.n_tokens, o.n_known, o.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(o.base_score - sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert np.isfinite(o.score) and o.score < 0
    assert maxent.score_language(empty).count() == 0


def test_mixing_keeps_what_one_shard_learnt(monkeypatch, docs):
    one = np.ones((3, 2), np.float32)
    shards = [(one * 4, one[:, 0], np.array([8, 0, 0], np.float32)), *((one * x, one[:, 0], np.array([0, n, 0], np.float32)) for x, n in ((0, 3), (2, 1), (2, 0)))]
    w, s, used = maxent.mix(shards)
    assert np.allclose(w, [[4, 4], [0.5, 0.5], [2, 2]], atol=1e-4) and (s == 1).all() and used.tolist() == [8, 4, 0]
    starts = []
    monkeypatch.setattr(maxent, "_round", lambda src, shards, tables, model, second: (starts.append((src.count(), float(model[0][0, 0]))), model[0].__iadd__(1)))
    maxent.train(docs, maxent.Tables(maxent.count_words(docs)), rounds=3)
    assert [x for _, x in starts] == [0, 1, 2] and sum(n for n, _ in starts) == docs.count()


@pytest.mark.parametrize("shard", [3000, 10**6])
def test_model_does_not_depend_on_partitions(spark, monkeypatch, shard):
    monkeypatch.setattr(maxent, "SHARD", shard)
    rng, data = random.Random(7), []
    for i in range(400):
        w = [rng.choice(WORDS[:40])]
        while len(w) < 60:
            w.append(WORDS[(WORDS.index(w[-1]) * 7 + rng.randint(0, 2)) % 300])
        data.append((i, " ".join(w)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    a, b = ({r.doc_id: r for r in maxent.score_language(d.repartition(n)).collect()} for n in (4, 32))
    assert all(abs(a[i].score - b[i].score) < 1e-6 and a[i].base_score == pytest.approx(b[i].base_score) for i in a)
    held = [r for r in a.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_shards_keep_their_size(spark, monkeypatch):
    """Where a task learns several shards, each starts from the mixed model and the average is the tree's."""
    monkeypatch.setattr(maxent, "SHARD", 1500)
    rng = random.Random(8)
    d = spark.createDataFrame([(i, text(rng, 60)) for i in range(300)], "doc_id long, text string")
    tables = maxent.Tables(maxent.count_words(d))
    models = []
    for tasks in (10_000, 2, 1):
        monkeypatch.setattr(maxent, "TASKS", tasks)
        models.append(maxent.train(d, tables))
    assert all(np.allclose(a, b, atol=2e-3) for other in models[1:] for a, b in zip(models[0], other)) and max(abs(w).max() for w in models[0]) > 0.05


def test_gradient_steps_lower_the_loss(spark):
    """The loss a step descends is the model's own log probability, which sums over features one by one."""
    rng = random.Random(9)
    data = [" ".join(WORDS[(i * 7 + j * j) % 90] for j in range(80)).encode() for i in range(30)]
    d = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(data)], "doc_id long, text string")
    tables = maxent.Tables(maxent.count_words(d))
    words, code, starts = maxent.cut(data)
    idx = maxent._indices(tables.lookup(), words, tables.places)[code]
    model = maxent.new_model(tables)
    before = maxent.log_probs(tables, model, idx, starts).sum()
    second, used = [np.full(len(w), 1e-2, np.float32) for w in model], [np.zeros(len(w), np.float32) for w in model]
    for _ in range(3):
        maxent.learn(tables, model, second, used, idx, starts)
    assert maxent.log_probs(tables, model, idx, starts).sum() > before + 0.2 * abs(before)


def test_sample_rate_never_loses_a_class():
    for n in (0, 1, 3000, 10**6, 5 * 10**9, 10**13):
        rate = toxicity.sample_rate(4000, n)
        assert 0 < rate <= toxicity.SHARES and rate * max(1, n) <= 4000 * toxicity.SHARES
        assert n < 4000 or rate * n > 0.99 * 4000 * toxicity.SHARES


def test_probabilities_sum_to_one(spark):
    data = [(i, " ".join(f"w{(i * 37 + j * j) % 4000}" for j in range(400))) for i in range(400)]
    counts = maxent.count_words(spark.createDataFrame(data, "doc_id long, text string")).cache()
    tables = maxent.Tables(counts)
    rng = np.random.default_rng(1)
    model = [rng.normal(0, 0.3, w.shape).astype(np.float32) for w in maxent.new_model(tables)]
    all_words = [bytes(r.word) for r in counts.collect()]
    n = {bytes(r.word): r.n for r in counts.collect()}
    known = tables.lookup()
    total = 0.0
    for w in all_words:
        idx = np.array([known[b" w3"], known[b" w5"], known[b" " + w if w else b" \xff"]])
        p = np.exp(maxent.log_probs(tables, model, idx, np.array([0]))[2])
        total += p * (n[w] + 1 if idx[2] >= maxent.VOCAB else 1)
    assert 0.98 < total < 1 + 1e-6  # a little is kept for unknown words


def test_encoder_is_exact():
    e = tokens.Encoder(tokenizer_path())
    rng = random.Random(3)
    bits = [" ", "\n", "a", "B", "é", "!", "1", "'s", "\t", " ", "\x1c", "  ", "\r\n", "<|endoftext|>", "x y", ". ", "\n\n", " \n", " ", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 10))) for _ in range(3000)]
    for _ in range(2):
        got = e.batch(texts)
        assert got == [np.array(e.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing(docs, empty):
    e = tokens.encoder(tokenizer_path())
    out = packing.pack(docs, tokenizer_path(), group=16).collect()
    ids = {r[0]: e(r[1] or "") + b"\0\0\0\0" for r in rows()}
    seqs = {}
    for r in out:
        raw = ids[r.doc_id]
        assert r.doc_tokens == len(raw) // 4 and r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    per = Counter(r[0] for r in rows())
    for d, n in per.items():
        mine = sorted((r.start, r.length) for r in out if r.doc_id == d)
        assert sum(x[1] for x in mine) == n * len(ids[d]) // 4
    assert packing.pack(empty, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_assign(lengths):
    got = packing.assign(lengths)
    fill = Counter()
    for i, a, n, s, off in got:
        assert off == fill[s] and n > 0
        fill[s] += n
    assert sum(1024 - x for x in fill.values()) < 1024 and sum(fill.values()) == sum(lengths)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1023), min_size=1, max_size=120))
def test_assign_takes_the_cheapest_with_room(lengths):
    n = -(-sum(lengths) // 1024)
    costs, fill, last = [0.0] * n, [0] * n, 1024
    for i, a, size, s, _ in packing.assign(lengths):
        assert costs[s] == min(c for c, f in zip(costs, fill) if f < 1024) and lengths[i] <= last
        costs[s], fill[s], last = costs[s] + packing.cost(size), fill[s] + size, lengths[i]


def test_assign_balances_cost():
    """Against filling one sequence after the other, the spread of costs falls to a small part."""
    rng = random.Random(4)
    lengths = [rng.choice([30, 60, 900]) for _ in range(600)]

    def spread(pieces):
        costs = Counter()
        for s, size in pieces:
            costs[s] += packing.cost(size)
        full = sorted(costs.values())[1:]  # one sequence may be short
        return max(full) - min(full)

    one_by_one, at = [], 0
    for n in lengths:
        while n:
            size = min(n, 1024 - at % 1024)
            one_by_one.append((at // 1024, size))
            n, at = n - size, at + size
    assert spread([(s, size) for _, _, size, s, _ in packing.assign(lengths)]) < 0.5 * spread(one_by_one)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=600))
def test_simple8b(ids):
    x = np.array(ids, np.uint64)
    p = binary.encode(x)
    assert (binary.decode(p) == x).all()
    assert (np.concatenate([binary.decode(p, k, 1) for k in range(10)]) == x).all()


def test_rows_of_one_id_are_dealt_out(spark, tmp_path):
    d = spark.createDataFrame([(7, f"text {i}") for i in range(400)] + [(8, "x"), (3, "y")], "doc_id long, text string").repartition(4)
    binary.write(d, f"{tmp_path}/ids", tokenizer_path())
    assert spark.read.parquet(f"{tmp_path}/ids").select("shard").distinct().count() > 3
    out = sorted(binary.read(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [3] + [7] * 400 + [8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))


def test_files(docs, empty):
    e = tokens.encoder(tokenizer_path())
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in binary.round_trip(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    at = 0
    for (d, start, n, crc), r in zip(got, sorted(rows(), key=lambda r: -1 if r[0] is None else r[0])):
        raw = e(r[1] or "") + b"\2\0\0\0"
        assert (d, start, n, crc) == (-1 if r[0] is None else r[0], at, len(raw) // 4, zlib.crc32(raw))
        at += n
    assert len(got) == len(rows()) and binary.round_trip(empty, tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(x):
    t = [*x, 0]
    assert suffixes.lyndon_suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def _removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        yield len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("kinds", [1000, 2])
@pytest.mark.parametrize("length, core", [(400, 128), (40, 8)])
def test_suffix_dedup(spark, docs, monkeypatch, kinds, length, core):
    monkeypatch.setattr(suffixes, "KINDS", kinds)
    rng = random.Random(5)
    passage = text(rng, 150)
    data = [(r[0], r[1]) for r in rows()] + [(1000 + i, text(rng, rng.randint(0, 40)) + passage[i : 700 - 3 * i] + text(rng, 50)) for i in range(12)] + [(2000, "ab" * 900), (2001, passage[:300] * 3)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    want = Counter((i, *r) for (i, _), r in zip(data, _removed([(t or "").encode() for _, t in data], length)))
    assert pairs(suffixes.dedup(d, length, core), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_suffix_dedup_of_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = [(r.doc_id, (r.text or "").encode()) for r in d.collect()]
    seen = Counter()
    for _, t in data:
        seen.update(xxhash.xxh3_128_digest(t[i : i + 400]) for i in range(len(t) - 399))
    want = Counter()
    for i, t in data:
        gone = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - 399):
            if seen[xxhash.xxh3_128_digest(t[p : p + 400])] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want[i, len(t), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]][: len(t)]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert pairs(suffixes.dedup(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 3), st.integers(1, 2)), min_size=1, max_size=12), st.integers(0, 2**32))
def test_order_of_a_part_finds_repeats(shapes, seed):
    rng, length = random.Random(seed), 40
    both = [bytes(rng.choice(b"ab") for _ in range(120)) for _ in range(4)]
    bodies = [both[k][60 - a : 60 + length + b] for a, b, k, _ in shapes]
    uniq = {(x, a): c for x, (a, _, _, c) in zip(bodies, shapes)}
    bodies, left, copies = [x for x, _ in uniq], np.array([a for _, a in uniq]), np.array(list(uniq.values()))
    strings = Counter((a - i, x[i : i + length]) for (x, a), c in uniq.items() for i in range(len(x) - length + 1) if a >= i for _ in range(c))
    for x, a, hit in zip(bodies, left, suffixes.repeated_starts(bodies, left, copies, length)):
        for i in range(min(a, len(x) - length) + 1):
            assert hit[i] >= (strings[a - i, x[i : i + length]] > 1)


def test_suffix_dedup_empty(empty):
    assert suffixes.dedup(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    data = [(i, text(rng, 60) + (" scumbag" * 3 if i % 10 == 0 else ""), "en", f"s{i % 12}", 0) for i in range(300)]
    item = text(rng, 30)
    data += [(400, data[1][1], "en", "s", 0), (401, data[2][1] + " " + item, "en", "s", 0), (402, None, None, None, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert not left & {400, 401}
    assert len(left & set(range(0, 300, 10))) <= 2
    assert {1, 2, 3, 402} <= left
    for name, (_, stage) in zip("abcd", corpus_pipeline.STAGES):
        src = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, src, str(tmp_path)).columns == src.columns
