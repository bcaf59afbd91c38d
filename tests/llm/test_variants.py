"""Clusters, spelling variants and chat texts against brute force; nulls, repeats, ties, long values and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row

from quarry.llm import chat, clusters, spelling

# --- clusters --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def lloyd(vectors, size, k, rounds, seed):
    data = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(data, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]

    def owners():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c)) for _, v in data]

    for _ in range(rounds):
        own = owners()
        for j in range(len(c)):
            mine = [v for (_, v), (_, o) in zip(data, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = owners()
    per = defaultdict(int)
    for d, j in own:
        per[j] += d
    return Counter((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(data, own))


def vectors(seed, n, size=4):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(rng.choice([-1, 0, 2]), 0.3) for _ in range(size)]) for i in range(n)]
    out += [(1000 + i, out[5][1]) for i in range(n // 3)]  # one vector with a third of all rows
    out += [out[7], out[7], (None, [0.5] * size), (None, None), (2000, None), (2001, [1.0]), (2002, []), (2003, [float("nan")] * size), (2004, [float("inf")] + [0.0] * (size - 1)), (2005, [None] * size), (2006, [100.0] * size)]
    return out


@pytest.mark.parametrize("seed, n, k, rounds", [(1, 90, 7, 5), (2, 40, 12, 1), (3, 9, 40, 4), (4, 60, 3, 0)])
def test_clusters_equal_lloyd(spark, seed, n, k, rounds):
    data = vectors(seed, n)
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in data], VECTORS).repartition(5)
    got = clusters.cluster(df, 4, k, rounds, 2)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert Counter(tuple(r) for r in got.collect()) == lloyd(data, 4, k, rounds, 2)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, [1.0], 0, "", ""), (2, None, 0, "", "")]):
        got = clusters.cluster(spark.createDataFrame(rows, VECTORS))
        assert got.count() == 0 and got.columns[:2] == ["vec_id", "cluster"]


def test_too_large_components_fail(spark):
    with pytest.raises(Exception, match="component is"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 4, 0, "", "")], VECTORS), 4).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.sets(st.integers(0, 8)), st.sampled_from([3, 1 << 23]))
def test_delta_comparison_equals_full(seed, k, which, scale):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-scale, scale, (50, 3)), rng.integers(-scale, scale, (k, 3))
    none = np.full(50, -1, np.int32)
    owner, distance = clusters.compare(x, none, np.zeros(50, np.int64), c, np.ones(k, bool))
    moved = np.array([j in which for j in range(k)])
    c[moved] = rng.integers(-scale, scale, (int(moved.sum()), 3))
    got = clusters.compare(x, owner, distance, c, moved)
    d = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
    assert got[0].tolist() == [min(range(k), key=lambda j: (r[j], j)) for r in d] and got[1].tolist() == [min(r) for r in d]


# --- spelling ----------------------------------------------------------------------------------------


def variants(docs):
    total = Counter()
    for doc_id, text in docs:
        run = ""
        for ch in (text or "") + "\0":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    n = {w: k for w, k in total.items() if len(w) >= 6 and k >= 5}
    return families(n)


def families(n):
    near = defaultdict(set)
    for w in n:
        for v in n:
            if len(w) == len(v) and sum(a != b for a, b in zip(w, v)) == 1 or len(w) == len(v) + 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w))):
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def writings(seed):
    rng = random.Random(seed)
    letters = "abÀé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(12)]
    for w in list(words):
        for _ in range(12):
            i = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]]))
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "ababababa", "bababab"]
    text = [w for w in words for _ in range(rng.choice([2, 5, 6, 30, 200]))]
    rng.shuffle(text)
    docs = [(i, "".join(w.upper().replace("É", "é") + rng.choice(" -\n.1ǅ") for w in text[i::9])) for i in range(9)]
    return [*docs, (None, docs[0][1]), docs[1], docs[1], (50, None), (51, ""), (52, " 12 "), (53, ("z" * 3000 + " ") * 6), (54, "qqqqqq " * 9 + "qqqqqqa " * 60 + "qqqqqqab " * 400)]


@pytest.mark.parametrize("seed, hot", [(1, 50_000), (2, 200), (3, 20), (4, 1)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "TOGETHER", 30)
    data = writings(seed)
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in data], "doc_id long, text string, word string, n long, form string").repartition(4)
    got = spelling.group_variants(df, hot).select("word", "n", "n_near", "form", "form_n", "root")
    want = variants(data)
    assert Counter(tuple(r) for r in got.collect()) == want and any(w[3] and w[5] != w[3] for w in want)


def test_variants_of_nothing(spark):
    got = spelling.group_variants(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and sorted(got.columns) == ["form", "form_n", "n", "n_near", "root", "word"]


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=7), min_size=1, max_size=40), st.text("ab", min_size=1, max_size=7))
def test_automaton(words, word):
    order = sorted(words)
    dawg = spelling.Automaton(order)
    assert [dawg.follow(dawg.root, 0, 0, w, 0) for w in order] == list(range(len(order)))
    rests = {frozenset(w[len(p) :] for w in order if w.startswith(p) and w != p) for x in order for p in (x[:i] for i in range(len(x) + 1))}
    assert len(dawg.moves) == len(rests)  # a state for each set of endings
    if word in words:
        near = dawg.near(word, 0, len(word))
        assert len(near) == len(set(near)) and {order[i] for i in near} == {w for w in families(dict.fromkeys([*words, word], 1)) and words if w != word and one_apart(w, word)}
        cut = len(word) // 2
        assert sorted(dawg.near(word, 0, cut) + dawg.near(word, cut, len(word))) == sorted(near) or cut == 0


def one_apart(a, b):
    a, b = sorted((a, b), key=len)
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


# --- chat --------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, example int, loss_start string"
NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "<\u2060|im_end|>", "<\u2060\u2060|", "<", "<|", "[INST", "$1\\", "a\nb", "", None, "<<s>>[[INST]]", "é😀" * 4000]


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(25):
        roles = [rng.choice(["user", "assistant", "assistant", "system", "<|im_sep|>", None]) for _ in range(rng.randint(1, 9))]
        rows += [(c, t, r, rng.choice(NASTY) if rng.random() < 0.6 else f"text {rng.random()}") for t, r in enumerate(roles)]
    rows += [(100, t, "assistant" if t % 2 else "user", f"<s>{t}") for t in range(300)]
    rows += [(101, 0, "user", "q"), (101, 0, "user", "q"), (101, None, "assistant", "first"), (None, 1, "assistant", "no id"), (102, 5, "user", "alone")]
    return rows


def want(rows):
    out = []
    for c in {r[0] for r in rows}:
        t = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        said = "".join(x[3] for x in t if x[2] == "assistant")
        out.append((c, len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in t).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_chat_round_trip(spark):
    rows = talks(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(6)
    examples = chat.expand(df)
    got = examples.collect()
    per = defaultdict(list)
    for r in got:
        per[r.conv_id].append(r)
    for c, own in per.items():
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        ends = [k + 1 for k, t in enumerate(turns) if t[2] == "assistant" or k == len(turns) - 1]
        own.sort(key=lambda r: r.example)
        assert [r.n_turns for r in own] == ends and [r.final for r in own] == [False] * (len(ends) - 1) + [True]
        for r in own:
            assert r.text.count(chat.END) == r.text.count(chat.START) == r.n_turns and own[-1].text.startswith(r.text)  # all preceding turns
            assert r.reply == (turns[r.n_turns - 1][2] == "assistant") and r.text[r.loss_start + r.loss_length :].startswith(chat.END) == r.reply
    d = chat.digests(examples)
    assert sorted((tuple(r)[:5] for r in d.collect()), key=repr) == want(rows)
    assert {r.conv_id: r.formatted_chars for r in d.collect()} == {c: sum(len(r.text) for r in own) for c, own in per.items()}
    assert not any(x in r.text.replace(chat.START, "").replace(chat.MIDDLE, "").replace(chat.END, "") for r in got for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_chat_turns_come_back(spark):
    rows = [(k, t, r or "", x or "") for k, t, r, x in talks(2) if k is not None and t is not None and k < 100]
    last = chat.expand(spark.createDataFrame([(*r, 1, "") for r in rows], TURNS)).where("final").select("conv_id", chat.turns_of("text").alias("t"))
    assert {r.conv_id: [tuple(x) for x in r.t] for r in last.collect()} == {c: [(r, x) for k, _, r, x in sorted(rows) if k == c] for c in {r[0] for r in rows}}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("<|s>[/INST]\u2060a", max_size=14), min_size=1, max_size=20))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([Row(x=x) for x in texts], "x string").select("x", chat.escape("x").alias("e"))
    for r in df.select("x", "e", chat.unescape("e").alias("u")).collect():
        assert r.u == r.x and not any(c in r.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_chat_is_native(spark):
    empty = chat.digests(chat.expand(spark.createDataFrame([], TURNS)))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.digests(chat.expand(chat.with_probe(spark.createDataFrame([], TURNS)))).first().n_turns == 2
