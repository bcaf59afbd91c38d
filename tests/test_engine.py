"""The engine's operators: against their SQL oracles, plain Python loops and their edge cases."""

import os
import random
import re
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, strategies as st

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry.functions import text as T, vectors as V
from quarry.functions.models import LayoutModel
from quarry.operators import chunk as C, evaluate as E, jobs as J, preprocess as P, retrieve as R, tables as TB
from quarry.plans import pipeline as PL
from quarry.queries import ORACLES, QUERIES
from quarry.sources import shared, tables as S
from quarry.sources.paged import pages_as_documents, read_pages
from quarry.sources.store import text_store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests
DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), f"/d/{i}.txt", t, "") for i, t in enumerate(texts)], "doc_id string, source_path string, text string, preprocessor_name string")


def chunks(df):
    return [r.text for r in df.orderBy("doc_id", "chunk_idx").collect()]


def test_character_windows(spark):
    rng = random.Random(1)
    texts = ["", "abc", "x" * 10, "é\U0001f600" * 20, "a\nb" * 30, None] + ["".join(rng.choice("ab \n") for _ in range(n)) for n in (9, 10, 11, 17, 18, 100)]
    for size, overlap in ((10, 0), (10, 3), (10, 9), (1, 0)):
        want = []
        for t in texts:
            t, k = t or "", 0
            while t:
                want.append(t[k : k + size])
                if k + size >= len(t):
                    break
                k += size - overlap
        assert sorted(chunks(C.by_characters(docs(spark, *texts), size, overlap))) == sorted(want)
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            C.by_characters(docs(spark, "a"), *bad)


def test_paragraphs_fall_back_to_lines(spark):
    nine, ten = "\n\n".join("abcdefghi"), "\n \n".join("abcdefghij")
    assert chunks(C.by_paragraphs(docs(spark, nine + "\nz"))) == [*"abcdefghi", "z"]
    assert chunks(C.by_paragraphs(docs(spark, ten + "\nz")))[-1] == "j\nz"
    assert chunks(C.by_paragraphs(docs(spark, "\xa0a\x1c\n b"), 2, 1)) == ["a\n\nb"]


def test_sentence_packing():
    t = "Eins zwei drei. Vier fünf. " + "w " * 7 + "ende. Noch einer."
    assert C.pack_sentences(t, 5, 0) == ["Eins zwei drei.", "Vier fünf. w w w", "w w w w ende.", "Noch einer."]
    rng = random.Random(4)
    for _ in range(200):
        t = " ".join(rng.choice(["A", "b", "c.", "D!", "e"]) for _ in range(rng.randint(0, 60)))
        size = rng.randint(1, 12)
        parts = C.pack_sentences(t, size, 0)
        assert " ".join(parts).split() == t.split() and all(len(p.split()) <= size for p in parts)
        assert all(len(p.split()) <= size for p in C.pack_sentences(t, size, rng.randint(0, size - 1)))


def test_whole_tables():
    table = "| a |\n| - |\n| 1 |"
    assert TB.whole_tables("a\nb\nc") == ["", "b", "c"] and TB.whole_tables("a") == []
    assert TB.whole_tables(f"t\ns\n{table}") == [TB.LEGEND + "t\ns\n" + table]
    near = TB.whole_tables(f"t\ns\n{table}\none\n{table}")
    assert len(near) == 1 and near[0].startswith(TB.LEGEND + "| 1 |\none\n")
    assert len(TB.whole_tables(f"t\ns\n{table}\none\n{table}", compat=False)) == 2
    for bad in (f"t\n{table}", f"t\n**b**\n{table}"):
        with pytest.raises(IndexError):
            TB.whole_tables(bad + "\nx") if bad.startswith("t\n|") else TB.whole_tables("t\n" + table)
    assert TB.whole_tables(f"t\n{table}", compat=False)


def test_split_tables(spark):
    plan = "# Kopf\n### 1. Sem\n*Summe: 2*\n\n| M | LP |\n| :--- | :--- |\n| **X** | 2 LP |\n| u | Pnr. 3 |\n| **Y** | 1 SWS |\n\nText. Mehr."
    assert TB.study_plan(plan) == ["# Kopf", "### 1. Sem\n\n| **X** | 2 ECTS-Leistungspunkte |\n| u | Prüfungsnummer 3 |", "### 1. Sem\n\n| **Y** | 1 Semesterwochenstunden |", "Text.", "Mehr."]
    book = "### Modul: A\n**Lehrveranstaltungen und Lehrformen:** a: X / 1 | b: Y (Ü) / 2<br>\n**F:** (a) und (b) | b: 3\n## Ende\n**frei** Satz."
    assert TB.module_handbook(book)[1:] == ["### Modul: A\n**F:** (X) und (Y (Ü)) | Y (Ü): 3", "**frei** Satz."]
    assert [r.chunk_id for r in TB.by_split_tables(docs(spark, book)).collect()] == ["0_chunk_0", "0_chunk_1", "0_chunk_2"]


def test_boundaries(spark):
    paras = [f"p{i} " + "wort " * 100 for i in range(20)]
    assert C.find_boundaries(paras[:5], lambda w: None) == [5] and C.find_boundaries([], None) == []
    ends = C.find_boundaries(paras, lambda w: f"Answer: ID {w[1][0]}")
    assert ends[-1] == 20 and ends[:3] == [1, 2, 3]
    assert C.find_boundaries(paras, lambda w: "answer: id 999")[0] == C.find_boundaries(paras, lambda w: "Answer: ID 0")[0]
    assert C.find_boundaries(paras, lambda w: "no idea") == [20]
    assert C.find_boundaries(["w " * 600] * 8, lambda w: 1 / 0) == [1, 2, 3, 8]
    ten = ["w " * 300] * 10
    assert C.find_boundaries(ten, lambda w: "Answer: ID 99") == [2, 4, 6, 10] and C.find_boundaries(ten, lambda w: f"Answer: ID {w[0][0]}") == [2, 4, 6, 10]
    assert C.find_boundaries(ten, lambda w: f"Answer: ID {w[-1][0]}") == [1, 2, 3, 4, 5, 10] and C.find_boundaries(ten, lambda w: f"Answer: ID {w[-1][0] + 1}") == [2, 4, 6, 10]
    assert C.find_boundaries(ten, lambda w: None) == [10] and C.find_boundaries(ten, lambda w: None if w[0][0] == 0 else "Answer: ID 0") == [4, 6, 10]
    d = docs(spark, "\n\n".join(paras))
    first = C.boundaries(d)
    again = C.boundaries(d, lambda w: 1 / 0, first)
    assert again.select("boundary_ids", "cached").first() == (first.first().boundary_ids, True)
    assert "".join(chunks(C.by_model(d))).replace("\n", "").replace(" ", "") == "".join(paras).replace(" ", "")


def test_clusters():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 3))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want, groups, low = [0], [[0]], None
    for i in range(1, 40):
        sims = [float(u[i] @ u[j]) for j in groups[-1]]
        if len(sims) == 1:
            low2, sim, bar = sims[0], 1.5 * sims[0], 0
        else:
            bar, sim, low2 = low * 0.9 / (1 + np.exp(-(len(sims) - 1))), max(sims), min(min(sims), low)
        if sim > max(bar, 0.2):
            groups[-1].append(i)
            low = low2
        else:
            groups.append([i])
        want.append(len(groups) - 1)
    assert C.cluster_vectors(v, 0.2, 0.9, 1.5) == want and C.cluster_vectors(v[:0], 0.2, 0.9, 1.5) == []


def test_budget_and_grid(spark):
    want = {221.9: (18, 6), 385.2: (9, 3), 97.4: (45, 15), 40.4: (111, 37), 121.6: (36, 12), 752.2: (3, 1), 77.2: (57, 19), 5000.0: (3, 1)}
    rows = spark.createDataFrame([(x,) for x in want], "avg double").select("avg", *E.budget(F.col("avg"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want
    assert PL.grids(spark).groupBy("chunker").count().where("chunker = 'maxmin'").first()["count"] == 10


def test_search_edges(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "ordinal long, embedding array<double>")
    q = spark.createDataFrame([(7, 0, [1.0, 0.0]), (8, 0, [0.0, 0.0])], "query_id long, variant int, embedding array<double>")
    got = {(r.query_id, r.rank): r.ordinal for r in R.top_k(v, q, 9).collect()}
    assert [got[7, k] for k in (1, 2, 3, 4)] == [0, 2, 1, 3] and [got[8, k] for k in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert R.top_k(v.limit(0), q, 3).count() == 0 and R.top_k(v, q.limit(0), 3).count() == 0
    hits = spark.createDataFrame([(1, 0, 1, 5, 0.9), (1, 0, 2, 6, 0.8), (1, 1, 1, 6, 0.7), (1, 1, 2, 5, 0.6)], "query_id long, variant int, rank int, ordinal long, score double")
    assert [(r.ordinal, r["rank"]) for r in R.fuse(hits, 5).orderBy("rank").collect()] == [(5, 1), (6, 2)]


def test_empty_context_and_batches(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, original_query string")
    hits = spark.createDataFrame([(1, 1, "x", 0.5)], "query_id long, rank int, text string, reranking_score double")
    ctx = R.contexts(q, hits)
    assert {r.query_id: r.response for r in R.answer(ctx).collect()} == {1: "x", 2: R.REFUSAL}

    def small(prompts):
        if len(prompts) > 1:
            raise MemoryError
        return [f" {len(prompts)} "]

    assert {r.response for r in R.answer(ctx, small).collect()} == {"1"}


def test_pipelines(spark, tmp_path):
    config = {"offline_config": {"chunking_params": {"chunk_size": 60, "overlap": 10}}, "online_config": {"top_k": 4, "top_n": 2, "reranking_score_threshold": 0.1}, "offline_pipeline": {"preprocessors": ["GeminiMarkdownProcessor", "DirectLLMProcessor"], "chunker": "FixedCharacterChunker", "index_builder": "FaissIndexBuilder"}, "online_pipeline": {"query_processor": "CoTQueryProcessor", "retriever": "FaissRetriever", "reranker": "JinaReranker", "generator": "HuggingfaceGenerator"}}
    offline, online = PL.from_config(config)
    d = docs(spark, "Die Katze schläft auf dem Sofa. " * 4, "| A | B |\n| - | - |\n| eins | zwei |", "")
    done, index = offline.run(d, f"{tmp_path}/index")
    assert done.first().doc_id.endswith("_markdown_gemini_direct_llm") and index.count() == R.load_index(spark, f"{tmp_path}/index").count()
    assert sorted(r.ordinal for r in index.select("ordinal").collect()) == list(range(index.count()))
    assert "Katze" in online.query(index, "Wo schläft die Katze").first().response
    assert online.batch(index, spark.createDataFrame([], "query_id bigint, original_query string")).count() == 0
    assert PL.pipeline_name(offline, online) == "Gemini_Direct_FixedC_FaissI_CoTQue_FaissR_JinaRe_Huggin"
    with pytest.raises(ValueError):
        PL.component("Nothing")
    with pytest.raises(ValueError):
        PL.OfflinePipeline([], "PassthroughChunker", "PassthroughIndexBuilder", PL.Offline())
    with pytest.raises(ValueError):
        R.build_index(C.whole(docs(spark, "")), None, f"{tmp_path}/none")
    qa = spark.createDataFrame([(0, "Wo schläft die Katze", "auf dem Sofa")], "qa_idx long, user_input string, reference string")
    runs = [{"name": PL.run_name("direct", "character", threshold=t), "preprocessors": ["RawTextProcessor"], "chunker": "FixedCharacterChunker", "params": {"chunk_size": 60, "overlap": 0}, "threshold": t} for t in (0.0, 0.1)]
    out = PL.run_experiment(d, qa, runs, str(tmp_path)).collect()
    assert [r.run_name for r in out] == ["direct__character__thr00", "direct__character__thr01"] and out[0].answer_correctness > 0


def test_sources(spark, tmp_path):
    for name, body in (("a.b.txt", "eins"), ("c.txt", "zwei")):
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / name).write_text(body)
    got = S.from_paths(spark, [f"{tmp_path}/docs"])
    assert {(r.doc_id, r.text) for r in got.collect()} == {("a.b", "eins"), ("c", "zwei")}
    cache = S.text_cache(spark, f"{tmp_path}/docs")
    with pytest.raises(Exception, match="not in the text cache"):
        S.converted(got, cache, "gemini").collect()
    (tmp_path / "qa.json").write_text('[{"user_input": "f", "reference": "r"}, {"user_input": "g", "reference": null}]')
    assert [tuple(r) for r in S.qa_pairs(spark, f"{tmp_path}/qa.json").orderBy("qa_idx").collect()] == [(0, "f", "r"), (1, "g", None)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "doc_1__0123456789abcdef.json").write_text('{"boundary_ids": [1, 4]}')
    (tmp_path / "b" / "doc_2__0123456789abcdef.json").write_text("{broken")
    assert [tuple(r) for r in S.boundary_cache(spark, f"{tmp_path}/b").collect()] == [("doc_1", "0123456789abcdef", [1, 4])]
    (tmp_path / "docs" / "p.pdf").write_bytes(b"%PDF-1.4 \xff\xfe")
    with pytest.raises(Exception, match="not a text file"):
        S.from_paths(spark, [f"{tmp_path}/docs"]).collect()
    assert {r.text for r in S.from_paths(spark, [f"{tmp_path}/docs"], lambda b: f"{len(b)} bytes").collect()} == {"eins", "zwei", "11 bytes"}
    with pytest.raises(Exception, match="not converted"):
        P.preconverted(spark.createDataFrame([("a", None)], "doc_id string, text string"), "x").collect()
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("z",)], "y string")
    S.write_summary([a, b], f"{tmp_path}/s.csv")
    assert spark.read.csv(f"{tmp_path}/s.csv", header=True).columns == ["x", "y"]


def test_retries():
    calls, waits = [], []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise RuntimeError("503 busy")
        return "ok"

    assert P.with_retries(flaky, wait=waits.append)("x") == "ok" and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(ValueError):
        P.with_retries(lambda p: (_ for _ in ()).throw(ValueError("no")), wait=waits.append)("x")


def test_page_contexts(spark):
    rows = [("d", 1, 10.0, "text", "vor"), ("d", 1, 90.0, "text", "titel"), ("d", 1, 100.0, "table", None), ("d", 2, 5.0, "text", "nach"), ("e", 1, 1.0, "text", "nur")]
    out = {r.doc_id: (r.contexts, r.captions) for r in P.page_contexts(spark.createDataFrame(rows, "doc_id string, page int, y double, kind string, text string")).collect()}
    assert out == {"d": (["vor", "nach"], ["titel"]), "e": (["nur"], [])}  # a caption is in no context
    rows = [("f", 1, 0.0, "table", None), ("f", 1, 0.0, "text", "a"), ("f", 1, 20.0, "text", "b"), ("f", 1, 70.0, "table", None), ("f", 1, 100.0, "text", "c"), ("f", 2, 10.0, "table", None)]
    got = P.page_contexts(spark.createDataFrame(rows, "doc_id string, page int, y double, kind string, text string")).first()
    assert (got.contexts, got.captions) == (["", "a", "c", ""], ["", "b", ""])


def test_stream(spark, tmp_path):
    from quarry.streaming.online import answer_stream

    offline = PL.OfflinePipeline(["RawTextProcessor"], "PassthroughChunker", "FaissIndexBuilder", PL.Offline())
    _, index = offline.run(docs(spark, "Die Katze schläft"), f"{tmp_path}/index")
    online = PL.OnlinePipeline("NoProcessingProcessor", "FaissRetriever", "JinaReranker", "PassthroughGenerator", PL.Online())
    spark.createDataFrame([(1, "Katze")], "query_id bigint, original_query string").write.json(f"{tmp_path}/in")
    src = spark.readStream.schema("query_id bigint, original_query string").json(f"{tmp_path}/in")
    q = answer_stream(src, index, online, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert "Katze" in spark.read.parquet(f"{tmp_path}/out").first().response


def test_text_rules_agree(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "B.", "ä", " ", "\n", "\n\n", "\xa0", "\x1c", "Ü", "1", "!", " LP"]) for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.sentences(F.col("t")).alias("s"), T.paragraphs(F.col("t")).alias("p"), T.approx_tokens(F.col("t")).alias("n"), T.expand_abbreviations(F.col("t")).alias("e"), T.lines(F.col("t")).alias("l")).collect():
        assert (r.s, r.p, r.n, r.e, r.l) == (T.split_sentences(r.t), T.split_paragraphs(r.t), T.approx(r.t), T.expand(r.t), r.t.splitlines())
    assert re.match(r"[0-9a-f]{16}$", T.short_hash("x")) and V.hash_bucket("x") < V.DIM


@given(st.lists(st.sampled_from(["SWS", "ECTS-LP", "LP", "MP", "SL", "PBB", "Pnr.", "Pnr", "ECTS-", "7", "12", "\u0663", " ", "  ", "\n", "-", ".", "x", "ä", "_", "|"]), max_size=12).map("".join))
def test_one_scan_expands_like_one_pattern_after_the_other(text):
    expected = text
    for pattern, full in T.ABBREVIATIONS:
        expected = re.sub(pattern, full, expected)
    assert T.expand(text) == expected


def test_few_large_row_groups_are_dealt_out(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/one"
    spark.range(1000).selectExpr("id", "repeat(md5(string(id)), 100) as t").coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    assert shared.spread(scan) is scan  # too small for tasks of its own
    monkeypatch.setattr(shared, "TASK_BYTES", 1 << 10)
    dealt = shared.spread(scan)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(scan.collect())
    many = f"{tmp_path}/many"
    scan.repartition(spark.sparkContext.defaultParallelism).write.parquet(many)
    many = spark.read.parquet(many)
    assert shared.spread(many) is many
    scan.limit(0).write.parquet(f"{tmp_path}/none")
    assert shared.spread(spark.read.parquet(f"{tmp_path}/none")).count() == 0


def test_few_row_groups_of_few_files(spark, tmp_path, monkeypatch):
    """A file of many row groups is read by many tasks, so it isn't shuffled."""
    monkeypatch.setattr(shared, "TASK_BYTES", 1 << 10)
    path = f"{tmp_path}/groups"
    spark.range(20000).selectExpr("id", "repeat(md5(string(id)), 20) as t").coalesce(1).write.option("parquet.block.size", 1 << 16).option("parquet.page.size", 1 << 12).option("parquet.enable.dictionary", "false").parquet(path)
    scan = spark.read.parquet(path)
    assert len(scan._jdf.inputFiles()) == 1 and shared.row_groups(spark, list(scan._jdf.inputFiles()), 99) >= 8
    assert shared.spread(scan) is scan


# --- caches by manifest ------------------------------------------------------------------------------


def test_store_shows_what_is_published(spark, tmp_path):
    store = text_store(spark, f"{tmp_path}/store")
    kind = "doc_id string, source_hash string, text string"
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    read = lambda: sorted((tuple(r) for r in store.read().collect()), key=repr)
    assert read() == [] and store.commits() == []
    store.add(rows())
    assert store.commits() == []
    one, two = store.stage(rows(("a", "h", "one"), (None, "h", "null"), ("a", "h", "one"))), store.stage(rows(("a", "h", "two"), ("b", "h", None)))
    assert read() == []  # staged rows are no one's
    store.publish(two)
    assert read() == [("a", "h", "two"), ("b", "h", None)]
    store.publish(one), store.publish(one)  # the earlier writer comes last, and is told twice
    want = [("a", "h", "one"), ("b", "h", None), (None, "h", "null")]
    assert read() == want and len(store.commits()) == 2
    store.compact()
    assert read() == want and len(store.commits()) == 1
    store.stage(rows(("a", "h", "lost"), ("z", "h", "lost")))
    assert read() == want and text_store(spark, f"{tmp_path}/store").read().count() == 3


def test_repeated_ids_keep_their_texts(spark, tmp_path):
    calls = f"{tmp_path}/calls"

    def step(d):
        def run(batches):
            for pdf in batches:
                with open(calls, "a") as f:
                    f.write("".join(f"{i}\n" for i in pdf.doc_id))
                yield pdf.assign(text=[f"> {t}" for t in pdf.text])

        return d.select("doc_id", "text").mapInPandas(run, "doc_id string, text string")

    d = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("x", None), ("x", ""), (None, "a"), (None, "c"), ("", "a")], "doc_id string, text string").withColumns({"source_path": F.lit(""), "preprocessor_name": F.lit("")})
    want = [("_n", "> a"), ("x_n", "> "), ("x_n", "> None"), ("x_n", "> a"), ("x_n", "> b"), ("x_n", "> b"), (None, "> a"), (None, "> c")]
    for _ in range(3):
        got = P.write_through(d, step, f"{tmp_path}/cache", "n")
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr) and got.columns == d.columns
    assert len(open(calls).readlines()) == 7  # different pairs, in the first run only

    def killed(d):
        return d.withColumn("text", F.raise_error(F.lit("killed")))

    with pytest.raises(Exception, match="killed"):
        P.write_through(d.withColumn("text", F.concat("text", F.lit("new"))), killed, f"{tmp_path}/cache", "n")
    assert text_store(spark, f"{tmp_path}/cache/n").read().count() == 7


def test_write_through_shuffles_texts_once(spark, tmp_path):
    d = spark.range(3000).select(F.col("id").cast("string").alias("doc_id"), F.lit("").alias("source_path"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 20).alias("text"), F.lit("").alias("preprocessor_name"))
    step = lambda x: x.withColumn("text", F.upper("text"))
    P.write_through(d.where("doc_id % 2 = 0"), step, f"{tmp_path}/cache", "n")
    seen, real = [], type(d.write).parquet

    def parquet(self, path, *a, **k):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *a, **k)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(d.write), "parquet", parquet)
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = P.write_through(d, step, f"{tmp_path}/cache", "n")
            plan = got._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(seen) == 1 and seen[0].count("Exchange hashpartitioning") == 2  # documents and known keys
    assert plan.count("Exchange hashpartitioning") == 2  # keys and known texts
    assert got.count() == 3000 and got.where("text <> upper(text)").isEmpty()


# --- pages, layout, batch jobs -------------------------------------------------------------------------


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for k in range(7):
        (tmp_path / "in" / ("sub" if k % 2 else ".") / f"f{k}.txt").write_text("\f".join(f"page {i} of {k}\né" for i in range(k)))
    (tmp_path / "in" / ".hidden.txt").write_text("no")
    pages = read_pages(spark, [f"{tmp_path}/in"], run_bytes=60)
    got = {(r.path.rsplit("/", 1)[1], r.page, r.text) for r in pages.collect()}
    assert got == {(f"f{k}.txt", i + 1, f"page {i} of {k}\né") for k in range(7) for i in range(k)}
    assert pages.rdd.getNumPartitions() > 2
    most = pages.select(F.spark_partition_id().alias("p"), "path").distinct().groupBy("p").count().agg(F.max("count")).first()[0]
    assert most < 4  # no task has the whole set
    assert {r.path.rsplit("/", 1)[1] for r in read_pages(spark, [f"file://{tmp_path}/in/f*.txt"]).collect()} == {"f2.txt", "f4.txt", "f6.txt"}
    d = {r.doc_id: r.text for r in pages_as_documents(pages.withColumn("text", F.when(F.col("page") == 2, "").otherwise(F.col("text")))).collect()}
    assert d["f3_raw_text"] == "page 0 of 3\né\npage 2 of 3\né\n"
    (tmp_path / "empty").mkdir()
    assert read_pages(spark, [f"{tmp_path}/empty"]).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read_pages(spark, [f"{tmp_path}/nowhere"]).collect()

    def convert(file, path):
        yield from (file.read().decode().upper().split("\f"))

    assert read_pages(spark, [f"{tmp_path}/in/f2.txt"], convert).orderBy("page").first().text == "PAGE 0 OF 2\nÉ"


def test_many_small_files(spark, tmp_path):
    names = [f"d{k}__{k:x}.json" for k in range(2000)]
    rows = spark.createDataFrame([(n, f'{{"boundary_ids": [{k}]}}') for k, n in enumerate(names)], "name string, text string")
    S.write_texts(rows, f"{tmp_path}/in")
    assert sorted(os.listdir(tmp_path / "in")) == sorted(names)  # no drafts are left
    for read in (lambda p: S.from_paths(spark, [p]), lambda p: S.text_cache(spark, p), lambda p: S.boundary_cache(spark, p)):
        got = read(f"{tmp_path}/in")
        assert got.rdd.getNumPartitions() <= 32 and got.count() == 2000


def test_cache_of_odd_ids(spark, tmp_path):
    rows = [(None, "eins"), (None, "zwei"), (2, "drei"), (2, "vier"), (2, "vier"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["text_cache_files"](spark, str(tmp_path))
    want = [(None if i is None else f"{i}.md_gemini", (t or "")[::-1]) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_files(spark, tmp_path):
    names = ["a", "b c", "d+e", "f%20g", "ö", "h,i"]
    S.write_texts(spark.createDataFrame([(f"{n}{k}.txt", k * "x") for n in names for k in range(2)], "name string, text string"), f"{tmp_path}/in")
    want = {(f"{n}{k}", k * "x") for n in names for k in range(2)}
    for read in (lambda p: S.from_paths(spark, [p]), lambda p: S.text_cache(spark, p)):
        assert sorted(tuple(r) for r in read(f"{tmp_path}/in").select("doc_id", "text").collect()) == sorted(want)
    paths = {r.source_path for r in S.from_paths(spark, [f"{tmp_path}/in"]).collect()}
    assert paths == {f"file:{tmp_path}/in/{n}.txt" for n, _ in want}


def test_documents_of_empty_files(spark, tmp_path):
    rows = [(k, [None, "", "eins"][k % 3]) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["path_documents"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((f"{k}.md", t or "") for k, t in rows)


def test_cache_of_odd_names(spark, tmp_path):
    rows = [(n, f"{n}.txt", f"text of {n}") for n in ("a b", "a%20b", "1#2", "ö[1]?")]
    S.write_texts(spark.createDataFrame(rows, "doc_id string, name string, text string"), f"{tmp_path}/in")
    assert {tuple(r) for r in S.text_cache(spark, f"{tmp_path}/in").collect()} == {(n, t) for n, _, t in rows}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a b__0f.json").write_text('{"boundary_ids": [1]}')
    assert [tuple(r) for r in S.boundary_cache(spark, f"{tmp_path}/b").collect()] == [("a b", "0f", [1])]


def test_pages_in_few_tasks(spark, tmp_path):
    for k in range(1000):
        (tmp_path / f"f{k}.txt").write_text("a\fb")
    pages = read_pages(spark, [str(tmp_path)], run_bytes=1)
    assert pages.rdd.getNumPartitions() <= 512 and pages.count() == 2000


def test_pages_with_aggregates(spark):
    pages = spark.createDataFrame([("/in/a.txt", 1, "x"), ("/in/a.txt", 2, ""), ("/in/b.txt", 1, "y")], "path string, page int, text string")
    got = pages_as_documents(pages, "raw_text", F.max("page").alias("pages"))
    assert {(r.doc_id, r.text, r.pages) for r in got.collect()} == {("a_raw_text", "x\n", 2), ("b_raw_text", "y\n", 1)}


def test_layout_model():
    page = "<!DOCTYPE html><html><head><title>x</title></head><body><h1>A &amp; B</h1><p><b>bold<br><p>next <i>it</i><ul><li>one</li><li>two</ul><table><tr><th>a</th><th>b|c</th></tr><tr><td>1<br>2</td></tr></table>tail<script>x</script></body>"
    assert LayoutModel()(page) == "# A & B\n\nbold\n\nnext it\n\n- one\n\n- two\n\n| a | b\\|c |\n| --- | --- |\n| 1 2 |  |\n\ntail"
    assert LayoutModel()("a < b\n| x |") == "a < b\n| x |" and LayoutModel()("") == ""


def test_layout_model_cut_entities():
    """A title that is cut within an entity keeps what is left of it; whole entities are resolved, once."""
    assert LayoutModel()("<h1>a&amp;&amp</h1><p>b&lt;&#65;&#x42;&copy; &am &</p><p>&amp;lt; &lt &#6</p>") == "# a&&amp\n\nb<AB© &am &\n\n&lt; &lt &#6"


def test_a_model_is_made_once_a_worker(spark, tmp_path):
    made = f"{tmp_path}/made"

    def make():
        with open(made, "a") as f:
            f.write(f"{os.getpid()}\n")
        return str.upper

    d = docs(spark, *(f"text {i}" for i in range(200))).repartition(150)
    assert sorted(r.text for r in P.by_layout(d, make).collect()) == sorted(f"TEXT {i}" for i in range(200))
    pids = open(made).read().split()
    assert len(pids) == len(set(pids)) < 150  # 150 tasks, one model a process


class Service:
    """A batch service of files, which notes every submission; jobs end when asked for the second time."""

    def __init__(self, folder, dies=None, state="SUCCEEDED"):
        self.folder, self.dies, self.end = folder, dies, state

    def find(self, key):
        return f"job-{key}" if os.path.exists(f"{self.folder}/{key}") else None

    def submit(self, key, requests):
        with open(f"{self.folder}/{key}", "x") as f:
            f.write("\n".join(r for r, _ in requests))
        if self.dies == "submit":
            raise OSError("lost the connection")
        return f"job-{key}"

    def state(self, job):
        asked = f"{self.folder}/asked-{job}"
        if not os.path.exists(asked):
            open(asked, "w").close()
            return "RUNNING"
        return self.end

    def collect(self, job, requests):
        if self.dies == "collect":
            raise OSError("lost the connection")
        return [(r, None if p.endswith("7") else p[::-1]) for r, p in requests if not p.endswith("8")]


def test_killed_jobs_go_on(spark, tmp_path):
    (tmp_path / "service").mkdir()
    t = spark.createDataFrame([(f"d{i % 9}", i, f"prompt {i}") for i in range(50)] + [(None, 0, "none 1"), ("d", None, None), ("d0", 0, "prompt 0")], "doc_id string, table_index int, prompt string")
    run = lambda dies=None, state="SUCCEEDED": J.Jobs(t, f"{tmp_path}/jobs", lambda: Service(f"{tmp_path}/service", dies, state), 10)
    for dies in ("submit", "collect"):
        with pytest.raises(Exception, match="lost the connection"):
            run(dies).run(0.0)
    waits = []
    out = run().run(1.5, waits.append)
    want = {(f"d{i % 9}", i, "" if i % 10 in (7, 8) else f"prompt {i}"[::-1]) for i in range(50)} | {(None, 0, "1 enon"), ("d", None, "")}
    assert {tuple(r) for r in out.collect()} == want and out.count() == 53
    sent = [line for p in (tmp_path / "service").iterdir() if not p.name.startswith("asked") for line in p.read_text().split("\n")]
    assert len(sent) == len(set(sent)) == 52  # every different request once, through all three programs
    before = len(list((tmp_path / "service").iterdir()))
    assert run().run(0.0).count() == 53 and len(list((tmp_path / "service").iterdir())) == before


def test_failed_jobs_are_named(spark, tmp_path):
    (tmp_path / "service").mkdir()
    t = spark.createDataFrame([("d", 1, "p")], "doc_id string, table_index int, prompt string")
    with pytest.raises(RuntimeError, match="job-.*EXPIRED"):
        J.Jobs(t, f"{tmp_path}/jobs", lambda: Service(f"{tmp_path}/service", state="EXPIRED")).run(0.0, lambda s: None)


def test_results_are_a_qa_source(spark, tmp_path):
    rows = spark.createDataFrame([(5, "q", "r", "a", ["c"], [0.5]), (2, "f", None, None, [], [])], S.RESULTS)
    S.write_results(rows, f"{tmp_path}/r.json")
    assert sorted(tuple(r) for r in S.qa_pairs(spark, f"{tmp_path}/r.json").collect()) == [(2, "f", None), (5, "q", "r")]


# --- search, experiments and clusters at scale -----------------------------------------------------------


@given(st.integers(0, 10**6), st.integers(1, 7), st.integers(1, 60))
def test_best_keeps_the_best(seed, k, n):
    rng = np.random.default_rng(seed)
    s, o = np.round(rng.random((n, 5)), 1), rng.permutation(n)
    best = R.Best(k, 5)
    for a in range(0, n, 9):
        best.add(s[a : a + 9], o[a : a + 9])
        assert len(best.query) <= 5 * k
    for j in range(5):
        want = sorted(zip(-s[:, j], o))[:k]
        mine = best.query == j
        assert list(zip(-best.score[mine], best.ordinal[mine])) == want


def test_a_task_passes_on_k_rows_a_query(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(900)], "ordinal long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, 0, rng.normal(size=4).tolist()) for i in range(40)], "query_id long, variant int, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        want = sorted(tuple(r) for r in R.top_k(v, q, 6).collect())
        assert R.partial_top_k(v, q, 6).count() == 3 * 40 * 6  # 45 batches, 3 tasks
        monkeypatch.setattr(R, "QUERY_BLOCK", 7)
        monkeypatch.setattr(R, "QUERY_BYTES", 13 * 4 * 8)  # four passes
        assert sorted(tuple(r) for r in R.top_k(v, q, 6).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_share_a_search(spark, tmp_path, monkeypatch):
    """27 query runs and 27 threshold runs over nine indexes: one search, one reranking and one answer to all of an index's."""
    calls = {"search": 0, "rerank": 0, "answer": 0}

    def counted(name, f):
        def run(*args, **more):
            calls[name] += 1
            return f(*args, **more)

        return run

    monkeypatch.setattr(R, "top_k", counted("search", R.top_k))
    monkeypatch.setitem(PL.COMPONENTS, "JinaReranker", counted("rerank", PL.COMPONENTS["JinaReranker"]))
    monkeypatch.setitem(PL.COMPONENTS, "HuggingfaceGenerator", counted("answer", PL.COMPONENTS["HuggingfaceGenerator"]))
    rng = random.Random(3)
    d = docs(spark, *(" ".join(rng.choice("haus katze hund baum see berg tal wald".split()) for _ in range(60)) for _ in range(6)))
    qa = spark.createDataFrame([(i, " ".join(rng.sample("haus katze hund baum see berg".split(), 3)), "katze hund") for i in range(5)], "qa_idx long, user_input string, reference string")
    configs = [("raw", ["RawTextProcessor"], f"c{s}", "FixedCharacterChunker", {"chunk_size": s, "overlap": 0}) for s in range(40, 130, 10)]
    assert [r["name"] for r in PL.query_runs([(*configs[0], 0.05)])] == ["raw__c40__no_processing", "raw__c40__hyde", "raw__c40__cot"]
    for runs in (PL.query_runs([(*c, 0.05) for c in configs]), PL.context_runs(configs)):
        for name in calls:
            calls[name] = 0
        out = PL.run_experiment(d, qa, runs, f"{tmp_path}/{len(list(tmp_path.iterdir()))}", negative=qa)
        assert calls == {"search": 9, "rerank": 9, "answer": 9}
        assert [r.run_name for r in out.collect()] == [r["name"] for r in runs] and len(runs) == 27
    # each run is what the pipeline gives by itself
    off = PL.OfflinePipeline(["RawTextProcessor"], "FixedCharacterChunker", "FaissIndexBuilder", PL.Offline({"chunk_size": 40, "overlap": 0}))
    index = off.run(d, f"{tmp_path}/alone")[1]
    few = PL.context_runs(configs[:1], [0.0, 0.4, 0.7]) + [{**r, "threshold": None} for r in PL.query_runs([(*configs[0], 0.0)])[1:]]
    got = {r.run: r for r in PL.scored_runs(index, qa, few, 6, 2, qa).collect()}
    for k, run in enumerate(few):
        online = PL.OnlinePipeline(run.get("query_processor", "NoProcessingProcessor"), "FaissRetriever", "JinaReranker", "HuggingfaceGenerator", PL.Online(6, 2, run["threshold"]))
        rows = PL.answered(online, index, qa)
        one = E.means(E.evaluate(rows).select("answer_correctness", "context_recall")).first()
        assert (got[k].answer_correctness, got[k].context_recall) == pytest.approx(tuple(one))
        assert got[k].negative_negative_rejection == pytest.approx(E.means(E.evaluate_rejection(rows).select("negative_rejection")).first()[0])


def test_large_batches_are_halved(spark, tmp_path):
    sizes = []

    def retriever(index, q, embed, k):
        sizes.append(q.count())
        if sizes[-1] > 2:
            raise MemoryError
        return R.retrieve(index, q, embed, k)

    PL.register("TwoAtOnce", retriever)
    off = PL.OfflinePipeline(["RawTextProcessor"], "PassthroughChunker", "FaissIndexBuilder", PL.Offline())
    index = off.run(docs(spark, "die katze", "der hund", "das haus"), f"{tmp_path}/i")[1]
    online = PL.OnlinePipeline("NoProcessingProcessor", "TwoAtOnce", "PassthroughReranker", "PassthroughGenerator", PL.Online(1, 1))
    qa = spark.createDataFrame([(i, ("katze", "hund", "haus")[i % 3], "r") for i in range(9)], "qa_idx long, user_input string, reference string")
    got = {r.qa_idx: r.response.split()[-1] for r in PL.run_queries(online, index, qa).collect()}
    assert got == {i: ("katze", "hund", "haus")[i % 3] for i in range(9)} and sizes[0] == 9 and max(sizes[1:]) < 9
    sizes.clear()
    assert PL.run_queries(online, index, qa, batching=False).count() == 9 and max(sizes) < 9
    assert PL.run_queries(online, index, qa.limit(0)).count() == 0
    PL.register("TwoAtOnce", lambda *a: (_ for _ in ()).throw(MemoryError()))
    with pytest.raises(RuntimeError, match="one question"):
        PL.run_queries(PL.OnlinePipeline("NoProcessingProcessor", "TwoAtOnce", "PassthroughReranker", "PassthroughGenerator", PL.Online(1, 1)), index, qa.limit(1))
    PL.register("TwoAtOnce", lambda *a: (_ for _ in ()).throw(ValueError("other")))
    with pytest.raises(ValueError, match="other"):
        PL.run_queries(PL.OnlinePipeline("NoProcessingProcessor", "TwoAtOnce", "PassthroughReranker", "PassthroughGenerator", PL.Online(1, 1)), index, qa)


def test_chunkers_pass_on_bounded_batches(spark):
    """A worker passes chunks on as they come, in batches of bounded rows and characters, and reads batches of bounded bytes."""
    import pyarrow as pa

    done = []

    def cut(d, text):
        done.append(d)
        return [(i, text, {"k": i}) for i in range(50)]

    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(1000))), pa.array(["x" * 10] * 990 + ["y" * (C.CHUNK_CHARS // 10)] * 9 + [None])], names=["doc_id", "text"])
    got = C.cut_batches(iter([batch, batch]), "n", cut)
    first = next(got)
    assert first.num_rows == C.CHUNK_ROWS and len(done) < 100 and first.column("metadata")[3].as_py() == [("k", "3")]
    rest = [first, *got]
    assert sum(b.num_rows for b in rest) == 100_000 and max(b.num_rows for b in rest) <= C.CHUNK_ROWS
    assert max(sum(len(t.as_py()) for t in b.column("text")) for b in rest) < 1.2 * C.CHUNK_CHARS
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    C.sequential(docs(spark, "a"), "n", cut)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(shared.BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", held)


def test_ordinals_shuffle_texts_once(spark):
    """First numbers go to every task, whatever Spark takes for their size; chunks are not shuffled again for them."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.with_ordinals(C.by_characters(docs(spark, *("abc" * k for k in range(1, 40))), 10, 0))
        rows = out.orderBy("ordinal").collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r.ordinal for r in rows] == list(range(len(rows))) and [(r.doc_id, r.chunk_idx) for r in rows] == sorted((r.doc_id, r.chunk_idx) for r in rows)


def test_embedder_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(V, "KNOWN", 100)
    bucket = V.Buckets()
    words = [w for k in range(2000) for w in (f"rare{k}", "common")]
    assert [bucket[w] for w in words] == [V.hash_bucket(w) for w in words]
    assert len(bucket) <= 100 and len(bucket.before) <= 100 and "common" in bucket and V.hash_bucket("common") == int(__import__("hashlib").md5(b"common").hexdigest()[:6], 16) % V.DIM


def test_a_small_reranker_repeats_no_search(spark, tmp_path):
    """A reranker that takes one pair at once halves its own hits; the index is searched once."""
    searches, pairs = [], []

    def retriever(index, q, embed, k):
        searches.append(q.count())
        return R.retrieve(index, q, embed, k)

    def reranker(hits, n, threshold):
        pairs.append(hits.count())
        if pairs[-1] > 1:
            raise MemoryError
        return R.keep_ranks(hits, n)

    PL.register("CountedRetriever", retriever)
    PL.register("OnePair", reranker)
    index = PL.OfflinePipeline(["RawTextProcessor"], "PassthroughChunker", "FaissIndexBuilder", PL.Offline()).run(docs(spark, "die katze", "der hund", "das haus"), f"{tmp_path}/i")[1]
    online = PL.OnlinePipeline("NoProcessingProcessor", "CountedRetriever", "OnePair", "PassthroughGenerator", PL.Online(1, 1))
    qa = spark.createDataFrame([(i, ("katze", "hund", "haus")[i % 3], "r") for i in range(9)], "qa_idx long, user_input string, reference string")
    got = {r.qa_idx: r.response.split()[-1] for r in PL.run_queries(online, index, qa).collect()}
    assert got == {i: ("katze", "hund", "haus")[i % 3] for i in range(9)} and searches == [9] and pairs.count(1) == 9


@pytest.mark.parametrize("fixed, segment, n", [(0.3, 16, 400), (0.6, 7, 150), (-1.0, 20, 130), (0.99, 5, 60)])
def test_segments_equal_the_loop(spark, fixed, segment, n):
    """One label with most rows, small ones, a null one; clusters of one row, and one cluster over all segments."""
    rng = np.random.default_rng(n)
    walk = np.cumsum(rng.normal(size=(n, 3)) * 0.25, axis=0)
    data = [("a", i, walk[i].tolist()) for i in range(n)] + [("b", i, walk[i].tolist()) for i in range(9)] + [(None, i, walk[3 * i].tolist()) for i in range(segment + 3)] + [("c", 5, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "label string, pos long, v array<double>").repartition(6)
    got = C.cluster_rows(df, "label", "pos", "v", fixed, 0.9, 1.5, segment)
    want = []
    for label in ("a", "b", None, "c"):
        own = sorted((p, v) for k, p, v in data if k == label)
        want += [(label, i + 1, c) for i, c in enumerate(C.cluster_vectors([v for _, v in own], fixed, 0.9, 1.5))]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert got.dtypes == C.cluster_rows(df, "label", "pos", "v", fixed, 0.9, 1.5).dtypes
    if fixed == 0.3:
        seen = C._by_segments(df.select(F.col("label").alias("k"), F.col("pos").alias("o"), "v").limit(0), (0.3, 0.9, 1.5), 4)
        assert seen.count() == 0
