"""Preprocessors: documents in, documents out, one row each."""

from __future__ import annotations

import itertools
import json
import random
import re
import time
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.models import LayoutModel, Once
from quarry.schemas import DOCUMENT
from quarry.sources.store import text_store

Step = Callable[[DataFrame], DataFrame]


def renamed(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn("doc_id", F.concat("doc_id", F.lit(f"_{name}"))).withColumn("preprocessor_name", F.lit(name))


def cached(docs: DataFrame, step: Step, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all processed documents, the new ones). ``cache(doc_id, source_hash, text)`` is keyed by the renamed id and a
    hash of the source text, so a changed source is a miss; only misses reach ``step``."""
    keyed = docs.withColumn("source_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    miss = keyed.join(cache.select("doc_id", "source_hash"), ["doc_id", "source_hash"], "left_anti")
    hit = keyed.drop("text").join(cache.select("doc_id", "source_hash", "text"), ["doc_id", "source_hash"])
    new = step(miss)
    return hit.select(*new.columns).unionByName(new), new


#: The source hash of a null text, which no text has.
NO_TEXT = "-" * 64


def source_hash(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(NO_TEXT))


def write_through(docs: DataFrame, step: Step, folder: str, name: str) -> DataFrame:
    """``step`` over ``docs`` with the cache ``name`` in ``folder``: only what it lacks is processed, and is added to
    it; ids get the step's name.

    ``step`` gets every different pair of id and text once, under an id of its own (the text's hash and the document's id), so
    documents that share an id keep their own texts, null ones too; it gives a row for each at most. What it computed is staged, read back and published
    whole (see ``Store``), so a repeated run processes nothing and one that is killed leaves nothing.
    """
    cache = text_store(docs.sparkSession, f"{folder}/{name}")
    own = F.concat("source_hash", F.coalesce(F.concat(F.lit("."), "doc_id"), F.lit(""))).alias("own")
    keyed = docs.withColumn("source_hash", source_hash(F.col("text"))).select(*docs.columns, own)
    miss = keyed.join(cache.read().select(own), "own", "left_anti").dropDuplicates(["own"])  # by one key, so in one shuffle
    done = step(miss.withColumn("doc_id", F.col("own")).select(*docs.columns)).select(F.col("doc_id").alias("own"), "text")
    doc_id = F.when(F.length("own") > len(NO_TEXT), F.expr(f"substr(own, {len(NO_TEXT) + 2})"))
    cache.add(done.select(doc_id.alias("doc_id"), F.substring("own", 1, len(NO_TEXT)).alias("source_hash"), "text"), unique=True)
    both = keyed.drop("text").join(cache.read().select(own, "text"), "own")
    return renamed(both.select(*docs.columns), name)


def preconverted(docs: DataFrame, name: str) -> DataFrame:
    """Texts converted elsewhere; one that is missing (null) fails the query, for nothing is converted here."""
    missing = F.raise_error(F.concat(F.lit("not converted and not in the text cache: "), F.col("doc_id")))
    return renamed(docs.withColumn("text", F.when(F.col("text").isNull(), missing).otherwise(F.col("text"))), name)


def chain(docs: DataFrame, steps: list[Step]) -> DataFrame:
    return reduce(lambda df, s: df.transform(s), steps, docs)


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and comments go, block ends become line ends, entities are resolved."""
    x = F.regexp_replace(html, "(?is)<(script|style|head)\\b.*?</\\1>|<!--.*?-->", "")
    x = F.regexp_replace(x, "(?i)</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)>|<br\\s*/?>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, "[ \\t]+", " "))), lambda s: s != ""), "\n")


def with_retries(call: Callable[[str], str], attempts: int = 5, base: float = 2.0, wait=time.sleep) -> Callable[[str], str]:
    """Exponential back-off with jitter on overload errors (503, 429); other errors and the last one are raised."""

    def run(prompt: str) -> str:
        for k in range(attempts):
            try:
                return call(prompt)
            except Exception as e:
                if k == attempts - 1 or not re.search(r"\b(503|429)\b", str(e)):
                    raise
                wait(base * 2**k + random.uniform(1, 3))
        raise AssertionError

    return run


def linearize(text: str) -> str:
    """Default rewriting model: table rows become sentences of ``header: cell`` pairs, other lines stay."""
    out, header = [], None
    for line in text.splitlines():
        if not line.lstrip().startswith("|"):
            header = None
            out.append(re.sub(r"^#+\s*", "", line))
            continue
        cells = [c.strip().strip("*") for c in line.strip().strip("|").split("|")]
        if header is None:
            header = cells
        elif not all(re.fullmatch(r":?-+:?", c) for c in cells):
            out.append("; ".join(f"{h}: {c}" if h else c for h, c in zip(header, cells) if c) + ".")
    return "\n".join(out)


def rewrite(docs: DataFrame, model: Callable[[str], str] = linearize, name: str = "direct_llm") -> DataFrame:
    """Whole texts through a model, made once per worker."""

    def run(batches):
        call = with_retries(model)
        for pdf in batches:
            yield pdf.assign(text=[call(t or "") for t in pdf.text])

    return renamed(docs.select("doc_id", "source_path", "text", "preprocessor_name").mapInPandas(run, DOCUMENT), name)


def by_layout(docs: DataFrame, make: Callable[[], Callable[[str], str]] = LayoutModel, name: str = "markdown_docling") -> DataFrame:
    """Texts converted by a layout model, which ``make`` builds on first use, once a worker process."""
    model = Once(make)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[None if t is None else model(t) for t in pdf.text])

    return renamed(docs.select("doc_id", "source_path", "text", "preprocessor_name").mapInPandas(run, DOCUMENT), name)


def table_prompt(caption: Column, data: Column) -> Column:
    return F.concat(F.lit("Describe this table in full sentences.\nCaption: "), F.coalesce(caption, F.lit("")), F.lit("\nRows: "), F.to_json(data))


def describe(prompt: str) -> str:
    """Default table model: a sentence of ``header: cell`` pairs for every row behind the first."""
    rows = json.loads(prompt.rsplit("\nRows: ", 1)[-1])
    head = [c or "" for c in rows[0]] if rows else []
    return " ".join("; ".join(f"{h}: {c}" for h, c in zip(head, r) if c) + "." for r in rows[1:])


def paper(docs: DataFrame, model: Callable[[str], str] = describe, name: str = "paper_llm_processor") -> DataFrame:
    """Texts whose Markdown tables are replaced by a model's descriptions, the text between them kept in order.

    The last line above a table is its caption and goes to the model with it; a failed request leaves an empty description.
    """

    def run(batches):
        call = with_retries(model)
        for pdf in batches:
            yield pdf.assign(text=[_described(t or "", call) for t in pdf.text])

    return renamed(docs.select("doc_id", "source_path", "text", "preprocessor_name").mapInPandas(run, DOCUMENT), name)


def _described(text: str, call: Callable[[str], str]) -> str:
    out: list[str] = []
    for is_table, group in itertools.groupby(text.splitlines(), lambda x: x.lstrip().startswith("|")):
        part = list(group)
        if not is_table:
            out.append("\n".join(part).strip())
            continue
        rows = [[c.strip().strip("*") for c in x.strip().strip("|").split("|")] for x in part]
        rows = [r for r in rows if not all(re.fullmatch(r":?-+:?", c) for c in r)]
        caption = (out[-1].splitlines() or [""])[-1] if out else ""
        try:
            out.append(call(f"Describe this table in full sentences.\nCaption: {caption}\nRows: {json.dumps(rows, ensure_ascii=False)}"))
        except Exception:
            out.append("")
    return "\n".join(out)


def interleave(contexts: Column, descriptions: Column) -> Column:
    """context, description, context, ..., context by line; a failed (null) description is empty, no table leaves the first context."""
    pairs = F.flatten(F.transform(descriptions, lambda d, i: F.array(F.get(contexts, i), F.coalesce(d, F.lit("")))))
    return F.when(F.size(descriptions) == 0, F.get(contexts, F.lit(0))).otherwise(F.array_join(F.concat(pairs, F.array(F.element_at(contexts, -1))), "\n"))


def stitch_tables(parts: DataFrame) -> DataFrame:
    """Tables of ``parts(doc_id, page, y, bottom, height, rows)`` with continuations joined.

    The first table of a page continues the last one of the page before if both have as many columns,
    the one ends in the lowest and the other starts in the highest quarter. A repeated header row
    is dropped. A table id counts up in reading order; rows are joined in that order.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "y")
    prev = F.lag(F.struct("page", "bottom", "height", F.size(F.get("rows", F.lit(0))).alias("width"), "rows")).over(w)
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y")) == 1
    x = parts.withColumn("p", prev).withColumn("first", first)
    goes_on = F.col("first") & (F.col("page") == F.col("p.page") + 1) & (F.size(F.get("rows", F.lit(0))) == F.col("p.width")) & (F.col("p.bottom") > 0.75 * F.col("p.height")) & (F.col("y") < 0.25 * F.col("height"))
    x = x.withColumn("on", F.coalesce(goes_on, F.lit(False)))
    x = x.withColumn("table_index", F.sum((~F.col("on")).cast("int")).over(w) - 1)
    head = F.first(F.get("rows", F.lit(0))).over(Window.partitionBy("doc_id", "table_index").orderBy("page", "y"))
    x = x.withColumn("body", F.when(F.col("on") & (F.get("rows", F.lit(0)) == head), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows")))
    g = x.groupBy("doc_id", "table_index").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.array_sort(F.collect_list(F.struct("page", "y", "body"))).alias("b"))
    return g.select("doc_id", F.col("table_index").cast("int").alias("table_index"), "start_page", "end_page", F.flatten(F.transform("b", lambda s: s["body"])).alias("data"))


#: Text so many units above a table, and below the table before it, is its caption.
CAPTION = 50


def page_contexts(items: DataFrame) -> DataFrame:
    """(doc_id, contexts, captions): the text between tables, for ``items(doc_id, page, y, kind, text)``.

    N tables leave N + 1 contexts and N captions. A text within CAPTION units above the next table of its page is that table's
    caption and in no context. Texts of a document meet once, by the gap that they lie in.
    """
    table = F.col("kind") == "table"
    gap = F.sum(table.cast("int")).over(Window.partitionBy("doc_id").orderBy("page", "y", "kind")) - table.cast("int")
    after = Window.partitionBy("doc_id", "page").orderBy("y", "kind").rowsBetween(1, Window.unboundedFollowing)
    next_y = F.first(F.when(table, F.col("y")), ignorenulls=True).over(after)
    x = items.withColumn("gap", gap).withColumn("caption", F.coalesce(next_y - F.col("y") <= CAPTION, F.lit(False)))
    of = lambda which: F.transform(F.array_sort(F.collect_list(F.when(~table & which, F.struct("page", "y", "text")))), lambda s: s["text"])
    gaps = x.groupBy("doc_id", "gap").agg(F.array_join(of(~F.col("caption")), "\n").alias("context"), F.array_join(of(F.col("caption")), " ").alias("caption"), F.max(table).alias("table"))
    g = gaps.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("gap", "context", "caption", "table"))).alias("g"))
    n = F.size(F.filter("g", lambda s: s["table"]))
    last = F.when(F.size("g") == n, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))  # nothing follows the last table
    return g.select("doc_id", F.concat(F.transform("g", lambda s: s["context"]), last).alias("contexts"), F.transform(F.filter("g", lambda s: s["table"]), lambda s: s["caption"]).alias("captions"))


def batch_describe(tables: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """A description for each row's ``prompt``, prompt by prompt; a failed request is the empty string. ``operators.jobs`` sends
    the same requests as batch jobs."""

    def run(batches):
        def one(p):
            try:
                return model(p)
            except Exception:
                return ""

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "table_index": pdf.table_index, "description": [one(p) for p in pdf.prompt]})

    return tables.select("doc_id", "table_index", "prompt").mapInPandas(run, "doc_id string, table_index int, description string")
