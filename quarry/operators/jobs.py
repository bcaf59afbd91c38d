"""Batch requests to a model as jobs that survive their driver: submit, poll, collect, each step kept in a table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarry.functions.models import Once
from quarry.sources.store import Store

#: Requests of a job, about.
JOB_REQUESTS = 1000
#: The states in which a job stays.
SUCCEEDED, ENDED = "SUCCEEDED", ("SUCCEEDED", "FAILED", "CANCELLED", "EXPIRED")


class Client(Protocol):
    """A batch service. Its methods are called in tasks; ``find`` makes a submission that was killed halfway safe to repeat."""

    def find(self, key: str) -> str | None: ...  # the id of the job submitted under this key

    def submit(self, key: str, requests: list[tuple[str, str]]) -> str: ...  # (request id, prompt) -> job id

    def state(self, job: str) -> str: ...

    def collect(self, job: str, requests: list[tuple[str, str]]) -> Iterable[tuple[str, str | None]]: ...  # None: that request failed


class Direct:
    """A service that answers when asked, by a model in the task: one call a prompt, an error fails that request only."""

    def __init__(self, model: Callable[[str], str]):
        self.model = model

    def find(self, key):
        return None

    def submit(self, key, requests):
        return key

    def state(self, job):
        return SUCCEEDED

    def collect(self, job, requests):
        for rid, prompt in requests:
            try:
                yield rid, self.model(prompt)
            except Exception:
                yield rid, None


class Jobs:
    """Jobs over ``requests(doc_id, table_index, prompt)``, resumable from ``folder``.

    A request's id is a hash of its three values, so equal rows are one request. ``plan`` deals the requests that no job has yet to
    jobs, ``submit``, ``poll`` and ``collect`` do only what their tables lack; ``run`` is all four. A program
    that dies between any two steps, or inside one, goes on from what is published. Before a submission the service's own
    ``find`` is asked for the job's key, so a job whose row was lost is not sent twice.
    """

    def __init__(self, requests: DataFrame, folder: str, make: Callable[[], Client], job_requests: int = JOB_REQUESTS):
        spark = requests.sparkSession
        whole = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("table_index").cast("long"), F.lit(-1)), F.coalesce("prompt", F.lit("")))
        self.requests = requests.withColumn("request_id", F.sha2(F.to_json(whole), 256))
        self.client, self.size = Once(make), job_requests
        self.planned = Store(spark, f"{folder}/planned", "request_id string, job_key string, prompt string", ["request_id"])
        self.submitted = Store(spark, f"{folder}/submitted", "job_key string, job string", ["job_key"])
        self.ended = Store(spark, f"{folder}/ended", "job_key string, job string, state string", ["job_key"])
        self.answers = Store(spark, f"{folder}/answers", "request_id string, answer string", ["request_id"])

    def plan(self) -> None:
        """Requests without a job are dealt out evenly, about ``job_requests`` to a job, under keys of this plan's own."""
        new = self.requests.select("request_id", F.coalesce("prompt", F.lit("")).alias("prompt")).dropDuplicates(["request_id"]).join(self.planned.read().select("request_id"), "request_id", "left_anti")
        n, tag = new.count(), uuid.uuid4().hex
        if n:
            self.planned.add(new.withColumn("job_key", F.concat(F.lit(f"{tag}-"), F.pmod(F.xxhash64("request_id"), F.lit(-(-n // self.size))))))

    def submit(self) -> None:
        rows = self.planned.read().select("job_key").distinct().join(self.submitted.read().select("job_key"), "job_key", "left_anti").withColumn("job", F.lit(""))
        self.submitted.add(self._each(rows, lambda client, key, _, requests: [(key, client.find(key) or client.submit(key, requests))], "job_key string, job string"))

    def poll(self) -> int:
        """Note the jobs that have ended; how many have not."""
        client = self.client

        def run(batches):
            for pdf in batches:
                yield pdf.assign(state=[client.model().state(j) for j in pdf.job])

        asked = self.submitted.read().join(self.ended.read().select("job_key"), "job_key", "left_anti")
        self.ended.add(asked.mapInPandas(run, "job_key string, job string, state string").where(F.col("state").isin(*ENDED)))
        return self.submitted.read().join(self.ended.read().select("job_key"), "job_key", "left_anti").count()

    def collect(self) -> None:
        """Answers of the jobs that succeeded; a job that did not fails the query, by name."""
        if bad := self.ended.read().where(F.col("state") != SUCCEEDED).select("job", "state").orderBy("job").head(5):
            raise RuntimeError("batch jobs failed: " + ", ".join(f"{r.job} {r.state}" for r in bad))
        missing = self.planned.read().join(self.answers.read().select("request_id"), "request_id", "left_anti").select("job_key").distinct()

        def call(client, key, job, requests):
            got = dict(client.collect(job, requests))
            return [(rid, got.get(rid)) for rid, _ in requests]  # a request that the job says nothing about has failed

        self.answers.add(self._each(self.ended.read().join(missing, "job_key", "left_semi").select("job_key", "job"), call, "request_id string, answer string"))

    def run(self, every: float = 30.0, wait: Callable[[float], None] = time.sleep) -> DataFrame:
        """(doc_id, table_index, description): a failed request's description is empty. Null ids keep their rows."""
        self.plan()
        self.submit()
        while self.poll():
            wait(every)
        self.collect()
        return self.requests.join(self.answers.read(), "request_id").select("doc_id", "table_index", F.coalesce("answer", F.lit("")).alias("description"))

    def _each(self, rows: DataFrame, call: Callable, schema: str) -> DataFrame:
        """``call(client, job_key, job, requests)`` for each job of ``rows(job_key, job)``. Its requests are gathered in a row: the
        job's size bounds them."""
        client = self.client

        def run(batches):
            for pdf in batches:
                out = []
                for key, job, requests in zip(pdf.job_key, pdf.job, pdf.requests):
                    out += call(client.model(), key, job, [(r["request_id"], r["prompt"]) for r in requests])
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        jobs = self.planned.read().join(rows, "job_key").groupBy("job_key", "job").agg(F.collect_list(F.struct("request_id", "prompt")).alias("requests"))
        return jobs.mapInPandas(run, schema)
