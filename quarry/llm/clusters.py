"""Delta Lloyd: exact k-means over integer vectors that compares only what a round can have changed.

Assignments are persisted with the vectors, the clusters' sums and counts on the driver (k rows). A vector whose centroid
moved meets all centroids; any other meets only the centroids that moved, since its own and the rest are as they were. Sums
follow by signed transfers of the vectors that changed hands.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import batch, bounded, written

SIZE, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Components from here on (after scaling) fail the query: distances would not fit a long.
LARGEST = 1 << 26
_STATE = "vec_id long, vec array<int>, owner int, distance long, former int"
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def points(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): the vectors with ``size`` components, none null or not finite, as integers floor(scale * x)."""
    whole = F.coalesce((F.size("embedding") == size) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    too_large = F.raise_error(F.lit(f"a vector's component is {LARGEST // scale} or more")).cast("int")
    x = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * scale) < LARGEST, F.floor(x.cast("double") * scale).cast("int")).otherwise(too_large))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vec"))


def first_centroids(pts: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least sha256 of ``seed:vec_id``; ties by components, null ids last. One partial top-k a task."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = pts.select(key.alias("key"), "vec").orderBy(F.col("key").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r.vec for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and c; in doubles where every sum stays below 2**53."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 21:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def compare(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, c: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; an owner of -1 is none yet. Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    anew = np.flatnonzero((owner < 0) | moved[owner])
    rest = np.flatnonzero((owner >= 0) & ~moved[owner])
    if len(anew):
        d = squared(x[anew], c)
        owner[anew] = d.argmin(1)
        distance[anew] = d.min(1)
    some = np.flatnonzero(moved)
    if len(rest) and len(some):
        d = squared(x[rest], c[some])
        j = d.argmin(1)
        d, j = d.min(1), some[j]
        better = (d < distance[rest]) | ((d == distance[rest]) & (j < owner[rest]))
        owner[rest[better]], distance[rest[better]] = j[better], d[better]
    return owner, distance


def assign(state: DataFrame, c: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The next state; on the map side, nothing is shuffled."""
    bounded(state.sparkSession)

    def run(batches):
        for b in batches:
            former = b.column("owner").to_numpy(zero_copy_only=False)
            owner, distance = compare(_matrix(b, c.shape[1]), former, b.column("distance").to_numpy(zero_copy_only=False), c, moved)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(former, pa.int32())], ["vec_id", "vec", "owner", "distance", "former"])

    return state.mapInArrow(run, _STATE)


def transfers(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed hands bring to (and, negative, take from) each cluster: counts and sums."""
    schema = pa.schema([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            x, to, out = _matrix(b, size), b.column("owner").to_numpy(), b.column("former").to_numpy()
            np.add.at(n, to, 1)
            np.add.at(s, to, x)
            np.subtract.at(n, out[out >= 0], 1)
            np.subtract.at(s, out[out >= 0], x[out >= 0])
        some = np.flatnonzero((n != 0) | s.any(1))
        if len(some):
            yield batch(schema, some, n[some], s[some].tolist())

    parts = state.where("owner <> former").select("vec", "owner", "former").mapInArrow(run, "c int, n long, s array<long>")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(size)]).alias("s")).collect()
    n, s = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for r in rows:
        n[r.c], s[r.c] = r.n, r.s
    return n, s


def cluster(vectors: DataFrame, size: int = SIZE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, a row per
    vector kept.

    Vectors that are null, of another length or hold null or non-finite components are left out. Repeated rows are
    vectors of their own; a null id can start no cluster while others are left. Ties of distance go to the smaller
    number; fewer than k vectors make as many clusters; an empty table gives no rows. Further columns are ignored.

    A round is one pass on the map side, written to the shared folder, and one over the vectors that changed hands; at most
    k rows reach the driver. It ends early when no centroid moved, with the same result.
    """
    spark = vectors.sparkSession
    pts = points(vectors, size, scale)
    c = first_centroids(pts, k, seed)
    if not len(c):
        return spark.createDataFrame([], _RESULT)
    state = pts.select("vec_id", "vec", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("former"))
    n, s, moved = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), np.ones(len(c), bool)
    for left in range(rounds, -1, -1):
        if not moved.any():
            break
        state = written(assign(state, c, moved), "lloyd")
        if left:
            dn, ds = transfers(state, *c.shape)
            n, s = n + dn, s + ds
            new = np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], c)
            c, moved = new, (new != c).any(1)
    inertia = {r.owner: r.d for r in state.groupBy("owner").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("owner"))  # noqa: E731  k literals
    return state.select(
        "vec_id",
        F.col("owner").alias("cluster"),
        "distance",
        of([inertia.get(j, 0) for j in range(len(c))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(names).alias("centroid_sha256"),
    )


def _matrix(b: pa.RecordBatch, size: int) -> np.ndarray:
    return b.column("vec").flatten().to_numpy().reshape(-1, size).astype(np.int64)


def oracle(size: int = SIZE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select p.id, arg_min(c, (d, c)) as c, min(d) as d from (select p.id, c.c, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from p, c{r} c) p group by p.id)""")
        if r < rounds:
            steps.append(f"""s{r} as (select c, i, sum(p.v[i])::bigint as s, count(*) as n from a{r} join p using (id), (select unnest(range(1, {size + 1})) as i) group by c, i),
c{r + 1} as materialized (select c.c, coalesce(m.v, c.v) as v from c{r} c left join (select c, list((s - ((s % n + n) % n)) // n order by i) as v from s{r} group by c) m on m.c = c.c)""")
    last = f"a{rounds} join c{rounds} c using (c)"
    return f"""with p as materialized (select row_number() over () as id, vec_id, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) as v from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id) nulls last, v) - 1 as c, v from p qualify c < {k}),
{", ".join(steps)}
select p.vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from {last} join p using (id)"""
