"""Nearest neighbours by balanced posting lists, searched through a graph of their centroids.

Build. A bounded sample (SAMPLE vectors, by a hash of their ids) is halved again and again along
its widest gap, each half holding its share of the vectors, so the centroids stand for lists of
like size. Every vector of the table goes into the list of its nearest centroid, and, near a
boundary, also into further lists within REPLICA_RATIO of that distance, unless a list chosen
before lies between the two; REPLICAS lists at most.

Search. The centroids of a query are found best first over an in-memory graph (each centroid and
its nearest others). All lists within SEARCH_RATIO of the nearest centroid's distance are read, and
more until their vectors number at least k + 1. Within a list the distances are computed on the
vectors as given, in double precision.

Lists meet their queries in parts of at most about PART vectors and PART queries, so no task
depends on how full a list is. Equal vectors are one entry with its k + 1 smallest ids, which is all
that a result of k can show; equal queries are searched once. Sample, centroids and graph are
bounded by SAMPLE and MAX_LISTS.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormledger.session import WorkTables

SAMPLE = 20_000
LIST_VECTORS, MAX_LISTS = 256, 16_384
REPLICAS, REPLICA_RATIO, SEARCH_RATIO = 4, 0.1, 0.15
NEIGHBOURS, RANDOM_LINKS, BEAM = 16, 4, 16
PART = 4096
RESULT = "query_id long, rank int, vec_id long, score double"


def balanced_centroids(sample, lists: int):
    """The means of `lists` parts of the sample (float64 rows), of like size."""
    import numpy as np

    def halves(rows, parts: int):
        if parts <= 1 or len(rows) <= 1:
            return [rows.mean(axis=0)]
        left = rows[0]
        right = rows[np.argmax(((rows - left) ** 2).sum(axis=1))]
        share = parts // 2 / parts
        for _ in range(6):
            side = ((rows - left) ** 2).sum(axis=1) - ((rows - right) ** 2).sum(axis=1)
            near = side <= np.quantile(side, share)
            if near.all() or not near.any():
                break
            left, right = rows[near].mean(axis=0), rows[~near].mean(axis=0)
        order = np.argsort(side, kind="stable")
        cut = min(max(1, round(len(rows) * share)), len(rows) - 1)
        return halves(rows[order[:cut]], parts // 2) + halves(rows[order[cut:]], parts - parts // 2)

    return np.array(halves(sample, lists))


class CentroidGraph:
    """Best-first search over the centroids' neighbour graph."""

    def __init__(self, centroids) -> None:
        import numpy as np

        self.centroids, n = centroids, len(centroids)
        rng = np.random.default_rng(0)
        links: list[set[int]] = [set(rng.integers(0, n, RANDOM_LINKS).tolist()) for _ in range(n)]
        for at in range(0, n, 512):
            part = centroids[at:at + 512]
            d = ((part ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1)[None] - 2 * part @ centroids.T)
            for k, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, : NEIGHBOURS + 1].tolist()):
                for other in near:
                    links[at + k].add(other)
                    links[other].add(at + k)
        self.links = [np.array(sorted(own - {k}), np.int64) for k, own in enumerate(links)]
        self.entries = np.unique(np.concatenate([[0], rng.integers(0, n, max(8, int(n ** 0.5)))]))

    def near(self, vector, ratio: float, beam: int = BEAM, enough=None) -> list[tuple[float, int]]:
        """(distance, list) ascending: all found within (1 + ratio) of the nearest, by expanding
        every centroid within that range or among the `beam` nearest seen. enough(list) adds up to
        True once the lists so far hold enough vectors; until then the range is open."""
        import numpy as np

        first = np.sqrt(((self.centroids[self.entries] - vector) ** 2).sum(axis=1)).tolist()
        seen = dict(zip(self.entries.tolist(), first))
        open_ = [(d, c) for c, d in seen.items()]
        heapq.heapify(open_)
        nearest = sorted(first)[:beam]
        while open_:
            d, c = heapq.heappop(open_)
            if len(nearest) >= beam and d > max(nearest[-1], (1 + ratio) * nearest[0]):
                break
            new = [x for x in self.links[c].tolist() if x not in seen]
            if not new:
                continue
            for x, dx in zip(new, np.sqrt(((self.centroids[new] - vector) ** 2).sum(axis=1)).tolist()):
                seen[x] = dx
                heapq.heappush(open_, (dx, x))
                nearest.append(dx)
            nearest = sorted(nearest)[:beam]
        found = sorted((d, c) for c, d in seen.items())
        within = [x for x in found if x[0] <= (1 + ratio) * found[0][0]]
        if enough is None or enough([c for _, c in within]):
            return within
        everything = np.sqrt(((self.centroids - vector) ** 2).sum(axis=1))
        found = sorted(zip(everything.tolist(), range(len(everything))))
        more = len(within)
        while more < len(found) and not enough([c for _, c in found[:more]]):
            more += 1
        return found[:more]

    def homes(self, vectors) -> list[list[int]]:
        """The lists of each vector (rows), its own first; all distances of a block at once."""
        import numpy as np

        squares = (vectors ** 2).sum(axis=1)[:, None] + (self.centroids ** 2).sum(axis=1)[None]
        d = np.sqrt(np.maximum(squares - 2 * vectors @ self.centroids.T, 0))
        few = min(4 * REPLICAS, d.shape[1])
        near = np.argpartition(d, few - 1, axis=1)[:, :few]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        found = []
        for own, order in zip(d, near):
            chosen = [int(order[0])]
            for c in order[1:][own[order[1:]] <= (1 + REPLICA_RATIO) * own[order[0]]].tolist():
                if len(chosen) == REPLICAS:
                    break
                between = np.sqrt(((self.centroids[chosen] - self.centroids[c]) ** 2).sum(axis=1))
                if own[c] <= (1 + REPLICA_RATIO) * between.min():
                    chosen.append(c)
            found.append(chosen)
        return found


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector (doubles): without null, zero, non-finite vectors and those of an uncommon length."""
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & fit & F.exists("vector", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("vector") == (common[0]["n"] if common else 0))


def _matrix(column):
    """An Arrow list column of equal lengths as rows of float64."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(rows: DataFrame, places, extra: str) -> DataFrame:
    """rows (entry, vector) once per list that places(vectors) gives, with the list's number and place."""
    schema = f"{extra} long, vector array<double>, list int, place int"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = places(_matrix(part.column(1)))
                rows_of = np.repeat(np.arange(len(found)), [len(f) for f in found])
                taken = part.take(pa.array(rows_of))
                lists = pa.array([c for f in found for c in f], pa.int32())
                order = pa.array([k for f in found for k in range(len(f))], pa.int32())
                yield pa.RecordBatch.from_arrays([*taken.columns, lists, order], [extra, "vector", "list", "place"])

    return rows.select(extra, "vector").mapInArrow(run, schema)


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query, itself left
    out, by Euclidean distance, ties to the smaller id.

    is_query is a condition on `id`, the key as a long. Rows with a null key, and vectors that are
    null, zero, of another length than most, or hold nulls or non-finite values take no part, as
    queries neither. Where fewer than k others exist, all are returned. Rows with equal keys are
    one candidate each. No usable rows give no rows.
    """
    spark = df.sparkSession
    work = WorkTables(spark, "ann")
    rows = _usable(df, key, vector)
    by_vector = Window.partitionBy("vector").orderBy("id")
    entries = (
        rows.withColumn("_n", F.row_number().over(by_vector)).filter(F.col("_n") <= k + 1)
        .groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("entry", F.monotonically_increasing_id())
    )
    entries, n = work.save_counting(entries.withColumn("_one", F.lit(True)), "_one")
    entries = entries.drop("_one")
    if not n:
        return spark.createDataFrame([], RESULT)

    import numpy as np

    picked = entries.select("entry", "vector").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE)
    sample = np.array([r["vector"] for r in picked.select("vector").collect()], np.float64)
    lists = max(1, min(MAX_LISTS, -(-n // LIST_VECTORS), max(1, len(sample) // 8)))
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(sample, lists)))
    postings = work.save(_placed(entries, lambda vectors: graph.value.homes(vectors), "entry"))
    sizes = postings.groupBy("list").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("place") == 0).alias("own")
    ).collect()  # at most MAX_LISTS rows
    own = {r["list"]: r["own"] for r in sizes}
    part_rows = [(r["list"], -(-r["size"] // PART)) for r in sizes]

    def enough(found: list[int]) -> bool:
        return sum(own.get(c, 0) for c in found) > k

    def lists_of(vectors) -> list[list[int]]:
        return [[c for _, c in graph.value.near(v, SEARCH_RATIO, enough=enough)] for v in vectors]

    queries = work.save(rows.filter(is_query).join(entries.select("vector", "entry"), "vector").select(F.col("id").alias("query_id"), "entry"))
    searched = entries.join(queries.select("entry").distinct(), "entry").select(F.col("entry").alias("query"), "vector")
    asked = work.save(_placed(searched, lists_of, "query"))
    parts = F.broadcast(spark.createDataFrame(part_rows, "list int, parts long"))
    asks = F.broadcast(spark.createDataFrame(
        [(r["list"], -(-r["count"] // PART)) for r in asked.groupBy("list").count().collect()], "list int, asks long",
    ))

    def cell(of: str, parts_name: str, other: str):
        mine = F.pmod(F.xxhash64(of), F.col(parts_name)).alias(f"{parts_name}_no")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"{other}_no")
        return [F.col("list"), mine, every, F.col(of), F.col("vector")]

    left = postings.join(parts, "list").join(asks, "list").select(*cell("entry", "parts", "asks"))
    right = asked.join(parts, "list").join(asks, "list").select(*cell("query", "asks", "parts"))
    keys = ["list", "parts_no", "asks_no"]

    def compare(vectors, wanted):
        import pyarrow as pa

        out_q, out_e, out_d = [], [], []
        if vectors.num_rows and wanted.num_rows:
            table, ids = _matrix(vectors.column("vector")), vectors.column("entry").to_numpy()
            for q, v in zip(wanted.column("query").to_pylist(), _matrix(wanted.column("vector"))):
                d = np.sqrt(((table - v) ** 2).sum(axis=1))
                # Ties at the limit all stay: which of them has the smallest id shows only later.
                best = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                out_q += [q] * len(best)
                out_e += ids[best].tolist()
                out_d += d[best].tolist()
        return pa.table({"query": pa.array(out_q, pa.int64()), "entry": pa.array(out_e, pa.int64()), "score": pa.array(out_d, pa.float64())})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query long, entry long, score double")
    once = found.groupBy("query", "entry").agg(F.min("score").alias("score"))
    named = once.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    by_query = Window.partitionBy("query").orderBy("score", "vec_id")
    best = (
        named.withColumn("_n", F.row_number().over(by_query)).filter(F.col("_n") <= k + 1)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    )
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(best, queries["entry"] == best["query"]).select("query_id", F.posexplode(others)).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"),
    )
