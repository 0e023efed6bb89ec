"""The k most similar vectors of every vector, through learned partitions.

A bounded sample trains a router (:mod:`palimpsest.llm.router`); every vector is stored in its most
probable partition and looked for in several; partitions are compared in blocks of bounded size and
the best are ranked again by exact distance. Equal vectors are compared once and share the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from palimpsest.llm import router as learned
from palimpsest.operators.skew import join_unique
from palimpsest.session import materialize

#: Vectors a partition should hold; the fewest (of a profile that has PART_LEAST vectors for each)
#: and the most partitions of a profile.
PART_ROWS = 2048
MIN_PARTS, PART_LEAST = 4, 64
MAX_PARTS = 512

#: A partition of over SPLIT times PART_ROWS vectors is partitioned again, by a router of its own,
#: into MAX_SUBPARTS at most.
SPLIT = 4
MAX_SUBPARTS = 64

#: The documented bound of the training sample: rows per partition, and in all, per router.
SAMPLE_PER_PART = 256
MAX_SAMPLE = 60_000

#: Partitions a vector is looked for in, until their probabilities reach MASS.
PROBES = 3
MASS = 0.999

#: Stored vectors and looked-for vectors that one task compares at a time.
BLOCK = 8192

VALID = "segment_id string, profile string, vec binary"


def valid_vectors(df: DataFrame, dim: int) -> DataFrame:
    """(segment_id, profile, vec) of the usable vectors, one row per segment_id.

    Vectors of another length, with null, infinite or undefined numbers or only zeros take no part,
    nor do rows with a null segment or profile. Negative zeros count as zeros.
    """
    e = F.col("embedding")
    usable = df.select(F.col("segment_id").alias("segment_id"), F.col("model_profile_id").alias("profile"), e.cast("array<float>").alias("embedding")).filter(
        F.col("segment_id").isNotNull() & F.col("profile").isNotNull() & (F.size("embedding") == dim)
    )
    target = T._parse_datatype_string(VALID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat = column.flatten()
            x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim) + np.float32(0)
            ok = np.isfinite(x).all(1) & x.any(1)
            rows = np.flatnonzero(ok)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([x[i].tobytes() for i in rows], pa.binary())], names=target.names
            )

    return usable.mapInArrow(run, target).dropDuplicates(["segment_id"])


def distinct_vectors(valid: DataFrame, k: int) -> DataFrame:
    """(rid, profile, vec, n, ids): one row per different vector with its k + 1 smallest segments.

    Row numbers rid rise with the smallest segment, so that ties can be settled by them.
    """
    grouped = valid.groupBy("profile", "vec").agg(F.min("segment_id").alias("first"), F.count(F.lit(1)).alias("n"))
    several = grouped.filter("n > 1").select("profile", "vec")
    ranked = valid.join(several, ["profile", "vec"], "left_semi").withColumn(
        "r", F.row_number().over(Window.partitionBy("profile", "vec").orderBy("segment_id"))
    )
    few = ranked.filter(F.col("r") <= k + 1).groupBy("profile", "vec").agg(F.sort_array(F.collect_list("segment_id")).alias("several"))
    every = grouped.join(few, ["profile", "vec"], "left").select(
        "profile", "vec", "n", "first", F.coalesce("several", F.array("first")).alias("ids")
    )
    return every.orderBy("first").select(F.monotonically_increasing_id().alias("rid"), "profile", "vec", "n", "ids")


def train(vectors: DataFrame, part_rows: int, max_parts: int, dim: int) -> dict[str, learned.Router]:
    """Routers of the profiles that need more than one partition, by profile."""
    counts = {r["profile"]: r["count"] for r in vectors.groupBy("profile").count().collect()}
    parts = {p: min(max_parts, max(math.ceil(n / part_rows), MIN_PARTS if n >= MIN_PARTS * PART_LEAST else 1)) for p, n in counts.items()}
    large = {p: m for p, m in parts.items() if m > 1}
    if not large:
        return {}
    sizes = {p: min(MAX_SAMPLE, SAMPLE_PER_PART * m, counts[p]) for p, m in large.items()}
    # Rows with the smallest hashes; a generous threshold keeps the ranked rows few.
    h = F.xxhash64("vec").cast("double") / float(2**64) + 0.5
    wanted = None
    for p, size in sizes.items():
        share = min(1.0, 1.5 * size / counts[p] + 1e-3)
        one = (F.col("profile") == p) & (h <= share)
        wanted = one if wanted is None else wanted | one
    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.xxhash64("vec"), "rid"))
    sample = vectors.filter(wanted).withColumn("r", rank).filter(F.col("r") <= MAX_SAMPLE).select("profile", "r", "vec")

    def one_profile(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        profile = keys[0].as_py()
        rows = table.filter(pc.less_equal(table["r"], sizes[profile]))
        x = np.frombuffer(b"".join(rows["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
        model = learned.fit(x, large[profile])
        return pa.table({"profile": [profile], "model": pa.array([model.dump()], pa.binary())})

    fitted = sample.groupBy("profile").applyInArrow(one_profile, "profile string, model binary").collect()
    return {r["profile"]: learned.Router.load(bytes(r["model"])) for r in fitted}


ROUTED = "profile string, part int, base boolean, rid bigint, vec binary"


def route(vectors: DataFrame, routers: dict[str, learned.Router], probes: int, mass: float, dim: int) -> DataFrame:
    """A row per vector and partition it is looked for in; ``base`` in the one that stores it."""
    shared = vectors.sparkSession.sparkContext.broadcast({p: r.dump() for p, r in routers.items()})
    target = T._parse_datatype_string(ROUTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {p: learned.Router.load(d) for p, d in shared.value.items()}
        for batch in batches:
            profiles = np.array(batch.column(1).to_pylist(), dtype=object)
            for profile in set(profiles):
                rows = np.flatnonzero(profiles == profile)
                part = batch.take(pa.array(rows))
                model = models.get(profile)
                if model is None:
                    to = np.zeros((len(rows), 1), dtype=np.int32)
                else:
                    x = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.float32).reshape(-1, dim)
                    to = learned.routes(model, x, probes, mass)
                for column in range(to.shape[1]):
                    there = np.flatnonzero(to[:, column] >= 0)
                    if not len(there):
                        continue
                    take = pa.array(there)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(1).take(take),
                            pa.array(to[there, column], pa.int32()),
                            pa.array([column == 0] * len(there), pa.bool_()),
                            part.column(0).take(take),
                            part.column(2).take(take),
                        ],
                        names=target.names,
                    )

    return vectors.select("rid", "profile", "vec").mapInArrow(run, target)


def split_large(routed: DataFrame, probes: int, mass: float, part_rows: int, max_parts: int, dim: int) -> DataFrame:
    """``routed`` with partitions of over SPLIT * ``part_rows`` vectors partitioned again.

    Each has a router of its own, learned from its own bounded sample; there are at most as many as
    partitions. New partitions are numbered after the old ones.
    """
    counts = routed.filter("base").groupBy("profile", "part").agg(F.count(F.lit(1)).alias("n"))
    large = {(r["profile"], r["part"]): min(MAX_SUBPARTS, math.ceil(r["n"] / part_rows)) for r in counts.filter(F.col("n") > SPLIT * part_rows).collect()}
    if not large:
        return routed
    spark = routed.sparkSession
    listed = spark.createDataFrame([(p, i, m) for (p, i), m in large.items()], "profile string, part int, m int")
    sizes = listed.join(counts, ["profile", "part"]).select("profile", "part", F.least(F.col("m") * SAMPLE_PER_PART, F.col("n")).alias("size"), "n")
    h = F.xxhash64(F.lit(2), "vec").cast("double") / float(2**64) + 0.5
    rank = F.row_number().over(Window.partitionBy("profile", "part").orderBy(F.xxhash64("vec"), "rid"))
    near = routed.filter("base").join(F.broadcast(sizes), ["profile", "part"]).filter(h <= 1.5 * F.col("size") / F.col("n") + 1e-3)
    sample = near.withColumn("r", rank).filter(F.col("r") <= F.col("size")).select("profile", "part", "vec")

    def one_part(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        key = (keys[0].as_py(), keys[1].as_py())
        x = np.frombuffer(b"".join(table["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
        return pa.table({"profile": [key[0]], "part": pa.array([key[1]], pa.int32()), "model": pa.array([learned.fit(x, large[key]).dump()], pa.binary())})

    fitted = sample.groupBy("profile", "part").applyInArrow(one_part, "profile string, part int, model binary").collect()
    shared = spark.sparkContext.broadcast({(r["profile"], r["part"]): bytes(r["model"]) for r in fitted})
    target = T._parse_datatype_string(ROUTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[tuple[str, int], learned.Router] = {}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            by_key: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(keys):
                by_key.setdefault(key, []).append(i)
            for key, rows in by_key.items():
                own = batch.take(pa.array(rows))
                if key not in models:
                    models[key] = learned.Router.load(shared.value[key])
                x = np.frombuffer(b"".join(own.column(4).to_pylist()), dtype=np.float32).reshape(-1, dim)
                to = learned.routes(models[key], x, probes, mass)
                base = own.column(2).to_numpy(zero_copy_only=False)
                for column in range(to.shape[1]):
                    there = np.flatnonzero(to[:, column] >= 0)
                    take = pa.array(there)
                    number = key[1] + (to[there, column].astype(np.int32) + 1) * max_parts
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0).take(take), pa.array(number, pa.int32()), pa.array(base[there] & (column == 0), pa.bool_()), own.column(3).take(take), own.column(4).take(take)],
                        names=target.names,
                    )

    which = F.broadcast(listed.select("profile", "part"))
    again = routed.join(which, ["profile", "part"], "left_semi").select("profile", "part", "base", "rid", "vec").mapInArrow(run, target)
    return materialize(routed.join(which, ["profile", "part"], "left_anti").select(*target.names).unionByName(again), "resplit")


PAIRS = "rid bigint, near bigint, d2 double"


def nearest_in_block(stored_ids: np.ndarray, stored: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, id of a near vector, squared distance) of the k nearest stored vectors of each row.

    Products of centred vectors pick a shortlist, differences rank it; where the products' rounding
    could have kept a neighbour out, the row is compared with all. Ties go by id.
    """
    n = len(stored)
    keep = min(n, 2 * k + 6)
    wide = stored.astype(np.float64)
    centre = wide.mean(0)
    moved = wide - centre
    norms = (moved**2).sum(1)
    out_i, out_j, out_d = [], [], []

    def ranked(exact: np.ndarray, near_id: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact[near_id == own[:, None]] = np.inf
        order = np.lexsort((near_id, exact), axis=1)[:, :k]
        return np.take_along_axis(near_id, order, 1), np.take_along_axis(exact, order, 1)

    for low in range(0, len(x), 512):
        part, own = x[low : low + 512].astype(np.float64), ids[low : low + 512]
        q = part - centre
        d = norms[None, :] - 2.0 * (q @ moved.T)
        near = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < n else np.tile(np.arange(n), (len(part), 1))
        near_id, chosen = ranked(((wide[near] - part[:, None, :]) ** 2).sum(2), stored_ids[near], own)
        if keep < n:
            size = (q**2).sum(1)
            reach = np.take_along_axis(d, near, 1).max(1) + size - 1e-12 * (size + norms.max())
            for i in np.flatnonzero(~(chosen[:, -1] < reach)):
                near_id[i : i + 1], chosen[i : i + 1] = ranked(((wide - part[i]) ** 2).sum(1)[None, :], stored_ids[None, :].copy(), own[i : i + 1])
        good = np.isfinite(chosen)
        rows = np.nonzero(good)[0]
        out_i.append(own[rows])
        out_j.append(near_id[good])
        out_d.append(chosen[good])
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_d)


def compare(routed: DataFrame, k: int, dim: int, block: int) -> DataFrame:
    """The k nearest of every row within each partition: (rid, near, d2)."""
    sizes = routed.groupBy("profile", "part").agg(F.sum(F.col("base").cast("int")).alias("stored"), F.count(F.lit(1)).alias("looked"))
    # Stored rows in blocks, looked-for rows in blocks, each pair of blocks one group: however
    # large a partition grows, a task holds at most two blocks.
    sizes = sizes.select("profile", "part", F.ceil(F.col("stored") / block).cast("int").alias("nb"), F.ceil(F.col("looked") / block).cast("int").alias("nq")).filter("nb > 0")
    placed = routed.join(F.broadcast(sizes), ["profile", "part"])  # at most MAX_PARTS * (MAX_SUBPARTS + 1) rows a profile
    as_query = placed.select(
        "profile", "part", "rid", "vec", F.lit(False).alias("is_stored"),
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.pmod(F.xxhash64("rid"), "nq").cast("int").alias("q"),
    )
    as_stored = placed.filter("base").select(
        "profile", "part", "rid", "vec", F.lit(True).alias("is_stored"),
        F.pmod(F.xxhash64("rid"), "nb").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"),
    )
    # Where a partition is one pair of blocks a stored row is also the looked-for row: send it once.
    single = placed.filter("nb = 1 AND nq = 1").select("profile", "part", "rid", "vec", F.lit(0).alias("b"), F.lit(0).alias("q"), F.lit(True).alias("looks"), F.col("base").alias("is_stored"))
    multi_q = as_query.join(F.broadcast(sizes.filter("nb > 1 OR nq > 1").select("profile", "part")), ["profile", "part"], "left_semi")
    multi_s = as_stored.join(F.broadcast(sizes.filter("nb > 1 OR nq > 1").select("profile", "part")), ["profile", "part"], "left_semi")
    columns = ["profile", "part", "b", "q", "rid", "vec", "looks", "is_stored"]
    rows = (
        single.select(*columns)
        .unionByName(multi_q.withColumn("looks", F.lit(True)).select(*columns))
        .unionByName(multi_s.withColumn("looks", F.lit(False)).select(*columns))
    )

    def search(table: pa.Table) -> pa.Table:
        ids = table["rid"].to_numpy()
        x = np.frombuffer(b"".join(table["vec"].to_pylist()), dtype=np.float32).reshape(-1, dim)
        stored, looks = table["is_stored"].to_numpy().astype(bool), table["looks"].to_numpy().astype(bool)
        i, j, d = nearest_in_block(ids[stored], x[stored], ids[looks], x[looks], k) if stored.any() else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"rid": pa.array(i, pa.int64()), "near": pa.array(j, pa.int64()), "d2": pa.array(d, pa.float64())})

    return rows.groupBy("profile", "part", "b", "q").applyInArrow(search, PAIRS)


def nearest(
    df: DataFrame, k: int = 5, dim: int = 64, probes: int = PROBES, mass: float = MASS,
    part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, block: int = BLOCK,
) -> DataFrame:
    """(segment_id, neighbour_id, rank, d2): the ``k`` nearest vectors of every usable vector of
    ``df`` (segment_id, model_profile_id, embedding) within its profile, by Euclidean distance.

    Equal distances go by segment_id; copies of a vector are neighbours at distance 0; a profile of
    k vectors or fewer gives as many as there are. See :func:`valid_vectors` for what takes part.
    """
    valid = materialize(valid_vectors(df, dim), "vectors")
    vectors = materialize(distinct_vectors(valid, k), "distinct")
    routers = train(vectors, part_rows, max_parts, dim)
    routed = materialize(route(vectors, routers, probes, mass, dim), "routed")
    routed = split_large(routed, probes, mass, part_rows, max_parts, dim)
    found = compare(routed, k, dim, block)
    order = Window.partitionBy("rid").orderBy("d2", "near")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("rid", "near", "d2")

    ids = vectors.select("rid", "ids")
    others = best.join(ids.withColumnRenamed("rid", "near"), "near").select("rid", "d2", F.explode("ids").alias("neighbour_id"))
    own = ids.select("rid", F.lit(0.0).alias("d2"), F.explode("ids").alias("neighbour_id"))
    ranked = own.unionByName(others).withColumn("r", F.row_number().over(Window.partitionBy("rid").orderBy("d2", "neighbour_id")))
    # The k + 1 nearest entries, copies included, serve every segment of the vector.
    lists = ranked.filter(F.col("r") <= k + 1).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("d2", "neighbour_id"))).alias("near"))
    listed = lists.join(vectors.select("rid", "n", "ids"), "rid")
    # Segments among the smallest k + 1 of their vector are known here; further copies join.
    first = listed.select(F.explode("ids").alias("segment_id"), "near")
    crowded = vectors.filter(F.col("n") > k + 1).select("rid", "profile", "vec", "ids")
    rest = (
        join_unique(valid, crowded, ["profile", "vec"])
        .filter(~F.array_contains("ids", F.col("segment_id")))
        .select("segment_id", F.transform(F.slice("ids", 1, k), lambda x: F.struct(F.lit(0.0).alias("d2"), x.alias("neighbour_id"))).alias("near"))
    )
    every = first.unionByName(rest)
    without = F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("segment_id")), 1, k)
    return every.select("segment_id", F.posexplode(without).alias("rank", "x")).select(
        "segment_id", F.col("x.neighbour_id").alias("neighbour_id"), (F.col("rank") + 1).alias("rank"), F.col("x.d2").alias("d2")
    )


def pairs(near: DataFrame) -> DataFrame:
    """(segment_id_a, segment_id_b), a < b, once per pair of which one is near the other."""
    a, b = F.least("segment_id", "neighbour_id"), F.greatest("segment_id", "neighbour_id")
    return near.select(a.alias("segment_id_a"), b.alias("segment_id_b")).distinct()


def brute_force(df: DataFrame, k: int = 5, dim: int = 64, one_in: int = 100, queries_at_once: int = 20_000) -> DataFrame:
    """Exact (segment_id, neighbour_id) of the stated query set, every segment whose hash is
    divisible by ``one_in``, against all rows, a bounded block of queries at a time: plain sums of
    squared differences in double precision."""
    valid = materialize(valid_vectors(df, dim), "exact")
    chosen = valid.filter(F.pmod(F.xxhash64("segment_id"), F.lit(one_in)) == 0)
    blocks = max(1, math.ceil(chosen.count() / queries_at_once))
    order = Window.partitionBy("segment_id").orderBy("d2", "neighbour_id")
    found = None
    for block in range(blocks):
        part = chosen if blocks == 1 else chosen.filter(F.pmod(F.xxhash64("segment_id", F.lit(7)), F.lit(blocks)) == block)
        queries: dict[str, list[tuple[str, np.ndarray]]] = {}
        for r in part.select("segment_id", "profile", "vec").collect():
            queries.setdefault(r["profile"], []).append((r["segment_id"], np.frombuffer(bytes(r["vec"]), dtype=np.float32).astype(np.float64)))
        shared = df.sparkSession.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                profiles = np.array(batch.column(1).to_pylist(), dtype=object)
                names = np.array(batch.column(0).to_pylist(), dtype=object)
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float32).reshape(-1, dim).astype(np.float64)
                own, near, far = [], [], []
                for profile, asked in shared.value.items():
                    rows = np.flatnonzero(profiles == profile)
                    sub, known = x[rows], names[rows]
                    for name, q in asked:
                        apart = sub - q
                        d = np.einsum("ij,ij->i", apart, apart)
                        d[known == name] = np.inf
                        worst = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                        for i in np.flatnonzero((d <= worst) & np.isfinite(d)):
                            own.append(name)
                            near.append(known[i])
                            far.append(d[i])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(near, pa.string()), pa.array(far, pa.float64())], names=["segment_id", "neighbour_id", "d2"])

        near = valid.select("segment_id", "profile", "vec").mapInArrow(run, "segment_id string, neighbour_id string, d2 double")
        best = materialize(near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("segment_id", "neighbour_id"), "truth")
        shared.unpersist()
        found = best if found is None else found.unionByName(best)
    return found


def recall(df: DataFrame, near: DataFrame, k: int = 5, dim: int = 64, one_in: int = 100) -> DataFrame:
    """(n_queries, n_true, n_found, recall) of ``near`` on the stated query set of ``brute_force``."""
    true = brute_force(df, k, dim, one_in)
    hits = true.join(near.select("segment_id", "neighbour_id", F.lit(1).alias("hit")), ["segment_id", "neighbour_id"], "left")
    return hits.agg(
        F.count_distinct("segment_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"),
        F.try_divide(F.coalesce(F.sum("hit"), F.lit(0)), F.count(F.lit(1))).alias("recall"),
    )
