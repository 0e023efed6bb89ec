"""Generations of the vector index: a new model's vectors are built beside the current ones.

A generation is a folder named by its profile. It is filled by what is not there yet, so a build
that stopped goes on where it was; it becomes current by one new, numbered pointer file, of which the
highest counts: at no moment is there none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.models import embed

POINTER = "CURRENT-"
SCHEMA = "segment_id string, model_profile_id string, embedding array<float>"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def vectors(spark: SparkSession, base: str, profile_id: str) -> DataFrame:
    """The vectors of a generation so far."""
    fs, p = _fs(spark, base)
    path = f"{base}/{profile_id}"
    if not fs.exists(p(path)):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def build(segments: DataFrame, embedder, base: str) -> int:
    """Embeds the segments (segment_id, text) that the generation lacks; returns how many it has."""
    spark = segments.sparkSession
    profile = embedder.profile.id
    missing = segments.join(vectors(spark, base, profile).select("segment_id"), "segment_id", "left_anti")
    embed(missing, "segment_id", "text", embedder).write.mode("append").parquet(f"{base}/{profile}")
    return vectors(spark, base, profile).count()


def publish(segments: DataFrame, embedder, base: str) -> str:
    """Makes the generation current; refuses while any segment lacks a vector."""
    spark = segments.sparkSession
    profile = embedder.profile.id
    if segments.join(vectors(spark, base, profile), "segment_id", "left_anti").limit(1).count():
        raise ValueError("the generation is not complete")
    fs, p = _fs(spark, base)
    number = max(_pointers(spark, base), default=0) + 1
    out = fs.create(p(f"{base}/.{POINTER}{number:08d}"), True)
    out.write(bytearray(profile.encode()))
    out.close()
    # A rename to a name that another publisher took in the meantime fails.
    if not fs.rename(p(f"{base}/.{POINTER}{number:08d}"), p(f"{base}/{POINTER}{number:08d}")):
        raise OSError("cannot publish the generation")
    return profile


def _pointers(spark: SparkSession, base: str) -> list[int]:
    fs, p = _fs(spark, base)
    if not fs.exists(p(base)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p(base))]
    return [int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER)]


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The vectors of the current generation, or None before the first."""
    numbers = _pointers(spark, base)
    if not numbers:
        return None
    profile = spark.read.text(f"{base}/{POINTER}{max(numbers):08d}").first()[0]
    return vectors(spark, base, profile)
