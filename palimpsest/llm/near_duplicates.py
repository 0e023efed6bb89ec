"""Texts that share most of their word shingles, across a collection too large for pairs.

One hash function turns shingles into numbers. A text retains the bottom of its set in one fixed
order of all shingles: rarer classes of document frequency first, the hash within a class. How many
it retains follows from its size, so that two texts over the threshold always retain a common value
(the prefix principle holds for any fixed order): inverted lists of retained values meet every such
pair, and because rare values come first, the lists stay short however common other shingles are.
The sketches of lowest hashes then estimate each met pair's similarity over the union's sketch, and
the pairs that may reach the threshold are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.functions.bloom import might_contain
from palimpsest.functions.columns import computed_once
from palimpsest.operators.skew import join_unique
from palimpsest.session import materialize

WORDS = r"[\p{L}\p{N}]+"

#: Hashes of a union sketch, and the share of pairs at the threshold that it may drop.
SKETCH = 32
SKETCH_LOSS = 1e-9

#: Shingles whose document frequency is broadcast, at most (9 bytes each); all others count as
#: rare. The bound moves only the order, never what is found.
MAX_FREQUENT = 2_000_000
LEAST_FREQUENT = 8

#: Rows of a list, or texts of a class, that meet at once; longer ones meet in pairs of blocks.
BLOCK = 1024


def shingles(text: F.Column, width: int) -> F.Column:
    """Sorted distinct hashes of the runs of ``width`` words of the lower-cased text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))

    def hashes(w: F.Column) -> F.Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[w[i + j] for j in range(width)]))
        return F.when(F.size(w) >= width, F.array_sort(F.array_distinct(runs)))

    # The one-element array binds the words to a variable, so that they are found once a text.
    return F.transform(F.array(words), hashes)[0]


def _least_shared(threshold: Fraction) -> int:
    """The most shared sketch hashes to ask for at a loss of at most SKETCH_LOSS."""
    from math import comb

    p, total = float(threshold), 0.0
    for shared in range(SKETCH + 1):
        total += comb(SKETCH, shared) * p**shared * (1 - p) ** (SKETCH - shared)
        if total > SKETCH_LOSS:
            return shared
    return SKETCH


class NearDuplicates:
    """Classes of equal texts, and the pairs of classes whose similarity reaches a threshold."""

    def __init__(self, df: DataFrame, id_column: str, text_column: str, threshold: Fraction = Fraction(4, 5), width: int = 5):
        self.spark = df.sparkSession
        self.threshold = Fraction(threshold)
        rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
        rows = rows.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
        #: (id, h1, h2): every text's class, equal texts sharing one; redelivered ids once.
        self.members = materialize(rows.select("id", "h1", "h2").distinct(), "members")
        one = computed_once(rows.select("h1", "h2", "text").dropDuplicates(["h1", "h2"]), {"sh": shingles(F.col("text"), width)})
        one = one.filter(F.size("sh") > 0).select(F.monotonically_increasing_id().alias("did"), "h1", "h2", F.size("sh").alias("n"), "sh")
        #: (did, h1, h2, n, sh): one row per class with shingles.
        self.sets = materialize(one, "sets")
        self._pairs: DataFrame | None = None

    def _frequent(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Sorted hashes of frequent shingles and their classes, log2 of the document frequency,
        counted over all texts; at most MAX_FREQUENT, the most frequent classes; and the class
        that all others count as, no lower than any of theirs."""
        counts = self.sets.select(F.explode("sh").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        frequent = counts.filter(F.col("df") >= LEAST_FREQUENT).select("h", F.floor(F.log2("df")).cast("int").alias("c"))
        frequent = materialize(frequent, "frequent")
        left, lowest = MAX_FREQUENT, 64
        for row in frequent.groupBy("c").count().orderBy(F.desc("c")).collect():
            if row["count"] > left:
                rest = row["c"]
                break
            left, lowest = left - row["count"], row["c"]
        else:
            rest = LEAST_FREQUENT.bit_length() - 2
        found = frequent.filter(F.col("c") >= lowest).toArrow()
        h, c = found["h"].to_numpy(), found["c"].to_numpy().astype(np.uint8)
        order = np.argsort(h)
        return h[order], c[order], rest

    def retained(self) -> DataFrame:
        """(h, did, n, small, c): the retained values with their classes; ``small`` marks those that
        suffice for a pair's smaller text, as the larger one retains more."""
        shared = self.spark.sparkContext.broadcast(self._frequent())
        p, q = self.threshold.numerator, self.threshold.denominator
        target = T._parse_datatype_string("h bigint, did bigint, n int, small boolean, c int")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent, classes, rest = shared.value
            for whole in batches:
                for low in range(0, whole.num_rows, 2000):
                    batch = whole.slice(low, 2000)
                    column = batch.column(2)
                    h = column.flatten().to_numpy(zero_copy_only=False)
                    n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                    row = np.repeat(np.arange(len(n)), n)
                    order_class = np.full(len(h), rest, dtype=np.uint8)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                        order_class = np.where(frequent[at] == h, classes[at], rest).astype(np.uint8)
                    order = np.lexsort((h, order_class, row))
                    position = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                    keep = n - (p * n + q - 1) // q + 1
                    enough = n - (2 * p * n + p + q - 1) // (p + q) + 1
                    kept = position < keep[row]
                    rows = row[kept]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[order][kept]),
                            pa.array(batch.column(0).to_numpy(zero_copy_only=False)[rows]),
                            pa.array(n[rows].astype(np.int32)),
                            pa.array(position[kept] < enough[rows]),
                            pa.array(order_class[order][kept].astype(np.int32)),
                        ],
                        names=target.names,
                    )

        return self.sets.select("did", "n", "sh").mapInArrow(run, target)

    def met(self) -> DataFrame:
        """(a, b): did of the pairs that share a retained value, the smaller text first, each once.

        A value of class c has fewer than 2^(c+1) texts; lists that may be longer than BLOCK meet
        in pairs of blocks, each a key of its own."""
        p, q = self.threshold.numerator, self.threshold.denominator
        kept = materialize(self.retained(), "retained")
        longest = BLOCK.bit_length() - 2
        left = lambda df: df.withColumnsRenamed({"did": "a", "n": "na", "small": "sa"})
        right = lambda df: df.withColumnsRenamed({"did": "b", "n": "nb", "small": "sb"})
        ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        # Written so that it is not pushed below the exchange, which then serves both sides.
        suffices = F.col("sa") | (F.col("na") + F.col("nb") < 0)
        fits = ordered & suffices & (F.col("na") * q >= F.col("nb") * p)
        short = kept.filter(F.col("c") <= longest).select("h", "did", "n", "small")
        pairs = left(short).join(right(short), "h").filter(fits).select("a", "b")
        long = kept.filter(F.col("c") > longest).withColumn("blocks", F.ceil(F.pow(F.lit(2.0), F.col("c") + 1) / BLOCK).cast("int"))
        long = long.withColumn("own", F.pmod(F.xxhash64("did"), "blocks").cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        split = left(long.select("h", "did", "n", "small", F.col("own").alias("i"), every.alias("j"))).join(
            right(long.select("h", "did", "n", "small", F.col("own").alias("j"), every.alias("i"))), ["h", "i", "j"]
        )
        return materialize(pairs.unionByName(split.filter(fits).select("a", "b")).distinct(), "met")

    def pairs(self) -> DataFrame:
        """(a, b): did of the pairs of different classes at or over the threshold, each once."""
        if self._pairs is not None:
            return self._pairs
        p, q = self.threshold.numerator, self.threshold.denominator
        met = self.met()

        # Union sketch: of the SKETCH lowest hashes of the union, those in both sketches. Half the
        # bits of a hash serve, the order and the count stay the same.
        sketch = self.sets.select("did", F.transform(F.slice("sh", 1, SKETCH), lambda x: F.shiftright(x, 32).cast("int")).alias("s"))
        both = (
            met.join(sketch.withColumnsRenamed({"did": "a", "s": "sa"}), "a")
            .join(sketch.withColumnsRenamed({"did": "b", "s": "sb"}), "b")
            .withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH))
        )
        shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u"))
        # Small unions are known whole, so their share is exact.
        least = F.when(F.size("u") < SKETCH, F.size("u") * float(self.threshold) - 1e-6).otherwise(F.lit(_least_shared(self.threshold)))
        likely = materialize(both.filter(shared >= least).select("a", "b"), "likely")

        # Only the sets that are asked for travel to the verification.
        ids = likely.select(F.col("a").alias("k")).unionByName(likely.select(F.col("b").alias("k"))).distinct()
        asked = self.sets.select("did", "n", "sh").filter(might_contain(ids, "k", "did", max(1, 2 * likely.count())))
        joined = likely.join(asked.select(F.col("did").alias("a"), F.col("n").alias("na"), F.col("sh").alias("sa")), "a").join(
            asked.select(F.col("did").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("sb")), "b"
        )
        common = F.size(F.array_intersect("sa", "sb"))
        sure = joined.withColumn("o", common).filter(F.col("o") * q >= (F.col("na") + F.col("nb") - F.col("o")) * p)
        self._pairs = materialize(sure.select("a", "b"), "pairs")
        return self._pairs

    def _classes(self) -> DataFrame:
        """(did, h1, h2, size): one row per class with shingles and the number of its texts."""
        sizes = self.members.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size"))
        return self.sets.select("did", "h1", "h2").join(sizes, ["h1", "h2"])

    def text_pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every pair of texts, those of equal texts too.

        Large classes meet in pairs of blocks, so that no key gives more than BLOCK x BLOCK rows."""
        classes = materialize(self._classes().withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "classes")
        member = join_unique(self.members, classes, ["h1", "h2"]).select("did", "id", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
        member = materialize(member, "texts")
        # Classes of one text have no pair of their own.
        own = classes.filter("size > 1").select(F.col("did").alias("a"), F.col("did").alias("b"))
        blocks = classes.select("did", "blocks")
        links = (
            self.pairs().unionByName(own)
            .join(blocks.withColumnsRenamed({"did": "a", "blocks": "na"}), "a")
            .join(blocks.withColumnsRenamed({"did": "b", "blocks": "nb"}), "b")
            .select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), "nb")
            .select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
            .filter("a <> b OR i <= j")
        )
        links = materialize(links, "links")
        left = links.join(member.select(F.col("did").alias("a"), F.col("block").alias("i"), F.col("id").alias("x")), ["a", "i"])
        right = links.join(member.select(F.col("did").alias("b"), F.col("block").alias("j"), F.col("id").alias("y")), ["b", "j"])
        out = left.join(right, ["a", "b", "i", "j"]).filter((F.col("a") != F.col("b")) | (F.col("i") != F.col("j")) | (F.col("x") < F.col("y")))
        return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, n_links): every text that has a near copy, its group's smallest id, and
        the number of other classes its class is linked to. Linked texts share a group."""
        pairs = self.pairs()
        labels = connected_components(pairs).withColumnRenamed("node", "did")
        ends = pairs.select(F.col("a").alias("did")).unionByName(pairs.select(F.col("b").alias("did"))).groupBy("did").agg(F.count(F.lit(1)).alias("n_links"))
        known = (
            self.sets.select("did", "h1", "h2").join(labels, "did", "left").join(ends, "did", "left")
            .select("h1", "h2", F.coalesce("label", "did").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )
        labelled = join_unique(self.members, known, ["h1", "h2"]).select("id", "label", "n_links")
        heads = labelled.groupBy("label").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        return join_unique(labelled, heads, ["label"]).select("id", "group_id", "n_links")


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label): the smallest node of each node's component, by alternating large and small
    stars; every round is written to the shared folder."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "stars")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "stars")
        changed = after.exceptAll(now).limit(1).count() + now.exceptAll(after).limit(1).count()
        now = after
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
