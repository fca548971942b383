"""Problem 8: filling fixed-capacity containers with items.

Planning works on the histogram of lengths, not on items: best-fit decreasing
over (length, count), where containers with equal space left form one group.
The histogram has at most `capacity` lengths, whatever the number of items, and
so is the plan's size bounded. A plan row says: the items of this length with
ranks lo..hi go, `per` to a container, into containers from `base` on. Items
take their slots by an equality join on length and a range test on their rank
within that length; ranks come from counts by (length, bucket of key), so even a
length that a third of all items have is ranked in many tasks.

Only an item that alone exceeds the capacity is split: into full pieces, each a
container of its own, and a rest that is packed as any other item.

Defined results: items of length 0 or null (null and empty texts) take no room
and stand in container 0 with n_tokens 0; an empty table gives no rows; equal
lengths are ranked by key, and repeated keys by their order of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table
from .p7_tokens import VOCABULARY, token_count

CAPACITY = 2048
#: Buckets by which items of one length are ranked apart, at least, and items of the whole that a further bucket is made for.
RANK_BUCKETS, ITEMS_A_BUCKET = 256, 1_000_000

PLAN = "size int, lo long, hi long, per long, base long"


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan rows (size, lo, hi, per, base) and the number of containers, from counts by length.

    Longest first; each length goes to the containers with the least space left
    that still holds it, as many to one as fit, then to new ones.
    """
    left: dict[int, list[tuple[int, int]]] = {}  # space left -> [(first container, how many)]
    rows, used = [], 0
    for size in sorted(counts, reverse=True):
        todo, lo = counts[size], 1
        while todo:
            fits = [r for r in left if r >= size]
            if fits:
                space = min(fits)
                base, many = left[space].pop()
                if not left[space]:
                    del left[space]
            else:
                space = capacity
                base, many = used, -(-todo // (capacity // size))
                used += many
            per = space // size
            full = min(many, todo // per)
            if full:
                rows.append((size, lo, lo + full * per - 1, per, base))
                left.setdefault(space - full and space - per * size, []).append((base, full))
                todo -= full * per
                lo += full * per
            if full < many and todo:  # fewer than `per` are left: one container takes them
                rows.append((size, lo, lo + todo - 1, todo, base + full))
                left.setdefault(space - todo * size, []).append((base + full, 1))
                todo, full = 0, full + 1
            if full < many:
                left.setdefault(space, []).append((base + full, many - full))
        left.pop(0, None)
    return rows, used


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, buckets: int = RANK_BUCKETS) -> DataFrame:
    """(key, piece, start, n_tokens, container) of items with a key and a size column.

    piece counts the pieces of an item from 0, start is the piece's first token.
    Containers are numbered from 0 without gaps, the full pieces of split items last.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    sized = items.select(F.col(key).alias("k"), F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long").alias("n"))
    # What is packed of an item: all of it, or the rest beyond its full pieces. n_full: its full pieces.
    rest = cut(
        sized.withColumn("n_full", F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", (F.col("n") - F.col("n_full") * capacity).cast("int"))
    )
    buckets = max(buckets, rest.count() // ITEMS_A_BUCKET)
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int"))
    by_bucket = rest.groupBy("rest", "bucket").agg(F.count("*").alias("c"), F.sum("n_full").alias("f"))
    by_bucket = cut(by_bucket)
    counts = {r["rest"]: r["c"] for r in by_bucket.groupBy("rest").agg(F.sum("c").alias("c")).where("rest > 0").collect()}
    rows, used = plan_best_fit(counts, capacity)
    plan = spark.createDataFrame(rows, PLAN)
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Full pieces before those of a length: at most `capacity` rows, so one small task; then before those of a bucket, by length.
    by_length = by_bucket.groupBy("rest").agg(F.sum("f").alias("f")).withColumn("b0", F.coalesce(F.sum("f").over(Window.orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = (
        by_bucket.join(by_length.drop("f"), "rest")
        .withColumn("r0", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .withColumn("f0", F.lit(used) + F.col("b0") + F.coalesce(F.sum("f").over(before), F.lit(0)))
        .select("rest", "bucket", "r0", "f0")
    )
    within = Window.partitionBy("rest", "bucket").orderBy("k", "n_full")
    ranked = (
        rest.withColumn("i", F.row_number().over(within))
        .withColumn("fi", F.sum("n_full").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_full"))
        .join(offsets.hint("merge"), ["rest", "bucket"])  # partitioned alike, and not broadcast: it may have capacity * buckets rows
        .withColumn("rank", F.col("r0") + F.col("i"))
        .withColumn("first_full", F.col("f0") + F.col("fi"))
    )
    on = (F.col("rest") == F.col("size")) & F.col("rank").between(F.col("lo"), F.col("hi"))
    placed = ranked.join(F.broadcast(plan), on, "left").withColumn(
        "slot", F.when(F.col("rest") == 0, F.lit(0)).otherwise(F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
    )
    cols = ["k", "piece", "start", "n_tokens", "container"]
    packed = placed.where("rest > 0 or n_full = 0").select(
        "k", F.col("n_full").cast("int").alias("piece"), (F.col("n_full") * capacity).alias("start"), F.col("rest").alias("n_tokens"), F.col("slot").cast("long").alias("container")
    )
    full = placed.where("n_full > 0").select("k", "first_full", F.posexplode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece", "p"))
    full = full.select("k", "piece", (F.col("p") * capacity).cast("long").alias("start"), F.lit(capacity).alias("n_tokens"), (F.col("first_full") + F.col("p")).cast("long").alias("container"))
    return packed.select(cols).unionByName(full.select(cols)).withColumnRenamed("k", key)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text"), VOCABULARY).alias("n_tok"))
    return pack(docs, "doc_id", "n_tok")


#: Capacity of p8_chars, in code points.
CHARS = 20_000


def p8_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by code points, each with its pieces, what they hold, and how full the fullest of their containers is beyond the capacity."""
    packed = cut(pack(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id", "n", CHARS))
    over = packed.groupBy("container").agg(F.greatest(F.sum("n_tokens") - CHARS, F.lit(0)).alias("over"))
    sums = packed.join(over, "container").groupBy("doc_id")
    return sums.agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").cast("long").alias("n_chars"), F.countDistinct("container").alias("n_containers"), F.max("over").cast("long").alias("over"))


SQL = {
    "p8_chars": f"""with s as (select doc_id, cast(coalesce(length(text), 0) as bigint) n from documents), p as (select *, greatest(1, cast(ceil(n / {CHARS}) as bigint)) pieces from s)
select doc_id, pieces n_pieces, n n_chars, pieces n_containers, cast(0 as bigint) "over" from p""",
}
