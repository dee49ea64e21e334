"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a key's hash. A bucket over the
byte limit splits on one more bit; all others stay. A bucket of depth d is the
sum of its two children, so all depths follow from one histogram over fine
prefixes, and a row's shard is its shallowest bucket that needs no split. What
is still too large at the grain of the histogram is taken through the same
steps on further bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.session import written

from .batches import aside, one_column

# Bits of the hash; how many bits finer than the expected depth the histogram is, and each later one.
HASH_BITS, FINER, STEP = 60, 6, 12
LIMIT_BYTES = 1 << 20
ADDED = ["depth", "bucket", "shard_bytes", "shard_rows", "family"]


def key_hash(key: Column) -> Column:
    """The leading 60 bits of the key's MD5, as a number; a null key hashes like the empty text."""
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(hexed, 16, 10).cast("long")


def assign_shards(rows: DataFrame, key: str = "doc_id", size: str = "n_bytes", limit: int = LIMIT_BYTES) -> DataFrame:
    """``rows`` with the shard of each added: depth, bucket, and the shard's bytes and rows.

    A shard is the ``depth`` leading bits of the key's hash, read as the number
    ``bucket``; it holds at most ``limit`` bytes, or a single row that is larger
    by itself. Null sizes count as 0, null keys as one key. Rows of one key
    share all bits: where they alone are over the limit, they form a family of
    their own (``family`` is their hash, else null), divided in the same way by a hash
    of their place in the table. Repeated rows count each; an empty table gives
    no rows; other columns pass through, whatever their names; those with the new names are replaced. A very long text
    is nothing but its size here.

    Only sums over prefixes are shuffled to find the shards, a number of rows
    in proportion to the shards; then the rows once, by prefix.
    """
    given = [c for c in rows.columns if c not in ADDED]
    bare, back = aside(one_column(rows, *given))
    kept = bare.columns
    key, size = kept[given.index(key)], kept[given.index(size)]
    sized = bare.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    main = sized.withColumn("_family", F.lit(None).cast("long")).withColumn("_hash", key_hash(F.col(key)))
    done, over = _divided(main, limit)
    if over is not None:
        # Rows of one key can't be told apart by their key, but by where they stand.
        place = F.concat_ws(":", F.col("_hash"), F.monotonically_increasing_id())
        again = written(over.withColumn("_family", F.col("_hash")).withColumn("_place", place), "shard-family")
        more, left = _divided(again.withColumn("_hash", key_hash(F.col("_place"))).drop("_place"), limit)
        done += more + ([] if left is None else [_named(left.withColumn("_leaf", _alone(left)))])
    shards = done[0]
    for part in done[1:]:
        shards = shards.unionByName(part)
    return back(shards.select(*kept, *ADDED))


def _alone(rows: DataFrame) -> Column:
    """All bits equal: only where two places have one hash."""
    return F.struct(
        F.lit(HASH_BITS).alias("depth"), F.col("_hash").alias("bucket"), F.col("_size").alias("bytes"), F.lit(1).cast("long").alias("rows")
    )


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        F.col("_leaf.depth").cast("int").alias("depth"),
        F.col("_leaf.bucket").alias("bucket"),
        F.col("_leaf.bytes").alias("shard_bytes"),
        F.col("_leaf.rows").alias("shard_rows"),
        F.col("_family").alias("family"),
    ).drop("_leaf", "_family", "_hash", "_size", "_fine", "_f")


def _divided(rows: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows with their shards, in parts, and the rows that all bits together leave over the limit."""
    total = rows.agg(F.sum("_size")).first()[0] or 0
    start, grain = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + FINER)
    done: list[DataFrame] = []
    while True:
        marked = rows.withColumn("_f", F.coalesce("_family", F.lit(-1))).withColumn(
            "_fine", F.shiftright("_hash", HASH_BITS - grain)
        )
        sizes = written(
            marked.groupBy("_f", "_fine").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-sizes"
        )
        judged = written(_judged(sizes, start, grain, limit), "shard-judged")
        least, left = judged.agg(F.min(F.when(F.col("settled"), F.col("depth"))), F.count_if(~F.col("settled"))).first()
        leaf = written(_leaves(sizes, judged.filter("settled"), grain if least is None else least, grain), "shard-leaves")
        # Tables of prefixes are never broadcast: small as files, they are too large for the driver.
        placed = marked.join(leaf.hint("merge"), ["_f", "_fine"], "left")
        done.append(_named(placed.filter("_leaf is not null")))
        if not left:
            return done, None
        rows = placed.filter("_leaf is null").drop("_leaf", "_fine", "_f")
        if grain == HASH_BITS:
            return done, rows
        start, grain = grain, min(HASH_BITS, grain + STEP)


def _at_depths(sizes: DataFrame, start: int, grain: int) -> DataFrame:
    """Every fine prefix once for each depth from ``start``, with its bucket there."""
    depths = sizes.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(grain))))
    return depths.withColumn("bucket", F.expr(f"shiftright(_fine, {grain} - depth)"))


def _judged(sizes: DataFrame, start: int, grain: int, limit: int) -> DataFrame:
    """Buckets that need no split while the one above does (``settled``), and the finest that still need one.

    So many rows as shards, not as prefixes: two halves meet in one group, which tells whether their whole was to be split.
    """
    sums = _at_depths(sizes, start, grain).groupBy("_f", "depth", "bucket").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
    )
    fits = (F.col("bytes") <= limit) | (F.col("rows") == 1)
    halves = sums.groupBy("_f", "depth", F.shiftright("bucket", 1).alias("above")).agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.collect_list(F.struct("bucket", "bytes", "rows")).alias("halves")
    )
    parted = halves.filter((F.col("depth") == start) | ~fits)
    buckets = parted.select("_f", "depth", F.inline("halves")).withColumn("settled", fits)
    return buckets.filter(F.col("settled") | (F.col("depth") == grain))


def _leaves(sizes: DataFrame, settled: DataFrame, least: int, grain: int) -> DataFrame:
    """For each fine prefix its shallowest bucket that needs no split, where there is one; none is above depth ``least``."""
    met = _at_depths(sizes, least, grain).select("_f", "_fine", "depth", "bucket").join(settled.hint("merge"), ["_f", "depth", "bucket"])
    return met.groupBy("_f", "_fine").agg(F.min(F.struct("depth", "bucket", "bytes", "rows")).alias("_leaf"))


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", size: str = "n_bytes", limit: int = LIMIT_BYTES) -> None:
    """Writes one Parquet folder per shard, named by family, depth and bucket."""
    placed = assign_shards(rows, key, size, limit)
    folder = F.concat_ws("-", F.coalesce(F.col("family").cast("string"), F.lit("main")), "depth", "bucket")
    dealt = placed.withColumn("shard", folder).repartition("shard")
    dealt.drop(*ADDED).write.partitionBy("shard").parquet(path)


#: The shards by the definition: sums over every prefix of every depth.
ORACLE = f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
lv AS (SELECT d AS depth, hash >> ({HASH_BITS} - d) AS bucket, h.* FROM h, range(0, 31) t(d)),
sums AS (SELECT depth, bucket, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM lv GROUP BY depth, bucket),
settled AS (
  SELECT lv.doc_id, lv.n_bytes, s.* FROM lv JOIN sums s ON lv.depth = s.depth AND lv.bucket = s.bucket
  WHERE s.shard_bytes <= {LIMIT_BYTES} OR s.shard_rows = 1)
SELECT doc_id, n_bytes, depth::INT AS depth, bucket, shard_bytes::BIGINT AS shard_bytes, shard_rows
FROM settled QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
