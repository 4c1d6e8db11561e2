"""Extendible hashing: shards under a byte limit.

A directory is indexed by the leading bits of a row's hash. A bucket that is over the limit splits
on one more bit, the others stay as they are, until every bucket fits. All steps are DataFrame
expressions; what the driver sees is a handful of totals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.plans.lineage import cut

#: Bits that one hash word gives.
WORD_BITS = 60
#: Bits of the first directory at most, and of each directory below an oversized slot.
FIRST_BITS, NEXT_BITS = 24, 12
#: Bits of the first directory beyond those by which an even spread would fit: few, since it is as large
#: as they make it, and a bucket that is still too large gets a directory of its own.
SPARE_BITS = 3
#: Identical rows that one task numbers at most (see ``_overflow``).
SALT_ROWS = 100_000


def hash_word(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string; null hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _slots(rows: DataFrame, word: str, offset: int, bits: int, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Split each ``path`` of ``rows`` on up to ``bits`` bits of ``word``.

    Returns the directory (path, cell, depth, prefix), one row for each of the 2^bits slots of a
    path, and the buckets that are still over the limit at full depth.
    """
    cell = F.shiftright(F.col(word), WORD_BITS - offset - bits).bitwiseAND(F.lit((1 << bits) - 1))
    cells = rows.groupBy("path", cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
    up = cells.select("path", "cell", "n_bytes", "n_rows", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    nodes = (
        up.groupBy("path", "depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix"))
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
        .filter((F.col("n_bytes") > max_bytes) & (F.col("n_rows") > 1))
    )
    nodes = cut(nodes.select("path", F.col("depth").cast("int").alias("depth"), F.col("prefix").cast("long").alias("prefix")))
    split = nodes.filter(F.col("depth") < bits)
    roots = rows.select("path").distinct().select("path", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    children = split.select("path", (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    leaves = roots.unionByName(children).join(split, ["path", "depth", "prefix"], "left_anti")
    directory = leaves.select(
        "path", "depth", "prefix",
        F.explode(F.expr(f"sequence(shiftleft(prefix, {bits} - depth), shiftleft(prefix + 1, {bits} - depth) - 1)")).alias("cell"),
    )
    return directory, nodes.filter(F.col("depth") == bits)


def extendible_shards(
    df: DataFrame, key: str | list[str], size: Column, max_bytes: int, content: Column | None = None
) -> DataFrame:
    """Assign each row of ``df`` to a shard of at most ``max_bytes`` bytes.

    ``key``: column(s) whose hash indexes the directory; rows of one key stay together as long as
    they fit. ``size``: bytes of a row, null counts 0. ``content``: a string that tells rows of one
    key apart, used only where a single key is over the limit (a hot key); without it such rows
    are split as if identical.

    Returns the key column(s), ``n_bytes``, ``shard_depth`` (bits used) and ``shard`` (those bits
    as a string of 0 and 1). A row that is over the limit alone is a shard of its own. Rows that
    agree in key and content share all bits; where they are over the limit together, ``shard``
    gets a suffix ``+salt.number``. Null keys hash like empty strings; an empty table gives no
    rows; further columns of ``df`` are ignored, whatever their names. A key column that is named like
    one of the three columns added comes back as ``key_<name>``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    slim = cut(
        df.select(
            F.struct(*keys).alias("key"),
            hash_word(text).alias("h1"),
            hash_word(F.coalesce(content, F.lit(""))).alias("h2") if content is not None else F.lit(0).cast("long").alias("h2"),
            F.coalesce(size.cast("long"), F.lit(0)).cast("long").alias("n_bytes"),
            F.lit(1).cast("long").alias("n_rows"),
        )
    )
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    first = min(FIRST_BITS, SPARE_BITS + max(0, math.ceil(math.log2(max(1, total / max_bytes)))))
    steps = [("h1", 0, first)]
    for word in ("h1", "h2"):
        start = first if word == "h1" else 0
        steps += [(word, at, min(NEXT_BITS, WORD_BITS - at)) for at in range(start, WORD_BITS, NEXT_BITS)]

    pending, done, alike = slim.withColumn("path", F.lit("")), [], set()
    for word, offset, bits in steps:
        if done and word not in alike:  # where each path's rows agree in all bits of a word, it cannot split them
            range_of = pending.groupBy("path").agg(F.min(word).alias("low"), F.max(word).alias("high"))
            if range_of.filter("low < high").isEmpty():
                alike.add(word)
        if word in alike:
            continue
        directory, full = _slots(pending, word, offset, bits, max_bytes)
        cell = F.shiftright(F.col(word), WORD_BITS - offset - bits).bitwiseAND(F.lit((1 << bits) - 1))
        placed = (
            pending.withColumn("cell", cell)
            .join(directory, ["path", "cell"])
            .withColumn("path", F.concat("path", F.expr("lpad(bin(prefix), depth, '0')")))
            .drop("cell", "prefix")
        )
        if full.isEmpty():
            done.append(placed.drop("depth"))
            pending = None
            break
        over = full.select(F.concat("path", F.expr(f"lpad(bin(prefix), {bits}, '0')")).alias("path"))
        done.append(placed.join(over, "path", "left_anti").drop("depth"))
        pending = cut(placed.join(over, "path", "left_semi").drop("depth"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select("key", "n_bytes", F.col("path").alias("shard"), F.length("path").alias("shard_depth"))
    if pending is not None:
        out = out.unionByName(_overflow(pending, max_bytes))
    named = [F.col("key").getField(k).alias(f"key_{k}" if k in ("n_bytes", "shard_depth", "shard") else k) for k in keys]
    return out.select(*named, "n_bytes", F.col("shard_depth").cast("long").alias("shard_depth"), "shard")


def _overflow(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Number rows that share all hash bits into shards under the limit, exactly and in pieces.

    Such rows are alike in key and content, so any numbering does. Each group is dealt over
    enough salts that no task numbers more than about SALT_ROWS rows.
    """
    # the number is stored before anything is dealt by it, so that a row computed again keeps its salt
    rows = cut(rows.withColumn("number", F.monotonically_increasing_id()))
    groups = rows.groupBy("path").agg(F.count("*").alias("rows_here"), F.max("n_bytes").alias("largest"))
    salted = rows.join(groups, "path").withColumn("salt", F.pmod(F.xxhash64("number"), F.ceil(F.col("rows_here") / SALT_ROWS)))
    fit = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest("largest", F.lit(1))))
    place = F.row_number().over(Window.partitionBy("path", "salt").orderBy("n_bytes", "number")) - 1
    return cut(salted.withColumn("place", place)).select(
        "key", "n_bytes",
        F.concat("path", F.lit("+"), F.col("salt").cast("string"), F.lit("."), F.floor(F.col("place") / fit).cast("string")).alias("shard"),
        F.length("path").alias("shard_depth"),
    )


def shard_sizes(shards: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return shards.groupBy("shard", "shard_depth").agg(
        F.count("*").cast(T.LongType()).alias("n_rows"), F.sum("n_bytes").alias("n_bytes")
    )
