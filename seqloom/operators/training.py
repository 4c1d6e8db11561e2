"""Training records and ragged batches as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.alphabets import MAIN, Alphabet, append_startstop, encode
from seqloom.operators.clusters import last_wins

#: Reference index of a position that has none.
NO_REFERENCE = -100


def splice_structured(sequence: Column, struct_sequence: Column) -> Column:
    """The structured sequence framed by $ and *, then what follows the first * of the original."""
    rest = F.substr(sequence, F.instr(sequence, "*") + 1)
    return F.concat(F.lit("$"), struct_sequence, F.lit("*"), rest)


def splice_values(values: Column, length: Column) -> Column:
    """Values of a structured part at positions 1.. of a spliced sequence, null elsewhere."""
    none = F.get(values, F.lit(-1))
    return F.concat(F.array(none), values, F.array_repeat(none, (length - 1 - F.size(values)).cast("int")))


def assemble_training(sequences: DataFrame, assigned: DataFrame, structures: DataFrame, order: Column) -> DataFrame:
    """(id, sequence, coords, scores) of the sequences that have a structure.

    ``sequences`` (id, sequence), ``assigned`` (id, suffix and an order; the last row of an id wins),
    ``structures`` (suffix, struct_sequence, coords array, scores array).
    """
    joined = sequences.join(last_wins(assigned, "id", order).select("id", "suffix"), "id").join(structures, "suffix")
    final = joined.withColumn("final", splice_structured(F.col("sequence"), F.col("struct_sequence")))
    return final.select("id", F.col("final").alias("sequence"), splice_values(F.col("coords"), F.length("final")).alias("coords"), splice_values(F.col("scores"), F.length("final")).alias("scores"))


def tokenize(df: DataFrame, text: str, sides: list[str] | None = None, alphabet: Alphabet = MAIN) -> DataFrame:
    """Adds ``tokens``, framed; each side array gets a null at both framing places."""
    out = df.withColumn("tokens", append_startstop(encode(F.col(text), alphabet), alphabet))
    for side in sides or []:
        none = F.array(F.get(F.col(side), F.lit(-1)))
        out = out.withColumn(side, F.concat(none, F.col(side), none))
    return out


def batch_ids(df: DataFrame, order: str, size: int = 128) -> DataFrame:
    """Adds ``batch``: consecutive slices of ``size`` rows by a given dense order."""
    return df.withColumn("batch", F.floor(F.col(order) / size))


def pad_batch(df: DataFrame, batch: str, tokens: str = "tokens", pad: int = MAIN.missing, sides: list[str] | None = None) -> DataFrame:
    """Pads token arrays to the longest of their batch, and adds ``segment_size``.

    Arrays of ``sides`` go with the tokens, and are padded with nulls.
    """
    longest = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("__most"))
    out = df.join(longest, batch).withColumn("segment_size", F.size(tokens))
    more = lambda a, fill: F.concat(a, F.array_repeat(fill, F.greatest(F.lit(0), F.col("__most") - F.size(a))))
    for side in sides or []:
        out = out.withColumn(side, more(F.col(side), F.get(F.col(side), F.lit(-1))))
    return out.withColumn(tokens, more(F.col(tokens), F.lit(pad))).drop("__most")


def concat_prompt(prompts: DataFrame, segments: DataFrame, prompt: str, order: str, tokens: str = "tokens", pad: int = MAIN.missing, sides: list[str] | None = None) -> DataFrame:
    """(prompt, tokens, segment_sizes, sides): a prompt's segments one after another, with their ``sides``.

    An empty prompt is one mask token, whose side values are missing. A prompt is a model's context,
    so it is one value.
    """
    sides = sides or []
    parts = segments.groupBy(prompt).agg(F.array_sort(F.collect_list(F.struct(order, tokens, *sides))).alias("__parts"))
    joined = prompts.select(prompt).distinct().join(parts, prompt, "left")
    joined_up = lambda name: F.flatten(F.transform("__parts", lambda p: p[name]))
    sizes = F.transform("__parts", lambda p: F.size(p[tokens]))
    return joined.select(
        prompt,
        F.coalesce(joined_up(tokens), F.array(F.lit(pad))).alias("tokens"),
        F.coalesce(sizes, F.array(F.lit(1))).alias("segment_sizes"),
        *[F.coalesce(joined_up(s), F.array(F.lit(None).cast(segments.schema[s].dataType.elementType))).alias(s) for s in sides],
    )


def unpad(df: DataFrame, keys: list[str], tokens: str = "tokens", size: str = "segment_size") -> DataFrame:
    """Long rows (keys, pos, token) without padding."""
    return df.select(*keys, F.posexplode(F.slice(tokens, F.lit(1), F.col(size))).alias("pos", "token"))


def pad(rows: DataFrame, keys: list[str], fill: int = 0, width: str | None = None) -> DataFrame:
    """The inverse: arrays in order of ``pos``, filled up to the column ``width`` or the longest array."""
    arrays = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("tokens"), *([F.max(width).alias("__most")] if width else []))
    if not width:
        arrays = arrays.crossJoin(F.broadcast(arrays.agg(F.max(F.size("tokens")).alias("__most"))))
    return arrays.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.col("__most") - F.size("tokens"))))).drop("__most")


def length_mask(length: Column, width: Column | int) -> Column:
    """Booleans that are true from ``length`` on."""
    most = width if isinstance(width, Column) else F.lit(width)
    return F.transform(F.sequence(F.lit(0), most - 1), lambda i: i >= length)


def segment_offsets(df: DataFrame, by: str, order: str, length: Column) -> DataFrame:
    """Adds ``segment_offset``: the exclusive prefix sum of lengths."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("segment_offset", F.coalesce(F.sum(length).over(window), F.lit(0)).cast("bigint"))


def segment_positions(df: DataFrame, keys: list[str], tokens: str, padding: int | None = None) -> DataFrame:
    """Long rows (keys, at, token, position): the place in the segment, counting what is no padding."""
    rows = df.select(*keys, F.posexplode(tokens).alias("at", "token"))
    if padding is None:
        return rows.withColumn("position", F.col("at"))
    window = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("position", (F.sum((F.col("token") != padding).cast("int")).over(window) - 1).cast("int"))


def query_refs(encoder: DataFrame, decoder: DataFrame, missing: int = MAIN.missing, value: bool = False) -> DataFrame:
    """For each decoder position the encoder position it refers to: (batch_id, y_pos, ref_idx, known).

    ``encoder`` (batch_id, segment, tokens), ``decoder`` (batch_id, segment, length, query_segment or null).
    A decoder segment with a query segment refers to it position by position, and a position is
    known if the encoder's token there is not the mask; all others have NO_REFERENCE. With ``value`` there is
    also the token referred to, null where there is none. Segments are joined whole, and positions are told
    apart last, so that no join or shuffle has a row for each position. The join is by shuffle: how long
    segments are doesn't show in the size by which small tables are broadcast.
    """
    enc = segment_offsets(encoder, "batch_id", "segment", F.size("tokens")).select(
        "batch_id", F.col("segment").alias("query_segment"), F.col("segment_offset").alias("__from"), "tokens"
    )
    dec = segment_offsets(decoder, "batch_id", "segment", F.col("length"))
    rows = dec.join(enc.hint("merge"), ["batch_id", "query_segment"], "left").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
    token = F.get(F.col("tokens"), F.col("__i").cast("int"))
    return rows.select(
        "batch_id",
        (F.col("segment_offset") + F.col("__i")).alias("y_pos"),
        F.coalesce(F.when(token.isNotNull(), F.col("__from") + F.col("__i")), F.lit(NO_REFERENCE)).cast("bigint").alias("ref_idx"),
        F.coalesce(token != missing, F.lit(False)).alias("known"),
        *([token.alias("value")] if value else []),
    )


def gather_refs(refs: DataFrame, values: DataFrame) -> DataFrame:
    """Values (batch_id, idx, value) at the referred positions; null where there is none."""
    table = values.select("batch_id", F.col("idx").alias("ref_idx"), "value")
    return refs.join(table, ["batch_id", "ref_idx"], "left")
