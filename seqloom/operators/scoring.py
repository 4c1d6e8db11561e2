"""Logits, losses, sequence scores and prompt ensembles as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.alphabets import CLS, MAIN
from seqloom.functions.columns import lit_array
from seqloom.plans.shipping import ship_package

#: Targets that are never supervised, and the highest loss of a position.
UNSUPERVISED, CLAMP = (24, 26, 27), 20.0
#: Token ids no prediction may have, and what the variants forbid besides.
FORBIDDEN = (20, 21, 22, 23, 24, 26, CLS)
FORBIDDEN_MORE = {"gap": (MAIN.gap,), "stop": (MAIN.stop,), "residues": tuple(range(20))}


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top)))


def log_softmax_at(logits: Column, target: Column) -> Column:
    """Log-probability of one token of a logits array."""
    return F.get(logits, target.cast("int")).cast("double") - log_sum_exp(logits)


def first_half(logits: Column) -> Column:
    return F.slice(logits, F.lit(1), F.floor(F.size(logits) / 2).cast("int"))


def next_token_shift(df: DataFrame, by: str, pos: str, target: str = "target") -> DataFrame:
    """Logits at t beside the target at t + 1; a sequence's last position goes."""
    following = F.lead(target).over(Window.partitionBy(by).orderBy(pos))
    return df.withColumn("next_target", following).filter("next_target IS NOT NULL")


def sequence_log_likelihood(df: DataFrame, by: str, logits: Column, target: Column, missing: int = MAIN.missing) -> DataFrame:
    """(by, loglik): sum of the targets' log-probabilities; masked targets count 0."""
    each = F.when(target == missing, F.lit(0.0)).otherwise(log_softmax_at(logits, target))
    return df.groupBy(by).agg(F.sum(each).alias("loglik"))


def gap_to_query(logits: Column, query: Column, gap: int = MAIN.gap) -> Column:
    """Log-probabilities in which the query's token also takes the gap's share, and gaps none."""
    total = log_sum_exp(logits)
    logp = F.transform(logits, lambda v: v.cast("double") - total)
    own = lambda v, i: F.when(i == query, v + F.log1p(F.exp(F.get(logp, F.lit(gap)) - v))).otherwise(v)
    return F.transform(logp, lambda v, i: F.when(i == gap, F.lit(float("-inf"))).otherwise(own(v, i)))


def loss_mask(target: Column, base: Column | None = None) -> Column:
    mask = ~target.isin(*UNSUPERVISED)
    return mask if base is None else base & mask


def bad_targets(df: DataFrame, target: str, size: int, missing: int = MAIN.missing) -> DataFrame:
    """Rows with a target that is neither the mask nor a token."""
    return df.filter((F.col(target) != missing) & ((F.col(target) < 0) | (F.col(target) >= size)))


def assert_targets(df: DataFrame, target: str, size: int, missing: int = MAIN.missing) -> DataFrame:
    """``df``, which raises when a row with a target that is neither the mask nor a token is reached."""
    bad = (F.col(target) != missing) & ((F.col(target) < 0) | (F.col(target) >= size))
    kind = df.schema[target].dataType
    wrong = F.raise_error(F.concat(F.lit("target out of range: "), F.col(target).cast("string"))).cast(kind)
    return df.withColumn(target, F.when(bad, wrong).otherwise(F.col(target)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Loss of a position, clamped."""
    return F.least(-log_softmax_at(logits, target), F.lit(CLAMP))


def masked_cross_entropy(df: DataFrame, logits: Column, target: Column, mask: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., loss, n): mean loss over the mask, at least one position counted; no mask: plain mean."""
    ce = cross_entropy(logits, target)
    if mask is None:
        return df.groupBy(*(by or [])).agg(F.avg(ce).alias("loss"), F.count("*").alias("n"))
    m = mask.cast("double")
    return df.groupBy(*(by or [])).agg((F.sum(ce * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("loss"), F.sum(mask.cast("bigint")).alias("n"))


def total_loss(losses: list[Column]) -> Column:
    out = losses[0]
    for loss in losses[1:]:
        out = out + loss
    return out


def mix_next_token(df: DataFrame, by: list[str], prompt_logp: Column, logp: Column, weight: Column | None = None, method: str = "arithmetic") -> DataFrame:
    """Next-token log-probabilities over prompts: (by..., mixed).

    ``df``: a row for each prompt and token. "arithmetic": the log of the weighted mean of
    probabilities, weights normalised; "geometric": the weighted sum of logarithms, given weights
    as they are. Without weights every prompt weighs the same.
    """
    if method not in ("arithmetic", "geometric"):
        raise ValueError(f"unknown method {method}")
    rows = df.withColumns({"__p": prompt_logp, "__v": prompt_logp + logp})
    if weight is None:
        share = F.lit(1.0) / F.count("*").over(Window.partitionBy(*by))
    elif method == "arithmetic":
        share = weight / F.sum(weight).over(Window.partitionBy(*by))
    else:
        share = weight
    rows = rows.withColumn("__w", share)
    if method == "geometric":
        return rows.groupBy(*by).agg((F.sum(F.col("__w") * F.col("__v")) - F.sum(F.col("__w") * F.col("__p"))).alias("mixed"))
    rows = rows.withColumns({"__v": F.col("__v") + F.ln("__w"), "__p": F.col("__p") + F.ln("__w")})
    tops = rows.groupBy(*by).agg(F.max("__v").alias("__tv"), F.max("__p").alias("__tp"))
    summed = rows.join(tops, by).groupBy(*by, "__tv", "__tp").agg(F.sum(F.exp(F.col("__v") - F.col("__tv"))).alias("v"), F.sum(F.exp(F.col("__p") - F.col("__tp"))).alias("p"))
    return summed.select(*by, (F.col("__tv") + F.ln("v") - F.col("__tp") - F.ln("p")).alias("mixed"))


def valid_token_mask(logits: Column, forbid: tuple[str, ...] = ()) -> Column:
    """Logits with the forbidden tokens at minus infinity."""
    bad = sorted({*FORBIDDEN, *(t for f in forbid for t in FORBIDDEN_MORE[f])})
    table = lit_array(bad)
    return F.transform(logits, lambda v, i: F.when(F.array_contains(table, i), F.lit(float("-inf"))).otherwise(v.cast("double")))


def filter_tokens(df: DataFrame, by: list[str], token: str, logit: Column, temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0) -> DataFrame:
    """(by..., token, probability) of the tokens that stay, renormalised.

    ``df``: a row for each token. The logits are scaled by the temperature; ``top_k`` most likely
    tokens stay (0: all), then of those the shortest prefix whose mass reaches ``top_p``. Ties go by token.
    """
    order = Window.partitionBy(*by).orderBy(F.col("__l").desc(), F.col(token))
    whole = Window.partitionBy(*by)
    rows = df.withColumn("__l", logit.cast("double") / temperature).withColumn("__rank", F.row_number().over(order))
    if top_k:
        rows = rows.filter(F.col("__rank") <= top_k)
    rows = rows.withColumn("__e", F.exp(F.col("__l") - F.max("__l").over(whole))).withColumn("__p", F.col("__e") / F.sum("__e").over(whole))
    before = F.coalesce(F.sum("__p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("__before", before).filter(F.col("__before") < top_p)
    return rows.select(*by, token, (F.col("__p") / F.sum("__p").over(whole)).alias("probability"))


def worst_tokens(df: DataFrame, loss: Column, supervised: Column, k: int = 10, tie: list[str] | None = None) -> DataFrame:
    """The k supervised positions of the highest finite positive loss."""
    rows = df.withColumn("loss", loss).filter(supervised & (F.col("loss") > 0) & (F.col("loss") < float("inf")))
    return rows.orderBy(F.col("loss").desc(), *(tie or [])).limit(k)


def ensemble_mean(scores: DataFrame, variant: str = "variant_id", score: str = "logp") -> DataFrame:
    """(variant, score): the mean over prompts, as float."""
    return scores.groupBy(variant).agg(F.avg(score).cast("float").alias("score"))


def wt_delta(scores: DataFrame, wild_type: Column, variant: str = "variant_id", score: str = "score") -> DataFrame:
    """Scores less the wild type's, whose row goes. ``wild_type`` is true for that one row."""
    base = scores.filter(wild_type).agg(F.max(score).alias("__wt"))
    return scores.filter(~wild_type).crossJoin(F.broadcast(base)).select(variant, (F.col(score) - F.col("__wt")).alias("delta"))


def append_wt(variants: DataFrame, wild_type: DataFrame) -> DataFrame:
    """Variants and, after them, the wild type, flagged ``is_wt``; ``ord`` keeps the file's order."""
    last = variants.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("ord"))
    row = wild_type.drop("ord").crossJoin(F.broadcast(last)).withColumn("is_wt", F.lit(True))
    return variants.withColumn("is_wt", F.lit(False)).unionByName(row.select(*variants.columns, "is_wt"))


def with_structure_or_fallback(prompt: DataFrame, structures: DataFrame, name: str = "name", fields: list[str] | None = None) -> DataFrame:
    """Each protein replaced by its structured version, by name; others stay as they are.

    A structured version replaces the whole protein, so its sequence may have another length.
    """
    fields = fields or [c for c in structures.columns if c != name]
    other = structures.select(name, F.struct(*fields).alias("__s"))
    joined = prompt.join(other, name, "left")
    return joined.select(*[F.when(F.col("__s").isNotNull(), F.col("__s")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in prompt.columns], F.col("__s").isNotNull().alias("has_structure"))


def score_with(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], out: str = "logp", batch: int = 128, length: str | None = None, tokens: int = 1 << 15) -> DataFrame:
    """Adds a score by a user's function, called on slices of at most ``batch`` rows.

    The function gets the rows as pandas and returns one float for each; models are the user's. With
    ``length``, a column of lengths, rows are dealt and sorted by it, and a slice also holds no more than
    ``tokens`` when all its rows are padded to its longest (one row at least), so that little is padding.
    """
    ship_package(df.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` float"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = 0
            while at < rows.num_rows:
                size = batch
                if length is not None:
                    longest = np.maximum.accumulate(rows[length].slice(at, batch).to_pandas().fillna(0).to_numpy())
                    size = max(1, int((longest * np.arange(1, len(longest) + 1) <= tokens).sum()))
                part = rows.slice(at, size)
                # only this slice becomes Python objects, and its columns go on as they came
                values = pd.Series(score(part.to_pandas())).to_numpy(dtype="float32")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float32(), from_pandas=True)], names=[*rows.schema.names, out])
                at += size

    dealt = df if length is None else df.repartitionByRange(length).sortWithinPartitions(length)
    return dealt.mapInArrow(run, schema)
