"""Perplexity and prompt reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def perplexity(logp: DataFrame, keys, *, logp_col: str = "logp", mask_col: str | None = None,
               mask_pad: bool = False) -> DataFrame:
    """A4: ``exp(-(1/n) * sum log p)`` per key over a long-form table.

    n counts every position, padding included (the reference's rule);
    ``mask_pad`` counts and sums only positions whose mask is 1.
    """
    keys = list(keys)
    df = logp.where(F.col(mask_col) == 1) if (mask_pad and mask_col) else logp
    return df.groupBy(*keys).agg(
        F.exp(-F.avg(logp_col)).alias("ppl"))


def tail_perplexity(logp: DataFrame, keys, n_generated, *, pos_col: str = "pos",
                    logp_col: str = "logp") -> DataFrame:
    """A5: perplexity of the last ``n_generated`` positions only."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    n = n_generated if isinstance(n_generated, Column) else F.lit(n_generated)
    tail = (logp.withColumn("_n", F.max(pos_col).over(w) + 1)
            .where(F.col(pos_col) >= F.col("_n") - n).drop("_n"))
    return perplexity(tail, keys, logp_col=logp_col)


def array_perplexity(logps) -> Column:
    """A4 on an array of per-token log-probs, without any shuffle."""
    a = F.col(logps) if isinstance(logps, str) else logps
    total = F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
    return F.exp(-F.try_divide(total, F.size(a)))


def rerank(df: DataFrame, group_col: str, *, ppl_col: str = "ppl", pos_col: str) -> DataFrame:
    """L2: 1-based ``rank`` of every prompt inside its group, ascending
    perplexity, then position -- a distributed running count, so a group
    holding a third of all prompts is not sorted in one task."""
    from .ordered import positions
    return positions(df, [group_col], [ppl_col, pos_col], "rank", base=1).withColumn(
        "rank", F.col("rank").cast("int"))


def template_wins(df: DataFrame, group_col: str, template_col: str, *, ppl_col: str = "ppl",
                  pos_col: str) -> DataFrame:
    """A10: first places per template.  ``min_by`` per group is an aggregate with a
    partial step, so a group holding a third of all prompts is no single task."""
    best = (df.groupBy(group_col)
            .agg(F.min_by(F.col(template_col), F.struct(F.col(ppl_col), F.col(pos_col))).alias("_t")))
    return best.groupBy(F.col("_t").alias(template_col)).agg(F.count(F.lit(1)).alias("wins"))


def transpose_prompts(df: DataFrame, idx_col: str, template_col: str, input_col: str) -> DataFrame:
    """Prompts of one position across templates, ``array<struct<template, input>>``."""
    return df.groupBy(idx_col).agg(F.array_sort(F.collect_list(
        F.struct(F.col(template_col).alias("template"), F.col(input_col).alias("input")))).alias("prompts"))
