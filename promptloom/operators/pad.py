"""Batch padding (A14) and label masking around it (F16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LABEL_IGNORE_ID, PAD_ID


def _round_up(n: Column, multiple: int | None) -> Column:
    if not multiple:
        return n
    return (F.ceil(n / F.lit(multiple)) * F.lit(multiple)).cast("int")


def pad_batch(df: DataFrame, batch_col: str, *, ids_col: str = "input_ids",
              labels_col: str | None = None, pad_id: int = PAD_ID,
              label_pad_id: int = LABEL_IGNORE_ID, pad_to_multiple_of: int | None = None) -> DataFrame:
    """Pad every row of a batch to the longest row of that batch.

    Adds ``attention_mask``; ids are padded with ``pad_id`` and labels with
    ``label_pad_id``.  A batch is a bounded group (its batch size), so the
    window over it never grows with the data."""
    w = Window.partitionBy(batch_col)
    target = _round_up(F.max(F.size(ids_col)).over(w), pad_to_multiple_of)
    out = df.withColumn("_len", target)
    n_pad = F.col("_len") - F.size(ids_col)
    out = (out.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids_col)),
                                                     F.array_repeat(F.lit(0), n_pad)))
           .withColumn(ids_col, F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id), n_pad))))
    if labels_col:
        lw = _round_up(F.max(F.size(labels_col)).over(w), pad_to_multiple_of)
        out = out.withColumn("_llen", lw).withColumn(
            labels_col, F.concat(F.col(labels_col),
                                 F.array_repeat(F.lit(label_pad_id), F.col("_llen") - F.size(labels_col))))
        out = out.drop("_llen")
    return out.drop("_len")
