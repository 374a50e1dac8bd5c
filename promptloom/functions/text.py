"""Column functions for prompt text and token arrays (all JVM-side expressions).

The default tokenizer splits on whitespace and maps a token to a stable id by
hashing (``3 + pmod(xxhash64(token), vocab_size - 3)``; ids 0, 1, 2 are pad,
EOS and unknown), so no vocabulary has to be built, shipped or joined.  Any
other tokenizer can be passed as a function ``Column -> Column`` (for
instance an Arrow ``pandas_udf`` wrapping a sub-word model).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values shared with the reference's tokenizer conventions
PAD_ID = 0
EOS_ID = 1
UNK_ID = 2
LABEL_IGNORE_ID = -100
NO_LABEL = "<NO LABEL>"
DEFAULT_VOCAB = 32100
# whitespace for word pieces, spelled out so every regex engine agrees
WS_SPLIT = r"[ \t\n\x0B\f\r]+"



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rstrip_newlines(col) -> Column:
    return F.rtrim(_c(col), F.lit("\n"))


def lstrip_newlines(col) -> Column:
    return F.ltrim(_c(col), F.lit("\n"))


def demo_text(inputs, targets) -> Column:
    """``input.rstrip('\\n') + '\\n' + target.lstrip('\\n')``."""
    return F.concat(rstrip_newlines(inputs), F.lit("\n"), lstrip_newlines(targets))


def strip_ws(col) -> Column:
    """Python ``str.strip()`` (Unicode whitespace on both ends)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def whitespace_tokens(col) -> Column:
    """Whitespace word pieces of a whole text; empty text -> empty array."""
    return F.array_remove(F.split(_c(col), WS_SPLIT), "")


def hashed_ids(tokens, vocab_size: int = DEFAULT_VOCAB) -> Column:
    return F.transform(_c(tokens), lambda t: (F.pmod(F.xxhash64(t), F.lit(vocab_size - 3))
                                              + F.lit(3)).cast("int"))


def tokenize(col, tokenizer: Callable[[Column], Column] | None = None,
             vocab_size: int = DEFAULT_VOCAB) -> Column:
    """text -> token ids.  ``tokenizer`` overrides the hashed whitespace default."""
    if tokenizer is not None:
        return tokenizer(_c(col))
    return hashed_ids(whitespace_tokens(col), vocab_size)


def truncate_left(arr, max_length: int, special: bool = False) -> Column:
    """keep the last ``max_length`` items; ``special`` keeps the first item
    plus the last ``max_length - 1``.  A fitting array is returned unchanged."""
    a = _c(arr)
    n = F.size(a)
    if not special:
        return F.slice(a, F.greatest(n - F.lit(max_length) + 1, F.lit(1)), F.lit(max_length))
    tail = F.slice(a, F.greatest(n - F.lit(max_length - 1) + 1, F.lit(2)), F.lit(max_length - 1))
    return F.when(n <= max_length, a).otherwise(F.concat(F.slice(a, 1, 1), tail))


def last_ids(col, max_length: int, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """the ids of the last ``max_length`` tokens; the default hashes no others."""
    if tokenizer is not None:
        return truncate_left(tokenize(col, tokenizer), max_length)
    return hashed_ids(truncate_left(whitespace_tokens(col), max_length))


def truncate_right(arr, max_length: int) -> Column:
    """F8: keep the first ``max_length`` items."""
    return F.slice(_c(arr), 1, max_length)


def append_eos(arr, eos_id: int = EOS_ID) -> Column:
    """EOS goes on targets only."""
    return F.array_append(_c(arr), F.lit(eos_id))


def mask_labels(arr, pad_id: int = PAD_ID, append_eos_id: int | None = None) -> Column:
    """F16: pad id -> -100; the training-data variant also appends EOS."""
    out = F.transform(_c(arr), lambda t: F.when(t == pad_id, F.lit(LABEL_IGNORE_ID)).otherwise(t))
    return F.array_append(out, F.lit(append_eos_id)) if append_eos_id is not None else out


def label_to_class(choices, label) -> Column:
    """0-based position of the stripped label in the choices, -1 if absent."""
    return (F.array_position(_c(choices), strip_ws(label)) - 1).cast("int")


def no_label(target) -> Column:
    """falsy target -> '<NO LABEL>'."""
    return F.coalesce(F.nullif(_c(target), F.lit("")), F.lit(NO_LABEL))
