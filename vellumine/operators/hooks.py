"""Pluggable functions over rows: readers of page images, translators, reviewers.

A hook maps a text to a text in Python and runs in Arrow batches. Rows that need no work do not reach it; a row on
which it fails keeps its text and carries the error, after a bounded number of tries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIES = 2


def apply_hook(df: DataFrame, key: str, text: str, hook: Callable[[str], str], needed: Column | None = None, valid: Callable[[str, str], bool] | None = None) -> DataFrame:
    """key, result, error. needed: rows outside it keep their text. valid: a result that it rejects counts as a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in b.itertuples(index=False):
                error = None
                for _ in range(TRIES):
                    try:
                        r = hook(t)
                        error = None if valid is None or valid(t, r) else "rejected"
                    except Exception as e:  # noqa: BLE001 - a failed row is a row
                        r, error = t, f"{type(e).__name__}: {e}"[:200]
                    if error is None:
                        break
                rows.append((k, t if error else r, error))
            yield pd.DataFrame(rows, columns=["k", "result", "error"])

    kind = dict(df.dtypes)[key]
    todo = F.coalesce(F.col(text).isNotNull() & (needed if needed is not None else F.lit(True)), F.lit(False))
    done = df.where(todo).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, result string, error string")
    rest = df.where(~todo).select(F.col(key).alias("k"), F.col(text).alias("result"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(rest).withColumnRenamed("k", key)


def _numbered(pieces: Column, mark: str) -> Column:
    """Pieces put together with numbered marks between them."""
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(mark), (i - 1).cast("string"), F.lit(mark), p))), "")


def protect(text: Column, pattern: str, mark: str = "\ue000") -> tuple[Column, Column]:
    """The text with every match replaced by a numbered mark, and the array of matches; restore() puts them back."""
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, f"(?:{pattern})")
    marked = _numbered(pieces, mark)
    return F.when(F.size(values) == 0, text).otherwise(marked), values


def restore(text: Column, values: Column, mark: str = "\ue000") -> Column:
    """The text with its numbered marks replaced; null where a mark is lost, repeated or unknown."""
    seen = F.regexp_extract_all(text, F.lit(f"{mark}([0-9]+){mark}"), F.lit(1))
    whole = F.array_sort(F.transform(seen, lambda x: x.cast("int"))) == F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    filled = F.aggregate(F.sequence(F.lit(0), F.size(values)), text, lambda s, i: F.when(i < F.size(values), F.replace(s, F.concat(F.lit(mark), i.cast("string"), F.lit(mark)), F.get(values, i))).otherwise(s))
    return F.when(whole, F.when(F.size(values) == 0, text).otherwise(filled))


def protect_terms(text: Column, terms: Column, mark: str = "\ue000") -> tuple[Column, Column]:
    """As protect, for terms given as an array of plain texts, as whole words and the longest first."""
    from .consensus import whole_words

    held = F.array_sort(F.transform(whole_words(text, terms), lambda t: F.named_struct(F.lit("a"), -F.length(t), F.lit("t"), t)))
    quoted = F.transform(held, lambda x: F.concat(F.lit("\\Q"), x["t"], F.lit("\\E")))
    pattern = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}_])("), F.array_join(quoted, "|"), F.lit(")(?![\\p{L}\\p{N}_])"))
    values = F.when(F.size(held) > 0, F.regexp_extract_all(text, pattern, F.lit(1))).otherwise(F.array().cast("array<string>"))
    pieces = F.split(text, F.when(F.size(held) > 0, pattern).otherwise(F.lit("(?!)")))
    marked = _numbered(pieces, mark)
    return F.when(F.size(values) == 0, text).otherwise(marked), values
