"""Recognition engines behind one protocol: a page's image in, its text out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import markup
from docspark.operators import quality


class ContextOverflow(Exception):
    """The request doesn't fit; another try can't help."""


class Engine(Protocol):
    def read(self, image: bytes, instruction: str) -> str: ...


class FakeEngine:
    """Gives back the image's bytes as text; for tests and dry runs."""

    def read(self, image: bytes, instruction: str) -> str:
        return image.decode("utf-8")


#: Added to a second attempt by what the first lacked.
HINTS = {"missing_vietnamese_diacritics": "Keep every diacritic.", "repetition_loop": "Write each line once.", "repeated_words": "Write each line once."}


def attempt(read: Callable[[], str], tries: int = 3, pause: float = 2.0) -> tuple[str | None, str | None]:
    """(text, error) of up to `tries` calls, `pause` seconds apart; an overflow ends them."""
    error = None
    for k in range(tries):
        try:
            return read(), None
        except ContextOverflow as e:
            return None, str(e)
        except Exception as e:  # noqa: BLE001  the page's error is data
            error = str(e)
            if k + 1 < tries:
                time.sleep(pause)
    return None, error


def recognise(pages: DataFrame, make: Callable[[], Engine], keys: list[str], image: str = "content", tries: int = 3, pause: float = 2.0) -> DataFrame:
    """keys, text, error: one request a page, one engine for each Python worker.

    pages may have an `instruction`. A page that fails has a null text and its
    error. The engine may not be deterministic: write the result before it is
    read twice.
    """
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "text string, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            found = [attempt(lambda i=i, s=s: engine.read(i, s), tries, pause) for i, s in zip(batch[image], batch["instruction"], strict=True)]
            out = batch[keys].copy()
            out["text"], out["error"] = [f[0] for f in found], [f[1] for f in found]
            yield out

    with_hint = pages if "instruction" in pages.columns else pages.withColumn("instruction", F.lit(""))
    return with_hint.select(*keys, image, "instruction").mapInPandas(run, schema)


def instruction(errors: Column) -> Column:
    """Hints for a second attempt at a page with these errors."""
    kinds = F.transform(errors, quality.kind)
    return F.concat_ws(" ", F.array_distinct(F.array_compact(F.array(*(F.when(F.array_contains(kinds, k), h) for k, h in HINTS.items())))))


def read_twice(pages: DataFrame, make: Callable[[], Engine], keys: list[str], keep: Callable[[DataFrame], DataFrame], image: str = "content") -> DataFrame:
    """The better of two attempts for pages whose first should be retried; keep writes a frame and reads it back."""
    first = keep(recognise(pages, make, keys, image))
    judged = keep(quality.report(first.withColumn("text", markup.clean_response(F.col("text")))).withColumn("attempt", F.lit(1)))
    again = judged.where("should_retry").select(*keys, instruction(F.col("errors")).alias("instruction"))
    second = keep(recognise(pages.drop("instruction").join(again, keys), make, keys, image))
    both = judged.unionByName(quality.report(second.withColumn("text", markup.clean_response(F.col("text")))).withColumn("attempt", F.lit(2)))
    return quality.choose_best(both, keys, "attempt")
