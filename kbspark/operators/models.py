"""Runners of the caller's models, and registries of loaders and splitters.

A model is a function over a batch; give a factory so that it is made once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.columns import extension
from kbspark.functions.text import SPLITTERS, splitter

#: Loaders by extension: bytes -> list of texts.
LOADERS: dict[str, Callable[[bytes], list[str]]] = {}


def register_loader(ext: str, load: Callable[[bytes], list[str]]) -> None:
    LOADERS[ext.lower()] = load


def plain_text(content: bytes) -> list[str]:
    return [content.decode("utf-8", "replace")]


def load_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Texts of binary files by the registered loaders, others as plain text; a failure sets the row aside with its error."""
    known = dict(LOADERS)

    @F.pandas_udf("struct<texts:array<string>,error:string>")
    def load(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for exts, contents in columns:
            rows = []
            for ext, data in zip(exts, contents, strict=True):
                try:
                    rows.append((known.get(ext, plain_text)(bytes(data)), None))
                except Exception as e:  # one bad file must not end the job
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["texts", "error"])

    return files.withColumn("loaded", load(extension(path), F.col(content))).select(*[c for c in files.columns if c != content], "loaded.texts", "loaded.error")


def budget_batches(sizes: list[int], most: int, budget: int) -> list[list[int]]:
    """Places of the rows by batch: rows of like size together, `most` of them at most, and (number of rows) * (largest size) within the budget; a larger row is alone."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * sizes[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def in_batches(texts: list[str], call: Callable[[list[str]], list], most: int, budget: int) -> list:
    """Results of a batch function in the order of the texts, which it gets sorted by length, so that little is padded."""
    out: list = [None] * len(texts)
    for places in budget_batches([len(t) for t in texts], most, budget):
        for i, x in zip(places, call([texts[i] for i in places]), strict=True):
            out[i] = x
    return out


#: Characters of a padded batch.
BUDGET = 65_536


def generate(prompts: DataFrame, make_model: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", into: str = "answer", batch_size: int = 16, budget: int = BUDGET) -> DataFrame:
    """Answers of a text model; where a batch fails its rows are tried alone, and a failed one gets null and an error. A missing prompt is empty."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def call(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def safe(some: list[str]) -> list[tuple]:
            try:
                return [(a, None) for a in model(some)]
            except Exception as e:
                return [(None, f"{type(e).__name__}: {e}")] if len(some) == 1 else [x for t in some for x in safe([t])]

        for batch in texts:
            yield pd.DataFrame(in_batches([t or "" for t in batch], safe, batch_size, budget), columns=["answer", "error"])

    return prompts.withColumn("__out", call(prompt)).withColumns({into: F.col("__out.answer"), "error": F.col("__out.error")}).drop("__out")


def embed(rows: DataFrame, make_model: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "content", into: str = "embedding", prefix: str = "", normalize: bool = True, batch_size: int = 64, budget: int = BUDGET) -> DataFrame:
    """Vectors of a text column; prefix: the instruction put before queries. Repartition uneven inputs first."""

    @F.pandas_udf("array<float>")
    def call(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = make_model()

        def vectors(some: list[str]) -> list:
            found = np.asarray(model(some), np.float32)
            return list(found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12) if normalize else found)

        for batch in texts:
            yield pd.Series(in_batches([prefix + (t or "") for t in batch], vectors, batch_size, budget), dtype=object)

    return rows.withColumn(into, call(text))


def register_split_text(spark, name: str = "split_text") -> None:
    """A table function for SQL: split_text(text, splitter) -> (seq, chunk), for LATERAL joins; an unknown name cuts sentences."""
    from pyspark.sql.functions import udtf

    known, by_name = dict(SPLITTERS), splitter

    @udtf(returnType="seq int, chunk string")
    class SplitText:
        def eval(self, text: str, splitter: str):
            yield from enumerate((known.get(splitter) or by_name(splitter))(text) if text else [])

    spark.udtf.register(name, SplitText)
