"""From documents to a chunk store: splitting, small-to-big children, enrichment, keys, replacement by file.

Chunks: kb_name, file, seq, chunk_id, parent_id, source, content, metadata map<string,string>.
A file's chunks stay an array in one row until merging is done, then explode once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.columns import chunk_id, extension, in_order, joined, without_extension
from kbspark.functions.text import merge_small, split_characters
from kbspark.functions.text import splitter as splitter_of
from kbspark.sources.io import stored

#: One table holds the files of all bases, and two bases may have files of one name.
FILE, SOURCE = ("kb_name", "file"), ("kb_name", "source")
KNOWN_FIELDS = ("id", "parent_id", "multi_vector_type", "source", "filename", "knowledge_path")


def array_udf(split: Callable[[str], list[str]]) -> Callable:
    """A pandas UDF text -> array<string>; null gives an empty array."""

    @F.pandas_udf("array<string>")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([split(t) if t else [] for t in batch], dtype=object)

    return udf


def split_texts(docs: DataFrame, text: str = "text", splitter: str = "recursive", least: int | None = None, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """`docs` without the text, a row per chunk: seq and content; least: merge small chunks of a file."""
    options = {k: v for k, v in (("size", size), ("overlap", overlap)) if v is not None}
    base = splitter_of(splitter)

    def split(t: str) -> list[str]:
        parts = base(t, **options)
        return merge_small(parts, least) if least else parts

    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(array_udf(split)(F.col(text))).alias("seq", "content"))


#: Chunks of a file that are looked at together where small ones are merged.
MERGE_PART = 4096


def merge_steps(lengths: list[int], states: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What a run of chunks does to a file that is being merged: (state behind it, chunks begun in it) for each state before it.

    State 0: the next chunk begins a new one; 1 + n: the last one has n characters and takes in the next.
    """
    begun = np.zeros(len(states), np.int64)
    for n in lengths:
        free = states == 0
        begun += free
        grown = np.where(states + n < 2 * least, states + 1 + n, 0)
        states = np.where(free, 1 + n if n < least else 0, grown)
    return states, begun


def merge_small_chunks(chunks: DataFrame, by: tuple[str, ...] = FILE, seq: str = "seq", content: str = "content", least: int = 80, part: int = MERGE_PART) -> DataFrame:
    """(by, seq, content) of every group's merged chunks, by the rule of `merge_small`. A group is one file's chunks.

    A file is looked at in parts of `part` places. What a part does hangs on the few states that the parts before it can
    leave, so all parts work at once: each gives its table of states, a file's tables are chained, and then each
    chunk knows the one that it goes to. So no file has to fit a row or a task.
    """
    place = F.floor(F.col(seq) / part).alias("__part")
    head = chunks.groupBy(*by).agg(F.min(F.floor(F.col(seq) / part)).alias("__first"))
    parts = chunks.select(*by, place, F.struct(F.col(seq).cast("long").alias("seq"), F.col(content).alias("text")).alias("x")).groupBy(*by, "__part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    same = reduce(lambda a, b: a & b, [parts[c].eqNullSafe(head[c]) for c in by])
    parts = stored(parts.join(head, same).select(*[parts[c] for c in by], "__part", "xs", (F.col("__part") == F.col("__first")).alias("opens")), "merge-parts")

    @F.pandas_udf("struct<states:array<int>,begun:array<long>>")
    def table(lengths: pd.Series, opens: pd.Series) -> pd.DataFrame:
        found = [merge_steps([min(n, 2 * least) for n in own], np.zeros(1, np.int64) if first else np.arange(2 * least + 1), least) for own, first in zip(lengths, opens, strict=True)]
        return pd.DataFrame([(s.astype(np.int32), g) for s, g in found], columns=["states", "begun"])

    sizes = F.transform("xs", lambda x: F.char_length(x["text"]))
    tables = parts.select(*by, "__part", table(sizes, "opens").alias("t")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__part", "t"))).alias("ts"))
    # along the parts of a file: the state and the number of chunks begun before each one
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("begun"), F.array().cast("array<struct<part:bigint,state:int,begun:bigint>>").alias("seen"))
    step = lambda a, x: F.struct(
        F.get(x["t"]["states"], a["state"]).alias("state"), (a["begun"] + F.get(x["t"]["begun"], a["state"])).alias("begun"),
        F.concat(a["seen"], F.array(F.struct(x["__part"].alias("part"), a["state"].alias("state"), a["begun"].alias("begun")))).alias("seen"),
    )
    chain = tables.select(*[F.col(c).alias(f"__{c}") for c in by], F.aggregate("ts", start, step).alias("c"))
    # a last one that is still small joins the one before
    short = (F.col("c.state") > 0) & (F.col("c.state") <= least) & (F.col("c.begun") > 1)
    chain = chain.select(*[f"__{c}" for c in by], F.when(short, F.col("c.begun") - 2).otherwise(F.col("c.begun") - 1).alias("most"), F.inline("c.seen"))
    same = reduce(lambda a, b: a & b, [parts[c].eqNullSafe(chain[f"__{c}"]) for c in by])

    @F.pandas_udf("array<long>")
    def places(lengths: pd.Series, states: pd.Series, begun: pd.Series) -> pd.Series:
        out = []
        for own, state, n in zip(lengths, states, begun, strict=True):
            at, mine = int(n) - 1, []
            for size in own:
                at += state == 0
                mine.append(at)
                state = (1 + size if size < least else 0) if state == 0 else (state + 1 + size if state + size < 2 * least else 0)
            out.append(mine)
        return pd.Series(out, dtype=object)

    placed = parts.join(chain, same & (parts["__part"] == chain["part"])).select(*[parts[c] for c in by], "xs", "most", places(sizes, "state", "begun").alias("at"))
    rows = placed.select(*by, "most", F.explode(F.arrays_zip("at", "xs")).alias("x")).select(*by, F.least("x.at", "most").cast("int").alias("__seq"), F.col("x.xs.seq").alias("__at"), F.col("x.xs.text").alias("__text"))
    return rows.groupBy(*by, F.col("__seq").alias("seq")).agg(joined(in_order("__at", "__text"), "\n").alias("content")).select(*by, "seq", "content")


def small_to_big(chunks: DataFrame, size: int) -> DataFrame:
    """Children of every chunk, with the parent's id; none if size is 0."""
    children = array_udf(lambda t: split_characters(t, size, 0) if size else [])
    return chunks.select(
        "kb_name", "file", F.col("chunk_id").alias("parent_id"), F.posexplode(children("content")).alias("seq", "content"), F.lit("text small-to-big").alias("multi_vector_type")
    ).withColumn("chunk_id", chunk_id("parent_id", F.lit("child"), "seq", "content"))


def summary_rows(chunks: DataFrame, generated: Column, kind: str = "text summary") -> DataFrame:
    """A row per chunk with a generated text (column of the caller's model output), linked to it."""
    return chunks.select("kb_name", "file", F.col("chunk_id").alias("parent_id"), "seq", generated.alias("content"), F.lit(kind).alias("multi_vector_type")).withColumn(
        "chunk_id", chunk_id("parent_id", F.lit(kind), "seq", "content")
    )


def chunk_corpus(corpus: DataFrame, splitter: str = "recursive", least: int | None = 80, smaller_size: int = 0, whole: tuple[str, ...] = (".pptx",)) -> DataFrame:
    """corpus (kb_name, file, text) -> chunks with ids, and children if smaller_size is given. Files of `whole` are not split."""
    base = splitter_of(splitter)
    split = array_udf(lambda t: merge_small(base(t), least) if least else base(t))
    parts = F.when(extension("file").isin(*whole), F.array("text")).otherwise(split("text"))
    big = corpus.select("kb_name", "file", F.posexplode(parts).alias("seq", "content")).withColumns(
        {"parent_id": F.lit(None).cast("string"), "multi_vector_type": F.lit(None).cast("string"), "chunk_id": chunk_id("kb_name", "file", F.lit("text"), "seq", "content")}
    )
    return big.unionByName(small_to_big(big, smaller_size)) if smaller_size else big


def enrich_chunks(chunks: DataFrame, path: str | None = "knowledge_path", context: str | None = None) -> DataFrame:
    """Content with the knowledge path, then the file name, then a generated context put in front."""
    content = F.col("content")
    if path:
        content = F.when(F.coalesce(F.col(path), F.lit("")) != "", F.concat(F.col(path), F.lit(": \n"), content)).otherwise(content)
    content = F.concat(without_extension("file"), F.lit(": \n"), content)
    if context:
        content = F.when(F.col(context).isNotNull(), F.concat(F.col(context), F.lit(":"), content)).otherwise(content)
    return chunks.withColumn("content", content)


def source_ids(files: DataFrame, file: str = "file") -> DataFrame:
    return files.withColumn("source", F.md5(file))


def normalize_metadata(chunks: DataFrame, metadata: str = "metadata", file: str = "file", fields: tuple[str, ...] = KNOWN_FIELDS, drop: tuple[str, ...] = ("text", "vector")) -> DataFrame:
    """Metadata as strings with source and file name added, known fields defaulting to '', text and vector left out."""
    defaults = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.lit("")] * len(fields)))
    given = F.map_filter(F.transform_values(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v.cast("string"), F.lit(""))), lambda k, v: ~k.isin(*drop, "source", "filename"))
    keys = F.array_distinct(F.concat(F.map_keys(defaults), F.map_keys(given)))
    merged = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.coalesce(F.when(k == "source", F.md5(file)).when(k == "filename", F.col(file)), F.try_element_at(given, k), F.lit("")))))
    return chunks.withColumn(metadata, merged)


def upsert_chunks(store: DataFrame, new: DataFrame, key: tuple[str, ...] = SOURCE) -> DataFrame:
    """The store after all chunks of the files in `new` are replaced; a file of the same name in another base stays."""
    return delete_chunks(store, new, key).unionByName(new)


def delete_chunks(store: DataFrame, files: DataFrame, key: tuple[str, ...] = SOURCE) -> DataFrame:
    """The store without the chunks of these files."""
    return store.join(files.select(*key).distinct(), list(key), "left_anti")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write by knowledge base; only partitions that occur are replaced. Write to another path than `chunks` is read from."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_name").parquet(path)


def neighbor_context(chunks: DataFrame, by: tuple[str, ...] = FILE, seq: str = "seq", content: str = "content", reach: int = 2) -> DataFrame:
    """Text of the chunks around each one, itself included, joined by a blank line."""
    around = Window.partitionBy(*by).orderBy(seq).rowsBetween(-reach, reach)
    return chunks.withColumn("context", F.array_join(F.collect_list(content).over(around), "\n\n"))


def dump_chunks(chunks: DataFrame, by: str = "file", seq: str = "seq", content: str = "content") -> DataFrame:
    """One text per file with numbered chunks, for inspection."""
    line = F.concat(F.lit("--- Chunk "), (F.col(seq) + 1).cast("string"), F.lit(" ---\n"), F.col(content))
    return chunks.groupBy(by).agg(joined(in_order(seq, line), "\n").alias("dump"))


def dispatch_loader(files: DataFrame, mapping: DataFrame, file: str = "file", default: str = "generic") -> DataFrame:
    """Loader of each file by its lower-case extension; mapping (ext, loader) is a small registry."""
    return files.withColumn("ext", extension(file)).join(F.broadcast(mapping), "ext", "left").withColumn("loader", F.coalesce("loader", F.lit(default)))
