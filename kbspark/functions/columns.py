"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a sentence, closing quotes, opening quotes.
ENDS, CLOSERS, OPENERS = "﹒﹔﹖﹗．。！？", '"」』', '"「『'


def sentence_pattern() -> str:
    """Places between sentences: behind an end and up to two closing quotes, unless the next sentence would begin with an end or an opening quote, or be a lone line feed."""
    ends, closers, glued = f"[{ENDS}]", f"[{CLOSERS}]", f"[{ENDS}{OPENERS}]"
    guard = rf"(?!{glued})(?!\n(?:{glued}|\n?\z))"
    return "|".join(f"(?<={ends}{closers}{{{n}}})(?!{closers}){guard}" if n < 2 else f"(?<={ends}{closers}{{2}}){guard}" for n in range(3))


def sentences(text: Column | str, pdf: bool = False) -> Column:
    """Array of sentences, blanks dropped; pdf: runs of line feeds become one, white space becomes blanks."""
    text = F.col(text) if isinstance(text, str) else text
    if pdf:
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n"), r"(?U)\s", " "), "\n\n", "")
    return F.filter(F.split(text, sentence_pattern(), -1), lambda s: F.trim(s) != "")


def joined(parts: Column, separator: str) -> Column:
    """Text of an array of (order, text) structs, in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), separator)


def in_order(order, text) -> Column:
    """Aggregate: (order, text) structs of a group, for `joined`. collect_list alone keeps no order after a shuffle."""
    return F.collect_list(F.struct(F.col(order).alias("order") if isinstance(order, str) else order.alias("order"), (F.col(text) if isinstance(text, str) else text).alias("text")))


def without_extension(file: Column | str) -> Column:
    return F.regexp_replace(file, r"\.[^./]*$", "")


def extension(file: Column | str) -> Column:
    return F.lower(F.regexp_extract(file, r"(\.[^./]+)$", 1))


def chunk_id(*parts: Column | str) -> Column:
    """A deterministic id, the same when a task is repeated."""
    return F.sha2(F.concat_ws("\u0001", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)
