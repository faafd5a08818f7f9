"""Names matched with a table of ILIKE patterns, by an index of pieces of six letters or fewer.

A name stands in the index with the pieces of its lower-case form, framed by marks of its ends; a pattern has the pieces
of its literal parts, framed where it begins or ends without a wildcard. All of a pattern's pieces stand in every name
that it matches, so the rarest one picks the candidates by an equi-join, and ILIKE confirms them. Six letters tell
numbered names apart, of which three leave a fixed share. Patterns without a piece of six letters are looked up by a piece of three, then of two and
of one, and patterns of wildcards alone by the length they ask for; only the sizes that occur among the patterns are indexed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.sources.io import stored

#: Marks of a name's beginning and end; characters that no name should hold.
BEGIN, END = "\x02", "\x03"
PIECES = (6, 3, 2, 1)
#: Counted bytes up to which patterns go to all tasks. The names' pieces never do: Spark reckons them by the file of
#: the names, a fraction of what they take, and would send them through the driver.
FEW_BYTES = 8 << 20


def framed(text: Column) -> Column:
    return F.concat(F.lit(BEGIN), text, F.lit(END))


def pieces(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters; none of a shorter text."""
    last = F.char_length(text) - (size - 1)
    return F.array_distinct(F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def literals(pattern: Column) -> Column:
    """The literal parts of a lower-case pattern: % and _ cut it, a backslash makes the next character literal."""
    # an escaped wildcard is no cut: it stands as a character of its own until the parts are made
    safe = F.replace(F.replace(F.replace(framed(pattern), F.lit("\\\\"), F.lit("\x04")), F.lit("\\%"), F.lit("\x05")), F.lit("\\_"), F.lit("\x06"))
    return F.transform(F.split(safe, "[%_]+"), lambda p: F.replace(F.replace(F.replace(p, F.lit("\x04"), F.lit("\\")), F.lit("\x05"), F.lit("%")), F.lit("\x06"), F.lit("_")))


def pattern_pieces(pattern: Column, size: int) -> Column:
    """Pieces that every match of a lower-case pattern holds, the end marks alone left out."""
    own = F.array_distinct(F.flatten(F.transform(literals(pattern), lambda p: pieces(p, size))))
    return F.filter(own, lambda p: ~p.isin(BEGIN, END, BEGIN + END))


def beside(patterns: DataFrame, counted_bytes: int) -> DataFrame:
    """The patterns as the side of a join that goes to all tasks if it is counted as small; else both sides are shuffled and sorted, whatever Spark reckons."""
    return F.broadcast(patterns) if counted_bytes <= FEW_BYTES else patterns.hint("merge")


def ilike_join(names: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """(pattern, name): every distinct pattern with the distinct names that it matches as ILIKE does. Null names and patterns match nothing.

    A pattern joins on its rarest piece, so what is confirmed is the shortest posting list that it has; the mark of a
    pattern's length serves those of wildcards alone: '%' has to give every name, however many there are.
    """
    known = stored(names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct(), "names")
    asked = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern")).distinct()
    lower = F.lower("pattern")
    sized = asked.withColumn("size", reduce(lambda rest, n: F.when(F.size(pattern_pieces(lower, n)) > 0, F.lit(n)).otherwise(rest), reversed(PIECES), F.lit(0)))
    sized = stored(sized, "patterns")
    found = []
    for row in sized.groupBy("size").agg(F.sum(F.octet_length("pattern") + 96).alias("bytes")).sort("size").collect():  # five sizes
        size, own = row["size"], sized.where(F.col("size") == row["size"])
        if size:
            index = known.select(F.explode(pieces(framed(F.lower("name")), size)).alias("piece"), "name")
            wanted = own.select("pattern", F.explode(pattern_pieces(lower, size)).alias("piece"))
            often = index.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("names"))
            # a pattern with a piece of no name matches nothing
            rarest = wanted.join(often, "piece", "left").groupBy("pattern").agg(F.min_by("piece", F.struct(F.coalesce("names", F.lit(0)), "piece")).alias("piece"))
            pairs = index.join(beside(rarest, row["bytes"]), "piece")
        else:
            # only wildcards: as many characters as it has _, or more if it has %
            least = F.char_length(F.replace("pattern", F.lit("%"), F.lit("")))
            wide = own.select("pattern", least.alias("length"), F.contains("pattern", F.lit("%")).alias("open"))
            longest = known.agg(F.coalesce(F.max(F.char_length("name")), F.lit(-1))).first()[0]
            longer = wide.where("open").where(F.col("length") <= longest).select("pattern", F.explode(F.sequence("length", F.lit(longest))).alias("length"))
            lengths = wide.where("NOT open").select("pattern", "length").unionByName(longer)
            pairs = known.withColumn("length", F.char_length("name")).join(beside(lengths, row["bytes"] * (longest + 2)), "length")
        found.append(pairs.where(F.expr("name ILIKE pattern")).select("pattern", "name"))
    return reduce(DataFrame.unionByName, found) if found else asked.select("pattern", F.col("pattern").alias("name")).limit(0)
