"""Which symbols fit which LIKE patterns, any case, without trying every pair.

A symbol is posted under the pieces of one to three characters that it holds, its ends marked. A pattern's literal parts
hold such pieces as well; those symbols that are posted under its rarest one are candidates, and LIKE verifies them. A
pattern without any literal part is posted under the empty piece, which all symbols hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mark the ends of a symbol; no symbol holds them.
START, END = "\x02", "\x03"
LONGEST = 3


def _pieces(c: Column, n: int) -> Column:
    """array of all pieces of n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def symbol_grams(symbol: Column) -> Column:
    """array of the pieces under which a symbol is posted."""
    whole = F.concat(F.lit(START * 2), F.lower(symbol), F.lit(END * 2))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(whole, n) for n in range(1, LONGEST + 1)]))


def pattern_grams(pattern: Column) -> Column:
    """array of pieces that every symbol which fits the pattern holds, of LONGEST characters where its literal parts allow."""
    parts = F.split(F.lower(pattern), "%", -1)
    last = F.size(parts) - 1
    ended = F.transform(parts, lambda p, i: F.concat(F.when((i == 0) & (p != ""), F.lit(START * 2)).otherwise(""), p, F.when((i == last) & (p != ""), F.lit(END * 2)).otherwise("")))
    literal = F.filter(F.flatten(F.transform(ended, lambda p: F.split(p, "_", -1))), lambda p: p != "")  # _ stands for any character
    grams = F.flatten(F.transform(literal, lambda p: F.when(F.length(p) >= LONGEST, _pieces(p, LONGEST)).otherwise(F.array(p))))
    escaped = F.contains(pattern, F.lit("\\"))
    return F.when(escaped | (F.size(grams) == 0), F.array(F.lit(""))).otherwise(F.array_distinct(grams))


def ilike(symbols: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """Distinct column, name for patterns(name, pattern): the symbols that fit any pattern of a name, any case."""
    wanted = patterns.where("pattern IS NOT NULL").select("name", "pattern", F.explode(pattern_grams(F.col("pattern"))).alias("gram"))
    known = symbols.select(column).where(F.col(column).isNotNull()).distinct()
    posted = known.select(column, F.explode(symbol_grams(F.col(column))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    held = wanted.join(posted.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").na.fill(0, ["n"])
    rarest = held.groupBy("name", "pattern").agg(F.min(F.struct("n", "gram")).alias("r")).where("r.n > 0").select("name", "pattern", "r.gram")
    return posted.join(rarest, "gram").where(F.expr(f"{column} ILIKE pattern")).select(column, "name").distinct()
