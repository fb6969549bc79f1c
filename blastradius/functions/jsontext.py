"""JSON in the answers of language models: found among other text, mended, and read.

An object is followed from its first brace to the one that closes it, by the running sum of the braces between. Backslashes
that start no escape of JSON (as in `\\s`) are doubled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may follow a backslash in a JSON string.
ESCAPE = r"""["\\/bfnrt]|u[0-9a-fA-F]{4}"""


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def closed(rest: Column) -> Column:
    """Of a text that starts with a brace what lies up to the brace that closes it; null if none does."""
    braces, between = F.regexp_extract_all(rest, F.lit("[{}]"), F.lit(0)), F.split(rest, "[{}]", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, brace: Column) -> Column:
        depth = acc["depth"] + F.when(brace == "{", 1).otherwise(-1)
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth == 0).alias("done")))

    found = F.aggregate(braces, start, step)
    length = lambda n: F.aggregate(F.slice(between, F.lit(1), n), F.lit(0), lambda s, p: s + F.length(p)) + n
    return _bind(found, lambda f: F.when(f["done"], F.substring(rest, 1, length(f["n"]))))


def _from(text: Column, opening: str) -> Column:
    """The object that starts at the first match of a pattern's group; null if there is none."""
    before = F.regexp_extract(text, rf"(?s)^(.*?)(?:{opening})", 1)
    return F.when(text.rlike(f"(?s){opening}"), _bind(F.substring(text, F.length(before) + 1, F.length(text)), lambda rest: closed(F.regexp_replace(rest, r"^[^{]*", ""))))


def extract_object(text: Column, key: str) -> Column:
    """The JSON object of an answer: in a code fence, else the one that names the key before any other brace, else the first;
    else the whole text."""
    return F.coalesce(_from(text, r"```(?:json)?\s*\{"), _from(text, rf'\{{[^{{}}]*"{key}"'), _from(text, r"\{"), F.trim(text))


def mend_escapes(json: Column) -> Column:
    return F.regexp_replace(json, rf"\G((?:[^\\]|\\(?:{ESCAPE}))*+)\\", r"$1\\\\")


def listed(text: Column, key: str = "variations") -> Column:
    """The strings under a key of an answer's object, without blank ones; an empty list where there is nothing to read."""
    rows = F.from_json(mend_escapes(extract_object(text, key)), f"`{key}` array<string>")[key]
    kept = F.filter(F.transform(rows, lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))
