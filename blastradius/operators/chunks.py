"""A test file cut into pieces for a vector store: whole if it is small, else where tests and their helpers begin, with
pieces that are too large cut on, else at the last line end that fits. No character is lost and none comes twice.

Where the next piece begins depends on where the last one ended, which no built-in function expresses: a table function
carries it through a text and gives back offsets only, and the pieces are taken from the text in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import display_names

# Lines at which a piece may begin, by language (any case); and for all other languages.
BOUNDARIES = {
    "python": r"def[^\S\n]+test|class[^\S\n]+Test|@pytest",
    "javascript": r"(?:describe|it|test|beforeEach|afterEach|beforeAll|afterAll)[^\S\n]*\(",
    "typescript": r"(?:describe|it|test|beforeEach|afterEach|beforeAll|afterAll)[^\S\n]*\(",
    "java": r"@Test|public[^\S\n]+void[^\S\n]+test|@BeforeEach|@AfterEach",
}
OTHER = r"(?:function|def|public[^\S\n]+void)[^\S\n]+test"
MOST = 2000
SPANS = "chunk_no int, chunk_type string, start int, stop int, start_line int, end_line int"


def cuts(body: str, language: str | None, most: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, stop) of a text's pieces, one after the other."""
    if len(body) <= most:
        if body:
            yield "single", 0, len(body)
        return
    begins = re.compile(rf"(?mi)^[^\S\n]*(?:{BOUNDARIES.get(language or '', OTHER)})")
    marks = [m.start() for m in begins.finditer(body) if m.start() > 0]
    for lo, hi in zip([0, *marks], [*marks, len(body)], strict=True) if marks else ():
        kind = "method_boundary" if hi - lo <= most else "method_boundary_split"
        for start in range(lo, hi, most):
            yield kind, start, min(start + most, hi)
    start = len(body) if marks else 0
    while start < len(body):
        stop = min(start + most, len(body))
        line_end = body.rfind("\n", start + 1, stop) if stop < len(body) else -1
        stop = line_end + 1 if line_end > 0 else stop
        yield "character_split", start, stop
        start = stop


class Cutter:
    """The table function: offsets (from 0, in characters) and lines (from 1) of a text's pieces."""

    def eval(self, body: str, language: str, most: int) -> Iterator[tuple]:
        line = 1
        for no, (kind, start, stop) in enumerate(cuts(body or "", language, most)):
            last = line + body.count("\n", start, stop)
            yield no, kind, start, stop, line, last
            line = last


def chunk(files: DataFrame, most: int = MOST) -> DataFrame:
    """files(file_id, language, body, ...) -> file_id, chunk_no, chunk_type, content, start_line, end_line, method_name,
    class_name. Files without text give none."""
    cutter = F.udtf(Cutter, returnType=SPANS)
    rows = files.select("file_id", "language", "body").lateralJoin(cutter(F.col("body").outer(), F.col("language").outer(), F.lit(most)))
    rows = rows.withColumn("content", F.substring("body", F.col("start") + 1, F.col("stop") - F.col("start")))
    names = display_names(F.col("content"), F.coalesce("language", F.lit("")))
    rows = rows.withColumn("n", names).select("file_id", "chunk_no", "chunk_type", "content", "start_line", "end_line", "n.method_name", "n.class_name")
    return rows
