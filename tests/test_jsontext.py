"""JSON among other text, against plain Python."""

import json
import re

from pyspark.sql import functions as F

from blastradius.functions import jsontext as J

ANSWERS = {
    'Sure:\n```json\n{"variations": ["a", " b ", "", null]}\n``` done {"variations": ["no"]}': ["a", "b"],
    '{"x": 1} then {"note": "n", "variations": ["c"]}': ["c"],
    'first {"x": {"variations": ["nested"]}} last': ["nested"],
    '{"variations": ["find \\s+ and \\d", "tab\\t", "u\\u0041", "\\\\s", "\\u12"]}': ["find \\s+ and \\d", "tab", "uA", "\\s", "\\u12"],
    '{"variations": "no list"}': [], "no json": [], "": [], '{"variations": ["open"': [], '["x"]': [], '```{"variations": ["{", "d"]}```': [], '{"other": ["z"]}': [],
    '{"variations": ["é", "日本"]} }': ["é", "日本"], "{" * 50 + "}" * 50: [],
}


def test_lists_of_answers(spark):
    rows = spark.createDataFrame([(t,) for t in ANSWERS] + [(None,)], "t string")
    got = {r.t: r.v for r in rows.select("t", J.listed(F.col("t")).alias("v")).collect()}
    assert got.pop(None) == [] and got == ANSWERS


def test_objects_are_followed_to_their_end(spark):
    def plain(t):
        depth = 0
        for i, c in enumerate(t):
            depth += (c == "{") - (c == "}")
            if depth == 0 and c == "}":
                return t[: i + 1]
        return None

    texts = ["{}", "{a}{b}", "{{x}{y}} z}", "{", "{{}", "{a" + "{b}" * 300 + "} tail"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.c for r in rows.select("t", J.closed(F.col("t")).alias("c")).collect()} == {t: plain(t) for t in texts}


def test_mended_escapes_can_be_read(spark):
    parts = ["\\", "s", '"', "n", "u0041", "u00", "/", "d"]
    texts = ["".join(parts[i // 8**k % 8] for k in range(4)) for i in range(4096)]
    texts = [t for t in texts if '"' not in t.replace('\\"', "") and not t.endswith("\\")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", J.mend_escapes(F.col("t")).alias("m")).collect():
        want = re.sub(r'\\(["\\/bfnrt]|u[0-9a-fA-F]{4})?', lambda m: m[0] if m[1] else "\\\\", r.t)
        assert r.m == want
        json.loads(f'"{r.m}"') if '"' not in re.sub(r"\\.", "", r.m) else None
