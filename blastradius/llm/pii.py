"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction. DataFrame functions only.

Fixed kinds are email, ip, card and phone. The regular expressions used here find the same leftmost, non-overlapping
matches as the plain ones in BASE, but never rescan a run of characters (possessive, anchored at the run's start), so
that long texts of one character class take linear time.

Bootstrapping: candidates are long tokens with a digit; a candidate's pattern is its left lexical context (the two
words before it, lower-cased, without marks; ^ stands for the start of the text). Candidates themselves are left out
of contexts, so that all members of a list have the context of its first one. Words are seen whole, however long.
Candidates that look like the seeds (SEEDS, by kind) have confidence 1.
In each round a pattern's score is the mean confidence of its distinct candidates (smoothed), and a candidate's
confidence is that at least one of its patterns is right. Patterns of enough distinct candidates and a high score
mark all their candidates, whatever those look like.

Offsets are code points, ends exclusive. Null text is empty. Rows are keyed by (doc_id, text hash): repeated rows
get equal results, rows with equal doc_id and other texts their own. Other columns are ignored by spans() and kept
by redact(). Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Kinds as listed, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time; card: only those of 12 digits or more.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": BASE["phone"],
}
#: A parameter of the seeds: tokens of fewer characters are never candidates, as no kind of identifier that is looked for is shorter.
LEAST_LENGTH = 12
#: The digit may stand anywhere: a run of these characters is looked through once, at its start only.
CANDIDATE = rf"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{{{LEAST_LENGTH},}}+"
#: Seed entities by kind: what a candidate looks like.
SEEDS = {"secret": r"^[0-9a-f]{32,64}$"}
ROUNDS = 3
LEAST_CANDIDATES, LEAST_SCORE = 3, 0.7
#: Elements summed in one step of a running sum, and code points in one piece of a text that is cut at its spans.
STEP, PIECE = 64, 4096


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda s, x: s + x)


def before_each(xs: Column) -> Column:
    """The sum of the elements before each one: steps of STEP elements, so that long arrays stay cheap."""
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(xs) - 1) / STEP).cast("int"))), lambda c: total(F.slice(xs, c * STEP + 1, STEP)))
    upto = bind(steps, lambda ss: F.aggregate(ss, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))))
    return bind(upto, lambda u: F.transform(xs, lambda x, i: F.element_at(u, (i / STEP).cast("int") + 1) + total(F.slice(xs, i - i % STEP + 1, i % STEP))))


def most_before_each(xs: Column) -> Column:
    """The largest of the elements before each one, 0 at least, in the same steps."""
    most = lambda ys: F.coalesce(F.array_max(ys), F.lit(0))
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(xs) - 1) / STEP).cast("int"))), lambda c: most(F.slice(xs, c * STEP + 1, STEP)))
    upto = bind(steps, lambda ss: F.aggregate(ss, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), s)))))
    return bind(upto, lambda u: F.transform(xs, lambda x, i: F.greatest(F.element_at(u, (i / STEP).cast("int") + 1), most(F.slice(xs, i - i % STEP + 1, i % STEP)))))


def placed(found: Column, between: Column) -> Column:
    """array of (start, end, value) of the matches, given the text's pieces between them."""
    lengths = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, p: F.length(m) + F.length(p))
    ends = bind(lengths, before_each)

    def one(at: Column) -> Column:
        first = lambda i: F.element_at(at, i + 1) + F.length(F.element_at(between, i + 1))
        return F.transform(found, lambda m, i: F.struct(first(i).alias("start"), (first(i) + F.length(m)).alias("end"), m.alias("value")))

    return bind(ends, one)


def matches(text: Column, regex: str) -> Column:
    """array of (start, end, value)."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return bind(F.regexp_extract_all(text, F.lit(regex), 0), lambda ms: F.when(F.size(ms) == 0, none).otherwise(bind(F.split(text, regex, -1), lambda ps: placed(ms, ps))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: bind(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return total(each) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: bind(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))
    if kind == "card":
        return bind(digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    return F.length(digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """array of (start, rank, end, kind), unsorted."""
    kind_of = "array<struct<start:int,rank:int,end:int,kind:string>>"
    has = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9][ -]?[0-9]"), "phone": F.instr(text, "+") > 0}
    out = []

    def found(rank: int, kind: str) -> Column:
        good = F.filter(matches(text, FAST[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    for rank, kind in enumerate(KINDS):
        out.append(F.when(has[kind], found(rank, kind)).otherwise(F.array().cast(kind_of)))
    return F.concat(*out)


def last_words(piece: Column) -> Column:
    """The last two words of a piece of text (fewer if it has fewer), lower-cased, without marks."""
    plain = F.trim(F.regexp_replace(F.lower(piece), r"""[^\p{L}\p{N}=:\s]+|\s+""", " "))
    return bind(F.filter(F.split(plain, " +"), lambda w: w != ""), lambda ws: F.slice(ws, F.greatest(F.size(ws) - 1, F.lit(1)), 2))


def contexts(between: Column, n: Column) -> Column:
    """For each of the n candidates the two words before it, candidates left out; ^ where the text starts."""

    def joined(words: Column) -> Column:
        every = F.concat(F.array(F.lit("^"), F.lit("^")), F.flatten(words))
        return bind(every, lambda ws: bind(F.transform(words, F.size), lambda ns: bind(before_each(ns), lambda upto: F.transform(upto, lambda u, i: F.array_join(F.slice(ws, u + F.element_at(ns, i + 1) + 1, 2), " ")))))

    return bind(F.transform(F.slice(between, F.lit(1), n), last_words), joined)


def candidates(text: Column) -> Column:
    """array of (start, end, value, left)."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")

    def with_left(ms: Column, ps: Column) -> Column:
        return F.zip_with(placed(ms, ps), contexts(ps, F.size(ms)), lambda m, c: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), c.alias("left")))

    found = bind(F.regexp_extract_all(text, F.lit(CANDIDATE), 0), lambda ms: F.when(F.size(ms) == 0, none).otherwise(bind(F.split(text, CANDIDATE, -1), lambda ps: with_left(ms, ps))))
    return F.when(text.rlike("[0-9]"), found).otherwise(none)


def scored_patterns(pairs: DataFrame, seed: str) -> DataFrame:
    """pairs(left, value), distinct -> left, score of the patterns that hold."""
    pairs = pairs.withColumn("seed", F.col("value").rlike(seed).cast("double"))
    # patterns without any seed can gain only through a candidate that another pattern shares
    confident = pairs.withColumn("conf", F.col("seed"))
    strong = None
    for i in range(ROUNDS):
        score = confident.groupBy("left").agg((F.sum("conf") / (F.count("*") + 0.5)).alias("score"), F.count("*").alias("n"))
        strong = stash(score.where((F.col("n") >= LEAST_CANDIDATES) & (F.col("score") >= LEAST_SCORE)).select(F.col("left").alias("__left"), "score"), f"pii-patterns-{i}")
        if i < ROUNDS - 1:
            # hot patterns have many values; the table of strong patterns is one row for each
            each = pairs.join(strong, F.col("left") == F.col("__left"), "inner").groupBy(F.col("value").alias("__value")).agg((1 - F.exp(F.sum(F.log(1 - 0.9 * F.least("score", F.lit(0.999)))))).alias("__c"))
            confident = pairs.join(each, F.col("value") == F.col("__value"), "left").withColumn("conf", F.greatest("seed", F.coalesce("__c", F.lit(0.0))))
    return strong.select(F.col("__left").alias("left"), "score")


def bootstrapped(rows: DataFrame, seeds: dict[str, str] | None = None) -> DataFrame:
    """rows(doc_id, h, found) with candidates -> doc_id, h, more: array of (start, rank, end, kind)."""
    each = stash(rows.where(F.size("found") > 0).select("doc_id", "h", F.explode(F.array_distinct("found")).alias("m")).select("doc_id", "h", "m.*").distinct(), "pii-candidates")
    pairs = stash(each.select("left", "value").distinct(), "pii-pairs")
    out = []
    for rank, (kind, seed) in enumerate((seeds or SEEDS).items(), len(KINDS)):
        strong = scored_patterns(pairs, seed).select(F.col("left").alias("__l"))
        hit = each.join(strong, F.col("left") == F.col("__l"))
        out.append(hit.select("doc_id", "h", F.struct("start", F.lit(rank).alias("rank"), "end", F.lit(kind).alias("kind")).alias("s")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.groupBy("doc_id", "h").agg(F.collect_list("s").alias("more"))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def spans(docs: DataFrame, seeds: dict[str, str] | None = None) -> DataFrame:
    """doc_id, h, base, all: arrays of (start, rank, end, kind), sorted."""
    rows = _rows(docs).select("doc_id", "h", F.array_sort(base_spans(F.col("text"))).alias("base"), candidates(F.col("text")).alias("found"))
    rows = stash(rows, "pii-rows")  # texts are read once
    more = bootstrapped(rows, seeds).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), "more")
    joined = rows.join(more, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), "left")
    return joined.select("doc_id", "h", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("all"))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame, seeds: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return spans(docs, seeds).select("doc_id", *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("all")).alias("spans"))


def cut(pieces: Column, lo: Column, hi: Column) -> Column:
    """Code points lo to hi of a text, given its pieces of PIECE code points."""
    first, last = (lo / PIECE).cast("int"), (hi / PIECE).cast("int")
    part = lambda i: F.coalesce(F.try_element_at(pieces, i + 1), F.lit(""))
    one = F.substring(part(first), lo % PIECE + 1, hi - lo)
    inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    several = F.concat(F.substring(part(first), lo % PIECE + 1, F.lit(PIECE)), inner, F.substring(part(last), F.lit(1), hi % PIECE))
    return F.when(hi <= lo, "").when(first == last, one).otherwise(several)


def redacted(text: Column, found: Column) -> Column:
    """text with its spans (sorted, not empty) replaced; of overlapping ones the first gives the kind. A span costs
    what its surroundings cost, so that long texts with many spans take linear time."""

    def whole(pieces: Column, done: Column) -> Column:
        parts = F.transform(found, lambda s, i: bind(F.element_at(done, i + 1), lambda at: F.when(s["start"] < at, "").otherwise(F.concat(cut(pieces, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))))
        end = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), cut(pieces, end, F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)
    return bind(pieces, lambda ps: bind(most_before_each(F.transform(found, lambda s: s["end"])), lambda done: whole(ps, done)))


def redact(docs: DataFrame, seeds: dict[str, str] | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, and n_chars, if there is one, counted anew."""
    found = spans(docs, seeds).where(F.size("all") > 0).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("all").alias("__spans")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__h")), "left")
    joined = joined.withColumn("__new", F.when(F.col("__spans").isNotNull(), redacted(text, F.col("__spans"))))
    out = {"text": F.coalesce("__new", "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__new").isNull(), F.col("n_chars")).otherwise(F.length("__new").cast(docs.schema["n_chars"].dataType))
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
