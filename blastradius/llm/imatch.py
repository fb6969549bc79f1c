"""I-Match document fingerprints. DataFrame functions only.

Terms are lower-cased runs of letters and digits. Of a text's distinct terms, those stay whose document frequency
over the whole corpus lies in a band (LOW to HIGH of the documents); they are sorted (by 64-bit hash) and hashed once
for each of SUBSETS randomised parts of the lexicon (small ones, so that an edit leaves some parts whole; every term
lies in one). The fingerprint is the list of those hashes; the likeness of two fingerprints is the share of equal ones
among the parts that either text has terms in. A text without any term in the band has one last part instead (the hashes
of its terms combined, in any order), which counts only between such texts: so they are told apart too, and a term of
the band that comes or goes changes its own part, and the last one if it was the only one, but no other.

The lexicon has a proven size: a term of LOW of all documents or more is one of at most (mean distinct terms of a
document) / LOW terms, at any corpus size. It is held in a two-place hash table, a constant array of the plan.

Null text is empty; a text without terms has a fingerprint of zeros, equal to any other such one (likeness 1).
Equal texts have equal fingerprints. Order for the edited texts: descending doc_id, null last, rows with equal doc_id
by descending hash of the text; of rows equal in both, all but one have their like as the next one. A single document
is its own next one. Other columns are ignored. Empty input: no rows.

The order is found among keys (id, hash of the text) only, in ranges of RUN_ROWS keys whatever the input; a text then goes to its own key, and the part of it that the
document before it takes over to that one's key. So no task holds a run of texts, and no id is one task's. Rows that are equal in
id and text are compared once, and the result is written out as often as they come, in pieces of PIECE_ROWS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

LOW, HIGH = 0.002, 0.15
SUBSETS = 64
#: Keys of one range of the order, and rows that are written out at a time, on average.
RUN_ROWS, PIECE_ROWS = 200_000, 1_000
NULL_ID = -(2**63)


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term (hash), df."""
    return docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def two_places(h: Column, size: int) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(size)).cast("int") + 1, F.pmod(F.shiftright(h, 21), F.lit(size)).cast("int") + 1


def hash_table(keys: list[int]) -> list[int]:
    """Cuckoo hashing: every key at one of its two places. 0 is empty (a key 0 is left out)."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    while True:
        at, failed = [0] * size, False
        for key in keys:
            k, place = key, key % size
            for _ in range(500):
                if not k:
                    break
                k, at[place] = at[place], k
                first, second = k % size, (k >> 21) % size
                place = second if place == first else first
            failed |= k != 0
        if not failed:
            return at
        size *= 2


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """The terms in the band, as a hash table."""
    n = docs.count()
    found = document_frequencies(docs).where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n))
    return hash_table(sorted(r["term"] for r in found.select("term").toLocalIterator()))


def fingerprint(text: Column, table: list[int]) -> Column:
    """SUBSETS numbers of 16 bits, 0 where the text has no term in that part; and one more, 0 where it has a term in the band."""
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def inside(h: Column) -> Column:
        a, b = two_places(h, len(table))
        return (F.element_at(held, a) == h) | (F.element_at(held, b) == h)

    def hashed(sorted_terms: Column) -> Column:
        def part(k: Column) -> Column:
            own = F.filter(sorted_terms, lambda h: F.shiftright(h, 8).bitwiseAND(F.lit(SUBSETS - 1)) == k)
            return F.transform(F.array(own), lambda o: F.when(F.size(o) == 0, F.lit(0).cast("long")).otherwise(short(F.xxhash64(o))))[0]

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), part)

    def both(ts: Column) -> Column:
        last = short(F.xxhash64(F.aggregate(ts, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))))

        def of(band: Column) -> Column:
            return F.concat(hashed(band), F.array(F.when((F.size(band) > 0) | (F.size(ts) == 0), F.lit(0).cast("long")).otherwise(last)))

        return F.transform(F.array(F.array_sort(F.filter(ts, inside))), of)[0]

    short = lambda h: F.greatest(F.lit(1).cast("long"), h.bitwiseAND(F.lit(0xFFFF)))
    # one-element arrays bind a value once for the lambda below them
    return F.transform(F.array(terms(text)), both)[0].cast("array<int>")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal parts among those that either of two fingerprints has terms in; where there are none, whether the
    last parts are equal."""
    pairs = F.filter(F.zip_with(F.slice(a, 1, SUBSETS), F.slice(b, 1, SUBSETS), lambda x, y: F.when((x != 0) | (y != 0), x == y)), lambda x: x.isNotNull())
    last = (F.element_at(a, -1) == F.element_at(b, -1)).cast("double")
    share = lambda p: F.when(F.size(p) == 0, last).otherwise(F.size(F.filter(p, lambda x: x)).cast("double") / F.size(p))
    return F.transform(F.array(pairs), share)[0]


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def next_keys(keys: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """keys(id, tie, ...), distinct -> with next_id and next_tie: the next key's, descending, after the last the first.

    Keys are dealt into ranges of the order, written once so that ranges are what they were; the last key of a range
    meets the first one of the next, which is looked up in a table with a row for each range."""
    runs = max(1, -(-keys.count() // run_rows))
    dealt = keys.repartitionByRange(runs, F.desc("id"), F.desc("tie")).withColumn("__run", F.spark_partition_id())
    rows = stash(dealt, "imatch-runs")
    key = F.struct("id", "tie")
    ends = rows.groupBy("__run").agg(F.max(key).alias("__first"))
    over = Window.orderBy("__run")  # a row for each range
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("__run").alias("__r"), F.coalesce(F.lead("__first").over(over), F.first("__first").over(whole)).alias("__after"))
    inside = F.lead(key).over(Window.partitionBy("__run").orderBy(F.desc("id"), F.desc("tie")))
    rows = rows.withColumn("__next", inside).join(ends, F.col("__run") == F.col("__r"))
    after = F.coalesce("__next", "__after")
    return rows.select(*keys.columns, after["id"].alias("next_id"), after["tie"].alias("next_tie"))


def compare_edited(docs: DataFrame, table: list[int]) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    keys = rows.groupBy("id", "tie").agg(F.count("*").alias("n"), F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"))
    chain = stash(next_keys(stash(keys, "imatch-keys")), "imatch-order")
    # each key with the one before it, and how many code points that one takes over
    taker = chain.select(F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), F.col("id").alias("to_id"), F.col("tie").alias("to_tie"), F.col("half").alias("to_half"))
    place = chain.select("id", "tie", "n").join(taker, ["id", "tie"])
    every = rows.withColumn("fp", fingerprint(F.col("text"), table)).join(place, ["id", "tie"])
    # both read the same columns of the texts, and so share one shuffle of them
    head = [F.col("to_id").alias("id"), F.col("to_tie").alias("tie"), F.col("doc_id").alias("next_doc_id"), F.expr("substring(text, 1, to_half)").alias("head"), F.col("fp").alias("next_fp")]
    one = every.where("n = 1")
    heads = one.select(*head)
    own = one.select("doc_id", "id", "tie", "text", "fp")
    several = not chain.where("n > 1").isEmpty()
    if several:
        same = every.where("n > 1").groupBy("doc_id", "id", "tie", "n", "to_id", "to_tie", "to_half").agg(F.max("text").alias("text"), F.max("fp").alias("fp"))
        heads = heads.unionByName(same.select(*head))
        own = own.unionByName(same.select("doc_id", "id", "tie", "text", "fp"))
    met = own.join(heads, ["id", "tie"]).select("doc_id", "text", "fp", "head", "next_fp", "next_doc_id")
    met = met.withColumn("__times", F.lit(1).cast("long"))
    if several:  # all but one of equal rows have their like as the next one
        again = same.select("doc_id", "text", "fp", F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))").alias("head"), F.col("fp").alias("next_fp"), F.col("doc_id").alias("next_doc_id"), (F.col("n") - 1).alias("__times"))
        met = met.unionByName(again)
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.col("head"))
    met = met.select("doc_id", "fp", "next_fp", "next_doc_id", "__times", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    met = met.withColumn("edited_fp", fingerprint(F.col("edited"), table))
    out = met.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "next_doc_id", "__times",
    )
    if not several:
        return out.drop("__times")
    # results, no longer texts, are dealt to many tasks before they are written out
    out = stash(out, "imatch-results")
    pieces = out.where("__times > 1").withColumn("__piece", F.explode(F.expr(f"sequence(0L, (__times - 1) div {PIECE_ROWS})"))).repartition("__piece", "doc_id", "fingerprint")
    many = pieces.withColumn("__i", F.explode(F.expr(f"sequence(__piece * {PIECE_ROWS}, least(__times, (__piece + 1) * {PIECE_ROWS}) - 1)"))).drop("__piece", "__i")
    return out.where("__times = 1").unionByName(many).drop("__times")


def fingerprints(docs: DataFrame, table: list[int]) -> DataFrame:
    """doc_id, fingerprint."""
    return docs.select("doc_id", as_hex(fingerprint(F.coalesce(F.col("text"), F.lit("")), table)).alias("fingerprint"))
