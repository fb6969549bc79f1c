"""The training-data operators against plain versions, on the small tables and on hand-made edge cases."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from blastradius.llm import bpe, gbt, imatch, mixing, pii, quality_classifier, quality_rules, queries, sharding, simhash, suffix_dedup, textstats, url_filter
from blastradius.llm.components import components

SF = "/root/testdata/sf0.001"
#: Nulls, empty and long texts, repeated rows, equal texts, ties, other white space, code points beyond 16 bits.
EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "word", None, "b"), (5, "word", "de", None), (5, "word", "de", None),
    (6, "one two three four " * 60, "en", "a"), (7, "x" * 30_000, "en", "a"), (8, "é\U0001f600 à b\u00a0 c " * 40, "fr", "a"), (None, "no id here at all", "en", "a"),
    (9, "call +1 (555) 123-4567 or a.b@c.de, 10.0.0.256 10.0.0.1 4111 1111 1111 1111", "en", "b"), (10, "1 " * 3000, "es", "b"),
    (14, "one id and one text " * 9, "en", "a"), (14, "one id and another text " * 9, "en", "b"), (None, "no id either, " * 20, "en", "a"),
    (11, 'set token = "0123456789abcdef0123456789abcdef" now', "en", "a"), (12, "one two three four " * 60, "en", "c"), (13, "A\x1cB\x0bC", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    rows = spark.createDataFrame(EDGE, SCHEMA)
    return rows.withColumns({c: F.lit("clash") for c in ("size", "kept", "shard", "fp", "h", "base", "score", "slot", "id", "gram", "taken", "url")}).repartition(3)


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1. repeated byte strings


def repeats(rows):
    """Plain version: null ids first, rows of one id by hash of text, equal rows are one document."""
    seen, out = set(), []

    def place(r):
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        return r[0] is not None, r[0] or 0, h - (h >> 63 << 64)

    for _, same in itertools.groupby(sorted(rows, key=place), place):
        i, t = (same := list(same))[0]
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out += [(i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())] * len(same)
    return sorted(out, key=repr)


def removed(df):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, digest=True).collect()), key=repr)


def test_op1(spark, docs, edge, none):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert removed(docs) == repeats(rows)
    assert removed(edge) == repeats([r[:2] for r in EDGE])
    assert removed(none) == []


def test_op1_random(spark):
    random.seed(5)
    base = "".join(random.choice("abcdefgh \n") for _ in range(500))
    rows = []
    for i in range(80):
        t = ""
        for _ in range(random.randint(0, 4)):
            a = random.randint(0, 400)
            t += random.choice([base[a : a + random.randint(1, 300)], "x" * random.randint(0, 250), "ab" * random.randint(0, 110)])
        rows.append((i, t))
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == repeats(rows)


def test_op1_blocks(monkeypatch):
    random.seed(2)
    data = [b"".join(random.choice([b"abc" * 70, bytes(random.choices(b"ab", k=200)), b"y" * 333]) for _ in range(n)) for n in (12, 0, 1, 7)] + [b"short", b"", b"z" * 100]
    raw, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum(list(map(len, data)))
    whole = suffix_dedup.parse(raw, ends)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 211)
    suffix_dedup._powers.clear()
    for a, b in zip(whole, suffix_dedup.parse(raw, ends), strict=True):
        assert (a == b).all()
    suffix_dedup._powers.clear()
    _, _, first, last, place = whole
    own = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    starts = ends - list(map(len, data))
    assert own.tolist() == [i for a, b in zip(starts, ends, strict=True) for i in range(a, b - 99)]
    assert (place >= last).all() and (place - first <= 63).all() and (first + 100 >= place + 37).all()


def test_op1_suffix_order():
    # the masks against a plain comparison of all windows, with phrases cut at either end, and zero bytes
    random.seed(8)
    trigger, phrases = b"T" * 37, []
    for g in range(6):
        for _ in range(30):
            at = random.randint(0, 63)
            after = random.randint(100 - at, 100)
            left, right = (bytes(random.choices(b"\0a", weights=(1, 9), k=63)) for _ in range(2))
            phrases.append((g, left[63 - at :] + trigger + right[: after - 37], at))
    group, body, at = zip(*phrases, strict=True)
    raw, ends = np.frombuffer(b"".join(body), np.uint8), np.cumsum(list(map(len, body)))
    masks = suffix_dedup.first_windows(np.array(group), raw, ends, np.array(at))
    seen = set()
    for (g, b, a), mask in zip(phrases, masks.tolist(), strict=True):
        for k in range(a, a - (len(b) - 100) - 1, -1):
            window = (g, k, b[a - k : a - k + 100])
            assert bool(mask >> k & 1) == (window not in seen)
            seen.add(window)


def test_op1_hot_strings(spark, monkeypatch):
    # a line in every document, in ever new surroundings, and triggers with too many phrases for one task
    monkeypatch.setattr(suffix_dedup, "FEW", 3)
    random.seed(9)
    line = "this line stands in every document of the collection, and it is longer than any window of one hundred bytes"
    noise = lambda n: "".join(random.choice("abcdefghij ") for _ in range(n))
    rows = [(i, noise(random.randint(0, 90)) + line + noise(random.randint(0, 90)) + (line if i % 3 else "") + noise(50)) for i in range(200)]
    rows += [(None, rows[5][1]), (None, rows[6][1]), (7, rows[8][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert removed(df) == repeats(rows)
    monkeypatch.setattr(suffix_dedup, "FEW", 2000)
    assert removed(df) == repeats(rows)


# 2. URL filters


def test_op2(spark):
    urls = [None, "", "nourl", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "ftp://a.net/es/1", "x://net/fr/", "http://net?q", "http://notexample.com", "http://a.com/", "http://com", "http:///p"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "again")], "page_id long, url string, verdict string")
    mined = url_filter.mine(spark.createDataFrame([], "url string, bad double"))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, queries.URL_RULES, mined).collect()}
    assert got == {
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.com", "/en/x", "example.com/en/", "block"),
        (4, "www.example.com", "/en/", "www.example.com/en/", "allow"), (5, "a.net", "/es/1", "net/es/", "block"), (6, "net", "/fr/", "net/fr/", "block"), (7, "net", "", None, "allow"),
        (8, "notexample.com", "", None, "allow"), (9, "a.com", "/", "com/", "allow"), (10, "com", "", None, "allow"), (11, "", "/p", None, "allow"),
    }


def test_op2_mines_combinations(spark):
    random.seed(1)
    rows = []
    for i in range(600):
        spam, casino = random.random() < 0.5, random.random() < 0.5
        rows.append((f"http://{'spam' if spam else 'good'}.site.org/{'casino' if casino else 'news'}/{i}", float(spam and casino)))
    labelled = spark.createDataFrame(rows, "url string, bad double")
    rules = url_filter.mine(labelled)
    found = [set(r["tokens"]) for r in rules.collect()]
    assert found and all(not (a < b) for a, b in itertools.permutations(found, 2))
    # the same rules by brute force: both tokens together are always bad, alone they are so half of the time
    assert {frozenset(x) for x in found} >= {frozenset({"w:spam", "p:casino"})} or all(any("casino" in t for t in x) and any("spam" in t for t in x) for x in found)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(labelled.select(F.monotonically_increasing_id().alias("page_id"), "url"), [], rules).collect()}
    assert Counter(got.values())["block"] == sum(int(b) for _, b in rows)


def verdicts(labelled, rules):
    return {r["url"]: r["verdict"] for r in url_filter.judge(labelled.select("url", F.col("url").alias("page_id")), [], rules).withColumnRenamed("page_id", "url").collect()}


def test_op2_hot_tokens_and_domains(spark):
    # hot is on 60 % of the URLs, b on 35 %, both on 15 %, and only those are bad
    rows = [(f"http://h{i}.org/{'hot' if i % 20 < 12 else 'cold'}/{'b' if i % 20 < 3 or i % 20 >= 16 else 'c'}/{i}", float(i % 20 < 3)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, bad double")
    assert verdicts(labelled, url_filter.mine(labelled)) == {u: "block" if b else "allow" for u, b in rows}
    # a bad domain of many subdomains beside a larger good one of the same name; .com is on over half of the URLs
    rows = [(f"http://s{i}.evil.com/", 1.0) for i in range(40)] + [(f"http://s{i}.evil.org/", 0.0) for i in range(60)] + [(f"http://s{i}.fine.com/", 0.0) for i in range(90)]
    labelled = spark.createDataFrame(rows, "url string, bad double")
    assert verdicts(labelled, url_filter.mine(labelled)) == {u: "block" if b else "allow" for u, b in rows}


def test_op2_equal_tokens_stand_for_one_another(spark):
    rows = [(f"http://a{i}.org/pills/cheap/", 1.0) for i in range(20)] + [(f"http://a{i}.org/news/", 0.0) for i in range(60)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, bad double"))
    assert [r["tokens"] for r in rules.collect()] == [["p:cheap"]]
    pages = spark.createDataFrame([("http://b.net/cheap",), ("http://b.net/pills",), ("http://b.net/news",)], "url string")
    assert verdicts(pages, rules) == {"http://b.net/cheap": "block", "http://b.net/pills": "block", "http://b.net/news": "allow"}


def test_op2_sees_whole_urls(spark):
    # what decides stands behind a long host and a slug of common words
    slug = "-".join("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split())
    rows = [(f"http://a.b.c.d.e.org/{slug}/{i}.{'exe' if i % 4 == 0 else 'html'}?{'aff' if i % 4 == 1 else 'page'}=1", float(i % 4 < 2)) for i in range(240)]
    labelled = spark.createDataFrame(rows, "url string, bad double")
    assert verdicts(labelled, url_filter.mine(labelled)) == {u: "block" if b else "allow" for u, b in rows}


def test_op2_mines_where_most_are_bad(spark):
    rows = [(f"http://h{i}.org/{'ok' if i % 5 == 0 else 'mixed' if i % 5 == 1 else 'pills'}/", float(i % 5 > 1 or i % 10 == 1)) for i in range(300)]
    rows += [(f"http://k{i}.org/pills/", 1.0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "url string, bad double")
    rules = url_filter.mine(labelled)
    assert [r["tokens"] for r in rules.collect()] == [["p:pills"]]
    assert all(1 - 1e-9 > url_filter.gain(b / 100, 1.5) > b / 100 for b in range(1, 100))


# 3. I-Match


def plain_compared(rows, fp, fp_of):
    """Plain version over rows(doc_id, text): ids descending, null last, then hashes descending; equal rows follow one another."""

    def signed(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - (h >> 63 << 64)

    def near(a, b):
        (*a, last), (*b, other) = re.findall("....", a), re.findall("....", b)
        either = [(x, y) for x, y in zip(a, b, strict=True) if x != "0000" or y != "0000"]
        return sum(x == y for x, y in either) / len(either) if either else float(last == other)

    order = sorted(((i is not None, i or 0, signed(t), i, t) for i, t in rows), reverse=True)
    out = []
    for k, (*_, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][-1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp[t], fp_of(edited), near(fp[t], fp_of(edited)), near(fp[t], fp[after]), order[(k + 1) % len(order)][3]))
    return out


def plain_fingerprint(t, band):
    """By the rule of the docstring; band: hashes of the terms in the lexicon."""

    def h(x):
        v = xxhash.xxh64_intdigest(x.encode(), 42)
        return v - (v >> 63 << 64)

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
        return seed

    every = {h(x) for x in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if x}
    use = sorted(every & band)
    parts = [[x for x in use if (x >> 8) % 64 == k] for k in range(64)] + [[functools.reduce(lambda a, x: a ^ x, every)] if every and not use else []]
    return "".join(f"{max(1, chained(p) & 0xFFFF) if p else 0:04x}" for p in parts)


def test_op3(spark, docs, edge, none):
    table = imatch.lexicon(docs)
    band = set(table) - {0}
    for df in (docs, edge):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        got = Counter(tuple(r) for r in imatch.compare_edited(df, table).collect())
        known = {}
        fp_of = lambda t: known.setdefault(t, plain_fingerprint(t, band))
        assert got == Counter(plain_compared(rows, {t: fp_of(t) for _, t in rows}, fp_of))
    assert imatch.compare_edited(none, imatch.lexicon(none)).count() == 0


def test_op3_order_of_keys(spark):
    # ids that many keys share are cut again, by their hash
    random.seed(1)
    for n, run_rows in ((1, 5), (2, 1), (700, 9), (700, 100)):
        keys = list({(random.choice([-(2**63), 5, 6, random.randint(0, 999)]), random.getrandbits(64) - 2**63) for _ in range(n)})
        df = spark.createDataFrame(keys, "id long, tie long").repartition(3)
        got = {(r["id"], r["tie"]): (r["next_id"], r["next_tie"]) for r in imatch.next_keys(df, run_rows).collect()}
        order = sorted(keys, reverse=True)
        assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_op3_last_band_term_gone(spark):
    # the fingerprint changes in that term's part and in the last one, and nowhere else
    rows = [(i, f"alpha{i % 20} unique{i}") for i in range(400)] + [(999, "unique3"), (1000, "unique4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r["doc_id"]: re.findall("....", r["fingerprint"]) for r in imatch.fingerprints(df, imatch.lexicon(df, 0.01, 0.5)).collect()}
    assert sum(x != y for x, y in zip(fp[3], fp[999], strict=True)) == 2 and fp[3][-1] == "0000" != fp[999][-1] != fp[1000][-1]


def test_op3_third_of_all_rows_is_one(spark, monkeypatch):
    monkeypatch.setattr(imatch, "PIECE_ROWS", 7)
    rows = [(5, "one text of many copies")] * 50 + [(i, f"another text {i}") for i in range(10, 60)] + [(None, "")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = imatch.compare_edited(df, imatch.lexicon(df, 0.01, 0.5)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) >= 49


def test_op3_one_band_term_less(spark):
    # no number of band terms at which a text's fingerprint turns into another kind
    rows = [(i, f"alpha{i % 20} beta{i % 20} gamma{i % 20} delta{i % 20} unique{i}") for i in range(400)] + [(999, "alpha3 beta3 gamma3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(df, imatch.lexicon(df, 0.01, 0.5)).collect()}
    a, b = (re.findall("....", fp[i]) for i in (3, 999))
    assert sum(x == y != "0000" for x, y in zip(a, b, strict=True)) >= 2


def test_op3_band(spark):
    # terms in the band decide, terms outside it don't
    rows = [(i, f"common alpha{i % 20} beta{i % 20} gamma{i % 20} delta{i % 20} unique{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(df, imatch.lexicon(df, 0.01, 0.5)).collect()}
    assert fp[0] == fp[20] != fp[1]


# 4. mixing


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = budget * sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_op4(spark, docs, edge, none):
    for df in (docs, edge):
        got = mixing.plan(df).collect()
        assert len(got) == df.count()
        sizes = Counter()
        for r in df.collect():
            sizes[r["source"]] += len(words(r["text"]))
        want, taken = plain_targets(dict(sizes)), Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
            taken[r["source"]] += r["taken"]
        for s, t in want.items():
            assert taken[s] == math.floor(t + 1e-9)
    again = {(r["doc_id"], r["source"], r["taken"]) for r in mixing.plan(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["source"], r["taken"]) for r in mixing.plan(docs).collect()}
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns and mixed.count() > 0


def test_op4_keeps_rows_without_words(spark):
    rows = [(1, None, "en", "a"), (1, " ", "en", "a"), (None, "", "en", "a"), (None, None, "en", "a"), (2, "one two", "en", "a"), (2, "one two", "en", "a"), (3, "", "en", None), (3, "", "en", None)]
    got = Counter((r["doc_id"], r["source"], r["size"]) for r in mixing.plan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter({(1, "a", 0): 2, (None, "a", 0): 2, (2, "a", 2): 2, (3, None, 0): 2})


def test_op4_mix_tells_rows_by_text(spark):
    """Null and repeated ids: what comes stays within one document of the target, and no text more than twice."""
    r = random.Random(4)
    text = lambda: "w " * r.randrange(1, 40) + str(r.random())
    rows = [(None, text(), "en", "b") for _ in range(300)] + [(7, text(), "en", "b") for _ in range(200)]
    rows += [(i, text(), "en", "a") for i in range(100)] + [(100 + i, text(), "en", None) for i in range(300)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    had, size = Counter(), Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    for x in mixed:
        had[x["source"]] += len(words(x["text"]))
    target = plain_targets(dict(size))
    assert all(abs(had[s] - target[s]) <= 41 for s in size) and 0 < target["b"] < 1.9 * size["b"]
    assert max(Counter((x["doc_id"], x["text"]) for x in mixed).values()) == 2


def test_op4_mix_of_equal_rows(spark, monkeypatch):
    """A third of all rows are one document, in rows that differ in another column or in none."""
    monkeypatch.setattr(mixing, "PIECE_ROWS", 7)
    rows = [(1, "one two three", ("en", "de")[i % 2], "a") for i in range(101)] + [(None, "one two three", "en", "a")] * 50
    rows += [(i, f"t {i} b c", "en", "a" if i % 2 else "b") for i in range(10, 160)]
    df = spark.createDataFrame(rows, SCHEMA)
    times = Counter()
    for x in mixing.plan(df).collect():
        times[x["doc_id"], x["source"]] += math.floor(x["taken"] / x["size"] + 0.5)
    mixed = mixing.mix(df).collect()
    assert Counter((x["doc_id"], x["source"]) for x in mixed) == +times and 101 < times[1, "a"] < 202
    most = Counter((x["doc_id"], x["lang"]) for x in mixed if x["doc_id"] == 1)
    assert all(n <= 2 * sum(1 for r in rows if r[0] == 1 and r[2] == lang) for (_, lang), n in most.items())


def test_op4_prefixes_hold_the_weights(spark):
    per = spark.createDataFrame([("a", 1000, 5.0, 3000.0), ("b", 1000, 2.0, 1500.0), (None, 1000, 1.0, 500.0)], "source string, source_size long, weight double, target double")
    slots, block = mixing.schedule(per, slot_bits=8)
    rows = slots.orderBy("slot").collect()
    assert len({r["slot"] for r in rows}) == len(rows)
    for n in range(16, len(rows), 7):
        had = Counter(r["source"] for r in rows[:n])
        for s, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
            assert abs(had[s] - share * n) <= 4
    for s in ("a", "b", None):
        own = [r for r in rows if r["source"] == s]
        assert [r["block"] for r in own] == list(range(len(own))) and sum(r["words"] for r in own) in (3000, 1500, 500)


# 5. SimHash


def plain_simhash(text):
    import xxhash

    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(fp):
    """fp: id -> fingerprint."""
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(ids, 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_op5(docs, edge, none):
    for df in (docs, edge.where("doc_id <> 14").dropDuplicates(["doc_id"])):
        fp = {r["doc_id"]: plain_simhash(r["text"]) for r in df.collect()}
        got = simhash.near_duplicates(df).collect()
        assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fp
        assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(fp)
    assert simhash.near_duplicates(edge).count() == len(EDGE)
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 5").count() <= 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_op5_shared_ids_and_none(spark):
    text = [" ".join(f"{w}{i}" for w in "abcdefghijkl") for i in range(4)]
    rows = [(None, text[0], "en", "a"), (None, text[1], "en", "a"), (None, text[1], "en", "b"), (3, text[2], "en", "a"), (3, text[3], "en", "a"), (4, text[3], "en", "a"), (5, text[0], "en", "a"), (6, text[2], "en", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect())
    assert kept == Counter([(None, text[0]), (None, text[1]), (3, text[2]), (3, text[3])])
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == Counter({(None, None): 3, (3, 3): 2, (4, 3): 1, (5, None): 1, (6, 3): 1})
    some = simhash.keep_one(df.where("doc_id is null and source = 'b' or doc_id is null and text like 'a1 %'"))
    assert [(r["doc_id"], r["text"], r["source"]) for r in some.collect()] == [(None, text[1], "a")]


def test_op5_covering():
    masks = simhash.masks(list(range(64)))
    assert len(masks) == 15 and all(any(not any(m >> i & 1 for i in t) for m in masks) for t in itertools.combinations(range(64), 3))
    few = simhash.masks([1, 5, 9, 20, 33])
    assert all(any(not any(m >> i & 1 for i in t) for m in few) for t in itertools.combinations([1, 5, 9, 20, 33], 3))


def test_op5_large_buckets(spark, monkeypatch):
    # many fingerprints that share most of their bits: every level of the cover is used
    random.seed(4)
    monkeypatch.setattr(simhash, "FEW", 4)
    base = random.getrandbits(64)
    fps = {base ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 7))) % 2**64 for _ in range(250)}
    fps |= {base ^ a << 3 for a in range(100)}
    ids = {x: i for i, x in enumerate(sorted(fps))}
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    edges = [(ids[r["a"] % 2**64], ids[r["b"] % 2**64]) for r in simhash.links(nodes).collect()]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components({i: x for x, i in ids.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


# 6. quality rules


def plain_base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_op6(spark, docs, edge, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality_rules.train(docs, labels)
    for df in (docs, edge):
        got = quality_rules.judge(df, forest).collect()
        text = {(r["doc_id"], plain_base(r["text"])) for r in df.collect()}
        assert {(r["doc_id"], tuple(r[c] for c in textstats.BASE)) for r in got} == text and len(got) == df.count()
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(none, forest).count() == 0
    assert quality_rules.train(docs, labels.limit(0)) is None
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, kept int")
    assert [tuple(r) for r in quality_rules.labelled_sample(odd, 9).collect()] == [(2, 1.0)]


def test_op6_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_rules.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality_rules.judge(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.97


def test_op6_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.4 * np.sin(12 * x[:, 0]) + rng.normal(0, 0.2, 800) > 0.6).astype(float)
    forest = gbt.fit(x, y, np.array([1, 0, -1]))
    grid = np.linspace(0, 1, 50)
    for other in rng.random((20, 3)):
        z = np.tile(other, (50, 1))
        z[:, 0] = grid
        assert (np.diff(forest.margin(z)) >= -1e-12).all()
        z = np.tile(other, (50, 1))
        z[:, 2] = grid
        assert (np.diff(forest.margin(z)) <= 1e-12).all()


# 7. sharding


def test_op7(docs, edge, none):
    curve = sharding.hilbert_indices(3, 3)
    at = sorted(range(512), key=lambda c: curve[c])
    xyz = [(c >> 6, c >> 3 & 7, c & 7) for c in at]
    assert sorted(curve) == list(range(512)) and all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(xyz))
    for df in (docs, edge):
        got = sharding.shard(df).collect()
        key = lambda r: (r["doc_id"], len((r["text"] or "").encode()) + (r["text"] is not None or 1), zlib.crc32((r["text"] or "").encode()))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(key(r) for r in df.collect())
        for s in range(16):
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
        assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard(none).count() == 0


def test_op7_near_equal_with_one_large_group(spark):
    rows = [(i, "copy of one text " * 8 if i % 3 == 0 else f"text {i} " * (i % 23 + 1), "en", f"s{i % 7}") for i in range(6000)]
    per = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect():
        per[r["shard"]] += r["size"]
    assert len(per) == 16 and max(per.values()) < 1.05 * sum(per.values()) / 16


@pytest.mark.parametrize("one", [(5, "one id and one text " * 15), (None, "no id and one text " * 15), (None, None), (3, "")])
def test_op7_near_equal_with_repeated_rows(spark, one, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 500)
    rows = [(*one, "en", "a")] * 3000 + [(i, f"other text of a row {i} " * 3, "en", f"s{i % 5}") for i in range(10, 3010)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()
    per, count = Counter(), Counter((r["doc_id"], r["size"]) for r in got)
    for r in got:
        per[r["shard"]] += r["size"]
    assert len(got) == 6000 and count[one[0], len((one[1] or "").encode()) + 1] == 3000
    assert len(per) == 16 and max(per.values()) < 1.05 * sum(per.values()) / 16 and min(per.values()) > 0.95 * sum(per.values()) / 16
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_op7_files(docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# 8. personal data


def luhn(d):
    each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in each) % 10 == 0


def plain_spans(t):
    out = []
    for k, kind in enumerate(pii.KINDS):
        if kind == "email" and "@" not in t:  # the plain pattern is quadratic in runs of letters
            continue
        for m in re.finditer(pii.BASE[kind], t):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]
            if good():
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_op8(spark, docs, edge, none):
    random.seed(3)
    letters = "0123456789 -.+@a%b().é\U0001f600\n,"
    extra = spark.createDataFrame([(i, "".join(random.choice(letters) for _ in range(random.randint(0, 90)))) for i in range(1500)], "doc_id long, text string")
    for df in (docs, edge, extra):
        got = pii.digests(df).collect()
        found, plain = Counter(), Counter()
        for r in df.collect():
            want = plain_spans(r["text"] or "")
            base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
            plain[r["doc_id"], hashlib.sha256(base.encode()).hexdigest(), *(sum(w[3] == k for w in want) for k in pii.KINDS)] += 1
        for r in got:
            found[r["doc_id"], r["base_sha256"], *(r[f"n_{k}"] for k in pii.KINDS)] += 1
            base = [x for x in r["spans"].split(",") if not x.startswith("secret:")]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
        assert found == plain
    assert pii.digests(none).count() == 0 and pii.redact(none).count() == 0


def test_op8_discovers_by_context(spark):
    rows = [(i, f'x y{i} api token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end') for i in range(12)]
    rows += [(53, "an api token = ABC-9981-QQRS-71, ABC-9981-QQRS-72 and ABC-9981-QQRS-73"), (50, "so the API TOKEN = XYZ-9981-QQRS-77 ends"), (51, "plain serial XYZ-9981-QQRS-78 stays"), (52, "mail a@b.cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert text[50] == "so the API TOKEN = [SECRET] ends" and text[51] == rows[-2][1] and text[52] == "mail [EMAIL]"
    assert text[53] == "an api token = [SECRET], [SECRET] and ABC-9981-QQRS-73"
    assert text[3] == 'x y3 api token = "[SECRET]" end'


def plain_contexts(t):
    """(start, end, left) of every candidate, word by word."""
    out, words, last = [], ["^", "^"], 0
    for m in re.finditer(r"[A-Za-z0-9_+/-]+", t):
        if len(m.group()) >= 12 and re.search("[0-9]", m.group()):
            words += re.sub(r"[^\w=:\s]+|\s+|_+", " ", t[last : m.start()].lower()).split()
            out.append((m.start(), m.end(), " ".join(words[-2:])))
            last = m.end()
    return out


def test_op8_contexts_are_whole(spark):
    random.seed(6)
    long = "w" * 90
    rows = [f"{long} {long} key-1234567890 x", "key-1234567890", "a key-1234567890 key-1234567891, key-1234567892 b: key-1234567893", "q" * 80 + "7" + " t " + "-" * 70 + "7", ""]
    rows += [" ".join(random.choice(["a=", "Bcd:", "tok-99999999", "e", "zz_0123456789_zz", "(f)"]) for _ in range(random.randint(0, 300))) for _ in range(60)]
    df = spark.createDataFrame(enumerate(rows), "doc_id long, text string")
    for r in df.select("text", pii.candidates(F.col("text")).alias("c")).collect():
        assert [(c["start"], c["end"], c["left"]) for c in r["c"]] == plain_contexts(r["text"])


def test_op8_redacts_in_pieces(spark, monkeypatch):
    random.seed(7)
    monkeypatch.setattr(pii, "PIECE", 7)
    rows = ["".join(random.choice(["a@b.cd ", "10.0.0.1", "\U0001f600 ", "word ", "+1 234 567 890 ", "4111111111111111,", "\n"]) for _ in range(random.randint(0, 400))) for _ in range(40)]
    df = spark.createDataFrame(enumerate(rows), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df, {"none": "^$"}).collect()}
    for i, t in enumerate(rows):
        out, at = [], 0
        for a, _, b, kind in plain_spans(t):
            if a >= at:
                out += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert got[i] == "".join(out) + t[at:]


# 9. quality classifier


def test_op9(spark, docs, edge, none):
    scorer = quality_classifier.train(docs)
    for df in (docs, edge):
        got = quality_classifier.score(df, scorer)
        assert got.count() == df.count()
    kept = quality_classifier.keep_good(edge, scorer)
    assert kept.columns == edge.columns
    assert quality_classifier.score(none, quality_classifier.train(none)).count() == 0


def test_op9_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.score(docs, quality_classifier.train(docs)).join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.97


def test_op9_expectation_maximisation():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.95])
    said = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    said[rng.random((20_000, 4)) < 0.2] = -1
    patterns, inverse, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    post, rates = quality_classifier.expect_maximise(patterns, counts)
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.93
    assert np.abs(rates[1, :, 2] / rates[1, :, 1:].sum(1) - right).max() < 0.03


# 10. byte-level BPE


def test_op10(docs, edge, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    plain.no_padding()
    with open(path) as f:
        content = f.read()
    for df in (docs, edge):
        want = Counter()
        for r in df.collect():
            ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
            text = plain.decode(ids, skip_special_tokens=False)
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.encode_digests(df, content).collect()) == want
    back = bpe.decode(bpe.encode(docs, content), content)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert bpe.encode_digests(none, content).count() == 0


def test_op10_cuts():
    from tokenizers import Tokenizer

    with open(queries.tokenizer_path()) as f:
        coder = bpe.Coder(f.read())
    plain = Tokenizer.from_file(queries.tokenizer_path())
    random.seed(0)
    letters = " \n\t\r\u2003\u3000ab'sé1<|>.!\x1c\x85\U0001f600\xa0à"
    some = ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(4000)] + ["a<|endoftext|> b", "\xa0 \xa0 x  "]
    for t, (ids, text) in zip(some, coder.code([t.encode() for t in some]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids and text.decode() == t


# the registered queries, and the pipeline, on whole tables with edge rows


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """The small tables with the edge rows in documents, all three columns more with clashing names."""
    home = str(tmp_path_factory.mktemp("tables"))
    rows = spark.createDataFrame(EDGE, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    rows = docs.unionByName(rows).withColumns({c: F.lit("clash") for c in ("__key", "node", "votes")}).repartition(5)
    rows.write.parquet(f"{home}/documents.parquet")
    for t in ("labels", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{home}/{t}.parquet")
    return home


@pytest.fixture(scope="module")
def table_rows(spark, folder):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def signed_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (h >> 63 << 64)


def plain_score(scorer, text):
    """The logistic score by its definition: word shapes, words and binned statistics at their hashed places."""
    data = (text or "").encode()
    if scorer.weights is None:
        return 1.0
    shape = "".join("A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c if c < "\x80" and not c.isalpha() else "a" for c in data.decode("latin-1"))
    values = dict(zip(textstats.FEATURES, textstats.statistics(data)[1], strict=True))
    margin = float(scorer.weights[-1])
    each = 1 / max(1, data.count(b" ") + data.count(b"\n") + 1)
    ascii_lower = re.sub("[A-Z]", lambda m: m.group().lower(), data.decode("latin-1"))
    for kind, body in (("s", re.sub(r"(?s)(.)\1+", r"\1", shape)), ("w", ascii_lower)):
        for w, c in Counter(re.findall(r"[^ \t-\r]+", body)).items():
            margin += float(scorer.weights[zlib.crc32(w.encode("latin-1"), zlib.crc32(kind.encode())) % 2**18]) * c * each
    for j in quality_classifier.BINNED:
        v = values[textstats.FEATURES[j]]
        margin += float(scorer.weights[zlib.crc32(b"%d:%d" % (j, sum(v > e for e in quality_classifier.EDGES))) % 2**18])
    return 1 / (1 + math.exp(-max(-50, min(50, margin))))


def test_op1_query(spark, folder, table_rows):
    got = queries.op1_suffix_dedup(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == repeats([r[:2] for r in table_rows])


def test_op1_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op1_suffix_dedup"])
    got = queries.op1_suffix_dedup(spark, SF)
    assert got.columns == want.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())


def test_op3_query(spark, folder, table_rows):
    n, df = len(table_rows), Counter()
    for r in table_rows:
        df.update({signed_hash(x) for x in regex.split(r"[^\p{L}\p{N}]+", (r[1] or "").lower()) if x})
    band = {t for t, c in df.items() if max(2.0, imatch.LOW * n) <= c <= imatch.HIGH * n}
    fp_of = functools.cache(lambda t: plain_fingerprint(t, band))
    rows = [(r[0], r[1] or "") for r in table_rows]
    assert Counter(tuple(r) for r in queries.op3_imatch(spark, folder).collect()) == Counter(plain_compared(rows, {t: fp_of(t) for _, t in rows}, fp_of))


def test_op4_query(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op4_mixing"])
    got = queries.op4_mixing(spark, SF)
    assert got.columns == want.columns
    plain = lambda r: (*r[:3], round(r[3], 6), *r[4:])
    assert Counter(plain(r) for r in got.collect()) == Counter(plain(r) for r in want.fetchall())


def test_op5_query(spark, folder, table_rows):
    got = queries.op5_simhash(spark, folder).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r[0], f"{plain_simhash(r[1]):016x}") for r in table_rows)
    lead = plain_leaders(table_rows)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((r[0], lead[plain_simhash(r[1])][0]) for r in table_rows)


def test_op6_query(spark, folder, table_rows):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    forest = quality_rules.train(spark.read.parquet(f"{folder}/documents.parquet"), labels)

    def kept(text):
        # every tree walked by itself, one row at a time
        base, values = textstats.statistics((text or "").encode())
        margin = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if values[f[node]] > t[node] else 1)
            margin += leaf[node - len(f)]
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        return failed, not failed and 1 / (1 + math.exp(-margin)) >= 0.5

    got = Counter((r["doc_id"], *(r[c] for c in textstats.BASE), r["base_failed"], r["kept"]) for r in queries.op6_quality_rules(spark, folder).collect())
    assert got == Counter((r[0], *plain_base(r[1]), *kept(r[1])) for r in table_rows)


def test_op7_query(spark, folder, table_rows):
    got = queries.op7_sharding(spark, folder).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in table_rows)
    per, at = Counter(), {}
    for r in got:
        per[r["shard"]] += r["size"]
        at.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    total, largest = sum(per.values()), max(size(r[1]) for r in table_rows)
    assert all(abs(per[s] - total / 16) <= 2 * max(largest, total / 16 / 64) for s in range(16))
    many = Counter(zlib.crc32((r[1] or "").encode()) for r in table_rows)
    # copies stay in one shard, unless there are more than a piece of one
    assert all(len(s) == 1 for (crc, n), s in at.items() if many[crc] * n <= total / 16 / 64)
    for s in range(16):
        rows = sorted((r["slot"], r["hilbert"]) for r in got if r["shard"] == s)
        assert [x[0] for x in rows] == list(range(len(rows))) and [x[1] for x in rows] == sorted(x[1] for x in rows)


def test_op7_levels_see_whole_values(spark):
    # values that differ after a long prefix, hot ones and null
    rows = [(i, "t" * (i % 9 + 1) + str(i), "en", v) for i, v in enumerate([None] * 40 + ["https://a.org"] * 160 + ["https://b.org"] * 100 + ["https://z.org"] * 100)]
    df = sharding.rows_of(spark.createDataFrame(rows, SCHEMA))
    got = {r["__v"]: r["__level"] for r in sharding.rank_levels(df, "__source", 4).collect()}
    assert got == {None: 0, "https://a.org": 1, "https://b.org": 8, "https://z.org": 12}
    rows = [(None, "same", "en", "a")] * 3000 + [(i, f"other {i} " * 3, "en", "b") for i in range(3000)]
    per = Counter()
    for r in sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect():
        per[r["shard"]] += r["size"]
    assert len(per) == 16 and max(per.values()) < 1.1 * sum(per.values()) / 16


def test_op8_query(spark, folder, table_rows):
    got = Counter((r["doc_id"], r["spans"]) for r in queries.op8_pii(spark, folder).collect())
    spans = plain_discovered(table_rows)
    assert got == Counter((r[0], ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans(r[1] or ""))) for r in table_rows)


def test_op9_query(spark, folder, table_rows):
    scorer = quality_classifier.train(spark.read.parquet(f"{folder}/documents.parquet"))
    got = Counter((r["doc_id"], r["kept"]) for r in queries.op9_quality_classifier(spark, folder).collect())
    assert got == Counter((r[0], plain_score(scorer, r[1]) >= 0.5) for r in table_rows)


def test_op2_query(spark, tmp_path):
    # planted rules: labels follow URL words; against an enumeration of all token sets
    random.seed(4)
    urls, labels = [], []
    for i in range(400):
        words_ = random.sample(["pills", "news", "shop", "win", "blog"], random.randint(1, 3))
        bad = "pills" in words_ or {"win", "shop"} <= set(words_)
        urls.append((i, f"http://{random.choice(['a', 'b'])}.site.org/{'-'.join(words_)}/{i}"))
        labels.append((i, int(not bad), 0))
    urls += [(1000, None), (1001, ""), (1002, "x" * 20_000), (1003, "http://h.org/" + "a/" * 5000 + "pills"), (1004, "http://example.com/en/pills"), (7, urls[7][1])]
    labels += [(3, 1 - labels[3][1], 0), (None, 1, 0)]
    spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    quality = {}
    for d, q, _ in labels:
        quality.setdefault(d, []).append(q)
    known = {}  # of each labelled URL its words and whether it is bad
    for _, u in urls:
        m = re.search(r"://[^?#]*/([0-9]+)$", u or "")
        if m and int(m.group(1)) in quality:
            known[u] = (set(re.split("[/-]", u.split("site.org/")[1].rsplit("/", 1)[0])) | {u[7]}, 1 - np.mean(quality[int(m.group(1))]) >= 0.5)
    share = np.mean([b for _, b in known.values()])
    need, least = max(0.5, url_filter.gain(share, 1.5)), max(0.001, 10 / len(known)) * len(known)
    every = set().union(*(w for w, _ in known.values()))
    rules = []
    for n in range(1, 5):
        for c in map(set, itertools.combinations(sorted(every), n)):
            bad = [b for w, b in known.values() if c <= w]
            if not any(r < c for r in rules) and sum(bad) >= least and np.mean(bad) >= need:
                rules.append(c)
    assert {"pills"} in rules and {"win", "shop"} in rules
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    want = set()
    for i, u in urls:
        words_ = known[u][0] if u in known else set(re.split("[/]", u or ""))
        if i == 1004:
            want.add((i, "example.com/en/", "block"))
        else:
            want.add((i, None, "block" if any(r <= words_ for r in rules) else "allow"))
    assert got == want
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = lambda found, names: Counter(tuple(r[names.index(c)] for c in ("page_id", "host", "path", "rule", "verdict", "mined")) for r in found)
    for home, one in ((str(tmp_path), con), (SF, None)):
        if one is None:
            one = duckdb.connect()
            for t in ("pages", "labels"):
                one.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want, df = one.sql(queries.ORACLE_SQL["op2_url_filter"]), queries.op2_url_filter(spark, home)
        assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/none/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert queries.op2_url_filter(spark, f"{tmp_path}/none").count() == 0


def plain_leaders(rows):
    """fingerprint -> the smallest (doc_id, fingerprint) of its component; ids of None come first."""
    first = {}
    for i, t, *_ in rows:
        fp = plain_simhash(t)
        first[fp] = min(first.get(fp, (math.inf,)), (-(2**63) if i is None else i,))
    names = {fp: (i[0], fp - (fp >> 63 << 64)) for fp, i in first.items()}
    component = plain_components({names[fp]: fp for fp in names})
    found = {fp: component[names[fp]] for fp in names}
    return {fp: (None if c[0] == -(2**63) else c[0], c) for fp, c in found.items()}


def plain_discovered(rows):
    """A function from a text to all its spans, the discovered ones by bootstrapping over all rows."""
    pairs = {(left, t[a:b]) for _, t, *_ in rows if t for a, b, left in plain_contexts(t)}
    looks = re.compile(pii.SEEDS["secret"])
    conf, strong = {v: float(bool(looks.search(v))) for _, v in pairs}, {}
    seed = dict(conf)
    for _ in range(pii.ROUNDS):
        by = {}
        for left, v in pairs:
            by.setdefault(left, []).append(conf[v])
        strong = {left: sum(c) / (len(c) + 0.5) for left, c in by.items()}
        strong = {left: s for left, s in strong.items() if len(by[left]) >= pii.LEAST_CANDIDATES and s >= pii.LEAST_SCORE}
        miss = {}
        for left, v in pairs:
            if left in strong:
                miss[v] = miss.get(v, 1.0) * (1 - 0.9 * min(strong[left], 0.999))
        conf = {v: max(seed[v], 1 - miss.get(v, 1.0)) for v in seed}
    return lambda t: sorted(plain_spans(t) + [(a, 4, b, "secret") for a, b, left in plain_contexts(t) if left in strong])


def test_pipeline(spark, folder, table_rows):
    import corpus_pipeline
    from tokenizers import Tokenizer

    scorer = quality_classifier.train(spark.read.parquet(f"{folder}/documents.parquet"))
    good = [r for r in table_rows if plain_score(scorer, r[1]) >= 0.5]
    lead, groups = plain_leaders(good), {}
    for r in good:
        fp = plain_simhash(r[1])
        if (r[0] if r[0] is not None else -(2**63)) == lead[fp][1][0]:
            place = (signed_hash(r[1]), zlib.crc32((r[1] or "").encode()), r[0] is not None, r[0] or 0, r[3] is not None, r[3] or "", r[2] is not None, r[2] or "")
            groups[lead[fp][1]] = min(groups.get(lead[fp][1], (place, r)), (place, r))
    kept = [r for _, r in groups.values()]
    spans, clean = plain_discovered(kept), []
    for i, t, _, source in kept:
        out, at = [], 0
        for a, _, b, kind in spans(t or ""):
            if a >= at:
                out += [(t or "")[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        clean.append((i, "".join(out) + (t or "")[at:], source))
    sizes = Counter()
    for _, t, source in clean:
        sizes[source] += len(words(t))
    target, start, times = plain_targets(dict(sizes)), Counter(), Counter()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for i, t, source in sorted(clean, key=lambda r: md5(("" if r[0] is None else str(r[0])) + ":" + md5(r[1]))):
        n, at, most = len(words(t)), start[source], math.floor(target[source] + 1e-9)
        taken = sum(max(0, min(n, most - at - e * sizes[source])) for e in (0, 1))
        start[source] += n
        if n:
            times[i, t, source] += math.floor(taken / n + 0.5)
    plain = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, t, source in clean:
        ids = plain.encode(t, add_special_tokens=False).ids
        row = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want[row] += times.pop((i, t, source), 0)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == +want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii", "mixing", "bpe_encode_decode"]


def test_pipeline_stages_keep_columns_and_empty_tables(spark, edge, none):
    import corpus_pipeline

    for df in (edge, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= (2 * df.count())
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()
