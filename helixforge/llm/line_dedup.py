"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are near copies if one edit (an inserted, deleted or replaced code point) turns one into the other and that is
at most a fifth of the longer one.  A line goes if an earlier line, in the order of (doc_id, hash of the text, line
number), equals it or is a near copy of it.  Earlier lines count whether or not they go themselves.

An edit lies in one half of a line, so near copies share the other half.  Every distinct line is keyed by its halves,
and only lines that share one go on, in classes; there the other half is cut again, until what may hold the edit is at
most SEGMENT code points long.  Of those all deletion variants are emitted as hashed keys (place of the deletion and hash
of what is left, in its class), equal variants are joined, and the lines are compared whole.  Under one such key, lines
differ at one place only, so its members are all near copies of each other, no more than there are letters, and the
earliest of them stands for the rest: no pairs within a class are made.

Defined results: a null text is one empty line; blank lines always stay; lines of fewer than five code points need an
equal line to go; rows that repeat a doc_id and a text are one document, and all of them get its result; an empty table
gives no rows; further columns are ignored, or returned as they are by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, join_counted, marked, materialize, whole_text

SEGMENT = 256
LEAST = 5  # one edit is at most a fifth of so many code points


def _hash2(line: Column) -> list[Column]:
    """128 bits of a line, from two seeds."""
    return [F.xxhash64(line).alias("l1"), F.xxhash64(F.lit(7), line).alias("l2")]


def _lines(docs: DataFrame) -> DataFrame:
    text = whole_text()
    each = docs.select("doc_id", F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    return each.where(F.trim(F.translate("line", "\t\r\x0b\x0c", "    ")) != "").select("doc_id", "h", "n", "line")


def _half(seg: Column, n: Column, m: Column, side: Column, cls: Column) -> tuple[Column, Column]:
    """Key of the half that is shared, and the rest of seg (n code points; the shorter of two partners has m)."""
    p = F.floor(m / 2).cast("int")
    q = m - p
    shared = F.when(side == 0, F.left(seg, p)).otherwise(F.right(seg, q))
    rest = F.when(side == 0, F.substr(seg, p + 1)).otherwise(F.left(seg, n - q))
    return F.xxhash64(cls, m, side, shared), rest


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: doc_id, h, n, l1, l2, len, and the keys of its halves for partners as long as itself or
    longer (0, 1) and for shorter ones (2, 3)."""
    n = F.length("line")
    keys = F.array(*[_half(F.col("line"), n, n - c // 2, F.lit(c % 2), F.lit(0))[0] for c in range(4)])
    return _lines(docs).select("doc_id", "h", "n", *_hash2(F.col("line")), n.alias("len"), F.when(n >= LEAST - 1, keys).alias("keys"))


def _with_partners(items: DataFrame, key: str) -> DataFrame:
    """The items whose key another distinct item has.  An item has a key once."""
    several = materialize(items.groupBy(key).agg(F.count("*").alias("__c")).where("__c > 1"), "lines-keys")
    total = several.agg(F.sum("__c")).first()[0] or 0
    return join_counted(items, several, [key], total, "__c").drop("__c")


def _texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """l1, l2, first of some distinct lines -> l1, l2, line.  A line's text is taken from where it first stands: a bitmap of
    these places, of bounded size, goes to all tasks and keeps nearly all else from the shuffle.  What passes is one row a line
    in each task before it is shuffled; the join after it is exact."""
    place = F.xxhash64("first.doc_id", "first.h", "first.n")
    own = _lines(docs).select("line", *_hash2(F.col("line")), F.xxhash64("doc_id", "h", "n").alias("at"))
    near = marked(own, F.col("at"), bitmap(lines, place)).where("hit").groupBy("l1", "l2").agg(F.first("line").alias("line"))
    return near.join(lines.select("l1", "l2"), ["l1", "l2"], "left_semi")


def _variants(items: DataFrame) -> DataFrame:
    """l1, l2, first, cls, short, seg -> l1, l2, first, v: the deletion variants of each segment, and for the shorter partner
    the segment itself at every place where the longer one may have one code point more."""
    n = F.length("seg")
    gone = lambda i: F.xxhash64("cls", i, F.lit(1), F.concat(F.left("seg", i - 1), F.substr("seg", i + 1)))
    # what is left of the longer partner, and the shorter one as it is, must get equal keys: both say "shorter"
    own = lambda i: F.xxhash64("cls", i, F.lit(0), F.col("seg"))
    gone_long = lambda i: F.xxhash64("cls", i, F.lit(0), F.concat(F.left("seg", i - 1), F.substr("seg", i + 1)))
    none = F.array().cast("array<bigint>")
    cut = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    keys = F.when(F.col("short"), F.concat(F.transform(cut, gone), F.transform(F.sequence(F.lit(1), n + 1), own))).otherwise(
        F.coalesce(F.transform(cut, gone_long), none)
    )
    return items.select("l1", "l2", "first", F.explode(keys).alias("v"))


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """l1, l2 of the distinct lines that have an earlier near copy."""
    keyed = distinct.where("keys is not null").select("l1", "l2", "first", F.posexplode("keys").alias("c", "key"))
    some = materialize(_with_partners(keyed, "key"), "lines-halves")
    texts = materialize(_texts(docs, some.select("l1", "l2", "first").distinct()), "lines-texts")
    n = F.length("line")
    m = n - F.floor(F.col("c") / 2).cast("int")
    _, rest = _half(F.col("line"), n, m, F.col("c") % 2, F.lit(0))
    items = some.join(texts, ["l1", "l2"]).select("l1", "l2", "first", F.col("key").alias("cls"), (F.col("c") < 2).alias("short"), rest.alias("seg"))
    done = []
    while True:
        items = materialize(items, "lines-segments")
        long = F.length("seg") > SEGMENT + F.when(F.col("short"), 0).otherwise(1)  # partners go on together
        done.append(items.where(~long))
        left = items.where(long)
        if left.isEmpty():
            break
        n = F.length("seg")
        m = n - F.when(F.col("short"), 0).otherwise(1)
        sides = left.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        key, rest = _half(F.col("seg"), n, m, F.col("side"), F.col("cls"))
        cut = sides.select("l1", "l2", "first", "short", key.alias("key"), rest.alias("seg"))
        items = _with_partners(cut, "key").select("l1", "l2", "first", F.col("key").alias("cls"), "short", "seg")
    ready = done[0]
    for d in done[1:]:
        ready = ready.unionAll(d)
    own = F.struct("first", "l1", "l2")
    met = _variants(ready).groupBy("v").agg(F.collect_set(own).alias("who")).where(F.size("who") > 1)
    pairs = met.select(F.array_min("who").alias("e"), F.explode("who").alias("o")).where("e.first < o.first")
    pairs = pairs.select(F.col("o.l1").alias("l1"), F.col("o.l2").alias("l2"), F.col("e.l1").alias("e1"), F.col("e.l2").alias("e2")).distinct()
    other = texts.select(F.col("l1").alias("e1"), F.col("l2").alias("e2"), F.col("line").alias("earlier"))
    both = pairs.join(texts, ["l1", "l2"]).join(other, ["e1", "e2"])
    same = (F.levenshtein("line", "earlier", 1) >= 0) & (F.greatest(F.length("line"), F.length("earlier")) >= LEAST)
    return both.where(same).select("l1", "l2").distinct()


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, h, lines: for each document that loses lines their numbers, from 0, in order."""
    docs = docs.select("doc_id", "text")
    found = materialize(occurrences(docs), "lines")
    at = F.struct("doc_id", "h", "n")
    distinct = found.groupBy("l1", "l2").agg(F.min(at).alias("first"), F.count("*").alias("cnt"), F.first("keys").alias("keys"))
    distinct = materialize(distinct, "lines-distinct")
    near = _near(docs, distinct.select("l1", "l2", "first", "keys")).select("l1", "l2", F.lit(True).alias("near"))
    flagged = distinct.select("l1", "l2", "first", "cnt").join(near, ["l1", "l2"], "left").where("cnt > 1 or near")
    flagged = materialize(flagged.select("l1", "l2", "first", "cnt", F.coalesce("near", F.lit(False)).alias("near")), "lines-marked")
    rows = found.select("doc_id", "h", "n", "l1", "l2")
    hit = join_counted(rows, flagged, ["l1", "l2"], found.count(), "cnt").where(F.col("near") | (F.col("first") < at))
    return hit.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("n")).alias("lines"))


def report(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 1, comma-joined)."""
    text = whole_text()
    own = docs.select("doc_id", F.xxhash64(text).alias("h"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    some = gone.select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "lines")
    both = own.join(some, own["doc_id"].eqNullSafe(some["g_id"]) & (own["h"] == some["g_h"]), "left")
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return both.select("doc_id", "n_lines", F.size(lines).cast("long").alias("n_removed"), F.array_join(F.transform(lines, lambda i: (i + 1).cast("string")), ",").alias("removed"))


def apply(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the removed lines; columns as in docs, n_chars (if there) as long as the new text.  A null text stays."""
    some = gone.select(F.col("doc_id").alias("__g_id"), F.col("h").alias("__g_h"), F.col("lines").alias("__lines"))
    own = docs.withColumn("__h", F.xxhash64(whole_text()))
    both = own.join(some, own["doc_id"].eqNullSafe(some["__g_id"]) & (own["__h"] == some["__g_h"]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__lines", i)), "\n")
    cut = both.withColumn("text", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cut = cut.withColumn("n_chars", F.when(F.col("__lines").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return cut.select(*docs.columns)
