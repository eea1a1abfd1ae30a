"""Secret scans by character Markov models, in DataFrame functions only.

Base rules find assignments of secrets, access keys and hex strings.  Beside them, two character Markov models of first
order, one of random strings and one of ordinary identifiers, are trained from labelled samples; a token outside the
base spans whose log-likelihood ratio favours the random model is a span of kind ``markov``.  Tokens are read off a text in
which the base spans are blanks, kind after kind, so what stands beside a base span is judged by itself.

Samples.  Random: the values of the corpus' own base spans, and MADE strings of each of four encodings of hashes.  Ordinary:
whatever of the token alphabet stands in documents without a base span (words, numbers, codes), those words joined as
identifiers, constants and paths are, and MADE numbers, dates and rulers each.  Models see the same characters that they are asked about.

Offsets are sums of the lengths of matches and of what lies between, taken in blocks, so a text of many matches takes time in
proportion to them.

Defined results: a null text is empty and has no spans; ties and repeated rows are scanned row by row; offsets are code
points, end exclusive; letters in ``assign`` match in either ASCII case; with no labelled sample of one class both
models are uniform and no span is added; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of AKIA[A-Z0-9]+ with 20 or more characters: runs are greedy and maximal
HEX = r"[0-9a-f]{24,}"  # likewise the runs of [0-9a-f]+ with 24 or more
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
SHORT = r"[A-Za-z0-9+/_=-]{8,}"  # what ordinary samples are made of: shorter than a token, of the same characters
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1  # the last class holds every other character, and the token's begin
#: transitions of one token that count in full
FULL_WEIGHT = 64.0
#: weight of a character's own share against the transitions seen
BACK_OFF = 8.0
#: strings of each kind that are made by rule, for either model
MADE = 2000
#: matches in a block of a text
BLOCK = 256
#: log-likelihood ratio per transition, in nats, from which a token counts as random
THRESHOLD = 0.4


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _pairs(pieces: Column, text: Column, pattern: str) -> Column:
    """pieces: what lies between the matches (one more than matches) -> with the match that follows each, as (p, m)."""
    return F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """All matches, leftmost and non-overlapping, as array<struct<start, k, end, s>>: what lies between matches and the
    matches themselves add up to the offsets, in blocks of BLOCK matches and then over blocks."""
    k = KINDS.index(kind)
    empty = F.array().cast("array<struct<start:int,k:int,end:int,s:string>>")
    size = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def one(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["p"])
        own = F.array(F.struct(at.alias("start"), F.lit(k).alias("k"), (at + F.length(x["m"])).alias("end"), x["m"].alias("s")))
        return F.struct((acc["at"] + size(x)).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], own)).alias("out"))

    def over(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + size(x)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, begins, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), one)["out"]))

    cut = lambda pairs: F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK)), lambda i: F.slice(pairs, i, F.lit(BLOCK)))
    return _let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(pieces) > 1, _let(_let(_pairs(pieces, text, pattern), cut), over)).otherwise(empty))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def _blanker(pattern: str) -> Callable[[Column], Column]:
    """What makes of a text one with blanks, as many code points, for the spans of a base rule."""

    def blank(x: Column) -> Column:
        gone = F.repeat(F.lit(" "), F.length(x["m"]))
        return F.concat(x["p"], F.coalesce(F.when(F.length(_value(x["m"])) >= 6, gone).otherwise(x["m"]) if pattern == ASSIGN else gone, F.lit("")))

    def blanked(text: Column) -> Column:
        return _let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(pieces) > 1, F.array_join(F.transform(_pairs(pieces, text, pattern), blank), "")).otherwise(text))

    return blanked


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, base, tokens: the spans of the base rules in the order of (start, kind), and the tokens
    that the models are asked about.  One pass over the texts; no text is passed on."""
    text = F.col("text")
    assign = F.filter(_spans(text, ASSIGN, "assign"), lambda x: F.length(_value(x["s"])) >= 6)
    every = F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    based = docs.select("doc_id", whole_text().alias("text")).select("doc_id", "text", F.array_sort(every).alias("base"))
    left = text
    for rule in (ASSIGN, ACCESS, HEX):
        left = _let(left, _blanker(rule))
    tokens = _let(F.when(F.size("base") == 0, text).otherwise(left), lambda t: _spans(t, TOKEN, "markov"))
    return based.select("doc_id", "base", tokens.alias("tokens"))


def transitions(token: Column) -> Column:
    """Indices of a token's transitions in the SIDE x SIDE table."""
    chars = F.split(token, "")
    place = F.transform(chars, lambda c: F.position(c, F.lit(ALPHABET)))
    codes = F.transform(place, lambda p: F.when(p == 0, F.lit(SIDE - 1)).otherwise(p - 1))
    before = F.concat(F.array(F.lit(SIDE - 1)), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))))
    return F.zip_with(before, codes, lambda a, b: a * SIDE + b)


def train(samples: DataFrame) -> list[float]:
    """token, random (boolean) -> the table of log ratios, SIDE * SIDE numbers.  Distinct tokens count once, and the
    transitions of one longer than FULL_WEIGHT weigh as much as FULL_WEIGHT together, so that no one token makes the model.
    What reaches the driver is at most 2 * SIDE * SIDE sums."""
    once = samples.select("token", F.col("random").cast("boolean").alias("random")).where((F.length("token") > 0) & F.col("random").isNotNull()).distinct()
    each = once.select("random", F.least(F.lit(1.0), F.lit(FULL_WEIGHT) / F.length("token")).alias("w"), F.explode(transitions(F.col("token"))).alias("i"))
    counts = each.groupBy("random", "i").agg(F.sum("w").alias("count")).collect()
    table = {True: [0.0] * (SIDE * SIDE), False: [0.0] * (SIDE * SIDE)}
    for r in counts:
        table[r["random"]][r["i"]] = float(r["count"])
    if not any(table[True]) or not any(table[False]):
        return [0.0] * (SIDE * SIDE)

    def logs(t: list[float]) -> list[float]:
        """Transitions, backed off to the characters' own shares: what a row has not seen is as likely as the character is."""
        share = [sum(t[b::SIDE]) + 0.5 for b in range(SIDE)]
        share = [x / sum(share) for x in share]
        out = []
        for a in range(SIDE):
            row = t[a * SIDE : (a + 1) * SIDE]
            total = sum(row) + BACK_OFF
            out += [math.log((x + BACK_OFF * p) / total) for x, p in zip(row, share, strict=True)]
        return out

    return [a - b for a, b in zip(logs(table[True]), logs(table[False]), strict=True)]


def score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    table = F.array(*[F.lit(round(x, 6)) for x in ratios])
    ways = transitions(token)
    return F.aggregate(ways, F.lit(0.0), lambda a, i: a + F.get(table, i)) / F.greatest(F.size(ways), F.lit(1))


def _made(spark: SparkSession) -> DataFrame:
    """Samples made by rule: token, random."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample "), i.cast("string")), 256)
    coded = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = [coded, F.left(digest, F.lit(40)), F.upper(F.translate(coded, "+/", "")), F.translate(coded, "+/", "")]
    number = F.conv(F.left(digest, F.lit(13)), 16, 10)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (i * 11).cast("int")), "yyyy-MM-dd")
    clock = F.concat(day, F.lit("T"), F.lpad((i % 24).cast("string"), 2, "0"), F.lit("-"), F.lpad((i * 7 % 60).cast("string"), 2, "0"))
    ruler = F.repeat(F.substr(F.lit("-=_/+0xX"), (i % 8 + 1).cast("int"), F.lit(1)), (i % 60 + 8).cast("int"))
    ordinary = [number, day, clock, ruler]
    rows = spark.range(MADE).select(F.explode(F.array(*[F.struct(t.alias("token"), F.lit(r).alias("random")) for r, ts in ((True, random), (False, ordinary)) for t in ts])).alias("x"))
    return rows.select("x.token", "x.random")


def labelled_samples(docs: DataFrame, spanned: DataFrame, sample_docs: int = 4000) -> DataFrame:
    """Labelled tokens: token, random.  The values in base spans are random strings, and come from every document; the ordinary
    ones, which outnumber them, come from the `sample_docs` documents without a base span that have the smallest hash of
    their id (the bound of the fit).  Those made by rule are added."""
    value = F.when(F.col("b.k") == 0, _value(F.col("b.s"))).otherwise(F.col("b.s"))
    random = spanned.select(F.explode("base").alias("b")).select(value.alias("token"), F.lit(True).alias("random"))
    few = spanned.where(F.size("base") == 0).select(F.col("doc_id").alias("few")).orderBy(F.xxhash64("few"), "few").limit(sample_docs).distinct()
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(SHORT), F.lit(0)))
    words = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("few"), "left_semi").select(found.alias("words"))
    after = F.slice("words", F.lit(2), F.size("words"))
    by = lambda s: lambda a, b: F.concat(a, F.lit(s), b)
    joined = [F.zip_with("words", after, by(s)) for s in ("_", "-", "/")] + [F.zip_with("words", after, lambda a, b: F.concat(a, F.initcap(b))), F.zip_with("words", after, lambda a, b: F.upper(F.concat(a, F.lit("_"), b)))]
    every = F.concat("words", *[F.filter(j, lambda x: x.isNotNull()) for j in joined])
    ordinary = words.select(F.explode(every).alias("token"), F.lit(False).alias("random"))
    return random.unionAll(ordinary).unionAll(_made(docs.sparkSession))


def scan(spanned: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Output of spans -> doc_id, base, added: arrays of (start, k, end, s); added holds the tokens that the models call
    random."""
    return spanned.select("doc_id", "base", F.filter("tokens", lambda t: score(t["s"], ratios) >= threshold).alias("added"))


def written(listed: Column) -> Column:
    """kind:start:end, comma-joined, of listed spans in order."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
