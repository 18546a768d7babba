"""Operator 7: I-Match document fingerprints, in DataFrame functions only.

The terms of a text are its distinct runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case.
The lexicon is made of the terms whose inverse document frequency log(N / df), df counted over all documents, lies in
a band.  Its lower edge is ``low`` times log(N).  Its upper edge is log(``most`` / m), m being the mean number of
distinct terms of a document: a term needs at least one of ``most`` of all pairs of a document and a term.  So there
are at most ``most`` lexicon terms over any corpus, of any size, and the edge doesn't move as a corpus grows.
A fingerprint has one part for each of several random subsets of the lexicon: the hash of the document's distinct
terms in the subset, in sorted order.  Subsets of different density react to changes of different size, so the share
of equal parts grades how alike two texts are.

Whether a term is in the lexicon is decided by the whole term (by its MD5 beyond 32 characters): the lexicon is a
constant array of buckets, each a string of its terms, so no text or term has to be shuffled for it.

A text without lexicon terms (an empty one, say) gets the hash of the whole text after "=", so equal texts, and
only these, have equal fingerprints then too.  Null texts are empty.  Repeated rows get the same fingerprint.  An
empty table gives an empty result.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualitas.session import work_folder, written

#: Lower edge of the band of the inverse document frequency, in parts of log(N).
LOW = 0.1
#: The lexicon has this many terms at most.
MOST = 1 << 18
BUCKETS = 1 << 16
#: Each subset of the lexicon takes the terms in whose hash ``width`` bits from ``first`` on have a value, so a
#: 2**width-th of them: 4 quarters, 16 sixteenths in the quarters, and in each of these a 64th, a 256th and a 1024th.
FIRST = 24
_SIXTEENTHS = [v + 4 * w for v in range(4) for w in range(4)]
SUBSETS = [(FIRST, 2, v) for v in range(4)] + [(FIRST, width, v) for width in (4, 6, 8, 10) for v in _SIXTEENTHS]
#: Hexadecimal digits of a part.
DIGITS = 8
NOT_TERMS = r"[\x00-/:-@\[-`{-\x7f]+"
_NO_KEY = -(1 << 63)


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.filter(F.split(lower, NOT_TERMS), lambda t: t != ""))


def term_hash(term: Column) -> Column:
    """60 bits of the term's MD5."""
    return F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("long")


def _name(term: Column) -> Column:
    """What a term is called in its bucket: itself, or its MD5 behind a character that no term has."""
    return F.concat(F.lit(";"), F.when(F.length(term) > 32, F.concat(F.lit("."), F.md5(term))).otherwise(term), F.lit(";"))


def _bucket(term_hash: Column) -> Column:
    return term_hash.bitwiseAND(BUCKETS - 1).cast("int")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term, df`` of every term, written."""
    return written(docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term")
                   .agg(F.count(F.lit(1)).alias("df")), work_folder(docs.sparkSession, "document-frequencies"))


def in_band(frequencies: DataFrame, documents: int, low: float = LOW, most: int = MOST) -> DataFrame:
    """The lexicon's terms, at most ``most``: frequencies that are each 1 / ``most`` of their sum can't be more."""
    pairs = frequencies.agg(F.coalesce(F.sum("df"), F.lit(0))).scalar()
    return frequencies.where((F.col("df") * most >= pairs) & (F.col("df") <= F.pow(F.lit(documents), F.lit(1 - low))))


def lexicon(docs: DataFrame, low: float = LOW, most: int = MOST) -> Column:
    """The terms in the band by buckets, as a constant: an array of strings."""
    found = in_band(document_frequencies(docs), docs.count(), low, most).select(
        _bucket(term_hash(F.col("term"))).alias("bucket"), _name(F.col("term")).alias("name")).collect()
    buckets = [""] * BUCKETS                    # ``most`` names at most, of 35 characters at most
    for row in found:
        buckets[row["bucket"]] += row["name"]
    # a constant that Spark folds into an array once; it travels with the plan, so nothing is joined
    return F.split(F.lit(",".join(buckets)), ",")


def fingerprint(text: Column, buckets: Column) -> Column:
    """The fingerprint of a text for a lexicon: one hash for each subset, joined by "-"."""
    def known(t):
        return F.contains(F.element_at(buckets, _bucket(t["hash"]) + 1), _name(t["term"]))

    hashed = F.transform(terms(text), lambda t: F.struct(t.alias("term"), term_hash(t).alias("hash")))
    kept = F.array_sort(F.filter(hashed, known))

    def bits_are(t, first, value):
        return F.shiftright(t["hash"], first).bitwiseAND(3) == value

    def split(terms):
        """The four subsets of a set by the next two bits ``first``."""
        return lambda first: F.transform(F.array(*[F.lit(v) for v in range(4)]), lambda v: F.filter(
            terms, lambda t: bits_are(t, first, v)))

    def thinned(sets, first):
        return F.transform(sets, lambda g: F.filter(g, lambda t: bits_are(t, first, 0)))

    def bound(value, use):
        """``use(value)`` with the value computed once: a lambda's variable stands for it."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def part(chosen):
        return F.when(F.size(chosen) > 0, F.substring(F.md5(F.array_join(
            F.transform(chosen, lambda t: t["term"]), " ")), 1, DIGITS)).otherwise("")

    def parts(quarters):
        def deeper(sixteenths):
            def deepest(s64):
                def last(s256):
                    return F.concat(quarters, sixteenths, s64, s256, thinned(s256, FIRST + 8))
                return bound(thinned(s64, FIRST + 6), last)
            return bound(thinned(sixteenths, FIRST + 4), deepest)
        sixteenths = F.flatten(F.transform(quarters, lambda q: split(q)(FIRST + 2)))
        return F.concat_ws("-", F.transform(bound(sixteenths, deeper), part))

    return bound(kept, lambda k: F.when(F.size(k) > 0, bound(split(k)(FIRST), parts)).otherwise(
        F.concat(F.lit("="), F.md5(text))))


def likeness(one: Column, other: Column) -> Column:
    """Share of equal parts among those that either fingerprint has; 1 for equal fingerprints."""
    pairs = F.arrays_zip(F.split(one, "-").alias("a"), F.split(other, "-").alias("b"))
    own = F.filter(pairs, lambda p: (F.coalesce(p["a"], F.lit("")) != "") | (F.coalesce(p["b"], F.lit("")) != ""))
    return F.when(one == other, 1.0).otherwise(
        F.size(F.filter(own, lambda p: p["a"] == p["b"])) / F.size(own)).cast("double")


def _tree(key: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds up to ``key``, found by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(key < bounds[middle], _tree(key, bounds[:middle], first)).otherwise(
        _tree(key, bounds[middle + 1:], first + middle + 1))


def with_next(docs: DataFrame, carried: list[str], id_col: str = "doc_id") -> DataFrame:
    """Every row with ``next_<c>`` of the following row by ascending id; the first follows the last.

    Ids are dealt into ranges of about equal size; the first row of each range is sent to the range before too,
    so each range is ordered on its own.  Null ids come first, equal ids in the order of the carried columns.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_KEY))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bucket = _tree(F.col("_key"), sorted(set(cuts)))
    keyed = docs.select(F.col(id_col), *carried, key.alias("_key"))
    firsts = sorted((r["_bucket"], r["first"]) for r in keyed.select("_key", bucket.alias("_bucket")).groupBy("_bucket")
                    .agg(F.min("_key").alias("first")).collect())       # a row for each range
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    home = F.struct(bucket.alias("bucket"), F.lit(False).alias("copy"))
    copies = F.array(home)
    for chunk in ([*before.items()][i:i + 500] for i in range(0, len(before), 500)):
        target = F.element_at(F.create_map(*[F.lit(x) for pair in chunk for x in pair]), F.col("_key"))
        copies = F.when(F.col("_key").isin([k for k, _ in chunk]), F.array(
            home, F.struct(target.alias("bucket"), F.lit(True).alias("copy")))).otherwise(copies)
    order = Window.partitionBy("_at.bucket").orderBy("_at.copy", "_key", *carried)
    return (keyed.withColumn("_at", F.explode(copies))
            .select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
            .where(~F.col("_at.copy")).drop("_key", "_at"))


def edited(text: Column, following: Column) -> Column:
    """The text with the last half of its code points replaced by as many first ones of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
