"""Set-similarity join (prefix filtering).

Two token sets with Jaccard similarity of at least ``t`` share a token among the first
``n - ceil(t * n) + 1`` tokens of each, in any order that is the same for both.  With the rarest tokens first, a join
on those tokens meets few pairs that are not similar.  Only keys, sizes, positions and a signature of a few hundred bits
travel through that join; the signatures bound the overlap from above, so most pairs that merely share a frequent word
end where they meet, and token sets are fetched for the surviving pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremorline.functions.plan import once
from tremorline.functions.text import jaccard
from tremorline.operators.numbering import numbered
from tremorline.session import cut_lineage

#: Longs of a signature.
LONGS = 8


def set_key(tokens: Column) -> Column:
    """A short key of a token set; null for the empty set."""
    return F.when(F.size(tokens) > 0, F.unhex(F.md5(F.array_join(tokens, " "))))


def rarest_first(sets: DataFrame, key: list[str], within: list[str] | None = None) -> DataFrame:
    """``sets`` (``key``, ``tokens``) with ``ordered``: the tokens by number of sets that have them, then by name.

    ``key`` is unique; ``within`` names those of its columns that keep sets apart (none: all are counted together).
    """
    within = within or []
    words = sets.select(*key, F.explode("tokens").alias("word"))
    counts = words.groupBy(*within, "word").agg(F.count("*").alias("n"))
    ordered = (words.join(counts, [*within, "word"]).groupBy(*key)
               .agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("_o")))
    return sets.join(ordered.select(*key, F.col("_o.word").alias("ordered")), key)


def coded_sets(sets: DataFrame, key: str, within: list[str] | None = None) -> DataFrame:
    """``key, tokens`` with numbers in place of words, the word that fewest sets have being the least; sorted, so rarest
    first.  Words are counted and numbered apart for each value of the columns ``within``."""
    within = within or []
    words = sets.select(key, *within, F.explode("tokens").alias("word"))
    counts = words.groupBy(*within, "word").agg(F.count("*").alias("n"))
    codes = numbered(counts, [F.col("n"), *map(F.col, within), F.col("word")], "code", 0).select(*within, "word", "code")
    return words.join(codes, [*within, "word"]).groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("tokens"))


def prefix(ordered: Column, threshold: float) -> Column:
    """The part of an ordered set in which a partner at or above ``threshold`` must share a token."""
    n = F.size(ordered)
    return F.slice(ordered, F.lit(1), n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1)


def enough_left(threshold: float | Column, a_at: Column, a_size: Column, b_at: Column, b_size: Column) -> Column:
    """Can two sets that share the tokens at these positions (from 0), the first they share, still be similar enough?"""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    needed = F.ceil((a_size + b_size) * (t / (1 + t)) - F.lit(1e-9))
    return F.least(a_at, b_at) + F.least(a_size - a_at, b_size - b_at) >= needed


def signature(tokens: Column) -> Column:
    """``LONGS`` longs in which each token of a set sets one bit, by its hash."""
    bits = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * LONGS)))

    def long(i: int) -> Column:
        mine = F.filter(bits, lambda b: F.floor(b / 64) == i)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))

    return F.array(*[long(i) for i in range(LONGS)])


def enough_shared(threshold: float | Column, a_sign: str, a_size: Column, b_sign: str, b_size: Column) -> Column:
    """Can two sets of these signatures be similar enough?  Each bit that only one has is a token the other lacks."""
    def alone(x: str, y: str) -> Column:
        out = F.lit(0)
        for i in range(LONGS):
            out = out + F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i)))))
        return out

    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    needed = F.ceil((a_size + b_size) * (t / (1 + t)) - F.lit(1e-9))
    return (a_size - alone(a_sign, b_sign) >= needed) & (b_size - alone(b_sign, a_sign) >= needed)


def prefix_words(sets: DataFrame, threshold: float, coded: bool = False) -> DataFrame:
    """``set_key, size, sign, at, word``: the prefix of each of ``sets`` (``set_key, tokens``; ``coded`` by
    ``coded_sets``), with its signature."""
    ordered = sets.withColumn("ordered", F.col("tokens")) if coded else rarest_first(sets, ["set_key"])
    signed = once(ordered, "sign", signature(F.col("ordered")))
    return cut_lineage(signed.select("set_key", F.size("ordered").alias("size"), "sign",
                                     F.posexplode(prefix(F.col("ordered"), threshold)).alias("at", "word")))


def in_prefix(at: Column, size: Column, threshold: Column) -> Column:
    """Does a position lie in the prefix for ``threshold``?"""
    return at <= size - F.ceil(size * threshold - F.lit(1e-9))


def similar_sets(left: DataFrame, right: DataFrame, block: list[str], sets: DataFrame, threshold: float,
                 below: float | None = None, words: DataFrame | None = None) -> DataFrame:
    """Pairs of token sets that occur in a common block and have similarity of at least ``threshold``.

    ``left``, ``right``: the ``block`` columns and ``set_key``; ``sets``: ``set_key, tokens`` of both sides.  A column
    ``least`` of ``left``, not under ``threshold``, asks for pairs of at least that similarity only; ``below`` leaves out
    pairs of that similarity or more.  ``words``: ``prefix_words(sets, t)`` for some ``t`` up to ``threshold``, if at hand.
    Output: ``a, b, similarity``, each pair once.  Keys of type int, from 0 on, are cheapest: a pair of them travels as one
    number once for each word and block it meets in.
    """
    words = prefix_words(sets, threshold) if words is None else words
    least = F.least(F.min("least"), F.lit(1.0)) if "least" in left.columns else F.lit(float(threshold))
    left = left.groupBy(*block, "set_key").agg(least.alias("least"))
    right = right.select(*block, "set_key").distinct().withColumn("least", F.lit(float(threshold)))

    def worded(side: DataFrame, name: str) -> DataFrame:
        return side.join(words, "set_key").where(in_prefix(F.col("at"), F.col("size"), F.col("least"))).select(
            F.xxhash64(*block, "word").alias("met"), F.col("set_key").alias(name), F.col("size").alias(f"{name}_size"),
            F.col("at").alias(f"{name}_at"), F.col("sign").alias(f"{name}_sign"), F.col("least").alias(f"{name}_least"))

    asked = F.col("a_least")
    fits = enough_left(asked, F.col("a_at"), F.col("a_size"), F.col("b_at"), F.col("b_size"))
    fits = fits & enough_shared(asked, "a_sign", F.col("a_size"), "b_sign", F.col("b_size"))
    if below is not None and below <= 1:
        fits = fits & (F.col("a") != F.col("b"))
    # blocks and words meet by hash: a chance meeting is one more pair to check
    met = worded(left, "a").join(worded(right, "b").drop("b_least"), "met").where(fits)
    if dict(sets.dtypes)["set_key"] == "int":
        pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
        pairs = cut_lineage(met.select(pair.alias("pair")).distinct()).select(
            F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"))
        pairs = pairs.join(left.groupBy(F.col("set_key").alias("a")).agg(F.min("least").alias("least")), "a")
    else:
        pairs = cut_lineage(met.groupBy("a", "b").agg(F.min("a_least").alias("least")))
    of = lambda name: sets.select(F.col("set_key").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    checked = pairs.join(of("a"), "a").join(of("b"), "b").select(
        "a", "b", "least", jaccard(F.col("a_tokens"), F.col("b_tokens")).alias("similarity"))
    found = checked.where(F.col("similarity") >= F.col("least")).drop("least")
    return found if below is None else found.where(F.col("similarity") < F.lit(float(below)))
