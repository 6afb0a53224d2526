"""Pairs of similar strings without comparing all pairs: chunks of one side meet the grams of the other.

A text of n letters that d insertions and deletions make into another is cut into disjoint chunks of q letters. An
edit spoils one chunk at most, so that of any d + 1 chunks one is in the other text unchanged; the rarest d + 1 are looked up among
the other side's q-grams. No pair is lost. Keys grow with a text's length: d + 1 on one side, n on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fills up the last chunk of a text or token, which so stands for its end too.
_END = "\x01"
#: Rows of one key on either side that meet in one place; a key with more is dealt out.
MOST = 2000


def edit_share(least: float) -> float:
    """Insertions and deletions for each letter of a text, at most, that leave a ratio 2 x common / total of ``least``.

    The other text is longer by the factor (2 - least) / least at most.
    """
    return (1 - least) * 2 / least


def _edits(total: Column, least: float) -> Column:
    """Insertions and deletions that a ratio of ``least`` allows texts of a total length."""
    return F.floor((1 - least) * total + 1e-9).cast("int")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to as many tasks as shuffles have by setting: small tables of costly pairs else end up in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def salted_join(left: DataFrame, right: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """Inner join on one key; of a key with over ``most`` rows on a side, the rows of that side are dealt out and the other side's copied to each deal."""
    n = left.groupBy(key).agg(F.count("*").alias("n_left")).join(right.groupBy(key).agg(F.count("*").alias("n_right")), key)
    hot = n.filter((F.col("n_left") > most) | (F.col("n_right") > most)).select(key, F.ceil(F.col("n_left") / most).alias("lefts"), F.ceil(F.col("n_right") / most).alias("rights"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        cells = side.join(hot, key, "left")
        mine = F.pmod(F.xxhash64(*(F.col(c) for c in side.columns)), F.coalesce(own, F.lit(1)))
        return cells.withColumn(f"{own}_at", mine).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))).drop("lefts", "rights")

    at = [key, "lefts_at", "rights_at"]
    met = spread(dealt(left, "lefts", "rights"), *at).join(spread(dealt(right, "rights", "lefts"), *at), at)
    return met.drop("lefts_at", "rights_at")


def _padded(token: Column, q: int) -> Column:
    return F.concat(token, F.lit(_END * (q - 1)))


def grams(tokens: Column, q: int) -> Column:
    """The distinct q-grams of each token, filled up at its end."""
    of = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(_padded(t, q), i, F.lit(q)))
    return F.array_distinct(F.flatten(F.transform(F.filter(tokens, lambda t: t != ""), of)))


def chunks(tokens: Column, q: int) -> Column:
    """The disjoint chunks of each token, in order, repeated ones too."""
    of = lambda t: F.transform(F.sequence(F.lit(0), F.ceil(F.length(t) / q).cast("int") - 1), lambda i: F.substring(_padded(t, q), i * q + 1, F.lit(q)))
    return F.flatten(F.transform(F.filter(tokens, lambda t: t != ""), of))


def sharing_chunks(left: DataFrame, right: DataFrame, a: str, b: str, least: float, by_token: bool) -> DataFrame:
    """Distinct pairs (a, b) of texts that may reach the ratio ``least``.

    left: a and its tokens; right: b and its tokens. With ``by_token`` tokens count as sets and may stand in any order: common ones
    are thought of as first, in the same order, as the token set ratio has them; otherwise each text is its only token.
    """
    share = edit_share(least)
    # a token of t letters has t / q chunks at least, or (t + 1) / (q + 1) counted with its space
    q = max(1, int(1 / share - 1e-9) - by_token)
    posted = right.select(b, F.explode(grams(F.col("tokens"), q)).alias("key"))
    counts = posted.groupBy("key").agg(F.count("*").alias("n"))
    cut = left.select(a, F.length(F.array_join("tokens", " ")).alias("size"), F.posexplode(chunks(F.col("tokens"), q)).alias("at", "key"))
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")))
    first = cut.join(counts, "key", "left").groupBy(a, "size").agg(rare.alias("rare"))
    first = first.select(a, F.explode(F.slice("rare", F.lit(1), F.floor(share * F.col("size") + 1e-9).cast("int") + 1)).alias("one")).filter("one.n > 0").select(a, F.col("one.key").alias("key")).distinct()
    return spread(salted_join(first, posted, "key").select(a, b), a, b).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Distinct pairs (a of left, b of right) that may reach the ratio 2 x common / total of ``least``.

    All that reach it are there; the others are near it, since only replacements count for less here.
    """
    xs = left.select(a).filter(F.col(a) != "").distinct().withColumn("tokens", F.array(a))
    ys = right.select(b).filter(F.col(b) != "").distinct().withColumn("tokens", F.array(b))
    met, budget = sharing_chunks(xs, ys, a, b, least, False), _edits(F.length(a) + F.length(b), least)
    return met.filter((F.abs(F.length(a) - F.length(b)) <= budget) & (F.call_function("levenshtein", F.col(a), F.col(b), budget) >= 0))
