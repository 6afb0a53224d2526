"""Names matched to target names: alias, exact, then the best of three similarities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio, ratio_of, token_set_of, token_sort, token_sort_of
from ..functions.text import normalized, with_alias
from ..sources.scratch import staged
from .similar_pairs import similar_pairs

THRESHOLD = 90


def _best_target(targets: list[str], threshold: int):
    """The place of the first target with the best score of at least ``threshold``, and that score."""

    @F.pandas_udf("place int, score int")
    def run(norms: pd.Series) -> pd.DataFrame:
        out = []
        for a in norms:
            best, place = threshold - 1, None
            for i, b in enumerate(targets):
                # lengths bound the two ratios of whole texts
                fit = 200 * min(len(a), len(b)) >= (best + 0.5) * (len(a) + len(b))
                score = max(ratio_of(a, b), token_sort_of(a, b)) if fit else 0
                if score < 100:
                    score = max(score, token_set_of(a, b))
                if score > best:
                    best, place = score, i
                    if best == 100:
                        break
            out.append((place, best if place is not None else None))
        return pd.DataFrame({"place": pd.array([p for p, _ in out], "Int32"), "score": pd.array([s for _, s in out], "Int32")})

    return run


def match_targets(names: DataFrame, targets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """name, canonical, score for the distinct names that reach the threshold.

    targets: canonical, ordinal; a fixed list of some dozens, which each task holds.
    Equal normal forms (after aliases) score 100 with the first such target, else the best of three
    similarities counts; of equal scores the target first in the list wins.
    """
    listed = [(r.canonical, r.norm) for r in targets.select("canonical", "ordinal", normalized(F.col("canonical")).alias("norm")).orderBy("ordinal").collect()]
    place = {norm: i for i, (_, norm) in reversed(list(enumerate(listed)))}
    exact = F.element_at(F.create_map(*(F.lit(x) for kv in place.items() for x in kv)), F.col("norm"))
    # staged: else the filter on normal forms moves below the distinct, and every row of names is normalised
    left = staged(names.select("name").distinct(), "target_names").withColumn("norm", normalized(with_alias(F.col("name")))).filter("norm <> ''")
    best = _best_target([n for _, n in listed], threshold)
    hit = left.withColumn("exact", exact).withColumn("best", F.when(F.col("exact").isNull(), best("norm")))
    canonical = F.element_at(F.array(*(F.lit(c) for c, _ in listed)), F.coalesce("exact", "best.place") + 1)
    return hit.filter("exact IS NOT NULL OR best.place IS NOT NULL").select("name", canonical.alias("canonical"), F.when(F.col("exact").isNotNull(), 100).otherwise(F.col("best.score")).alias("score"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """name, candidate, score: the candidate of the best ratio, plain or of sorted tokens; ties to the smaller name.

    Exact names are joined by hash. Of the others ``similar_pairs`` finds every pair that can
    reach the threshold, of the texts and of their sorted tokens; only those are scored.
    """
    def with_order(df: DataFrame, name: str, norm: str, order: str) -> DataFrame:
        return df.select(name).distinct().withColumn(norm, normalized(F.col(name))).withColumn(order, F.array_join(F.array_sort(F.split(norm, " ")), " "))

    a, b = with_order(left, "name", "na", "oa"), with_order(right, "candidate", "nb", "ob")
    exact = a.join(b, F.col("na") == F.col("nb")).groupBy("name").agg(F.min("candidate").alias("candidate")).withColumn("score", F.lit(100))
    rest, least = a.join(exact, "name", "left_anti"), (threshold - 0.5) / 100
    plain = similar_pairs(rest, b, "na", "nb", least).withColumn("score", ratio("na", "nb"))
    ordered = similar_pairs(rest, b, "oa", "ob", least).withColumn("score", token_sort("oa", "ob"))
    scored = rest.join(plain, "na").join(b, "nb").select("name", "candidate", "score").union(rest.join(ordered, "oa").join(b, "ob").select("name", "candidate", "score"))
    best = scored.filter(F.col("score") >= threshold).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "candidate")).alias("b")).select("name", F.col("b.candidate").alias("candidate"), (-F.col("b.s")).alias("score"))
    return exact.unionByName(best)
