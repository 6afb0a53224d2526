"""Names matched to entities in passes, each over what the passes before left unmatched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio, token_set, token_sort
from ..functions.text import core_tokens, name_tokens, normalized, with_alias
from ..sources.scratch import staged
from .nearest_text import nearest_texts
from .similar_pairs import salted_join, sharing_chunks, similar_pairs, spread

# The least score of each pass, and the shortest core.
RATIO, TOKEN_SORT, TOKEN_SET, CORE, CORE_LETTERS = 90, 90, 95, 80, 4
# End of fixed values.

#: Scores are rounded, so that half a point less may do.
_LEAST = (RATIO - 0.5) / 100
#: Letters that a name may have besides the shared tokens, as a share of all, when those alone reach TOKEN_SET.
_EXTRA = 1 - 1 / (2 * 100 / (TOKEN_SET - 0.5) - 1)


def _place(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def _levels(c: Column, known: bool) -> Column:
    """What an entity's place may be looked up by, the nearest first: itself, that there is one (where some have none), nothing."""
    return F.when(c.isNull(), F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("="), c), F.lit(""), *([] if known else [F.lit("+")])))


def best_near(names: DataFrame, entities: DataFrame, scored: DataFrame, known: bool = False) -> DataFrame:
    """text, state, city, ein, entity, score of names with an entity: one in the same state if there is one, then the same city, then of the best score, then the smallest ein.

    names: text, state, city; entities: to_text, ein, entity, to_state, to_city; scored: text, to_text, score of all pairs of texts
    that count. ``known`` says that no place is null; a null is as far as can be. Of a text's entities only the first of each place is
    kept, of each state, of each city and of all, and a name looks into each of these once: rows grow with the texts that a name meets, not with the entities of that text.
    """
    at = lambda df, s, c: df.withColumn("at_state", F.explode(_levels(F.col(s), known))).withColumn("at_city", F.explode(_levels(F.col(c), known)))
    rank = lambda c: F.when(F.col(c).startswith("="), 0).when(F.col(c) == "+", 1).otherwise(2)
    of_place = entities.groupBy("to_text", "to_state", "to_city").agg(F.min(F.struct("ein", "entity")).alias("e"))
    first = at(of_place, "to_state", "to_city").groupBy("to_text", "at_state", "at_city").agg(F.min("e").alias("e"))
    asked = at(names.select("text", "state", "city").distinct().join(scored, "text"), "state", "city")
    met = asked.join(first, ["to_text", "at_state", "at_city"])
    best = met.groupBy("text", "state", "city").agg(F.min(F.struct(rank("at_state").alias("s"), rank("at_city").alias("c"), (-F.col("score")).alias("score"), "e")).alias("b"))
    return best.select("text", "state", "city", F.col("b.e.ein").alias("ein"), F.col("b.e.entity").alias("entity"), (-F.col("b.score")).alias("score"))


def _rarest(left: DataFrame, right: DataFrame) -> DataFrame:
    """text, tokens of both sides' distinct texts, the rarest token first."""
    texts = left.select("norm").union(right.select("to_norm")).filter("norm <> ''").distinct()
    tokens = texts.select("norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return tokens.join(counts, "token").groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))


def _first_tokens(tokens: Column) -> Column:
    """The rarest tokens, so many that a text which agrees in all but few letters has one of them."""
    letters = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.length(t["token"]) + 1)
    before = lambda i: F.aggregate(F.slice(tokens, F.lit(1), i), F.lit(0), lambda s, t: s + F.length(t["token"]) + 1)
    return F.filter(tokens, lambda t, i: before(i) <= letters * _EXTRA)


def _sharing(left: DataFrame, right: DataFrame) -> DataFrame:
    """norm, to_norm that share one of the first tokens of either; a pair may come several times."""
    table = staged(_rarest(left, right), "tokens")
    a = left.select("norm").distinct().join(table, "norm")
    b = right.select("to_norm").distinct().join(table.withColumnRenamed("norm", "to_norm"), "to_norm")
    every = lambda df, c: df.select(c, F.explode("tokens.token").alias("token"))
    first = lambda df, c: df.select(c, F.explode(F.transform(_first_tokens(F.col("tokens")), lambda t: t["token"])).alias("token"))
    one, other = salted_join(first(a, "norm"), every(b, "to_norm"), "token"), salted_join(every(a, "norm"), first(b, "to_norm"), "token")
    return one.select("norm", "to_norm").union(other.select("norm", "to_norm"))


def token_set_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """norm, to_norm: all pairs that reach TOKEN_SET by the ratio of token sets, and few others.

    They do by common tokens that make nearly all of one name, or all: then one of that name's rarest tokens, by a bound on
    letters, is common (``_sharing``). Or common tokens and what is left of both differ in few letters: then a
    chunk of a token is in a token of the other, wherever a misspelt one sorts (``sharing_chunks``).
    """
    def as_sets(df: DataFrame, c: str) -> DataFrame:
        return df.select(c).filter(F.col(c) != "").distinct().withColumn("tokens", F.array_distinct(F.split(c, " ")))

    spelt = sharing_chunks(as_sets(left, "norm"), as_sets(right, "to_norm"), "norm", "to_norm", (TOKEN_SET - 0.5) / 100, True)
    return spread(_sharing(left, right).union(spelt), "norm", "to_norm").distinct()


def match_entities(names: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched: name, city, state, ein, entity, score, pass; unmatched: name, city, state, best_candidate, best_score).

    names: name, city, state (null as ''); entities: ein, name, city, state. Passes:
    1 equal normal forms (after aliases); 3 the ratio; 4 the ratio of sorted tokens; 5 the ratio
    of token sets; 6 equal first two tokens, where the score counts only after the nearest was chosen.
    Several entities are told apart by place (``best_near``). All pairs of every pass are found.
    best_candidate is the entity of the highest ratio of all (of equal ones the smallest ein); '' if no entity has a letter in common.
    """
    matched, left_over, right = _passes(names, entities)
    return matched, _report(left_over, right)


def matched_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """The first table of ``match_entities`` alone: no best candidates are looked for."""
    return _passes(names, entities)[0]


def _shown() -> list:
    return ["name", F.col("raw_city").alias("city"), F.col("raw_state").alias("state")]


def _passes(names: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, names left over, entities: the first ein of each name and place, with what passes compare)."""
    left = names.select("name", F.coalesce("city", F.lit("")).alias("raw_city"), F.coalesce("state", F.lit("")).alias("raw_state")).distinct()
    # a filter on normal forms can't move below what is staged, so that they are made of distinct names only
    forms = staged(spread(left.select(F.coalesce("name", F.lit("")).alias("key")), "key").distinct(), "raw_names").select("key", normalized(with_alias(F.col("key"))).alias("norm"), core_tokens(F.col("key"), 2).alias("core"))
    left = left.withColumn("key", F.coalesce("name", F.lit(""))).join(forms, "key").drop("key")
    left = left.withColumns({"city": _place(F.col("raw_city")), "state": _place(F.col("raw_state")), "order": _sorted(F.col("norm"))})
    left = staged(left.withColumn("id", F.monotonically_increasing_id()), "names")
    places = entities.groupBy(F.col("name").alias("entity"), _place(F.col("city")).alias("to_city"), _place(F.col("state")).alias("to_state")).agg(F.min("ein").alias("ein"))
    right = staged(places, "places").select("ein", "entity", "to_city", "to_state", normalized(F.col("entity")).alias("to_norm"), F.array_join(F.slice(name_tokens(F.col("entity")), 1, 2), " ").alias("to_core"))
    right = staged(right.withColumn("to_order", _sorted(F.col("to_norm"))), "entities")

    def chosen(rest: DataFrame, scored: DataFrame, a: str, b: str, number: int, least: int) -> DataFrame:
        """The nearest entities of names by scored pairs of their texts a and b."""
        pairs = scored.select(F.col(a).alias("text"), F.col(b).alias("to_text"), "score")
        best = best_near(rest.select(F.col(a).alias("text"), "state", "city"), right.withColumn("to_text", F.col(b)), pairs, True).filter(F.col("score") >= least)
        return staged(rest.join(best.withColumnRenamed("text", a), [a, "state", "city"]).select("id", "ein", "entity", "score", F.lit(number).alias("pass")), f"pass_{number}")

    exact = left.select("norm").distinct().select("norm", F.col("norm").alias("to_norm"), F.lit(100).alias("score"))
    found = [chosen(left, exact, "norm", "to_norm", 1, 100)]
    rest = left.join(found[-1], "id", "left_anti")

    close = similar_pairs(rest, right, "norm", "to_norm", _LEAST).withColumn("score", ratio("norm", "to_norm")).filter(F.col("score") >= RATIO)
    found.append(chosen(rest, close, "norm", "to_norm", 3, RATIO))
    rest = rest.join(found[-1], "id", "left_anti")

    close = similar_pairs(rest, right, "order", "to_order", _LEAST).withColumn("score", token_sort("order", "to_order")).filter(F.col("score") >= TOKEN_SORT)
    found.append(chosen(rest, close, "order", "to_order", 4, TOKEN_SORT))
    rest = staged(rest.join(found[-1], "id", "left_anti"), "rest")

    met = token_set_pairs(rest, right).withColumn("score", token_set("norm", "to_norm")).filter(F.col("score") >= TOKEN_SET)
    found.append(chosen(rest, met, "norm", "to_norm", 5, TOKEN_SET))
    left_over = rest.join(found[-1], "id", "left_anti")

    # of a core the score differs by text: names are told apart by both
    cores = left_over.filter(F.length("core") >= CORE_LETTERS).withColumn("text", F.to_json(F.struct("core", "norm")))
    known = right.withColumn("to_text", F.to_json(F.struct("to_core", "to_norm")))
    pairs = salted_join(cores.select("core", "norm", "text").distinct(), known.select(F.col("to_core").alias("core"), "to_norm", "to_text").distinct(), "core")
    best = best_near(cores, known, pairs.withColumn("score", token_set("norm", "to_norm")), True).filter(F.col("score") >= CORE)
    found.append(staged(cores.join(best, ["text", "state", "city"]).select("id", "ein", "entity", "score", F.lit(6).alias("pass")), "pass_6"))
    left_over = left_over.join(found[-1], "id", "left_anti")

    matched = found[0]
    for f in found[1:]:
        matched = matched.unionByName(f)
    return left.join(matched, "id").select(*_shown(), "ein", "entity", "score", "pass"), left_over, right


def _report(left_over: DataFrame, right: DataFrame) -> DataFrame:
    left_over = staged(left_over, "left_over")
    first = right.groupBy("to_norm").agg(F.min(F.struct("ein", "entity")).alias("e"))
    best = nearest_texts(left_over.select(F.col("norm").alias("query")), first.select(F.col("to_norm").alias("text"), F.col("e.ein").alias("rank"))).filter("score > 0")
    best = best.join(first, best["text"] == first["to_norm"]).select("query", "score", F.col("e.entity").alias("candidate"))
    return left_over.join(best, left_over["norm"] == best["query"], "left").select(*_shown(), F.coalesce("candidate", F.lit("")).alias("best_candidate"), F.coalesce("score", F.lit(0)).alias("best_score"))


def match_index(names: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``match_entities`` against an index (ein, name) that knows no places."""
    return match_entities(names, _nowhere(index))


def matched_index(names: DataFrame, index: DataFrame) -> DataFrame:
    """The first table of ``match_index`` alone."""
    return matched_entities(names, _nowhere(index))


def _nowhere(index: DataFrame) -> DataFrame:
    return index.select("ein", "name", F.lit("").alias("city"), F.lit("").alias("state"))
