"""Evidence on (product, condition) pairs: polarity states, rankings, scores, mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.formula import PRODUCT_DEFAULT, product_formula

LABELS = ("positive", "caution", "mixed", "unclear")
#: From the most to the least severe.
SEVERITY = ("prohibition", "precaution", "none", "unknown")


def state(positive: Column, caution: Column, mixed: Column) -> Column:
    """State of a pair from its counts: mixed evidence, or positive with caution, is mixed; then positive, then caution,
    then unclear."""
    return F.when((mixed > 0) | ((positive > 0) & (caution > 0)), "mixed").when(positive > 0, "positive").when(caution > 0, "caution").otherwise("unclear")


def pair_states(evidence: DataFrame, entity: str = "entity", topic: str = "topic", label: str = "label") -> DataFrame:
    """``(entity, topic, positive_count, caution_count, mixed_count, unclear_count, state)``; one combining pass. Null
    labels count as none of the four."""
    counts = [F.count_if(F.col(label) == x).alias(f"{x}_count") for x in LABELS]
    pairs = evidence.groupBy(entity, topic).agg(*counts)
    return pairs.withColumn("state", state(F.col("positive_count"), F.col("caution_count"), F.col("mixed_count")))


def zero_preserving_ranking(entities: DataFrame, pairs: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """``(key, <counts>)`` for every entity, those without a pair included: the conditions of the counts apply to the
    pairs before the outer join, so entities keep their zeros."""
    per = pairs.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return entities.select(key).join(per, key, "left").na.fill(0, list(counts))


def severity_order(c: Column) -> Column:
    order = F.lit(len(SEVERITY))
    for k, name in reversed(list(enumerate(SEVERITY))):
        order = F.when(c == name, k).otherwise(order)
    return order


def fold_cautions(decisions: DataFrame, keys: Sequence[str], effect: str = "effect", recommended: str = "recommended") -> DataFrame:
    """``(keys, effect, recommended)``: the most severe effect of each group; recommended if any decision is."""
    return decisions.groupBy(*keys).agg(F.min_by(effect, severity_order(F.col(effect))).alias("effect"), F.bool_or(recommended).alias("recommended"))


def corroborate(effect: Column, from_model_only: Column) -> Column:
    """A prohibition that only a model saw is unknown; a precaution stays."""
    return F.when(from_model_only & (effect == "prohibition"), "unknown").otherwise(effect)


def fold_fragment(decisions: DataFrame, fragment: str, entity: str, topic: str, label: str = "label") -> DataFrame:
    """One label for each (fragment, entity, topic): positive wins within a fragment and mixed counts as positive, then
    caution, then unclear."""
    order = F.when(F.col(label).isin("positive", "mixed"), 0).when(F.col(label) == "caution", 1).otherwise(2)
    best = F.min(order)
    return decisions.groupBy(fragment, entity, topic).agg(F.when(best == 0, "positive").when(best == 1, "caution").otherwise("unclear").alias("label"))


def condition_scores(titles: DataFrame, mentions: DataFrame, pairs: DataFrame, fragment: str, entity: str, topic: str) -> DataFrame:
    """``(topic, entity, l1, l2, l3)`` of the eligible (positive or mixed) pairs: L1 fragments whose title names both,
    L2 fragments that mention both, L3 topics for which the entity is eligible. Fragments count once however often they
    mention a pair."""
    eligible = pairs.where(F.col("state").isin("positive", "mixed")).select(entity, topic)
    l1 = titles.groupBy(entity, topic).agg(F.countDistinct(fragment).alias("l1"))
    l2 = mentions.select(fragment, entity, topic).distinct().join(eligible, [entity, topic]).groupBy(entity, topic).agg(F.count("*").alias("l2"))
    l3 = eligible.groupBy(entity).agg(F.countDistinct(topic).alias("l3"))
    return eligible.join(l1, [entity, topic], "left").join(l2, [entity, topic], "left").join(l3, entity).na.fill(0, ["l1", "l2"])


def top_of_topic(scores: DataFrame, topic: str, entity: str, n: int, formula: str = PRODUCT_DEFAULT) -> DataFrame:
    """The first ``n`` entities of each topic by (formula, L3, id); scores are computed in the JVM from the formula."""
    s = product_formula(formula).column({"L1": F.col("l1"), "L2": F.col("l2"), "L3": F.col("l3")})
    w = W.partitionBy(topic).orderBy(F.desc("score"), F.desc("l3"), entity)
    return scores.withColumn("score", s).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def phrase_mentions(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_id: str = "name_id", name_col: str = "name") -> DataFrame:
    """``(id, name_id, position)``: where names stand as whole words in texts, without case and accents.

    Names are met by their first words: one pass over the texts, and only places where a name may begin are compared with
    the words that follow. No automaton to ship, and neither side is held by one process."""
    keyed = names.select(F.col(name_id), T.words(name_col).alias("w")).where(F.size("w") > 0).distinct()
    keyed = keyed.select(name_id, F.element_at("w", 1).alias("first"), F.slice("w", 2, F.size("w")).alias("rest"))
    longest = keyed.agg(F.max(F.size("rest"))).first()[0] or 0
    words = texts.select(F.col(id_col).alias("id"), T.words(text_col).alias("w")).where(F.size("w") > 0)
    follow = F.transform("w", lambda word, i: F.struct(word.alias("first"), F.slice("w", i + 2, F.lit(longest)).alias("next"))) if longest else F.transform("w", lambda word: F.struct(word.alias("first"), F.array().cast("array<string>").alias("next")))
    places = words.select("id", F.posexplode(follow).alias("position", "x")).select("id", "position", "x.first", "x.next")
    met = places.join(keyed, "first").where((F.size("next") >= F.size("rest")) & (F.slice("next", 1, F.greatest(F.size("rest"), F.lit(1))) == F.col("rest")) | (F.size("rest") == 0))
    return met.select("id", name_id, "position")


def cooccurrence(mentions: DataFrame, topics: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct pairs of what a text mentions and the topics it has; combined map-side before the shuffle."""
    return mentions.join(topics, id_col).drop(id_col, "position").distinct()


def canonical_labels(labels: DataFrame, dictionary: DataFrame, label_col: str) -> DataFrame:
    """Labels replaced by the canonical name whose name or synonym equals them (normalised); others stay.
    ``dictionary``: ``name, term``."""
    d = dictionary.select(T.normalized("term").alias("_k"), F.col("name").alias("_n")).groupBy("_k").agg(F.min("_n").alias("_n"))
    return labels.withColumn("_k", T.normalized(label_col)).join(d, "_k", "left").withColumn(label_col, F.coalesce("_n", label_col)).drop("_k", "_n")


def folded_catalog(items: DataFrame, aliases: DataFrame, key: str, alias_key: str, kinds: Sequence[str]) -> DataFrame:
    """Items with one sorted array of distinct alias names for each kind, empty where there is none."""
    per = aliases.groupBy(F.col(alias_key).alias(key)).agg(*(F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in kinds))
    out = items.join(per, key, "left")
    for k in kinds:
        out = out.withColumn(k, F.coalesce(k, F.array().cast("array<string>")))
    return out


def unambiguous(names: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """``(name, id)`` of the names that exactly one id has."""
    return names.groupBy(name_col).agg(F.countDistinct(id_col).alias("_n"), F.min(id_col).alias(id_col)).where("_n = 1").drop("_n")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int = 20) -> DataFrame:
    """A page under a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def without(array: Column, other: Column) -> Column:
    """``array`` without the items of ``other``, order and repeats kept; null is empty."""
    o = F.coalesce(other, F.array().cast("array<string>"))
    return F.filter(F.coalesce(array, F.array().cast("array<string>")), lambda x: ~F.array_contains(o, x))
