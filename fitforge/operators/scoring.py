"""Scores: weighted coverage, combination with missing parts, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(items: DataFrame, owned: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """Per group: weight of owned items over all weight (null when that is 0), and their numbers.

    ``owned`` has the owned ``item``s; items are joined by hash, each looked up once.
    """
    known = owned.select(item).distinct().withColumn("_owned", F.lit(True))
    rows = items.join(known, item, "left")
    has = F.coalesce("_owned", F.lit(False))
    total = F.sum(weight)
    return rows.groupBy(group).agg(
        (F.sum(F.when(has, F.col(weight)).otherwise(0.0)) / F.when(total != 0, total)).alias("coverage"),
        F.count_if(has).alias("n_matched"),
        F.count_if(~has).alias("n_missing"),
    )


def combine(semantic: Column, skill: Column, structure: Column, weights: tuple[float, float, float] = (0.50, 0.35, 0.15)) -> Column:
    """Weighted mean of what is there, times 100.

    The weight of a missing skill score goes to the semantic one if that is there;
    other missing parts drop out; nothing at all is 0.
    """
    w_semantic, w_skill, w_structure = (F.lit(w) for w in weights)
    w_semantic = F.when(semantic.isNull(), F.lit(0.0)).when(skill.isNull(), w_semantic + w_skill).otherwise(w_semantic)
    w_skill = F.when(skill.isNull(), F.lit(0.0)).otherwise(w_skill)
    w_structure = F.when(structure.isNull(), F.lit(0.0)).otherwise(w_structure)
    zero = F.lit(0.0)
    total = w_semantic + w_skill + w_structure
    value = w_semantic * F.coalesce(semantic, zero) + w_skill * F.coalesce(skill, zero) + w_structure * F.coalesce(structure, zero)
    return F.when(total > 0, F.lit(100.0) * value / total).otherwise(zero)


def eligibility(level: Column, own_level: Column | int, years: Column, most_years: Column | int | None, show_stretch: bool = False, penalty: float = 0.85, hide_levels: int = 2, hide_years: int = 3) -> dict[str, Column]:
    """levels_above, stretch, hidden and multiplier of a posting for someone of ``own_level``.

    Levels are numbers, null where unknown: then no rule on levels holds.  A posting is
    too much with ``hide_levels`` or more levels above, or with ``hide_years`` or more
    years beyond ``most_years`` (null: no limit).
    """
    own = own_level if isinstance(own_level, Column) else F.lit(own_level)
    most = most_years if isinstance(most_years, Column) else F.lit(most_years).cast("int")
    above = level - own
    up = F.greatest(F.coalesce(above, F.lit(0)), F.lit(0))
    too_much = F.coalesce(above >= hide_levels, F.lit(False)) | F.coalesce(years >= most + hide_years, F.lit(False))
    return {"levels_above": above, "stretch": too_much | (up > 0), "hidden": too_much & F.lit(not show_stretch), "multiplier": F.pow(F.lit(penalty), up.cast("double"))}


def role_scores(people: DataFrame, owned: DataFrame, roles: DataFrame, words: DataFrame, person: str, role: str, bonus: float = 0.25) -> DataFrame:
    """person, role and score: the share of a role's weight that owned skills cover, and ``bonus`` if a title has its word.

    ``people`` has titles (in lower case), ``owned`` person and skill, ``roles`` role,
    skill and weight, ``words`` role and word; only pairs with a score above 0.
    """
    total = roles.groupBy(role).agg(F.sum("weight").alias("_total"))
    covered = owned.join(roles, "skill").groupBy(person, role).agg(F.sum("weight").alias("_covered")).join(total, role)
    covered = covered.select(person, role, (F.col("_covered") / F.col("_total")).alias("score"))
    # each word of a title meets the roles that begin with it; whole phrases are compared only then
    tokens = people.select(person, "titles", F.explode(F.array_distinct(F.regexp_extract_all("titles", F.lit(r"(\w+)"), F.lit(1)))).alias("_first"))
    keyed = words.withColumn("_first", F.regexp_extract("word", r"(\w+)", 1))
    met = tokens.join(keyed, "_first").where(F.expr("regexp_like(titles, concat('\\\\b\\\\Q', word, '\\\\E\\\\b'))"))
    # once for a role, however many of its words the titles have
    named = met.select(person, role).distinct().select(person, role, F.lit(bonus).alias("score"))
    return covered.unionByName(named).groupBy(person, role).agg(F.sum("score").alias("score"))
