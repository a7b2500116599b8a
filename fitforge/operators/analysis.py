"""A résumé's analysis out of its rows: bullets, what they say, checks and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.functions import resumes
from fitforge.operators import bullets


def analysed_resumes(rows: DataFrame, document: str, place: str, forms: list[str], facts: DataFrame | None = None) -> DataFrame:
    """Per ``document``: n_bullets, n_verbs, n_measured, weak, n_pages, checks (as :func:`resumes.checks`) and score.

    ``rows`` are those of :func:`bullets.assembled`; ``forms`` the forms of action verbs;
    ``facts``, if given, ``document``, trapped (text behind images) and table_share.  A
    résumé without bullets has none of what they show; one without rows is not there.
    """
    text = F.col("text")
    # an address never spans rows, so rows are looked at one by one and no document is put together
    seen = rows.groupBy(document).agg(
        F.bool_or(resumes.has_email(text)).alias("_email"),
        F.bool_or(resumes.has_phone(text)).alias("_phone"),
        F.collect_set("key").alias("_keys"),
        F.countDistinct("page").alias("n_pages"),
    )
    counts = resumes.bullet_statistics(bullets.assembled(rows, document, place), document, "text", forms)
    found = seen.join(counts, document, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_bullets", "n_verbs", "n_measured")})
    found = found.withColumn("weak", F.coalesce("weak", F.lit("")))
    if facts is not None:
        found = found.join(facts.select(document, "trapped", "table_share"), document, "left")
    else:
        found = found.withColumns({"trapped": F.lit(False), "table_share": F.lit(0.0)})
    passed = resumes.structure_checks(
        F.coalesce("_email", F.lit(False)), F.coalesce("_phone", F.lit(False)), F.col("_keys"), F.col("n_bullets"), F.col("n_verbs"), F.col("n_measured"),
        F.col("n_pages"), F.coalesce("trapped", F.lit(False)), F.coalesce("table_share", F.lit(0.0)),
    )
    checked = found.withColumn("checks", resumes.checks(passed))
    return checked.select(document, "n_bullets", "n_verbs", "n_measured", "weak", "n_pages", "checks", resumes.structure_score(F.col("checks")).alias("score"))
