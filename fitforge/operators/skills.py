"""Mentions of the entries of a taxonomy in texts, with case, context and exclusions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Aliases that are sent to all tasks, at most; :func:`fitforge.operators.terms.phrase_mentions` takes any number.
MOST_ALIASES = 100_000
NEARBY = 40

# Sections that list skills, sections where soft skills count, and what stands between the items of a list.
LIST_SECTIONS = ("skills",)
SOFT_SECTIONS = ("skills", "summary", "header")
LIST_MARKS = ",/|;()•·"
# Nouns right behind a word that show it to be a technology.
TECHNICAL = (
    r"^\s+(?:apps?|applications?|apis?|backends?|frontends?|services?|microservices?|servers?|components?|hooks|librar(?:y|ies)|frameworks?|code(?:base)?|sdk|modules?|scripts?|"
    r"programs?|programming|developers?|development|dashboards?|ui|web|native|boot|mvc|spreadsheets?|macros|formulas|pivot|vba|workbooks?|charts?|cluster|jobs?|pipelines?|"
    r"projects?|game|engine|templates?|plugins?|packages?|channels?|bots?|integrations?)\b"
)
# What from a mention on, or before it, shows that it is no skill.
EXCLUDED_FROM = {
    "Spring": r"(?i)^Spring\s*(?:'?\d{2}|\d{4}|semester|break|term)",
    "Go": r"^Go\s*-|^Go\s+(?:to|out|through|beyond|above)\b",
    "Microsoft Excel": r"^Excel(?:led|s|ling)?\s+(?:at|in)\b",
    "Express": r"^Express(?:ed|ing)?\b(?!\.js|js)(?=\s+(?:my|our|interest|concern))",
}
EXCLUDED_BEHIND = {"Express": r"American\s+$", "Microsoft Teams": r"(?i)cross[- ]functional\s+$"}

_TOKEN = re.compile(r"\w+|[^\w\s]")


class _Finder:
    """Finds the aliases in one text; longer ones win, then earlier ones."""

    def __init__(self, aliases: list[tuple]):
        self.known: dict[tuple[bool, str], tuple[str, str, bool]] = {}
        for alias, canonical, category, case_sensitive, ambiguous in aliases:
            exact = bool(case_sensitive) and alias != alias.lower()
            tokens = _TOKEN.findall(alias if exact else alias.lower())
            self.known[exact, " ".join(tokens)] = canonical, category, exact and bool(ambiguous) and len(tokens) == 1
        self.longest = max((k[1].count(" ") + 1 for k in self.known), default=0)
        self.starts = {(exact, k.split(" ")[0]) for exact, k in self.known}

    def spans(self, text: str) -> list[tuple]:
        """start, stop, canonical, category and whether context is needed."""
        places = [m.span() for m in _TOKEN.finditer(text)]
        words = [text[a:b] for a, b in places]
        forms = {True: words, False: [w.lower() for w in words]}
        found = []
        for exact, tokens in forms.items():
            for i, w in enumerate(tokens):
                if (exact, w) in self.starts:
                    found += [(-n, i, self.known[key]) for n in range(1, self.longest + 1) if i + n <= len(tokens) and (key := (exact, " ".join(tokens[i : i + n]))) in self.known]
        taken, kept = bytearray(len(words)), []
        for n, i, entry in sorted(found):
            if not any(taken[i : i - n]):
                taken[i : i - n] = b"\1" * -n
                kept.append((places[i][0], places[i - n - 1][1], *entry))
        return sorted(kept)

    def mentions(self, text: str, section: str | None) -> Iterator[tuple]:
        """start, stop, canonical and category of what counts as a mention in this section."""
        kept = self.spans(text)
        sure = [(a, b) for a, b, _, _, needs in kept if not needs]
        for a, b, canonical, category, needs in kept:
            if category == "soft" and section not in SOFT_SECTIONS:
                continue
            if canonical in EXCLUDED_FROM and re.search(EXCLUDED_FROM[canonical], text[a : a + NEARBY]):
                continue
            if canonical in EXCLUDED_BEHIND and re.search(EXCLUDED_BEHIND[canonical], text[max(0, a - NEARBY) : a]):
                continue
            if needs and section not in LIST_SECTIONS:
                beside = text[:a].rstrip()[-1:], text[b:].lstrip()[:1]
                listed = any(c and c in LIST_MARKS for c in beside)
                if not (listed or re.match(TECHNICAL, text[b : b + 30], re.I) or any(max(x - b, a - y) <= NEARBY for x, y in sure)):
                    continue
            yield a, b, canonical, category


def skill_mentions(texts: DataFrame, taxonomy: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, section, canonical, category, start and stop of the mentions in ``texts`` (keys, section, text).

    ``taxonomy`` has alias, canonical, category, case_sensitive and ambiguous.  Aliases
    with capitals of case-sensitive entries match as they are written, all others in
    any case; of overlapping ones the longest counts.  A one-word alias of an ambiguous
    entry needs context: a section of skills, list marks beside it, a technical noun
    behind it, or an unambiguous mention within NEARBY characters.  Only mentions
    leave the tasks.  Null texts have none.
    """
    aliases = [tuple(r) for r in taxonomy.select("alias", "canonical", "category", "case_sensitive", "ambiguous").limit(MOST_ALIASES + 1).collect()]
    if len(aliases) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases: use terms.phrase_mentions")
    rows = texts.select(*keys, "section", "text")
    kept = [*keys, "section"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(aliases)
        for batch in batches:
            out: list[tuple] = []
            for i, (section, text) in enumerate(zip(batch.column("section").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                out += [(i, *m) for m in finder.mentions(text, section)] if text else []
            place = pa.array([m[0] for m in out], pa.int64())
            columns = [pa.array([m[j] for m in out], kind) for j, kind in ((3, pa.string()), (4, pa.string()), (1, pa.int64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in kept), *columns], names=[*kept, "canonical", "category", "start", "stop"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.select(*kept).dtypes), "canonical string, category string, start long, stop long"])
    return rows.mapInArrow(run, schema)


def posting_skills(mentions: DataFrame, key: str) -> DataFrame:
    """Per posting and skill: n (mentions), sections (sorted), weight, and place by weight, n and name.

    3.0 if required names it, 0.5 if only nice does, 2.0 with two mentions or more, else 1.0.
    Soft skills, and sections about the company or benefits, do not count.
    """
    counted = mentions.where("category <> 'soft' and section not in ('about', 'benefits')")
    skills = counted.groupBy(key, "canonical", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("section")).alias("sections"))
    weight = F.when(F.array_contains("sections", "required"), 3.0).when(F.col("sections") == F.array(F.lit("nice")), 0.5).when(F.col("n") >= 2, 2.0).otherwise(1.0)
    skills = skills.withColumn("weight", weight)
    return skills.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), F.desc("n"), F.lower("canonical"), "canonical")))


def own_skills(mentions: DataFrame, key: str) -> DataFrame:
    """Per person and skill: n, in_skills (named in a section of skills), and place by n and name."""
    skills = mentions.groupBy(key, "canonical", "category").agg(F.count("*").alias("n"), F.bool_or(F.col("section").isin(*LIST_SECTIONS)).alias("in_skills"))
    return skills.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.lower("canonical"), "canonical")))


def stored_skills(skills: DataFrame, key: str) -> DataFrame:
    """Per ``key`` the skills as an array of structs in their order: skill, category, weight, n and sorted sections."""
    row = F.struct("place", F.col("canonical").alias("skill"), "category", "weight", "n", F.array_sort("sections").alias("sections"))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(*(x[c].alias(c) for c in ("skill", "category", "weight", "n", "sections"))))
    return skills.groupBy(key).agg(listed.alias("skills"))
