"""Kernels of the rules on the text of postings: plain Python on the different texts of an Arrow batch.

:mod:`fitforge.functions.postings` gives them as column expressions.  Within Spark's own lambdas every line of
every posting costs dozens of interpreted calls; here equal texts of a batch are read once and what a line
heads is remembered for lines that come again, as headings and boilerplate do.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_REQUIREMENTS = 40

# Phrases that make a line a heading of a section; the first section with a phrase wins.
HEADINGS = {
    "nice": ["nice to have", "nice-to-have", "preferred", "bonus", "pluses", "a plus", "good to have", "desired", "extra credit"],
    "required": ["requirements", "required", "qualifications", "what you'll need", "what you need", "what we're looking for", "what we are looking for", "you have", "you'll have", "who you are", "must have", "must-haves", "skills and experience", "your background", "about you", "experience", "should have", "you bring", "you'll bring", "ideal candidate", "vision of you"],
    "responsibilities": ["responsibilities", "what you'll do", "what you will do", "the role", "your role", "day to day", "day-to-day", "duties", "in this role", "what you'll be doing", "job description", "key tasks", "the opportunity", "daily"],
    "benefits": ["benefits", "perks", "compensation", "salary", "pay", "what we offer", "why join", "why you'll love"],
    "about": ["about us", "about the company", "who we are", "our mission", "about the team", "equal opportunity", "eeo", "our company", "company overview", "about", "why"],
}
# Sections with requirements, in the order in which they fill the cap, and those without.
REQUIREMENT_SECTIONS = ("required", "responsibilities", "nice")
NO_REQUIREMENTS = ("about", "benefits")
# Wording that opens a section of boilerplate without a heading.
BOILERPLATE = {
    "benefits": r"\b(base (salary|pay)|salary range|pay range|compensation range|annual salary|pay transparency|on-target earnings|hourly rate|salary (for|of) this|medical, dental|401\(k\) (plan|match)|paid parental leave)\b",
    "about": r"(equal (employment )?opportunit|without regard to|sexual orientation|veteran status|protected (veteran|characteristic)|reasonable accommodation|e-verify|applicants with (arrest|criminal)|fair chance|privacy (notice|policy)|^#LI-)",
}
# Bullets, and those that are one before a blank only (o also needs a capital behind it).
BULLETS = "•●▪◦‣∙·■□►▸➢➤❖✓✔⁃"
# Numbers in words, years of experience, and what behind or before them tells otherwise.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
_NUMBER = r"(\d{1,2}(?:\.\d)?|" + "|".join(NUMBER_WORDS) + ")"
_YEARS = rf"(?i){_NUMBER}\s*(?:\(\s*\d{{1,2}}\s*\+?\s*\))?\s*(?:\+|plus|or more|or greater)?\s*(?:(?:-|–|—|to)\s*{_NUMBER}\s*\+?\s*)?(?:years?|yrs?)\b"
_EXPERIENCE_AFTER = r"(?i)^[\s'’]*(?:of\s+)?(?:\w+[\s,/-]+){0,6}?(?:experience|exp\b|professional|industry|working|hands-on|developing|building|programming|engineering|in\s+(?:a|an)\s)"
_OTHER_AFTER = r"(?i)^[\s'’]*(?:old|ago|of\s+(?:history|growth|service|operation|excellence)|in\s+business|vesting|vest|warranty|anniversary|running|straight|in\s+a\s+row)"
_OTHER_BEFORE = r"(?i)(founded|established|since|after|every|in\s+business|been\s+around|serving|operating|history\s+of|for\s+over|over\s+the\s+(?:last|past))\s*$"

# Blanks as Spark's expressions know them; the lengths up to which lines and texts are remembered, and how many (16 MB at most).
_WHITE = " \t\n\x0b\f\r"
_SHORT_LINE, _LINES, _SHORT_TEXT, _TEXTS = 200, 1 << 14, 1000, 1 << 12


def _compiled(pattern: str) -> re.Pattern[str]:
    """As Spark reads a pattern: classes and cases are of ASCII, bounds of words are not."""
    return re.compile(pattern.replace(r"\b", r"(?u:\b)"), re.ASCII)


_WORD, _BLANKS, _SENTENCES = (_compiled(p) for p in (r"\S+", r"\s+", r"(?<=[.!?])\s+(?=[A-Z])"))
_PHRASES = _compiled(r"\b(?:" + "|".join(p for phrases in HEADINGS.values() for p in phrases) + r")\b")
_BY_WIDTH = [
    (key, width, _compiled(r"\b(?:" + "|".join(p for p in phrases if len(p.split()) == width) + r")\b"))
    for key, phrases in HEADINGS.items()
    for width in sorted({len(p.split()) for p in phrases})
]
# first characters of boilerplate and of mentions (digits and number words): to ask for them alone is quicker
_FIRST = {"benefits": "(?=[bspcaohm4])", "about": "(?=[ewsvpraf#])"}
_BOILERPLATE = [(key, _compiled(f"(?i){_FIRST[key]}{p}")) for key, p in BOILERPLATE.items()]
_MENTION, _UNIT, _OTHER_BEHIND, _OTHER_AHEAD, _EXPERIENCE_BEHIND = (_compiled(p) for p in (_YEARS.replace("(?i)", "(?i)(?=[0-9efnostz])", 1), r"(?i)(?:years?|yrs?)\b", _OTHER_AFTER, _OTHER_BEFORE, _EXPERIENCE_AFTER))


class Line(NamedTuple):
    """What a line without blanks around it tells: the sections that it heads and that its wording opens, whether it can lead in to bullets and be one that is led in to."""

    heading: str | None
    boilerplate: str | None
    leads: bool
    led: bool


class Section(NamedTuple):
    key: str
    heading: str | None
    text: str


def words_in(text: str) -> int:
    return len(_WORD.findall(text))


def has_bullet(line: str) -> bool:
    first = line[:1]
    if not first:
        return False
    return first in BULLETS or unicodedata.category(first) == "Co" or (first in "-–—*>" and line[1:2] == " ") or (line[:2] == "o " and len(line) > 2 and unicodedata.category(line[2]) == "Lu")


def _heading(bare: str) -> str | None:
    if not bare or len(bare) > 80 or has_bullet(bare):
        return None
    spelled = bare.lstrip("#*_" + _WHITE).rstrip("#*_:" + _WHITE).replace("&", " and ").replace("’", "'")
    norm = _BLANKS.sub(" ", spelled).strip(_WHITE).lower()
    n = words_in(norm)
    if not 1 <= n <= 8 or norm.endswith(".") or not _PHRASES.search(norm):
        return None
    capitals = bare == bare.upper() and bare != bare.lower() and n <= 6
    marked = bare.endswith(":") or bare.startswith(("#", "**")) or capitals
    return next((key for key, width, phrases in _BY_WIDTH if (marked or 2 * width >= n) and phrases.search(norm)), None)


def _read(bare: str) -> Line:
    boilerplate = next((key for key, wording in _BOILERPLATE if wording.search(bare)), None)
    bullet = has_bullet(bare)
    leads = not bullet and boilerplate is None and bare[-1:] not in (".", "!", "?") and 1 <= words_in(bare) <= 10
    return Line(_heading(bare), boilerplate, leads, bullet and boilerplate is None)


_read_before = lru_cache(_LINES)(_read)


def line(text: str) -> Line:
    bare = text.strip(_WHITE)
    return _read_before(bare) if len(bare) <= _SHORT_LINE else _read(bare)


def sections(text: str) -> list[Section]:
    """The sections of a posting, as :func:`fitforge.functions.postings.sections` describes them."""
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip(_WHITE)]
    told = [line(lines[i]) for i in solid]
    key, bare, resume = "intro", True, "intro"
    begun = [(0, key, False)]
    for j, (i, x) in enumerate(zip(solid, told, strict=True)):
        beside = key in NO_REQUIREMENTS
        if x.heading is None and x.boilerplate is not None and not beside:
            resume, key, bare = key, x.boilerplate, True
            begun.append((i, key, False))
            continue
        back = x.heading is None and bare and beside and x.leads and j + 1 < len(told) and told[j + 1].led
        head = resume if back else x.heading
        if head is not None:
            key, bare = head, False
            begun.append((i, key, True))
    ends = [i for i, _, _ in begun[1:]] + [len(lines)]
    out = []
    for (i, key, heads), end in zip(begun, ends, strict=True):
        heading = lines[i].strip(_WHITE).rstrip(":").strip("#* ") if heads else None
        body = "\n".join(lines[i + heads : end]).strip(_WHITE)
        if body or heading is not None:
            out.append(Section(key, heading, body))
    return out


def _bare_lines(text: str) -> list[tuple[str, bool]]:
    """The lines without bullets and blanks around them, and whether they had a bullet."""
    stripped = [x.strip(_WHITE) for x in text.split("\n")]
    return [(x[1:].strip(_WHITE), True) if has_bullet(x) else (x, False) for x in stripped]


def units(text: str, sentences: bool = False) -> list[str]:
    """Lines without bullets, of three words or more; long ones (or all) are split into sentences."""
    out: list[str] = []
    for x, _ in _bare_lines(text):
        if x and not x.endswith(":"):
            out += [y.strip(_WHITE) for y in _SENTENCES.split(x)] if sentences or words_in(x) > 40 else [x]
    return [x for x in out if words_in(x) >= 3]


def requirements(found: list[Section]) -> list[tuple[str, str]]:
    """Section and text of each requirement, as :func:`fitforge.functions.postings.requirements` describes them."""
    out = [(key, u) for key in REQUIREMENT_SECTIONS for s in found if s.key == key for u in units(s.text)]
    pool = [s.text for s in found if s.key not in NO_REQUIREMENTS]
    if not out:
        out = [("required", x) for text in pool for x, bullet in _bare_lines(text) if bullet and words_in(x) >= 3]
    if not out:
        out = [("required", u) for text in pool for u in units(text, True)]
    return out[:MOST_REQUIREMENTS]


def _mentions(text: str) -> tuple[tuple[int, bool], ...]:
    out = []
    for m in _MENTION.finditer(text) if _UNIT.search(text) else ():
        start, stop = m.span()
        behind = text[stop : stop + 80]
        if _OTHER_BEHIND.search(behind) or _OTHER_AHEAD.search(text[max(start - 25, 0) : start]):
            continue
        number = m[1].lower()
        years = NUMBER_WORDS.index(number) if number.isalpha() else float(number)
        if years <= 30:
            out.append((int(years), bool(_EXPERIENCE_BEHIND.search(behind))))
    return tuple(out)


_mentions_before = lru_cache(_TEXTS)(_mentions)


def mentions(text: str) -> tuple[tuple[int, bool], ...]:
    """The least years of each mention of experience, and whether wording of experience is behind it."""
    return _mentions_before(text) if len(text) <= _SHORT_TEXT else _mentions(text)


_NONE = 99  # more years than any mention has


def _least(text: str) -> tuple[int, int]:
    found = mentions(text)
    return min((n for n, _ in found), default=_NONE), min((n for n, within in found if within), default=_NONE)


def least_years(found: list[Section]) -> int | None:
    """The years that sections ask for, as :func:`fitforge.functions.postings.least_years` describes them."""
    least = [(s.key, *_least(s.text)) for s in found if s.key != "nice"]
    required = min((n for key, n, _ in least if key == "required"), default=_NONE)
    years = required if required < _NONE else min((n for _, _, n in least), default=_NONE)
    return years if years < _NONE else None


# ---------------------------------------------------------------- columns


def by_value(column: pa.Array, f: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``f`` of every value, asked once for equal ones; null gives null."""
    coded = column.dictionary_encode()
    return pa.array([f(x) for x in coded.dictionary.to_pylist()], kind).take(coded.indices)


def least_years_of(found: pa.ListArray) -> pa.Array:
    """:func:`least_years` of a column of sections; equal texts of sections are read once."""
    lengths, flat = found.value_lengths().fill_null(0).to_numpy(), found.flatten()
    key, coded = flat.field("key"), flat.field("text").dictionary_encode()
    each = np.array([*map(_least, coded.dictionary.to_pylist()), (_NONE, _NONE)])
    least = each[coded.indices.fill_null(len(each) - 1).to_numpy()]
    row = np.repeat(np.arange(len(found)), lengths)
    required, others = (np.full(len(found), _NONE) for _ in range(2))
    for out, among, values in ((required, pc.equal(key, "required"), least[:, 0]), (others, pc.not_equal(key, "nice"), least[:, 1])):
        there = among.fill_null(False).to_numpy(zero_copy_only=False)
        np.minimum.at(out, row[there], values[there])
    years = np.where(required < _NONE, required, others)
    return pa.array(years, pa.int32(), mask=years == _NONE)
