"""Surrogates for personal data: keyed, of the same type, distinct and consistent.

Detected entities are replaced by others of their kind.  Within a type and format
the replacement is a keyed permutation (a Feistel network over the letters and
digits of the value), so that one entity has one surrogate everywhere and two
entities never share one.  A check over the entities of all documents finds
surrogates that are real entities or meet in spite of different formats, and
gives those entities another turn of the permutation, until none is left.  Later
turns reach further, so that small forms are not used up: names leave the list of
first names, and names, e-mail addresses and secrets grow by keyed characters.

A name is found by the form of address before it; its words are entities of their own
(given names by gender, family names), and every other mention of one of them in the
same document is replaced as well.  The key is the caller's: who has it can undo the
permutations, so it belongs with the originals, not with the result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut, discard, fresh

#: Turns within the list of first names, and turns before a surrogate grows.
LIST_TURNS, PLAIN_TURNS = 2, 4
_TURNS = 8

# Letters of a script and case that stand for each other.
_CLASSES = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
_HEX = ["0123456789abcdef", "0123456789ABCDEF"]
# First names by gender (u: borne by both), family names, and forms of address with the gender that they tell.
_FIRST_NAMES = {
    "f": ["Anna", "Claire", "Elena", "Emma", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nora", "Olivia", "Paula", "Sofia", "Sophie", "Teresa"]
    + ["Alice", "Beatrice", "Carmen", "Clara", "Diana", "Eva", "Hannah", "Helen", "Ingrid", "Irene", "Johanna", "Katharina", "Linda", "Lisa", "Martha", "Monika", "Petra", "Rosa", "Sarah", "Silvia", "Susan", "Ursula"],
    "m": ["Adam", "Carlos", "David", "Hugo", "Jan", "Jean", "John", "Jonas", "Karl", "Leon", "Louis", "Marco", "Martin", "Oscar", "Paul", "Thomas"]
    + ["Albert", "Anton", "Arthur", "Daniel", "Eric", "Felix", "Frank", "Georg", "Henry", "James", "Jorge", "Lucas", "Max", "Michael", "Miguel", "Oliver", "Pablo", "Peter", "Philip", "Richard", "Robert", "Simon", "Stefan", "Victor"],
    "u": ["Alex", "Camille", "Charlie", "Chris", "Claude", "Dominique", "Jordan", "Kim", "Lou", "Morgan", "Robin", "Sam", "Sascha", "Taylor"],
}
_FAMILY_NAMES = ["Adler", "Allen", "Bauer", "Becker", "Bernard", "Blanc", "Brandt", "Carter", "Castro", "Clark", "Cooper", "Costa", "Dubois", "Ellis", "Faure", "Fischer", "Fuentes", "Garnier", "Gomez", "Hansen", "Harris", "Hoffmann", "Iglesias", "Jansen", "Keller", "Kramer", "Lambert", "Lange", "Leroy", "Lopez", "Marchand", "Meyer", "Molina", "Moreau", "Morris", "Navarro", "Neumann", "Ortega", "Parker", "Perrin", "Ramos", "Richter", "Romero", "Roth", "Santos", "Schubert", "Turner", "Vidal", "Walker", "Winter"]
_ADDRESS = {"mr": "m", "mister": "m", "sir": "m", "lord": "m", "herr": "m", "herrn": "m", "monsieur": "m", "señor": "m", "don": "m"}
_ADDRESS |= {"mrs": "f", "ms": "f", "miss": "f", "lady": "f", "madam": "f", "frau": "f", "fräulein": "f", "madame": "f", "mme": "f", "mademoiselle": "f", "mlle": "f", "señora": "f", "señorita": "f", "doña": "f"}
_ADDRESS |= {"dr": "u", "doctor": "u", "prof": "u", "professor": "u", "professeur": "u", "docteur": "u", "profesor": "m", "profesora": "f", "doctora": "f"}
# Forms of address that are also ordinary words, and so need a capital.
_CAPITAL_ONLY = ("miss", "don", "sir", "lady", "lord")
_VOWELS = ("aeiou", "AEIOU")


def _ranges(kinds: tuple[str, ...]) -> str:
    """The inside of a pattern's set: all characters of these Unicode categories."""
    points = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in kinds]
    firsts = [p for p, before in zip(points, [-2, *points], strict=False) if p != before + 1]
    lasts = [p for p, after in zip(points, [*points[1:], -2], strict=True) if p != after - 1]
    return "".join(re.escape(chr(a)) + "-" + re.escape(chr(b)) for a, b in zip(firsts, lasts, strict=True))


# Words of names: letters of any script with their marks, begun by one that is no small
# letter; hyphens and apostrophes within.  An initial keeps its dot.  Fixed values:
# particles within names, and capitalised words that number something, not a name.
_BEGIN = f"[{_ranges(('Lu', 'Lt', 'Lo'))}]"
_LETTERS = "(?:[^\\W\\d_][\u0300-\u036f]*)"
_WORD = f"(?:{_BEGIN}\\.(?= )|(?:[dlDL]['’])?(?={_BEGIN}){_LETTERS}++(?:['’‐-]{_LETTERS}++)*+)"
_PARTICLES = "(?: (?:de|da|di|do|du|dos|del|della|der|den|la|le|las|los|van|von|zu|zum|zur|ten|ter|af|av|bin|bint|ibn|al|el))"
_NUMBERED = "(?:Version|Chapter|Section|Page|Room|Table|Figure|Part|Number|No|Kapitel|Abschnitt|Seite|Raum|Tabelle|Teil|Nummer|Nr|Chapitre|Salle|Tableau|Capítulo|Sección|Página|Tabla)"
_NAME = f"{_WORD}(?:{_PARTICLES}{{0,3}} (?!{_NUMBERED}\\.? ?\\d){_WORD})*"
_QUOTES = "\"'`“”‘’«»"
# Words before numbers with dots that are no addresses, and dates at the start of what may be a phone number.
_VERSION = re.compile(r"(?i:\b(?:version|versión|ver|release|build|firmware|v)\.? ?)$")
_DATED = re.compile(r"(?:(?:19|20)\d\d[ ./-](?:0?[1-9]|1[0-2])[ ./-](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[ ./-](?:0?[1-9]|1[0-2])[ ./-](?:19|20)\d\d)(?!\d)")


def _address() -> str:
    """A form of address: in any case, but with a capital where it is an ordinary word as well."""
    free = "|".join(a for a in _ADDRESS if a not in _CAPITAL_ONLY)
    return f"(?:(?i:{free})|{'|'.join(x for a in _CAPITAL_ONLY for x in (a.title(), a.upper()))})"


_PATTERNS = {
    "email": r"(?<![\w.+-])[^\W_][\w.+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}",
    "secret": r"(?i:(?<![^\W_])(?:token|secret|password|passwd|passphrase|pwd|api[ _-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*)"
    + rf"(?:\"([^\"\n]{{4,}})\"|'([^'\n]{{4,}})'|[{_QUOTES}]?([^\s{_QUOTES}]{{3,}}[^\s{_QUOTES}.,;:!?)\]}}]))",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    "ip": r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+(?:\)?[ ./-]?\(?\d){8,15}(?!\w)"
    # with brackets, with a leading 0 in groups, or as ten digits in the groups that North America writes
    + r"|(?<!\d[ ./-])(?:\(\d{1,5}\)[ .-]?\d{2,}(?:[ .-]\d{2,})*|0\d{1,5}[ /-]\d{3,}(?:[ .-]\d{2,})*|0\d(?:[ .-]\d\d){4}|(?:1[ .-])?\d{3}(?:([.-])\d{3}\1| \d{3}-)\d{4})(?![\w-]|[.,]\d))",
    "name": rf"\b((?:{_address()}\.? )+)({_NAME})",
}


def _titles() -> re.Pattern:
    """A form of address before what may be a name, for a quick look: it starts with one of few letters."""
    ends: dict[str, list[str]] = {}
    for title in sorted(_ADDRESS, key=len, reverse=True):
        ends.setdefault(title[0], []).append(title[1:])
    firsts = "".join(c + c.upper() for c in ends)
    whole = "|".join(f"(?<=[{c}{c.upper()}])(?i:{'|'.join(e)})" for c, e in ends.items())
    return re.compile(rf"[{firsts}](?<!\w.)(?:{whole})\.? (?=[^\W\d_a-z]|[dl]['’])")


_TITLED = _titles()
_NAME_WORD = re.compile(rf"(?<![^\W\d_]){_WORD}")
_FINDERS = {kind: re.compile(p) for kind, p in _PATTERNS.items()}
_NAME_KINDS = {"family", *(f"{k}:{g}" for k in ("name", "given") for g in "fmu")}
_DIGIT = re.compile(r"\d")
# Types that may match in a text without any digit, as \d has them.
_DIGITLESS = ["email", "secret", "hex", "name"]


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of the entities of a text, in order and apart from each other.

    A match that overlaps an earlier type's is left out.  A phone number has a plus
    and 8 to 15 digits, or 9 to 15 and a bracket or a leading 0, or is written as in
    North America (555-123-4567); dates and other groups of digits are none.  Numbers of
    versions are no addresses.
    A name behind a form of address is one entity (``name:`` and the gender); elsewhere
    the words of such names are entities each (``given:`` and the gender, or ``family``).
    """
    kinds = list(_FINDERS) if _DIGIT.search(text) else _DIGITLESS
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def take(start: int, end: int, kind: str) -> None:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind))

    words: dict[str, str] = {}
    for kind in kinds:
        if (kind == "email" and "@" not in text) or (kind == "name" and not _TITLED.search(text)):
            continue
        for m in _FINDERS[kind].finditer(text):
            start, end = m.span(0 if kind == "phone" else m.lastindex or 0)
            if kind == "phone" and m[0][0] != "+" and (not 9 <= len(_digits(m[0])) <= 15 or _DATED.match(m[0])):
                continue
            if kind == "ip" and _VERSION.search(text, max(0, start - 12), start):
                continue
            if kind == "name":
                gender = f"name:{_gender(m[1])}"
                for part, value in name_parts(gender, text[start:end]):
                    if part and len(value) > 2:
                        words.setdefault(value, part)
                take(start, end, gender)
            else:
                take(start, end, kind)
    if words:
        for m in _NAME_WORD.finditer(text):
            if m[0] in words:
                take(*m.span(), words[m[0]])
    return sorted(found)


def _gender(addresses: str) -> str:
    told = [_ADDRESS[a.strip(".").lower()] for a in addresses.split()]
    return next((g for g in told if g != "u"), "u")


def name_parts(kind: str, name: str) -> list[tuple[str, str]]:
    """The words of a name with their types, and what stands between them without one.

    The last word is the family name, unless it is the only one and a known first name.
    A first name that only one gender bears tells it where the form of address does not.
    """
    pieces = re.split("( )", name)
    last = max(i for i, x in enumerate(pieces) if x.strip())
    listed = {n: g for g in ("u", "m", "f") for n in _FIRST_NAMES[g]}
    out = []
    for i, x in enumerate(pieces):
        if not x.strip() or (i < last and x.islower()):  # blanks and particles
            out.append(("", x))
        elif i == last and (i > 0 or x not in listed):
            out.append(("family", x))
        else:
            gender = kind[-1] if kind[-1] != "u" else listed.get(x, "u")
            out.append((f"given:{gender}", x))
    return out


def canonical(kind: str, value: str) -> str:
    """What makes two mentions one entity: case does not in e-mail addresses, nor do separators in numbers."""
    if kind == "email":
        return value.lower()
    if kind == "phone":
        return "+" * value.startswith("+") + _digits(value)
    return re.sub(r"[ .-]", "", value) if kind in ("card", "iban", "ssn") else value


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permute(digits: list[int], bases: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the numbers with these digits in these bases."""
    n = len(digits)
    if n < 2:
        return [(d + _prf(key, tweak, b)) % b for d, b in zip(digits, bases, strict=True)]
    half, out = n // 2, list(digits)
    for turn in range(_TURNS):
        left, right = (range(half), range(half, n)) if turn % 2 else (range(half, n), range(half))
        noise = _prf(key, tweak, turn, *(out[i] for i in right))
        for i in left:
            noise, step = divmod(noise, bases[i]) if noise > bases[i] else (_prf(key, tweak, turn, i, noise), 0)
            out[i] = (out[i] + step) % bases[i]
    return out


@cache
def _class_of(c: str) -> str | None:
    """The characters that may stand for one: a fixed class, its script's digits, or its kind within its block of 128."""
    for letters in _CLASSES:
        if c in letters:
            return letters
    if not c.isalnum():
        return None
    digit, first = unicodedata.decimal(c, None), ord(c) & ~0x7F
    if digit is not None:
        return "".join(chr(ord(c) - digit + i) for i in range(10))
    block = [x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == unicodedata.category(c)]
    known = "".join(_CLASSES)
    block = [x for x in block if x not in known and x in (x.upper().lower(), x.lower().upper())]  # case can change and come back
    return "".join(block) if c in block and len(block) > 1 else None


def _keyed_text(length: int, letters: str, key: bytes, *parts: object) -> str:
    return "".join(letters[_prf(key, *parts, i) % len(letters)] for i in range(length))


@cache
def _sounds_of(c: str) -> str | None:
    """As :func:`_class_of`, with vowels and other letters apart, so that names can be spoken."""
    for vowels, letters in zip(_VOWELS, _CLASSES[1:3], strict=True):
        if c in letters:
            return vowels if c in vowels else "".join(x for x in letters if x not in vowels)
    return _class_of(c)


def _permuted_text(value: str, key: bytes, tweak: str, letters_of: str | None = None, class_of=_class_of) -> str:
    """The value with its letters and digits permuted within script and case; the rest stays.

    A value without any is replaced whole by keyed letters and digits.
    """
    places, digits, bases, letters = [], [], [], []
    for i, c in enumerate(value):
        found = letters_of or class_of(c)
        if found:
            places.append(i), digits.append(found.index(c)), bases.append(len(found)), letters.append(found)
    if value and not places:
        return _keyed_text(len(value), "".join(_CLASSES[:3]), key, tweak, value)
    form = "".join(x[0] + x[1] for x in letters) if class_of is _sounds_of else "".join(x[0] for x in letters)
    out = list(value)
    for i, d, x in zip(places, permute(digits, bases, key, f"{tweak}/{form}"), letters, strict=True):
        out[i] = x[d]
    return "".join(out)


def _luhn(digits: str) -> int:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def surrogate(kind: str, value: str, key: bytes, turn: int = 0) -> str:
    """The replacement of a canonical value: same type, script and format, valid where the value is.

    From PLAIN_TURNS on, forms of any length grow by one keyed character more with
    each turn, and a phone number's country code no longer stays.
    """
    tweak, grown = f"{kind}/{turn}", max(0, turn - PLAIN_TURNS + 1)
    if kind == "email":
        local, domain = value.split("@", 1)
        labels = domain.split(".")
        rest = local + "@" + ".".join(labels[:-1])
        made = _permuted_text(rest, key, tweak) if any(map(_class_of, rest)) else f"{_permuted_text(local, key, tweak)}@{domain.rpartition('.')[0]}"
        return f"{_keyed_text(grown, _CLASSES[1], key, tweak, value)}{made}.{labels[-1]}"
    if kind == "card":  # the check digit stays right where it is
        body, off = value[:-1], (int(value[-1]) - _luhn(value[:-1])) % 10
        body = _permuted_text(body, key, tweak)
        return body + _class_of(value[-1])[(_luhn(body) + off) % 10]
    if kind == "ip":
        digits = _class_of(value[0])
        return ".".join("".join(digits[int(d)] for d in str(x)) for x in permute([int(x) for x in value.split(".")], [256] * 4, key, tweak))
    if kind == "phone":  # the country code stays
        head = re.match(r"\+\d", value) if not grown else None
        head = head[0] if head else ""
        return head + _permuted_text(value[len(head) :], key, tweak)
    if kind in ("hex", "secret") and re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        letters = _HEX[0] if value == value.lower() else _HEX[1]
        return _permuted_text(value, key, tweak, letters) + _keyed_text(grown, letters, key, tweak, value)
    if kind == "iban":
        return value[:2] + _permuted_text(value[2:], key, tweak)
    if kind == "family" or kind.startswith("given"):
        names = _FAMILY_NAMES if kind == "family" else _FIRST_NAMES[kind[-1]]
        if turn < LIST_TURNS and value.isalpha() and len(value) > 1 and unicodedata.name(value[0], "").startswith("LATIN"):
            if value in names:
                return names[permute([names.index(value)], [len(names)], key, tweak)[0]]
            made = names[_prf(key, tweak, value) % len(names)]
            return made.upper() if value.isupper() else made
        return _permuted_text(value, key, tweak, class_of=_sounds_of) + _keyed_text(grown, _class_of(value[-1].lower()) or _CLASSES[1], key, tweak, value)
    return _permuted_text(value, key, tweak) + _keyed_text(grown if kind == "secret" else 0, "".join(_CLASSES[:3]), key, tweak, value)


def _as_written(kind: str, written: str, replacement: str) -> str:
    """The replacement with the separators and the case of the mention."""
    if kind == "email":
        return replacement.upper() if written == written.upper() else replacement
    if kind == "phone":
        digits = iter(_digits(replacement))
        return "".join(next(digits) if c.isdecimal() else c for c in written)
    if kind not in ("card", "iban", "ssn"):
        return replacement
    letters = iter(replacement)
    return "".join(c if c in " .-" else next(letters) for c in written)


def entities_of(text: str, start: int, end: int, kind: str) -> list[tuple[str, str]]:
    """What of a found entity has a surrogate: its type and canonical value, or those of the words of a name."""
    if kind.startswith("name"):
        return [(k, v) for k, v in name_parts(kind, text[start:end]) if k]
    return [(kind, canonical(kind, text[start:end]))]


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(h, *e) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for x in find_entities(t) for e in entities_of(t, *x)}
        rows = sorted(found)
        kinds = (pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_text", "kind", "value"])


def find_mentions(docs: DataFrame) -> DataFrame:
    """_text (hash of the text), kind and value of the entities of each text, written as a table.

    Texts stand for rows: doc_id may be null or repeated, and texts that share a hash
    only share what is looked up for them."""
    return cut(docs.select(F.xxhash64("text"), "text").mapInArrow(_mentions, "_text long, kind string, value string"), "mentions")


def _assigned(entities: DataFrame, key: bytes, turn: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, v, key, turn) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["kind", "value", "surrogate"])

    # a number of its own keeps the work in as many tasks, however few bytes they have
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = entities.select("kind", "value").repartition(parts, "kind", "value")
    return dealt.mapInArrow(run, "kind string, value string, surrogate string").withColumn("turn", F.lit(turn))


def checked_surrogates(mentions: DataFrame, key: bytes) -> DataFrame:
    """kind, value, surrogate and turn of every entity of the mentions, checked for collisions.

    An entity whose surrogate is a real entity, or that of another entity as well
    (then all but the smallest value), takes the next turn of its permutation, until
    there is none.  Forms of fixed width (cards, ssn, ip, iban, phones) have millions
    of values at least; all others grow.
    """
    entities = cut(mentions.select("kind", "value").distinct(), "entities")
    real = entities.select(F.col("value").alias("surrogate")).distinct()
    final = cut(_assigned(entities, key, 0), "assigned_0")
    for turn in count(1):
        least = final.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("owner"), F.count("*").alias("owners"))
        meets = final.join(least.where("owners > 1"), "surrogate").where(F.struct("value", "kind") != F.col("owner")).select("kind", "value")
        colliding = cut(final.join(real, "surrogate", "left_semi").select("kind", "value").unionByName(meets).distinct(), f"colliding_{turn}")
        if not colliding.limit(1).count():
            discard(entities, colliding)
            return final
        stay = final.join(colliding, ["kind", "value"], "left_anti")
        new = cut(stay.unionByName(_assigned(colliding, key, turn)), f"assigned_{turn}")
        discard(final, colliding)
        final = new
    raise AssertionError("count() does not end")


def assign_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, value, surrogate and turn of every entity of the documents: see :func:`checked_surrogates`."""
    return checked_surrogates(find_mentions(docs), key)


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities, the number of mentions replaced.

    Null and empty texts stay, and a null doc_id makes no difference; texts of any
    length are searched whole; other columns (but one named n_entities) and repeated
    rows stay as they are; an empty table gives no rows.
    """
    mentions = find_mentions(docs)
    odd = checked_surrogates(mentions, key).where("turn > 0").select("kind", "value", "turn")
    # written, so that its size is known where it is joined
    per_text = cut(mentions.join(odd, ["kind", "value"]).distinct().groupBy("_text").agg(F.collect_list(F.struct("kind", "value", "turn")).alias("_turns")), "turns")
    discard(mentions)
    source = docs.drop("n_entities")
    columns = source.columns
    hash_name, turns_name = fresh("_text_hash", columns), fresh("_turns", columns)

    def replaced(text: str | None, turns: dict) -> tuple[str | None, int]:
        found = find_entities(text) if text else []
        parts, at, n = [], 0, 0

        def made(kind: str, value: str) -> str:
            return surrogate(kind, value, key, turns.get((kind, value), 0))

        for i, (a, b, kind) in enumerate(found):
            mention = text[a:b]
            if kind.startswith("name"):
                new = "".join(made(k, v) if k else v for k, v in name_parts(kind, mention))
            else:
                new = _as_written(kind, mention, made(kind, canonical(kind, mention)))
            # words of a name side by side are one mention
            n += not (i and kind in _NAME_KINDS and found[i - 1][2] in _NAME_KINDS and text[at:a] == " ")
            parts += [text[at:a], new]
            at = b
        return ("".join([*parts, text[at:]]) if found else text), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = [{(x["kind"], x["value"]): x["turn"] for x in r or ()} for r in b.column(turns_name).to_pylist()]
            rows = [replaced(t, x) for t, x in zip(b.column("text").to_pylist(), turns, strict=True)]
            new = {"text": pa.array([r[0] for r in rows], pa.string())}
            yield pa.RecordBatch.from_arrays([*(new.get(c, b.column(c)) for c in columns), pa.array([r[1] for r in rows], pa.int64())], names=[*columns, "n_entities"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in source.dtypes), "n_entities bigint"])
    joined = source.withColumn(hash_name, F.xxhash64("text")).join(per_text.toDF(hash_name, turns_name), hash_name, "left").select(*columns, turns_name)
    return joined.mapInArrow(run, schema)
