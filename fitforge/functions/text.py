"""Text of web pages and rules on texts, as column expressions."""

from __future__ import annotations

import html as standard

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose bodies are no text, those that start and end a line, and tags that show a text to be HTML.
_SKIPPED = ("script", "style", "noscript", "head")
_BLOCKS = "p|div|br|ul|ol|h1|h2|h3|h4|h5|h6|tr|section|article|header|footer|table|blockquote|pre"
_TELLING = r"(?i)<(p|div|br|li|ul|ol|h[1-6]|span|strong|b|em|table)\b"
# What may be a character's name or number; some names need no semicolon.
_REFERENCE = "&(?:#[0-9]|#[xX][0-9A-Fa-f]|[A-Za-z])"


def unescaped(text: Column) -> Column:
    """Text with characters in place of their HTML names and numbers, one level of them: all of the standard's.

    Spark has no function for it; only texts that hold a reference go to Python, a batch at a time.
    """

    @F.arrow_udf("string")
    def replaced(column: pa.Array) -> pa.Array:
        return pa.array([x if x is None or "&" not in x else standard.unescape(x) for x in column.to_pylist()], pa.string())

    return F.when(text.rlike(_REFERENCE), replaced(F.when(text.rlike(_REFERENCE), text))).otherwise(text)


def html_to_text(html: Column) -> Column:
    """The text of HTML, one line a block, items with bullets; plain text only has its named characters replaced.

    Markup that is escaped as a whole is unescaped first.
    """
    raw = F.when(F.contains(html, F.lit("&lt;")) & ~F.contains(html, F.lit("<")), unescaped(html)).otherwise(html)
    text = raw
    for tag in _SKIPPED:
        text = F.regexp_replace(text, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, "(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)<li(?:\s[^>]*)?>", "\n• ")
    text = F.regexp_replace(text, rf"(?i)</li\s*>|</?(?:{_BLOCKS})(?:\s[^>]*)?/?>", "\n")
    text = unescaped(F.regexp_replace(text, "</?[A-Za-z!][^>]*>", ""))
    text = F.when(raw.rlike(_TELLING), text).otherwise(unescaped(raw))
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t ]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, "(?m)^ +| +$", ""), "\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def letter_share(text: Column) -> Column:
    """Letters among the characters that are no white space; null without any."""
    letters, rest = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, r"[ \t\r\n]", ""))
    return letters / F.when(rest > 0, rest)


def english_list(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n > 1, F.concat(head, F.lit(" and "), F.try_element_at(items, F.lit(-1)))).otherwise(F.array_join(items, ", "))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3) + 1
