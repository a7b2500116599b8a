"""Feedback that a language model gave as JSON: what is wrong with it, and what is shown instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitforge.functions.postings import let

# Kinds and severities of items, how many there are, and characters of a message.
KINDS, SEVERITIES = ("missing_skill", "weak_requirement", "structure", "strength"), ("high", "medium", "low")
FEWEST, MOST, SHORTEST, LONGEST = 5, 8, 10, 500
ITEM = "struct<type:string,severity:string,message:string>"


def _text(value: Column, path: str) -> Column:
    """The string at a path; null where there is none or something else, a number for instance."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def _item_errors(item: Column, i: Column) -> Column:
    """What is wrong with one item, as an array of strings that begin with its number."""

    def told(wrong: Column, what: str) -> Column:
        return F.when(F.coalesce(wrong, F.lit(True)), F.concat(i.cast("string"), F.lit(f": {what}")))

    message = _text(item, "$.message")
    checks = F.array(
        told(~_text(item, "$.type").isin(*KINDS), "type"),
        told(~_text(item, "$.severity").isin(*SEVERITIES), "severity"),
        told(~F.char_length(message).between(SHORTEST, LONGEST), "message"),
    )
    return F.array_compact(checks)


def answer_errors(answer: Column) -> Column:
    """Everything that is wrong with an answer, in order; an empty array if it can be used.

    An answer is a JSON object whose ``items`` are FEWEST to MOST objects with type,
    severity and message; one at least is a strength.  Null and broken JSON are ``no
    JSON``, anything but such a list ``no items``; other fields do not matter.
    """

    def of(parsed: Column) -> Column:
        items = F.try_variant_get(parsed, "$.items", "array<variant>")
        n = F.size(items)
        each = F.flatten(F.transform(items, _item_errors))
        strong = F.exists(items, lambda x: F.coalesce(_text(x, "$.type") == "strength", F.lit(False)))
        whole = F.array_compact(F.array(F.when(~n.between(FEWEST, MOST), F.concat(n.cast("string"), F.lit(" items"))), F.when(~strong, F.lit("no strength"))))
        listed = F.schema_of_variant(parsed).startswith("OBJECT") & items.isNotNull()
        return F.when(parsed.isNull(), F.array(F.lit("no JSON"))).when(~F.coalesce(listed, F.lit(False)), F.array(F.lit("no items"))).otherwise(F.concat(whole, each))

    return let(_parsed(answer), of)


def _parsed(answer: Column) -> Column:
    """The JSON value of a text as a variant, null where it is none or something stands behind it.

    Spark's parser stops behind the first value; so what follows the text must be found again."""
    inside = F.try_parse_json(F.concat(F.lit('{"answer":'), answer, F.lit(',"whole":true}')))
    return let(inside, lambda v: F.when(F.coalesce(F.try_variant_get(v, "$.whole", "boolean"), F.lit(False)), F.try_variant_get(v, "$.answer", "variant")))


def chosen_feedback(answer: Column, templates: Column) -> Column:
    """items (an array of ITEM), source (``llm`` or ``template``) and errors: the answer's items, or all of the templates if it has any error."""

    def of(errors: Column) -> Column:
        own = F.try_variant_get(F.try_parse_json(answer), "$.items", f"array<{ITEM}>")
        usable = F.size(errors) == 0
        return F.struct(F.when(usable, own).otherwise(templates.cast(f"array<{ITEM}>")).alias("items"), F.when(usable, "llm").otherwise("template").alias("source"), errors.alias("errors"))

    return let(answer_errors(answer), of)
