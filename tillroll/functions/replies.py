"""Logged model responses: the reply text, errors, and values as loose as models write them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.text import ANY_BLANK, ascii_digits, let, strip

# Texts, outcome names, number prefixes and the spelling of numbers.
NO_ERROR_DETAIL = "no error detail returned"
NO_TEXT_IN_RESPONSE = "response contained no text"
NO_RESPONSE = "no response"
DONE, FAILED, RETRYABLE = "done", "failed", "retryable"
NUMBER_PREFIX = "$£€₱¥ "
_DIGITS = "[0-9]+(?:_[0-9]+)*"
NUMBER = (
    f"(?i)^[+-]?(?:(?:{_DIGITS}(?:\\.(?:{_DIGITS})?)?|\\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    "|inf|infinity|nan)$"
)
# The blanks before a closing fence are trimmed with the rest, so no pattern looks for them.
OPENING, CLOSING = f"(?i)^{ANY_BLANK}*```(?:json)?", f"```{ANY_BLANK}*\\z"
# Numbers that JSON does not have. What lies between two of them is passed over in
# one piece, strings as a whole; possessive repeats need no stack, however long the text is.
_STRING = '"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"'


def _bare(number: str) -> str:
    """A value of JSON text that is spelled thus; what stands before it is group 1."""
    space = "[ \t\r\n]*+"
    end = f"(?={space}(?:[,}}\\]]|\\z))"
    ungrouped = number.replace("(", "").replace(")", "")
    passed = f"(?:[^\":,\\[]++|{_STRING}|[:,\\[](?!{space}{ungrouped}{end}))*+"
    return f"(?s)(^{space}|\\G{passed}[:,\\[]{space}){number}{end}"


_NAN, _INFINITY = _bare("NaN"), _bare("(-?)I(nf)(i)nity")
_EMPTY_ERRORS = ("", "0", "false", "[]")


def reply_text(body: Column) -> Column:
    """First part of the first candidate of a response body, else null."""
    return F.get_json_object(body, "$.candidates[0].content.parts[0].text")


def error_text(body: Column) -> Column:
    """The most readable error detail a body holds."""
    whole = F.get_json_object(body, "$.error")
    return F.coalesce(
        F.nullif(F.get_json_object(body, "$.error.message"), F.lit("")),
        F.nullif(F.get_json_object(body, "$.error.status"), F.lit("")),
        F.when(~whole.isin(*_EMPTY_ERRORS), whole),
        F.lit(NO_ERROR_DETAIL),
    )


def call_outcome(status: Column, reply: Column) -> Column:
    """What one attempt came to. Status 0 stands for no answer from the network."""
    again = (status == 0) | (status == 429) | status.between(500, 599)
    return (
        F.when((status == 200) & reply.isNotNull(), F.lit(DONE))
        .when(again, F.lit(RETRYABLE))
        .otherwise(F.lit(FAILED))
    )


def call_message(status: Column, reply: Column, body: Column) -> Column:
    return F.when(status != 200, error_text(body)).when(
        reply.isNull(), F.lit(NO_TEXT_IN_RESPONSE)
    )


def without_fence(reply: Column) -> Column:
    opened = F.regexp_replace(F.coalesce(reply, F.lit("")), F.lit(OPENING), F.lit(""))
    return strip(F.regexp_replace(opened, F.lit(CLOSING), F.lit("")))


def with_spelled_numbers(text: Column) -> Column:
    """The JSON text with the bare values NaN, Infinity and -Infinity as the strings nan, inf and
    -inf, which read as the same numbers. Strings are left as they are."""
    concerned = F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity"))
    spelled = F.regexp_replace(text, F.lit(_NAN), F.lit('$1"nan"'))
    spelled = F.regexp_replace(spelled, F.lit(_INFINITY), F.lit('$1"$2$4$3"'))
    return F.when(concerned, spelled).otherwise(text)


def parsed_with_end(text: Column) -> Column:
    """The text as the first of two array elements. The parser stops after the first value of a
    text; the second element only shows up where the text itself ends with its value."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


def whole_value(both: Column, text: Column) -> Column:
    """The JSON value of a text, out of `parsed_with_end`; null unless the whole text is one value."""
    whole = F.try_variant_get(both, "$[1]", "string") == F.md5(text)
    return F.when(whole, F.try_variant_get(both, "$[0]", "variant"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def clean_string(value: Column, path: str, as_text: Column) -> Column:
    """Any value as trimmed text, nothing left becomes null; `as_text` is the value at the path
    as a string."""
    return F.nullif(strip(_spelled(value, path, as_text)), F.lit(""))


def _spelled(value: Column, path: str, as_text: Column) -> Column:
    # Only these two texts may be a boolean's: no other value is asked for its kind.
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    boolean = as_text.isin("true", "false") & (kind == "BOOLEAN")
    return F.when(boolean, F.initcap(as_text)).otherwise(as_text)


def bare_number(text: Column) -> Column:
    """The text of a number without prefixes and commas."""
    return strip(F.ltrim(F.translate(text, ",", ""), F.lit(NUMBER_PREFIX)))


def number_of(bare: Column) -> Column:
    """Number out of what `bare_number` leaves; anything else is null."""
    return F.when(F.rlike(bare, F.lit(NUMBER)), F.translate(bare, "_", "").try_cast("double"))


def clean_number(text: Column) -> Column:
    """Number out of text such as "$1,234.5"; anything else is null."""
    return let(let(bare_number(text), lambda bare: ascii_digits(bare)), number_of)


def clean_items(value: Column) -> Column:
    """The objects among the line items; a missing or malformed list gives no items."""
    items = F.try_variant_get(value, "$.line_items", "array<variant>")

    def description(item: Column) -> Column:
        as_text = F.try_variant_get(item, "$.description", "string")
        return F.coalesce(strip(let(as_text, lambda text: _spelled(item, "$.description", text))), F.lit(""))

    return F.transform(
        F.filter(items, is_object),
        lambda item: F.struct(
            description(item).alias("description"),
            clean_number(F.try_variant_get(item, "$.amount", "string")).alias("amount"),
        ),
    )
