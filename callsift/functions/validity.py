"""JSON validity, the one check Spark's own JSON functions do not decide alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One character stands for a whole string, one for any other whole value.
STRING, VALUE = "\x01", "\x02"

# Tokens of JSON (fixed values).  Possessive repeats run as loops, so texts of any length are matched
# without recursion.
_STRINGS = r'"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1F]*+)*+"'
_NUMBERS = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?+[0-9]++)?+"
_OTHERS = rf"true|false|null|NaN|-?+Infinity|{_NUMBERS}"
# Objects and arrays without further ones inside, over the characters above.
_INNERMOST = (
    r"\{(?:\x01:[\x01\x02](?:,\x01:[\x01\x02])*+)?+\}"
    r"|\[(?:[\x01\x02](?:,[\x01\x02])*+)?+\]"
)

# Levels of nesting that are folded by patterns, and the deepest one that is accepted at all.
FOLDED, DEEPEST = 2, 2_000


def _outline(body: Column) -> Column:
    """The text with one character per string and value, folded from the inside; null where the text holds one itself."""
    own = F.contains(body, F.lit(STRING)) | F.contains(body, F.lit(VALUE))
    text = F.regexp_replace(F.when(~own, body), _STRINGS, STRING)
    text = F.translate(F.regexp_replace(text, _OTHERS, VALUE), " \t\r\n", "")
    for _ in range(FOLDED):
        text = F.regexp_replace(text, _INNERMOST, VALUE)
    return text


def _nests(outline: Column) -> Column:
    """Whether an outline is one value: a fold over its characters with the open brackets and what may come next.

    What may come next is a value, a (first) value or the end of an array, a first or
    further key, a colon, a comma or closing bracket ("after"), or nothing ("fail").
    """

    def step(state: Column, char: Column) -> Column:
        opened, due = state["opened"], state["due"]
        inner = F.right(opened, F.lit(1))
        value_due = due.isin("value", "first")
        starts = value_due & char.isin("{", "[") & (F.length(opened) < DEEPEST)
        ends = ((char == "}") & (inner == "{") & due.isin("first key", "after")) | (
            (char == "]") & (inner == "[") & due.isin("first", "after")
        )
        following = (
            F.when(starts, F.when(char == "{", "first key").otherwise("first"))
            .when(ends | (value_due & char.isin(STRING, VALUE)), "after")
            .when(due.isin("first key", "key") & (char == STRING), "colon")
            .when((due == "colon") & (char == ":"), "value")
            .when((due == "after") & (char == ",") & (inner == "{"), "key")
            .when((due == "after") & (char == ",") & (inner == "["), "value")
            .otherwise("fail")
        )
        brackets = (
            F.when(starts, F.concat(opened, char))
            .when(ends, F.left(opened, F.length(opened) - 1))
            .otherwise(opened)
        )
        return F.struct(brackets.alias("opened"), following.alias("due"))

    start = F.struct(F.lit("").alias("opened"), F.lit("value").alias("due"))
    return F.aggregate(
        F.split(outline, ""), start, step, lambda s: (s["opened"] == "") & (s["due"] == "after")
    )


def json_valid(body: Column, needed: Column) -> Column:
    """Whether ``body`` is one JSON document, asked only where ``needed`` holds; false elsewhere.

    Accepts what common parsers accept, ``NaN`` and ``Infinity`` included.  Null and
    empty texts and brackets nested deeper than :data:`DEEPEST` are not valid.

    Strings and values become one character each and :data:`FOLDED` levels of brackets are
    folded by patterns.  Mostly one character is left; only deeper texts are read
    character by character.
    """
    outline = _outline(body)
    valid = F.when(outline.isin(STRING, VALUE), True).otherwise(
        # What is valid and not yet folded has something to fold; cut-off texts mostly have not.
        outline.rlike(_INNERMOST) & ~outline.rlike(r"[^\x01\x02{}\[\]:,]") & _nests(outline)
    )
    return F.coalesce(F.when(needed, valid), F.lit(False))
