"""What a judge's reply says: VARIANT expressions over small tables of rules, so reading replies stays in the JVM.

A value is first bared, layer by layer, of the objects and one-element lists that it may be wrapped in; what is left is
read by its type. A value that can't be read gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import json_object, let

# Words that stand for true and false, and keys under which replies keep things, in order of priority.
TRUE_WORDS = ["true", "yes", "y", "correct", "1"]
FALSE_WORDS = ["false", "no", "n", "incorrect", "0", ""]
COUNT_KEYS = ["count", "value", "total"]
LIST_KEYS = ["claims", "items"]
FLAG_KEYS = ["correct_answer", "is_correct", "correct", "count", "value", "total"]
MESSAGE_KEYS = ["message", "delta"]
TEXT_KEYS = ["content", "reasoning_content", "reasoning", "text"]
REPLY_KEYS = ["output_text", "content", "text", "reasoning_content", "reasoning"]
COUNTS = ["supported_claims", "total_claims", "fabricated_claims"]

#: Fields of a reply that hold what was said, wherever they lie in it.
SAID_KEYS = ["content", "text", "output_text", "reasoning", "reasoning_content"]
VERDICT = "struct<" + ",".join(f"{c}:int" for c in [*COUNTS, "correct_answer"]) + ">"


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _items(v: Column) -> Column:
    """A list's values; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _number(v: Column) -> Column:
    """Finite number of a number, truth value or numeric text; null for the rest."""
    x = F.try_variant_get(v, "$", "double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _levels(json: Column) -> Column:
    """As many items as a JSON text opens lists and objects: no value in it lies deeper."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(json, F.lit(r"[\[{]"))))


def _bare(v: Column, keys: list[str], only_numbers: bool) -> Column:
    def layer(x: Column) -> Column:
        alone = F.when(F.size(_items(x)) == 1, _items(x)[0])
        if only_numbers:
            alone = F.when(_number(alone).isNotNull(), alone)
        return F.coalesce(*[_at(x, k) for k in keys], alone, x)

    return F.aggregate(_levels(F.to_json(v)), v, lambda x, _: layer(x))


def count(v: Column) -> Column:
    """A VARIANT as a count, 0 at least: numbers, truth values, numeric texts; lists by their length, but a list of one
    number is that number; objects by what they hold under COUNT_KEYS, or the length of their LIST_KEYS. Nothing is 0."""

    def read(x: Column) -> Column:
        blank = _is(x, "VOID") | (_is(x, "STRING") & (F.btrim(F.try_variant_get(x, "$", "string")) == ""))
        listed = F.coalesce(_items(x), *[_items(_at(x, k)) for k in LIST_KEYS])
        return F.when(x.isNull() | blank, 0).otherwise(F.coalesce(F.when(_number(x) < 0, 0).otherwise(_number(x).cast("long")), F.size(listed))).cast("int")

    return let(_bare(v, COUNT_KEYS, only_numbers=True), read)


def flag(v: Column) -> Column:
    """A VARIANT as 0 or 1: truth values, numbers from 0.5 on, words of either kind, alone or wrapped. Nothing is 0."""

    def read(x: Column) -> Column:
        word = F.when(_is(x, "STRING"), F.lower(F.btrim(F.try_variant_get(x, "$", "string"))))
        known = F.when(word.isin(TRUE_WORDS), 1).when(word.isin(FALSE_WORDS), 0)
        return F.when(x.isNull() | _is(x, "VOID"), 0).otherwise(F.coalesce(known, (_number(x) >= 0.5).cast("int")))

    return let(_bare(v, FLAG_KEYS, only_numbers=False), read)


def verdict(text: Column) -> Column:
    """struct(supported_claims, total_claims, fabricated_claims, correct_answer) of the JSON object that a text is or
    holds; null if there is none or one of the four can't be read. What an object doesn't mention is 0."""

    def read(said: Column) -> Column:
        found = [*[count(_at(said, k)).alias(k) for k in COUNTS], flag(_at(said, "correct_answer")).alias("correct_answer")]
        whole = said.isNotNull()
        for f in found:
            whole &= f.isNotNull()
        return F.when(whole, F.struct(*found)).cast(VERDICT)

    return let(F.try_parse_json(json_object(text)), read)


def _text(v: Column) -> Column:
    """A text, the texts of a list's parts one after another, or the text of an object."""
    own = lambda x: F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string"))
    part = lambda x: F.coalesce(own(x), *[own(_at(x, k)) for k in SAID_KEYS], F.lit(""))
    listed = F.array_join(F.transform(_items(v), part), "")
    return F.btrim(F.coalesce(own(v), listed, *[own(_at(v, k)) for k in SAID_KEYS], F.lit("")))


def _said(v: Column, json: Column) -> Column:
    """The texts under SAID_KEYS anywhere in a VARIANT, the ones nearer to its root first, then by the names they lie under.

    Goes down level by level through lists and through objects' other fields; a field of those names is taken as a text
    and not entered. The state is the values of one level, and there are as many levels as the JSON text has brackets.
    """
    fields = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
    own = lambda x: F.map_values(F.map_filter(fields(x), lambda k, _: k.isin(SAID_KEYS)))
    inner = lambda x: F.coalesce(F.map_values(F.map_filter(fields(x), lambda k, _: ~k.isin(SAID_KEYS))), _items(x))
    each = lambda level, part: F.flatten(F.transform(level, lambda x: F.coalesce(part(x), F.array().cast("array<variant>"))))
    state = lambda level, found: F.struct(level.alias("level"), found.alias("found"))
    start = state(F.array(v), F.array().cast("array<string>"))

    def down(acc: Column, _: Column) -> Column:
        return state(each(acc["level"], inner), F.concat(acc["found"], F.transform(each(acc["level"], own), _text)))

    return F.aggregate(_levels(json), start, down, lambda acc: acc["found"])


def reply_text(reply: Column) -> Column:
    """The text of a chat reply given as JSON: of the choices' messages, the reply's own fields and then of all fields named
    so in it, the first text that holds an object; else the first that isn't blank; else the empty text. Other fields, a
    request that is given back say, are never read."""

    def read(v: Column) -> Column:
        choices = F.coalesce(_items(_at(v, "choices")), F.array(_at(v, "choices")))
        of_choice = lambda c: F.array(*[_text(_at(_at(c, box), k)) for box in MESSAGE_KEYS for k in TEXT_KEYS], _text(_at(c, "text")))
        usual = F.concat(F.flatten(F.transform(choices, of_choice)), F.array(*[_text(_at(v, k)) for k in REPLY_KEYS]))
        some = lambda texts: F.filter(texts, lambda s: s != "")
        holding = lambda texts: F.get(F.filter(texts, lambda s: s.rlike(r"(?s)\{.*\}")), F.lit(0))
        # The rest of the reply is gone through only if the usual fields hold no object.
        rest = lambda a: let(some(_said(v, reply)), lambda b: F.coalesce(holding(b), F.get(a, F.lit(0)), F.get(b, F.lit(0))))
        return let(some(usual), lambda a: F.coalesce(holding(a), rest(a), F.lit("")))

    return let(F.try_parse_json(reply), read)
