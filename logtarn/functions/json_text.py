"""Working on JSON text.

Nested members are held as JSON text, as the lake stores them. Text is checked and spliced, not
rebuilt from a parsed form, which is several times dearer than parsing.
"""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logtarn.functions.let import let

_SPACE = " \t\r\n"

#: Without these Spark's reader takes single quotes, NaN and Infinity for JSON.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def trimmed(text: Column) -> Column:
    """Text without the space that JSON allows around a value."""
    return F.btrim(text, F.lit(_SPACE))


def only_value(text: Column) -> Column:
    """``text`` without surrounding space, or null unless it is exactly one JSON value.

    Spark's JSON functions stop after the first value and ignore what follows it. Here the text is
    read as the first element of a two-element array whose second element is a hash of the text:
    only when the text is one complete value does the hash come out in second place.
    """
    mark = _mark(text)
    pair = F.from_json(
        F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", STRICT
    )
    complete = let(pair, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(1)) == mark))
    return F.when(complete, trimmed(text))


def only_object(text: Column, fields: dict[str, str]) -> Column:
    """The named members of ``text``, null unless it is exactly one JSON object.

    The same check as :func:`only_value`, made while the members are read. ``fields`` is as for
    :func:`object_fields`.
    """
    mark = _mark(text)
    kinds = ",".join(f"`{name}`: {kind}" for name, kind in fields.items())
    pair = F.from_json(
        F.concat(F.lit("["), text, F.lit(',{"_mark":"'), mark, F.lit('"}]')),
        f"array<struct<{kinds}, _mark: string>>",
        STRICT,
    )
    return let(
        pair,
        lambda p: F.when(
            (F.size(p) == 2) & (F.get(p, F.lit(1))["_mark"] == mark), F.get(p, F.lit(0))
        ),
    )


def _mark(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def is_object(text: Column) -> Column:
    """Whether a checked JSON value is an object."""
    return F.startswith(text, F.lit("{"))


def members(text: Column) -> Column:
    """The inside of a checked JSON object."""
    return F.btrim(
        let(text, lambda t: F.substring(t, F.lit(2), F.length(t) - 2)), F.lit(_SPACE)
    )


def with_members(text: Column, more: Column) -> Column:
    """A checked JSON object with the members ``more`` appended."""
    head = let(
        text,
        lambda t: F.when(t == "{}", F.lit("{")).otherwise(
            F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit(","))
        ),
    )
    return F.concat(head, more, F.lit("}"))


def object_fields(text: Column, fields: dict[str, str]) -> Column:
    """The named members of a JSON object as a struct, in one pass; all null for other values.

    ``fields`` maps a member to its type. Read as ``string``, scalars come as written, objects and
    arrays as JSON, JSON null as null. Read as ``variant`` they keep their type.
    """
    schema = ",".join(f"`{name}` {kind}" for name, kind in fields.items())
    return F.from_json(F.when(is_object(text), text), schema, STRICT)


def is_text(value: Column) -> Column:
    """Whether a VARIANT holds a string; false for SQL null."""
    return F.coalesce(F.schema_of_variant(value) == F.lit("STRING"), F.lit(False))


def is_text_or_null(value: Column) -> Column:
    """Whether a VARIANT holds a string or null, or is absent."""
    return F.coalesce(F.schema_of_variant(value).isin("STRING", "VOID"), F.lit(True))


def register_json_functions(spark: SparkSession) -> None:
    """Define the SQL function ``json_extract_string(text, path)`` for ad-hoc queries."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION json_extract_string(doc STRING, path STRING) "
        "RETURNS STRING RETURN get_json_object(doc, path)"
    )
