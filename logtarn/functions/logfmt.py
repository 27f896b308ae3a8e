r"""logfmt (``key=value key="quoted value" flag``) to JSON, as column expressions.

The rules are those of the public logfmt parser the collector configures:

* fields are separated by spaces or tabs, white space around ``=`` is ignored;
* keys and values may be quoted, with ``\"``, ``\\`` and ``\n`` escapes inside;
* a key without ``=`` stands for boolean true;
* a key that occurs more than once holds the list of its values, in order;
* a field that starts with ``=``, or a text without any field, is an error.

There are two ways through. :func:`plain_json` rewrites the text of ordinary messages with a few
patterns; :func:`full_json` takes any message apart field by field. Both give the same value.
All loops in the patterns are possessive: time is linear and the stack does not grow with the
length of a message.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtarn.functions.let import let

# An ordinary field: no quote, backslash or control character outside a quoted value, no escape
# in it that JSON would read differently, no space around the equals sign.
_PLAIN_KEY = r'[^ ="\\\x00-\x1f]++'
_PLAIN_VALUE = r'(?:"(?:[^"\\\x00-\x1f]++|\\["\\n])*+"|[^ "\\\x00-\x1f]++|(?=\z))'
_PLAIN_FIELD = rf"{_PLAIN_KEY}(?:={_PLAIN_VALUE})?+"
_PLAIN_TEXT = rf"^{_PLAIN_FIELD}(?: ++{_PLAIN_FIELD})*+ *+\z"
# In ordinary text: a key with a value, to be written as a JSON member.
_PAIR = r'(?<![^ ])([^ =]++)=(?:"((?:[^"\\]++|\\.)*+)"|([^ ]*+)) *+'
# Members already written, and the bare key behind them.
_BARE_KEY = r'\G((?:"[^"]*+":"(?:[^"\\]++|\\.)*+",)*+)([^ "]++) *+'

# Any field at all; a lone equals sign is what remains of a field without a key.
_QUOTED = r'"(?:[^"\\]++|\\[\s\S])*+"'
_KEY = rf"(?:{_QUOTED}(?=[ \t]*(?:=|\z))|[^ =]+)"
_VALUE = rf"(?:{_QUOTED}(?=[ \t]|\z)|[^ ]*)"
_FIELD = rf"{_KEY}(?:[ \t]*=[ \t]*{_VALUE})?|="
_QUOTED_KEY = rf"^({_QUOTED})(?=[ \t]*(?:=|\z))"
_ALL_QUOTED = rf"^{_QUOTED}\z"


def plain_json(text: Column) -> Column:
    """The fields of an ordinary message as a JSON object, null for other messages.

    A key that occurs twice occurs twice in the object; see :func:`logfmt_json`.
    """
    pairs = F.regexp_replace(text, _PAIR, '"$1":"$2$3",')
    fields = F.regexp_replace(pairs, _BARE_KEY, '$1"$2":true,')
    return F.when(
        F.rlike(text, F.lit(_PLAIN_TEXT)),
        F.concat(F.lit("{"), F.rtrim(fields, F.lit(",")), F.lit("}")),
    )


def logfmt_json(text: Column, plain: Column, plain_keys: Column) -> Column:
    """The fields of any message as a JSON object, null when it is not logfmt.

    ``plain`` is the message's :func:`plain_json` and ``plain_keys`` the keys in that. Both should
    be columns, not expressions: they are referred to several times.
    """
    unique = F.size(F.array_distinct(plain_keys)) == F.size(plain_keys)
    return F.when(plain.isNotNull() & unique, plain).otherwise(full_json(text))


def full_json(text: Column) -> Column:
    """The same, field by field."""
    tokens = F.regexp_extract_all(text, F.lit(_FIELD), F.lit(0))
    return F.to_json(let(F.transform(tokens, _field), _checked_object))


def _unquote(text: Column) -> Column:
    """The inside of a quoted text, with its escapes resolved."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    lines = F.regexp_replace(inner, r"(?<!\\)((?:\\\\)*+)\\n", "$1\n")
    return F.when(
        F.contains(inner, F.lit("\\")), F.regexp_replace(lines, r'\\(["\\])', "$1")
    ).otherwise(inner)


def _member(token: Column, equals: Column) -> Column:
    """What stands after ``=`` as a VARIANT; true when there is none."""
    text = F.btrim(F.substring(token, equals + 1, F.length(token)), F.lit(" \t\r\n"))
    quoted = F.startswith(text, F.lit('"')) & F.rlike(text, F.lit(_ALL_QUOTED))
    value = F.when(quoted, _unquote(text)).otherwise(text)
    return F.when(equals == 0, F.parse_json(F.lit("true"))).otherwise(value.cast("variant"))


def _field(token: Column, position: Column) -> Column:
    """Key ``k``, position ``i`` and member ``m`` of one field."""

    def entry(key: Column, rest: Column) -> Column:
        return F.struct(
            key.alias("k"), position.alias("i"), _member(rest, F.instr(rest, "=")).alias("m")
        )

    def with_quoted_key(raw: Column) -> Column:
        return entry(_unquote(raw), F.substring(token, F.length(raw) + 1, F.length(token)))

    bare_key = entry(F.trim(F.substring_index(token, "=", 1)), token)
    return F.when(
        F.startswith(token, F.lit('"')),
        let(
            F.regexp_extract(token, _QUOTED_KEY, 1),
            lambda raw: F.when(raw != "", with_quoted_key(raw)).otherwise(bare_key),
        ),
    ).otherwise(bare_key)


def _checked_object(fields: Column) -> Column:
    keys = fields["k"]
    valid = (F.size(fields) > 0) & ~F.array_contains(keys, F.lit(""))
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    members = F.when(unique, F.map_from_arrays(keys, fields["m"])).otherwise(_grouped(fields))
    return F.when(valid, F.to_variant_object(members))


def _grouped(fields: Column) -> Column:
    """Members when a key repeats: sort by key and position, then cut the runs of one key."""
    # VARIANTs cannot be compared, so they are looked up after sorting.
    order = F.array_sort(F.transform(fields, lambda f: F.struct(f["k"].alias("k"), f["i"].alias("i"))))

    def run_starts(ordered: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda n: (n == 0) | (F.get(ordered, n)["k"] != F.get(ordered, n - 1)["k"]),
        )

    def from_runs(ordered: Column, starts: Column) -> Column:
        def members(start: Column, n: Column) -> Column:
            end = F.coalesce(F.get(starts, n + 1), F.size(ordered))
            run = F.slice(ordered, start + 1, end - start)
            return F.transform(run, lambda o: F.get(fields, o["i"])["m"])

        def member(values: Column) -> Column:
            return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(
                values.cast("variant")
            )

        return F.map_from_arrays(
            F.transform(starts, lambda start: F.get(ordered, start)["k"]),
            F.transform(starts, lambda start, n: let(members(start, n), member)),
        )

    return let(order, lambda o: let(run_starts(o), lambda s: from_runs(o, s)))
