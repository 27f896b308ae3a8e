"""Text helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminal escape sequences, introduced by the ESC byte or by its octal spelling.
ANSI_SEQUENCE = r"(\x1b|#033)\[[0-?]*[ -/]*[@-~]"


def strip_ansi(text: Column) -> Column:
    """Remove every terminal escape sequence."""
    # Most lines hold none; the containment tests are far cheaper than the pattern.
    return F.when(
        F.contains(text, F.lit("\x1b[")) | F.contains(text, F.lit("#033[")),
        F.regexp_replace(text, ANSI_SEQUENCE, ""),
    ).otherwise(text)


def word_after(text: Column, marker: str) -> Column:
    """The first alphanumeric run after ``marker`` and ``=`` or white space, in lower case.

    Null when there is none. The marker, given in lower case, is found in any case and may be the
    end of a longer word.
    """
    # The result is that of searching the lower-cased text, but only what is found is converted:
    # case mapping a whole message costs more than searching it. Two letters outside ASCII have
    # lower cases that begin with an ASCII letter.
    found = F.regexp_extract(
        text, rf"(?i){marker}[=\p{{IsWhite_Space}}]+([A-Za-z0-9\u212A\u0130]+)", 1
    )
    return F.when(found != "", F.regexp_extract(F.lower(found), "^[a-z0-9]+", 0))
