"""Character classes shared by the text functions (Java regex syntax).

Spark evaluates regexes with java.util.regex, whose ``\\s``/``\\w``/``\\b`` are
ASCII by default, while the rules being reproduced use Unicode-aware classes.
These spelled-out classes match the Unicode meaning; the ``\\b`` before or after
a word character becomes an explicit look-around on WORD.
"""

WS = r"[\s\x1c-\x1f\x85\p{Z}]"       # whitespace, Unicode meaning
NWS = r"[^\s\x1c-\x1f\x85\p{Z}]"     # its complement
WORD = r"[\p{L}\p{N}_]"              # word character, Unicode meaning
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
DIGIT = r"\p{Nd}"
# Every whitespace character (the Unicode rule: str.isspace), for plain trims.
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def let(value, body):
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Column functions that use their input several times would otherwise copy
    the whole input expression into the plan each time (and evaluate it each
    time); binding it through a one-element array keeps plans linear.
    """
    from pyspark.sql import functions as F
    return F.transform(F.array(value), body)[0]


def guarded_replace(value, needle: str, pattern: str, replacement: str):
    """``regexp_replace`` that only runs when ``needle`` occurs in the value.

    ``needle`` must be a substring of every possible match, so the result is
    unchanged; rows without it skip the regex scan (a plain substring search).
    """
    from pyspark.sql import functions as F
    return let(value, lambda x: F.when(F.contains(x, F.lit(needle)), F.regexp_replace(x, pattern, replacement))
               .otherwise(x))
