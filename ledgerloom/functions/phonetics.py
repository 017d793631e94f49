"""Metaphone and NYSIIS as Spark expressions: two ordered tables of what a letter becomes between its neighbours.

Both codes look at a few letters around each place and never at what was put
out before (NYSIIS only drops a letter that repeats the last one, which a final
pass does). So each letter's window is matched against a table of patterns, the
first that fits says what comes out, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let as _let

#: What a window may say for "the letter itself".
SAME = "="

# Fixed values: (pattern, output) for the window "letter before, letter, up to four after"; "-" stands beyond the ends.
METAPHONE = [
    ("[cgpst]h", ""), ("dg[eiy]", ""),
    ("-[aeiou]", SAME), (".[aeiou]", ""),
    ("mb-", ""),
    ("sc[eiy]", ""), (".cia", "x"), (".c[eiy]", "s"), ("sch", "k"), (".ch", "x"), ("ck", ""), (".[ckq]", "k"),
    (".dg[eiy]", "j"), (".d", "t"),
    (".gh[^aeiou-]", ""), ("-gh", "k"), (".gh-", "f"), (".gh", ""), (".gn-", ""), (".gned-", ""), (".gn", "k"), (".g[eiy]", "j"), (".g", "k"),
    (".h[aeiou]", "h"), (".h", ""),
    (".ph", "f"),
    (".sh", "x"), (".si[ao]", "x"),
    (".ti[ao]", "x"), (".thm", "t"), (".th", "0"), (".tch", ""),
    (".v", "f"), (".[wy][aeiou]", SAME), (".[wy]", ""), (".x", "ks"), (".z", "s"),
    (".", SAME),
]
METAPHONE_STARTS = [("^kn", "n"), ("^gn", "n"), ("^pn", "n"), ("^ae", "e"), ("^wr", "r"), ("^x", "s"), ("^wh", "w")]

# The window is "three letters before, letter, two after"; the first letter of a word stands as it is.
NYSIIS = [
    (".[a-z]ev", ""), (".[a-z]kn", ""), (".[a-z]sch", ""), ("[a-z]sch", ""), (".[a-z]ph", ""),
    ("...ev", "af"), ("...[aeiou]", "a"), ("...q", "g"), ("...z", "s"), ("...m", "n"), ("...kn", "n"), ("...k", "c"), ("...sch", "sss"), ("...ph", "ff"),
    ("..[^aeiou]h", ""), ("...h[^aeiou]", ""), ("..[aeiou]w", ""),
    ("...", SAME),
]
NYSIIS_STARTS = [("^mac", "mcc"), ("^kn", "nn"), ("^k", "c"), ("^ph", "ff"), ("^pf", "ff"), ("^sch", "sss")]
NYSIIS_ENDS = [("[ei]e$", "y"), ("(dt|rt|rd|nt|nd)$", "d")]
NYSIIS_LAST = [("(.)s$", "$1"), ("ay$", "y"), ("(.)a$", "$1")]


def _spelled(word: Column, table: list[tuple[str, str]], before: int, first: int) -> Column:
    """What the table makes of the letters of word from number ``first`` (0-based) on, in one string."""
    around = F.concat(F.lit("-" * before), word, F.lit("-" * 5))

    def out(i: Column) -> Column:
        def chosen(window: Column) -> Column:
            letter = F.substring(window, F.lit(before + 1), F.lit(1))
            told = letter
            for pattern, what in reversed(table):
                told = F.when(window.rlike("^" + pattern), letter if what == SAME else F.lit(what)).otherwise(told)
            return told

        return _let(F.substring(around, i + 1, F.lit(before + 5)), chosen)

    some = F.length(word) > first
    places = F.when(some, F.sequence(F.lit(first), F.length(word) - 1)).when(~some, F.array().cast("array<int>"))
    return F.array_join(F.transform(places, out), "")


def _replaced(col: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, what in steps:
        col = F.regexp_replace(col, pattern, what)
    return col


def metaphone(word: Column) -> Column:
    """Philips' Metaphone (1990) of a lower-case word, upper case; other characters are left out, null stays null."""
    w = _replaced(F.regexp_replace(word, "[^a-z]", ""), METAPHONE_STARTS)
    return _let(F.regexp_replace(w, r"([^c])\1+", "$1"), lambda x: F.upper(_spelled(x, METAPHONE, 1, 0)))


def nysiis(word: Column) -> Column:
    """The code of the New York State Identification and Intelligence System of a lower-case word; null stays null."""
    w = _replaced(F.regexp_replace(word, "[^a-z]", ""), NYSIIS_STARTS + NYSIIS_ENDS)
    whole = _let(w, lambda x: F.concat(F.left(x, F.lit(1)), _spelled(x, NYSIIS, 3, 1)))
    return F.upper(_replaced(F.regexp_replace(whole, r"(.)\1+", "$1"), NYSIIS_LAST))


def phonetic_codes(token: Column) -> Column:
    """'MP:' and 'NY:' codes of a token, empty ones left out; null: null. Made for distinct tokens: see operators/names.py."""
    codes = F.array(F.concat(F.lit("MP:"), metaphone(token)), F.concat(F.lit("NY:"), nysiis(token)))
    return F.when(token.isNotNull(), F.filter(codes, lambda c: F.length(c) > 3))
