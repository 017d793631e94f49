"""Text, digit, reference and phone functions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyphs that are read for one another in references.
CONFUSABLE_FROM, CONFUSABLE_TO = "OQDILSBZG", "000115826"
#: Every digit beyond ASCII and the ASCII digit of its value, from the Unicode tables.
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdigit()]
_DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)
_ICU = "com.ibm.icu.text.Normalizer"


def _ascii(col: Column) -> Column:
    return ~col.rlike(r"[^\x00-\x7f]")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row: lambda variables are not inlined, so plans don't grow with each use."""
    return F.transform(F.array(value), body)[0]


def normal_form(col: Column, composed: bool) -> Column:
    """NFKC (composed) or NFKD, by the ICU library that Spark itself ships; ASCII texts, and nulls, don't reach it."""
    call = lambda c: F.java_method(F.lit(_ICU), F.lit("compose" if composed else "decompose"), c, F.lit(True))
    return let(col, lambda c: F.when(~_ascii(c), call(c)).otherwise(c))


def nfkc(col: Column) -> Column:
    """NFKC, NBSP to space, direction marks dropped, white space collapsed, stripped."""
    folded = F.translate(normal_form(col, True), "\u00a0\u200f\u200e", " ")
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def fold_digits(col: Column) -> Column:
    """Every Unicode digit to ASCII."""
    return let(col, lambda c: F.when(_ascii(c), c).otherwise(F.translate(c, "".join(_DIGITS), _DIGIT_VALUES)))


def digits_changed(col: Column) -> Column:
    """Whether fold_digits() changes anything; false for ASCII, null for null."""
    return let(col, lambda c: ~_ascii(c) & F.exists(F.split(c, ""), lambda x: (x > "\x7f") & F.contains(F.lit("".join(_DIGITS)), x)))


def normalize_reference(col: Column) -> Column:
    """Folded, upper case, one leading label stripped, [A-Z0-9] kept."""
    s = fold_digits(F.upper(nfkc(col)))
    s = F.regexp_replace(s, r"^(?:TRANSACTION\s*ID|TID|TXN|TRX|REF)[:#\s]*", "")
    return F.regexp_replace(s, "[^A-Z0-9]", "")


def confusable(ref_norm: Column) -> Column:
    return F.translate(ref_norm, CONFUSABLE_FROM, CONFUSABLE_TO)


def common_suffix_len(a: Column, b: Column) -> Column:
    """Length of the longest equal tail."""
    ks = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.coalesce(F.array_max(F.filter(ks, lambda k: F.right(a, k) == F.right(b, k))), F.lit(0))


def mask_reference(col: Column) -> Column:
    """Null or empty: null; up to 4 characters: dots; else the first and last two."""
    return F.when(F.length(col) == 0, None).when(F.length(col) <= 4, "••••").otherwise(F.concat(F.left(col, F.lit(2)), F.lit("••••"), F.right(col, F.lit(2))))


def normalize_msisdn(col: Column) -> Column:
    """Pakistani mobile numbers as 03xxxxxxxxx; masked ones of 10 characters or more kept; others null."""
    t = F.trim(col)
    masked = t.rlike("[Xx*●]")
    cleaned = F.regexp_replace(t, r"[\s\-()]", "")
    digits = F.regexp_replace(t, r"\D", "")
    local = F.when(digits.startswith("92") & (F.length(digits) == 12), F.concat(F.lit("0"), F.substring(digits, 3, 10))).otherwise(digits)
    return F.when(t == "", None).when(masked, F.when(F.length(cleaned) >= 10, cleaned)).when(local.rlike(r"^03\d{9}$"), local)


def mask_msisdn(col: Column) -> Column:
    """0301-****890 of a local number."""
    return F.when(col.rlike(r"^03\d{9}$"), F.concat(F.substring(col, 1, 4), F.lit("-****"), F.right(col, F.lit(3))))


def join_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.get(items, n - 1)))


def squash(col: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(col)), r"[^\p{L}\p{N}]", "")


def grounded(raw: Column, haystack: Column) -> Column:
    """True where the squashed value occurs in the squashed text; else null, never false."""
    return F.when((squash(raw) != "") & F.contains(squash(haystack), squash(raw)), True)


def text_name_matches(a: Column, b: Column) -> Column:
    """Equal, or one in the other, after lower case and collapsed white space."""
    x, y = (F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")) for c in (a, b))
    return F.contains(x, y) | F.contains(y, x)


def content_sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def request_fingerprint(order_id: Column, digest: Column) -> Column:
    return F.sha2(F.concat(order_id, F.lit(":"), digest), 256)


def as_uuid(col: Column) -> Column:
    """Lower-case UUID or null."""
    return F.when(col.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), F.lower(col))


def earlier_order_ref(observations: Column, notes_text: Column, current: Column) -> Column:
    """The reference after a reuse note; else the first other order reference in the text."""
    prefix = "PROOF_PREVIOUSLY_SUBMITTED:"
    noted = F.get(F.filter(F.transform(F.filter(observations, lambda o: o.startswith(prefix)), lambda o: F.trim(o.substr(F.lit(len(prefix) + 1), F.length(o)))), lambda r: r != ""), F.lit(0))
    found = F.filter(F.regexp_extract_all(notes_text, F.lit(r"\b(ORD(?:ER)?[-_ ]?\d[A-Z0-9-]*)"), F.lit(1)), lambda r: r != F.coalesce(current, F.lit("")))
    return F.coalesce(noted, F.get(found, F.lit(0)))


def iban_check(country: str, bban: Column) -> Column:
    """Two check digits by mod 97 of a numeric BBAN with letters as 10..35."""
    tail = "".join(str(ord(c) - 55) for c in country) + "00"
    chars = F.split(F.concat(F.regexp_replace(F.upper(bban), "[^A-Z0-9]", ""), F.lit("")), "")
    value = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    digits = F.concat(F.array_join(value, ""), F.lit(tail))
    rem = F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * 10 + c.cast("int")) % 97)
    return F.lpad((F.lit(98) - rem).cast("string"), 2, "0")


def reference_check_digit(col: Column) -> Column:
    """Sum of the digits modulo 7."""
    return F.aggregate(F.regexp_extract_all(col, F.lit(r"(\d)"), F.lit(1)), F.lit(0), lambda s, c: s + c.cast("int")) % 7
