"""Amounts: parsing, display, probes and materiality. Minor units are whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_changed, fold_digits, let, nfkc

#: Digits that are read for one another.
CONFUSABLE_DIGITS = {"0": "8", "1": "7", "3": "8", "4": "9", "5": "6", "6": "58", "7": "1", "8": "063", "9": "4"}


#: Words and signs of money, spaces between thousands, glyphs that are read for digits, runs that may be a number.
CURRENCY_WORDS = r"(?i)(?:\bpkr\b|\brs\.?|\brupees?\b|\bpaisas?\b|\bonly\b|/\s*-|₨|﷼)"
SPACED_THOUSANDS = r"(?<=\d)[  ](?=\d{3}(?:\D|$))"
GLYPHS, GLYPH_DIGITS = "OolISB", "001158"
NUMBER_RUN = r"([0-9OolISB][0-9OolISB.,]*)"


def _best_run(s: Column) -> Column:
    """The run with most digits, then longest, then leftmost; '' if none has a digit."""
    runs = F.regexp_extract_all(s, F.lit(NUMBER_RUN), F.lit(1))

    def keep(best: Column, run: Column) -> Column:
        d = F.regexp_count(run, F.lit(r"\d"))
        bd = F.regexp_count(best, F.lit(r"\d"))
        return F.when((d > bd) | ((d == bd) & (d > 0) & (F.length(run) > F.length(best))), run).otherwise(best)

    return F.aggregate(runs, F.lit(""), keep)


def parse_amount_text(raw: Column) -> Column:
    """struct(value decimal(38,18), notes): a payment amount as printed; value null where nothing can be read.

    The folded text, the run of digits and the number in it are each computed once for a row.
    """
    return let(nfkc(raw), lambda folded: let(_best_run(_without_words(folded)), lambda run: let(_bare(run), lambda s: _read_amount(s, run, folded))))


def _without_words(folded: Column) -> Column:
    plain = F.translate(fold_digits(folded), "٬٫", ",.")
    return F.regexp_replace(F.regexp_replace(plain, CURRENCY_WORDS, " "), SPACED_THOUSANDS, "")


def _bare(run: Column) -> Column:
    return F.regexp_replace(F.translate(run, GLYPHS, GLYPH_DIGITS), r"^[.,]+|[.,]+$", "")


def _read_amount(s: Column, run: Column, folded: Column) -> Column:
    both = F.contains(s, F.lit(",")) & F.contains(s, F.lit("."))
    last_dot, last_comma = (F.length(s) - F.instr(F.reverse(s), c) for c in ".,")
    western = F.regexp_replace(s, ",", "")
    european = F.translate(F.regexp_replace(s, r"\.", ""), ",", ".")
    grouped_dots = F.contains(s, F.lit(".")) & ~F.contains(s, F.lit(",")) & s.rlike(r"^\d{1,3}(\.\d{3})+$")
    value = (
        F.when(both, F.when(last_dot > last_comma, western).otherwise(european))
        .when(F.contains(s, F.lit(",")), F.when(s.rlike(r"^\d{1,3}(,\d{3})+$"), western).otherwise(F.translate(s, ",", ".")))
        .when(grouped_dots, F.regexp_replace(s, r"\.", ""))
        .otherwise(s)
    )
    notes = F.array_compact(
        F.array(
            F.when(digits_changed(folded), F.lit("AMOUNT_NON_ASCII_DIGITS")),
            F.when(run.rlike(f"[{GLYPHS}]"), F.lit("AMOUNT_OCR_GLYPH_FIXUP")),
            F.when(grouped_dots, F.lit("AMOUNT_SEPARATOR_AMBIGUOUS")),
        )
    )
    number = let(value, lambda v: F.when(v.rlike(r"^(\d+\.?\d*|\.\d+)$"), v).try_cast("decimal(38,18)"))
    return F.struct(number.alias("value"), notes.alias("notes"))


def to_minor(value: Column) -> Column:
    """HALF_UP to two places, in minor units."""
    return (F.round(value, 2) * 100).cast("long")


def parse_amount_minor(raw: Column) -> Column:
    """The extractor's narrower parser: prefix and suffix stripped, thousands commas dropped, glyphs mapped; null on failure."""
    s = F.trim(F.regexp_replace(F.trim(raw), r"(?i)(?:Rs\.?\s*|PKR\s*|₨\s*)", ""))
    s = F.trim(F.regexp_replace(s, r"[/\-]+$", ""))
    s = F.translate(F.regexp_replace(s, r"(?<=\d),(?=\d{3})", ""), "OolIS ", "00115")
    return to_minor(F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s).try_cast("decimal(38,18)"))


def format_money(minor: Column) -> Column:
    """'Rs 1,500' or 'Rs 1,500.50'; null: a dash."""
    major, rest = F.floor(F.abs(minor) / 100), F.abs(minor) % 100
    text = F.concat(F.lit("Rs "), F.when(minor < 0, "-").otherwise(""), F.format_number(major, 0), F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0"))).otherwise(""))
    return F.coalesce(text, F.lit("—"))


def amount_gap(claimed: Column, received: Column) -> Column:
    """struct(kind SHORT, OVER or EQUAL, by): how the received amount differs from the claimed one."""
    gap = received - claimed
    return F.struct(F.when(gap < 0, "SHORT").when(gap > 0, "OVER").when(gap == 0, "EQUAL").alias("kind"), F.abs(gap).alias("by"))


def power_of_ten_multiple(a: Column, b: Column) -> Column:
    """a = b * 10^k, k >= 1, b > 0."""
    q = F.when((b > 0) & (a > b), F.when(F.try_mod(a, b) == 0, F.floor(F.try_divide(a, b))))
    return F.coalesce(q.cast("string").rlike("^10+$"), F.lit(False))


def amount_probes(minor: Column) -> Column:
    """Amounts that a misread digit, or one zero more or less, would give; the amount itself excluded."""
    m = F.abs(minor)
    text = m.cast("string")
    swaps = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.flatten(
                F.array(*[
                    F.when(F.substring(text, i, F.lit(1)) == d, F.array(*[F.concat(F.left(text, i - 1), F.lit(r), F.substring(text, i + 1, F.length(text))).cast("long") for r in rs])).otherwise(F.array().cast("array<bigint>"))
                    for d, rs in CONFUSABLE_DIGITS.items()
                ])
            ),
        )
    )
    tens = F.when(m % 10 == 0, F.array(m * 10, (m / 10).cast("long"))).otherwise(F.array(m * 10))
    return F.array_sort(F.filter(F.array_distinct(F.concat(tens, swaps)), lambda x: x != m))


def material(over_minor: Column, base_minor: Column, least_minor: int | Column, share: float | Column) -> Column:
    """Above zero, at least least_minor and at least share (decimal, exact) of the base."""
    printed = share.cast("string") if isinstance(share, Column) else F.lit(str(share))
    scaled = printed.cast("decimal(20,10)") * base_minor.cast("decimal(18,0)")
    return F.coalesce((over_minor > 0) & (over_minor >= least_minor) & (over_minor.cast("decimal(30,10)") >= scaled), F.lit(False))
