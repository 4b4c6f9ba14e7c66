"""Machine-readable zones: check digits, parsing and comparison with the printed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILLER, WIDTH = "<", 44
#: Fields of the second line: name, first and last position, check digit's position, counted from 1.
LINE2 = [("document_number", 1, 9, 10), ("birth_date", 14, 19, 20), ("expiry_date", 22, 27, 28), ("personal_number", 29, 42, 43)]
COMPOSITE, COMPOSITE_AT = [(1, 10), (14, 20), (22, 43)], 44


def part(line: Column, first: int, last: int) -> Column:
    return F.substring(line, first, last - first + 1)


def characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def check_digit(payload: Column) -> Column:
    """O1: weights 7, 3, 1 in turn; letters count from 10, fillers 0; null for any other character."""

    def weighted(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        value = F.when(c == FILLER, 0).when(code >= 65, code - 55).otherwise(code - 48)
        return value * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)

    total = F.aggregate(F.transform(characters(payload), weighted), F.lit(0), lambda a, v: a + v)
    return F.when(payload == "", 0).when(payload.rlike("^[0-9A-Z<]+$"), total % 10)


def lines(zone: Column) -> Column:
    """O2: trimmed lines that aren't empty; none of a null zone."""
    trimmed = F.transform(F.split(F.coalesce(zone, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def field_verdict(line2: Column, first: int, last: int, digit_at: int) -> Column:
    """O1, O3: ok, failed, or not_applicable where field and digit are filler."""
    payload, digit = part(line2, first, last), part(line2, digit_at, digit_at)
    empty = (payload == FILLER * (last - first + 1)) & (digit == FILLER)
    right = F.coalesce(check_digit(payload).cast("string") == digit, F.lit(False))
    return F.when(empty, "not_applicable").when(right, "ok").otherwise("failed")


def composite_verdict(line2: Column) -> Column:
    payload = F.concat(*[part(line2, a, b) for a, b in COMPOSITE])
    right = F.coalesce(check_digit(payload).cast("string") == part(line2, COMPOSITE_AT, COMPOSITE_AT), F.lit(False))
    return F.when(right, "ok").otherwise("failed")


def validate(zone: Column) -> Column:
    """Struct (lines, error, ok, one verdict for each field and composite)."""
    all_lines = lines(zone)
    line2 = F.try_element_at(all_lines, F.lit(2))
    fit = (F.length(line2) == WIDTH) & line2.rlike("^[A-Z0-9<]+$")
    error = F.when(F.size(all_lines) < 2, "expected 2 lines").when(
        ~fit, F.concat(F.lit("line 2 malformed (len="), F.length(line2).cast("string"), F.lit(")"))
    )
    verdicts = {name: field_verdict(line2, a, b, d) for name, a, b, d in LINE2} | {"composite": composite_verdict(line2)}
    verdicts = {name: F.when(error.isNull(), v) for name, v in verdicts.items()}
    ok = error.isNull()
    for v in verdicts.values():
        ok = ok & F.coalesce(v != "failed", F.lit(False))
    return F.struct(
        F.size(all_lines).alias("lines"), error.alias("error"), ok.alias("ok"), *[v.alias(n) for n, v in verdicts.items()]
    )


def date(raw: Column, future: bool, as_of_year: int) -> Column:
    """YYMMDD as dd.mm.yyyy. A past date's year beyond this one is of the century before, a
    future date's always of this one; what is no date is null."""
    yy = F.try_to_number(part(raw, 1, 2), F.lit("99"))
    century = F.lit("20") if future else F.when(yy <= as_of_year % 100, "20").otherwise("19")
    made = F.concat(century, part(raw, 1, 2), F.lit("-"), part(raw, 3, 4), F.lit("-"), part(raw, 5, 6))
    return F.when(raw.rlike("^[0-9]{6}$"), F.date_format(F.try_to_timestamp(made, F.lit("yyyy-MM-dd")), "dd.MM.yyyy"))


def _filled(x: Column) -> Column:
    return F.when(x != "", x)


def parse(zone: Column, as_of_year: int) -> Column:
    """Struct of the fields that the zone carries."""
    all_lines = lines(zone)
    line1, line2 = F.try_element_at(all_lines, F.lit(1)), F.try_element_at(all_lines, F.lit(2))
    line2 = F.when(F.length(line2) == WIDTH, line2)
    no_filler = lambda x: F.replace(x, F.lit(FILLER), F.lit(""))
    spaced = lambda x: F.trim(F.replace(x, F.lit(FILLER), F.lit(" ")))
    names = F.split(F.substring(line1, 6, 1000), "<<", 2)
    sex = part(line2, 21, 21)
    return F.struct(
        _filled(no_filler(part(line1, 1, 2))).alias("document_type"),
        _filled(part(line1, 3, 5)).alias("issuing_state"),
        _filled(spaced(names[0])).alias("surname"),
        _filled(spaced(F.try_element_at(names, F.lit(2)))).alias("given_names"),
        _filled(no_filler(part(line2, 1, 9))).alias("document_number"),
        _filled(part(line2, 11, 13)).alias("nationality"),
        date(part(line2, 14, 19), False, as_of_year).alias("birth_date"),
        F.when(sex.isin("M", "F"), sex).alias("sex"),
        date(part(line2, 22, 27), True, as_of_year).alias("expiry_date"),
        _filled(no_filler(part(line2, 29, 42))).alias("personal_number"),
    )


#: Pairs that are compared: field of the zone, printed field, and how both are read.
PAIRS = [
    ("document_number", "Licence_number", "digits"),
    ("birth_date", "Birth_date", "digits"),
    ("expiry_date", "Expiration_date", "digits"),
    ("sex", "Sex_en", "trimmed"),
    ("surname", "Last_name_en", "joined"),
    ("given_names", "First_name_en", "joined"),
]


def cross_check(parsed: Column, printed: dict[str, Column]) -> Column:
    """Struct of a verdict for each pair present on both sides, else null; ok is null without any."""
    read = {
        "digits": lambda x: F.regexp_replace(x, "[^0-9]", ""),
        "trimmed": lambda x: F.upper(F.trim(x)),
        "joined": lambda x: F.upper(F.replace(x, F.lit(" "), F.lit(""))),
    }
    verdicts = {}
    for name, field, kind in PAIRS:
        mine, theirs = parsed[name], printed.get(field, F.lit(None).cast("string"))
        both = (F.coalesce(mine, F.lit("")) != "") & (F.coalesce(theirs, F.lit("")) != "")
        verdicts[name] = F.when(both, F.when(read[kind](mine) == read[kind](theirs), "ok").otherwise("mismatch"))
    found = F.filter(F.array(*verdicts.values()), lambda x: x.isNotNull())
    ok = F.when(F.size(found) > 0, F.forall(found, lambda x: x == "ok"))
    return F.struct(ok.alias("ok"), *[v.alias(n) for n, v in verdicts.items()])


def snils_check(number: Column) -> Column:
    """Extension, not of the validated set: weights 9 to 1, modulo 101, 100 reads 00; null below 001-001-999."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    body = F.transform(characters(F.substring(digits, 1, 9)), lambda c, i: (F.ascii(c) - 48) * (9 - i))
    rest = F.aggregate(body, F.lit(0), lambda a, v: a + v) % 101
    expected = F.lpad((F.when(rest == 100, 0).otherwise(rest)).cast("string"), 2, "0")
    counted = (F.length(digits) == 11) & (F.substring(digits, 1, 9) > "001001998")
    return F.when(counted, F.substring(digits, 10, 2) == expected)


def entry(zone: Column) -> Column:
    """The verdicts of a zone, null where there is none to judge."""
    return F.when(F.size(lines(zone)) > 0, validate(zone))
