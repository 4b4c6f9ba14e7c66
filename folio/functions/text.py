"""Scalar text functions on recognised fields, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the field vocabulary.
CYRILLIC_DATES = ["Issue_date", "Expiration_date", "Birth_date", "Father_birth_date", "Mother_birth_date"]
LATIN_DATES = ["Issue_date", "Expiration_date", "Birth_date"]
CYRILLIC_NAMES = ["Last_name_ru", "First_name_ru", "Middle_name_ru"]
MONOSPACE = ["Licence_number", "Issue_date", "Expiration_date", "Birth_date", "Issue_organisation_code"]
MALE_RU, FEMALE_RU = "М", "Ж"
DRIVER_CLASS = "ABCDEM1"
RULER_MARKS = r"""[.,_\-"]"""


def fix_date(text: Column) -> Column:
    """O reads 0 and - reads a dot; exactly eight digits that are a date become dd.mm.yyyy.

    Eight digits that are no date leave the text as it came in; other texts keep the replacements.
    """
    swapped = F.regexp_replace(F.regexp_replace(text, "O", "0"), "-", ".")
    digits = F.regexp_replace(swapped, r"[^0-9]", "")
    made = F.concat_ws("-", F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    dated = F.date_format(F.try_to_timestamp(made, F.lit("yyyy-MM-dd")), "dd.MM.yyyy")
    return F.when(F.length(digits) == 8, F.coalesce(dated, text)).otherwise(swapped)


def sex_en(text: Column) -> Column:
    """M where the text has one, else F."""
    return F.when(F.upper(F.replace(text, F.lit("."), F.lit(""))).contains("M"), "M").otherwise("F")


def sex_ru(text: Column) -> Column:
    """The same in Cyrillic."""
    return F.when(F.upper(F.replace(text, F.lit("."), F.lit(""))).contains(MALE_RU), MALE_RU).otherwise(FEMALE_RU)


def driver_class(text: Column) -> Column:
    """C4: only letters of categories."""
    return F.regexp_replace(text, f"[^{DRIVER_CLASS}]", "")


def strip_dots(text: Column) -> Column:
    """Leading dots go; trailing ones stay."""
    return F.regexp_replace(text, r"^\.+", "")


def fix_errors(engine: Column, field: Column, text: Column) -> Column:
    """The correction of a field by the engine that read it."""
    cyrillic = (
        F.when(field.isin(CYRILLIC_DATES), fix_date(text))
        .when(field == "Sex_ru", sex_ru(text))
        .when(field.isin(CYRILLIC_NAMES), strip_dots(text))
        .otherwise(text)
    )
    latin = (
        F.when(field.isin(LATIN_DATES), fix_date(text))
        .when(field == "Sex_en", sex_en(text))
        .when(field == "Driver_class", driver_class(text))
        .otherwise(text)
    )
    return F.when(engine == "cyr", cyrillic).when(engine == "lat", latin).otherwise(text)


def is_number_token(text: Column) -> Column:
    """At least one digit, and letters don't outnumber the digits."""
    digits = F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{No}\p{Nl}]", ""))
    return F.coalesce((digits >= 1) & (digits >= letters), F.lit(False))


def route_address_word(latin: Column, cyrillic: Column) -> Column:
    """Number words from the Latin engine, others from the Cyrillic one."""
    return F.when(is_number_token(latin), latin).otherwise(cyrillic)


def route_engine(doc_type: Column, field: Column, position: Column, ru: Column, en: Column) -> Column:
    """The engine that reads a word; null where none does.

    ``ru`` and ``en`` say whether the document type lists the field for that engine.
    """
    return (
        F.when((doc_type == "SNILS") & (position % 2 == 1) | ru, "cyr")
        .when(F.lower(field).contains("date") | en, "lat")
    )


def doc_base(doc_type: Column) -> Column:
    """C11: the type without its era, the part after the last underscore."""
    return F.when(doc_type.contains("_"), F.regexp_replace(doc_type, r"_[^_]*$", "")).otherwise(F.coalesce(doc_type, F.lit("")))


def doc_era(doc_type: Column) -> Column:
    """C11: the era, null without one."""
    return F.when(doc_type.contains("_"), F.element_at(F.split(doc_type, "_"), -1))


def clean_ruler(text: Column) -> Column:
    """Runs of ruler marks, and single ones between spaces, read as spaces."""
    runs = F.regexp_replace(text, RULER_MARKS + "{2,}", " ")
    alone = F.regexp_replace(runs, rf"(?<!\S){RULER_MARKS}(?!\S)", " ")
    return F.trim(F.regexp_replace(alone, r"\s+", " "))


def single_space_once(text: Column) -> Column:
    """Each pair of spaces becomes one, in one pass, and the ends are trimmed."""
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def normalize(text: Column, kind: str = "strict") -> Column:
    """What an evaluation compares: strict, number, text or gender."""
    base = F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", " "))
    if kind == "number":
        return F.regexp_replace(base, r"[ .]", "")
    if kind == "text":
        return F.trim(F.regexp_replace(F.regexp_replace(base, "[.,\"'«»]", ""), r"\s+", " "))
    if kind == "gender":
        return F.left(base, F.lit(1))
    if kind != "strict":
        raise ValueError(f"unknown kind {kind}")
    return base


def cer(predicted: Column, truth: Column, kind: str = "strict") -> Column:
    """Edit distance over the truth's length, null where the truth is empty."""
    p, t = normalize(predicted, kind), normalize(truth, kind)
    return F.when(F.length(t) > 0, F.levenshtein(p, t) / F.length(t))


def field_quality(predicted: Column, truth: Column, kind: str = "strict") -> Column:
    """1 - edit distance over the longer length, at least 1."""
    p, t = normalize(predicted, kind), normalize(truth, kind)
    return 1 - F.levenshtein(p, t) / F.greatest(F.length(p), F.length(t), F.lit(1))


def search_text(filename: Column, doc_type: Column, values: list[Column]) -> Column:
    """The lower-case haystack of a record; what is null counts as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (filename, doc_type, *values)]))


def number(value: Column, places: int = 4) -> Column:
    """C20: half-even rounding; not a number and infinities are null."""
    v = value.cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, F.bround(v, places))


def script(field: Column) -> Column:
    """Num, ru or en."""
    return F.when(field.isin(MONOSPACE), "num").when(field.endswith("_ru"), "ru").when(field.endswith("_en"), "en").otherwise("ru")


def safe_filename(name: Column) -> Column:
    """The last path part, printable, without reserved characters, 200 at most."""
    base = F.substring_index(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1)
    kept = F.trim(F.left(F.regexp_replace(base, r'[<>:"|?*\p{Cntrl}]', ""), F.lit(200)))
    return F.when(F.length(kept) > 0, kept).otherwise("upload")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 in UTC with Z; micros only where there are some."""
    micros = F.date_format(ts, "SSSSSS")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def parse_day(text: Column) -> Column:
    """Yyyy-mm-dd, null where malformed."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def mask_key(key: Column) -> tuple[Column, Column, Column]:
    """Digest, prefix and masked form of an API key."""
    prefix = F.left(key, F.lit(10))
    return F.sha2(key, 256), prefix, F.concat(prefix, F.lit("…"))


def type_confidence(distance: Column, limit: Column) -> Column:
    """1 - distance / limit to two places; 0 without a limit."""
    return F.when(limit > 0, F.bround(1 - distance / limit, 2)).otherwise(0.0)


def suspicious(text: Column) -> Column:
    """Shorter than two, or hardly any letters and digits."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    alnum = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))
    return (n < 2) | (alnum < F.greatest(F.lit(2.0), n / 2))


def progress(status: Column, elapsed: Column, duration: Column) -> Column:
    """Share done: by time while processing, 0 while queued, 1 when over."""
    share = F.least(elapsed / F.greatest(duration, F.lit(0.05)), F.lit(0.95))
    return F.when(status == "processing", share).when(status == "queued", 0.0).otherwise(1.0)


#: Error classes in the order they are tried: code, transient, words that the lower-cased error holds.
ERROR_CLASSES = [
    ("TIMEOUT", True, ["timeouterror"]),
    ("BUSY", True, ["pipelinebusy", "runtimenotready"]),
    ("RECOGNITION_FAILED", False, ["recognitionerror"]),
    ("GPU_ERROR", True, ["cuda", "cudnn", "out of memory"]),
    ("IO_ERROR", True, ["oserror"]),
]


def error_code(error: Column) -> tuple[Column, Column]:
    """Code of an error text, and whether a retry may help."""
    low = F.lower(error)
    code, transient = F.lit("INTERNAL"), F.lit(False)
    for name, again, marks in reversed(ERROR_CLASSES):
        hit = reduce(lambda a, b: a | b, [low.contains(m) for m in marks])
        code, transient = F.when(hit, name).otherwise(code), F.when(hit, again).otherwise(transient)
    return code, transient


def bytes_text(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(F.bround(n / 1024, 1).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.bround(n / (1 << 20), 1).cast("string"), F.lit(" MB")))
    )


def ladder(x: Column, rungs: list[int]) -> Column:
    """The first rung not below x; beyond the last, up by its distance to the one before."""
    step = rungs[-1] - (rungs[-2] if len(rungs) > 1 else 0)
    out = (rungs[-1] + F.ceil((x - rungs[-1]) / step) * step).cast("long")
    for rung in reversed(rungs):
        out = F.when(x <= rung, rung).otherwise(out)
    return out


def as_int(x: Column) -> Column:
    """A whole number, null where the text is none; fractions are cut off."""
    return x.cast("string").try_cast("double").try_cast("long")


def as_text(x: Column) -> Column:
    """Any value as text; null stays null, numbers and truths as JSON has them."""
    return x.cast("string")


def plain_json(x: Column) -> Column:
    """A nested value as JSON, nulls kept; numbers that JSON can't hold become null."""
    return F.to_json(x, {"ignoreNullFields": "false"})


def quality_value(x: Column) -> Column:
    """A quality entry: a number to four places where it is one, else its text; both as text."""
    n = number(x.try_cast("double"))
    return F.coalesce(n.cast("string"), x)


def flat_contour(points: Column) -> Column:
    """Points (x, y) as pairs [x, y]; none of a null outline."""
    return F.transform(F.coalesce(points, F.array().cast("array<struct<x: double, y: double>>")), lambda p: F.array(p["x"], p["y"]))


def snils_verdict(value: Column) -> Column:
    """O9 (extension): SNILS-1 and SNILS-2: mask, and check number for numbers above 001-001-998."""
    mask = F.regexp_replace(F.trim(value), r"^(\d{3}-\d{3}-\d{3})-(\d{2})$", "$1 $2")
    digits = F.regexp_replace(mask, r"\D", "")
    total = F.lit(0)
    for i in range(9):
        total = total + F.substring(digits, i + 1, 1).try_cast("int") * (9 - i)
    total = F.when(total > 101, total % 101).otherwise(total)
    want = F.when(total >= 100, 0).otherwise(total)
    checked = F.left(digits, F.lit(9)).try_cast("long") > 1001998
    right = ~checked | (F.right(digits, F.lit(2)).try_cast("int") == want)
    verdict = F.when(~mask.rlike(r"^\d{3}-\d{3}-\d{3} \d{2}$"), "malformed").when(right, "ok").otherwise("failed")
    return F.when(value.isNotNull(), verdict)


def date_checks(birth: Column, issue: Column, today: Column, least_age: int = 0, most_age: int = 120) -> Column:
    """O9 (extension): GEN-1 to GEN-3: dates that exist, in order, none in the future, an age that can be."""
    b, i = (F.try_to_date(x, "dd.MM.yyyy") for x in (birth, issue))
    exists = F.when((birth.isNotNull() & b.isNull()) | (issue.isNotNull() & i.isNull()), "failed").when(birth.isNull() & issue.isNull(), "not_applicable").otherwise("ok")
    both = b.isNotNull() & i.isNotNull()
    order = F.when(~both, "not_applicable").when((b < i) & (i <= today), "ok").otherwise("failed")
    age = F.floor(F.months_between(i, b) / 12)
    fits = F.when(~both, "not_applicable").when((age >= least_age) & (age <= most_age), "ok").otherwise("failed")
    return F.struct(exists.alias("dates_exist"), order.alias("dates_in_order"), fits.alias("age"))
