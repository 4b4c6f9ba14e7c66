"""What is read of each document type: rules looked up by the type's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# For each document type the fields read by the Cyrillic engine, those read by the Latin
# engine, and those split into words first. The first type whose mark a name holds is taken.
CYRILLIC = {
    "intpassportaddr": [],
    "intpassport": [
        "Last_name_ru", "First_name_ru", "Birth_place_ru", "Issue_organization_ru", "Living_region_ru", "Middle_name_ru", "Sex_ru",
        "Licence_number",
    ],
    "extpassport": [
        "Last_name_ru", "First_name_ru", "Birth_place_ru", "Issue_organization_ru", "Living_region_ru", "Middle_name_ru", "Sex_ru",
        "Licence_number",
    ],
    "dl": [
        "Last_name_ru", "First_name_ru", "Birth_place_ru", "Issue_organization_ru", "Living_region_ru", "Middle_name_ru",
    ],
    "snils": [
        "Last_name_ru", "First_name_ru", "Birth_place_ru", "Middle_name_ru", "Sex_ru",
    ],
    "birthcert": [
        "Last_name_ru", "First_name_ru", "Birth_place_ru", "Issue_organization_ru", "Issue_date", "Licence_number", "Father_last_name_ru",
        "Father_first_middle_ru", "Mother_last_name_ru", "Mother_first_middle_ru", "Birth_date", "Father_birth_date", "Mother_birth_date",
        "Issue_place_ru", "Act_number",
    ],
}
LATIN = {
    "intpassportaddr": [],
    "intpassport": [
        "Issue_date", "Expiration_date", "Birth_date", "Issue_organisation_code", "MRZ",
    ],
    "extpassport": [
        "Last_name_en", "First_name_en", "Issue_date", "Expiration_date", "Birth_date", "Birth_place_en", "Issue_organization_en",
        "Living_region_en", "Sex_en", "Issue_organisation_code", "Middle_name_en", "MRZ",
    ],
    "dl": [
        "Last_name_en", "First_name_en", "Licence_number", "Issue_date", "Expiration_date", "Driver_class", "Birth_date", "Birth_place_en",
        "Issue_organization_en", "Living_region_en", "Issue_organisation_code", "Middle_name_en",
    ],
    "snils": [
        "Licence_number", "Issue_date", "Birth_date",
    ],
    "birthcert": [],
}
SPLIT = {
    "intpassportaddr": [],
    "intpassport": [
        "Licence_number", "Birth_place_ru", "Issue_organization_ru",
    ],
    "extpassport": [
        "Licence_number", "Birth_place_ru", "Birth_place_en",
    ],
    "dl": [
        "Licence_number", "Driver_class", "Birth_place_ru", "Birth_place_en", "Living_region_ru", "Living_region_en",
    ],
    "snils": [
        "Last_name_ru", "First_name_ru", "Licence_number", "Issue_date", "Birth_date", "Birth_place_ru", "Middle_name_ru", "Sex_ru",
    ],
    "birthcert": [
        "First_name_ru", "Birth_place_ru", "Issue_organization_ru", "Issue_date", "Licence_number", "Father_first_middle_ru",
        "Mother_first_middle_ru", "Birth_date", "Father_birth_date", "Mother_birth_date", "Issue_place_ru",
    ],
}
#: Types whose licence number stands upright, and types with address lines.
TURNED, WITH_ADDRESS = ["intpassport"], ["intpassportaddr"]


def rule_of(doc_type: Column) -> Column:
    """The mark of the first rule that a type's name holds, null if none does."""
    low = F.lower(doc_type)
    out = F.lit(None).cast("string")
    for mark in reversed(CYRILLIC):
        out = F.when(low.contains(mark), mark).otherwise(out)
    return out


def table(spark: SparkSession) -> DataFrame:
    """(rule, ru, en, split, turned, with_address): a table to broadcast."""
    rows = [(m, CYRILLIC[m], LATIN[m], SPLIT[m], m in TURNED, m in WITH_ADDRESS) for m in CYRILLIC]
    return spark.createDataFrame(rows, "rule string, ru array<string>, en array<string>, split array<string>, turned boolean, with_address boolean")


def with_options(docs: DataFrame) -> DataFrame:
    """Documents with their rule's lists; a type without a rule has empty ones."""
    joined = docs.withColumn("rule", rule_of(F.col("doc_type"))).join(F.broadcast(table(docs.sparkSession)), "rule", "left")
    none = F.array().cast("array<string>")
    for c in ("ru", "en", "split"):
        joined = joined.withColumn(c, F.coalesce(c, none))
    return joined.withColumn("turned", F.coalesce("turned", F.lit(False))).withColumn("with_address", F.coalesce("with_address", F.lit(False)))


def read_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, field, engine) for every field that is read, each once, by the Cyrillic engine where both list it."""
    opened = with_options(docs)
    ru = opened.select("doc_id", F.explode("ru").alias("field"), F.lit("cyr").alias("engine"))
    en = opened.select("doc_id", F.explode(F.array_except("en", "ru")).alias("field"), F.lit("lat").alias("engine"))
    return ru.unionByName(en)


def allowed_boxes(boxes: DataFrame, fields: DataFrame) -> DataFrame:
    """Boxes whose label some engine reads in their document."""
    return boxes.join(fields.select("doc_id", F.col("field").alias("label")).distinct(), ["doc_id", "label"], "left_semi")
