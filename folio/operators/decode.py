"""Decoding of character probabilities and joining of recognised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_classes(matrix: Column, allowed: list[int] | None = None) -> Column:
    """The class of each step (0 is blank), the first on ties; a class that isn't allowed gives way
    to the best allowed one that isn't blank."""

    def best(step: Column) -> Column:
        top = F.array_position(step, F.array_max(step)).cast("int") - 1
        if allowed is None:
            return top
        legal = F.array(*[F.lit(c) for c in allowed])
        scores = F.transform(legal, lambda c: F.element_at(step, c + 1))
        other = F.element_at(legal, F.array_position(scores, F.array_max(scores)).cast("int"))
        return F.when((top == 0) | F.array_contains(legal, top), top).otherwise(other)

    return F.transform(matrix, best)


def collapse(classes: Column, alphabet: str) -> Column:
    """Letters where the class changes to one that isn't blank."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    before = F.concat(F.array(F.lit(-1)), F.slice(classes, 1, F.greatest(F.size(classes) - 1, F.lit(0))))
    kept = F.zip_with(classes, before, lambda c, p: F.when((c != p) & (c != 0), F.element_at(letters, c)))
    return F.array_join(F.filter(kept, lambda x: x.isNotNull()), "")


def ctc_text(matrix: Column, alphabet: str, allowed: list[int] | None = None) -> Column:
    """Text of a [step][class] matrix."""
    return F.when(F.size(matrix) > 0, collapse(best_classes(matrix, allowed), alphabet)).otherwise("")


def join_words(words: DataFrame, doc_type: Column | None = None) -> DataFrame:
    """A field's words in order as its text: (doc_id, field, pos, word) to (doc_id, field, text).

    The lines of a machine-readable zone keep apart and empty ones go; a date is joined by dots unless
    it is worded; else words are joined by spaces. A field's words are bounded by its page.
    """
    snils = F.coalesce(doc_type == "SNILS", F.lit(False)) if doc_type is not None else F.lit(False)
    grouped = words.withColumn("__snils", snils).groupBy("doc_id", "field").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"), F.bool_or("__snils").alias("snils")
    )
    each = F.transform("w", lambda x: F.coalesce(x["word"], F.lit("")))
    worded = F.col("snils") | F.exists(each, lambda x: x.rlike(r"\p{L}"))
    joined = (
        F.when(F.col("field") == "MRZ", F.array_join(F.filter(each, lambda x: x != ""), "\n"))
        .when(F.lower("field").contains("date"), F.when(worded, F.array_join(each, " ")).otherwise(F.array_join(each, ".")))
        .otherwise(F.array_join(each, " "))
    )
    tidy = F.when(F.col("field") == "MRZ", joined).otherwise(F.trim(F.replace(joined, F.lit("  "), F.lit(" "))))
    return grouped.select("doc_id", "field", tidy.alias("text"))


def join_address(lines: DataFrame, placeholder: str = "[handwritten]") -> DataFrame:
    """An address's lines in order; handwritten ones read as a placeholder, and are told."""
    hand = F.col("kind") == "handwritten"
    row = F.struct("pos", F.when(hand, placeholder).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    grouped = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("w"), F.bool_or(hand).alias("has_handwritten"))
    return grouped.select("doc_id", F.array_join(F.transform("w", lambda x: x["text"]), "\n").alias("address"), "has_handwritten")


def ctc_indices(matrix: Column, blank: int = 0) -> Column:
    """The classes that a matrix of scores collapses to, as numbers: repeats once, blanks gone."""
    best = F.transform(matrix, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)
    emitted = lambda x, i: (x != blank) & ((i == 0) | (x != F.get(best, i - 1)))
    return F.filter(best, emitted)


def raveled(features: Column) -> Column:
    """A nested feature array as one flat array."""
    return F.flatten(features)


def batched_by_width(words: DataFrame, rungs: list[int], size: int) -> DataFrame:
    """(word_id, rung, batch, place): words of one padded width in batches of at most ``size`` of a document;
    results come back by word_id, whatever batch they ran in."""
    from folio.functions.text import ladder

    w = words.withColumn("rung", ladder(F.col("width"), rungs).cast("long"))
    at = F.row_number().over(Window.partitionBy("doc_id", "rung").orderBy("word_id")) - 1
    return w.withColumn("__at", at).select("doc_id", "word_id", "rung", F.floor(F.col("__at") / size).alias("batch"), (F.col("__at") % size).cast("long").alias("place"))
