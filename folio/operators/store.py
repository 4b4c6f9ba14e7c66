"""The document store: filter, search, sort, page, count, queue and upsert document records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ["queued", "processing", "done", "failed"]
#: Columns a listing may be sorted by; others mean created_at.
SORTABLE = {"id", "filename", "status", "doc_type", "doc_conf", "created_at", "field_count", "processing_ms", "size_bytes"}
NOT_RECOGNISED = "__none__"


@dataclass(frozen=True)
class Listing:
    """A listing's filters, order and page; a filter that is None or empty is off."""

    status: str | None = None
    doc_type: str | None = None
    search: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    sort_by: str = "created_at"
    descending: bool = True
    page: int = 1
    page_size: int = 20


def _day(text: str | None):  # noqa: ANN202
    from datetime import datetime

    try:
        return datetime.strptime(text or "", "%Y-%m-%d")
    except ValueError:
        return None


def constrain(log: DataFrame, q: Listing) -> DataFrame:
    """All filters that are on, as predicates that reach the scan.

    A type is a literal prefix; the sentinel asks for what wasn't recognised; a malformed day is no bound.
    """
    from datetime import timedelta

    if q.status:
        if q.status not in STATUSES:
            raise ValueError(f"unknown status {q.status}")
        log = log.where(F.col("status") == q.status)
    if q.doc_type == NOT_RECOGNISED:
        log = log.where(~F.col("recognised"))
    elif q.doc_type:
        log = log.where(F.col("doc_type").startswith(q.doc_type))
    if start := _day(q.date_from):
        log = log.where(F.col("created_at") >= F.lit(start))
    if end := _day(q.date_to):
        log = log.where(F.col("created_at") < F.lit(end + timedelta(days=1)))
    if q.search:
        log = log.where(F.col("search_text").contains(q.search.lower().strip()))
    return log


def order(q: Listing) -> list[Column]:
    """Nulls last both ways, the newest id first among equals."""
    c = F.col(q.sort_by if q.sort_by in SORTABLE else "created_at")
    return [c.desc_nulls_last() if q.descending else c.asc_nulls_last(), F.col("id").desc()]


def page(log: DataFrame, q: Listing) -> DataFrame:
    """H1, H2: the page's rows with their rank in the listing; a top-k, not a full sort."""
    if not 1 <= q.page_size <= 100:
        raise ValueError("page_size must be 1 to 100")
    skip = max(0, (q.page - 1) * q.page_size)
    top = constrain(log, q).orderBy(*order(q)).limit(skip + q.page_size)
    # What is left is a page's worth of rows; ranking them in one task is bounded by the request.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order(q))).cast("long"))
    return ranked.where(F.col("rank") > skip)


def page_after(log: DataFrame, q: Listing, value: object, last_id: int) -> DataFrame:
    """H1, H2 for deep listings: the page that follows the row with this sort value (it may be null) and id.

    The same rows as :func:`page` gives, in their order, but what comes before is filtered at the scan, so the
    work doesn't grow with the page; ``page`` of the listing is not read.
    """
    if not 1 <= q.page_size <= 100:
        raise ValueError("page_size must be 1 to 100")
    c = F.col(q.sort_by if q.sort_by in SORTABLE else "created_at")
    if value is None:
        later = c.isNull() & (F.col("id") < last_id)
    else:
        beyond = c < F.lit(value) if q.descending else c > F.lit(value)
        later = beyond | c.isNull() | ((c == F.lit(value)) & (F.col("id") < last_id))
    return constrain(log, q).where(later).orderBy(*order(q)).limit(q.page_size)


def page_with_total(log: DataFrame, q: Listing) -> DataFrame:
    """the page, and on each of its rows the number of rows before paging."""
    total = constrain(log, q).agg(F.count("*").alias("total"))
    return page(log, q).join(F.broadcast(total))


def count_by_status(log: DataFrame) -> DataFrame:
    """rows of each status, the four known ones at least."""
    known = log.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = log.groupBy("status").agg(F.count("*").alias("n"))
    both = counted.join(F.broadcast(known), "status", "full_outer")
    return both.select("status", F.coalesce("n", F.lit(0)).alias("n"))


def stats(log: DataFrame) -> DataFrame:
    """total, recognised, and the mean time of what is done, rounded half-even; null if none is."""
    done = (F.col("status") == "done") & F.col("processing_ms").isNotNull()
    return log.agg(
        F.count("*").alias("total"),
        F.count_if("recognised").alias("recognised"),
        F.bround(F.avg(F.when(done, F.col("processing_ms"))), 0).cast("long").alias("avg_processing_ms"),
    )


def next_id(log: DataFrame) -> DataFrame:
    """the id that the next record gets."""
    return log.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def queue_positions(log: DataFrame) -> DataFrame:
    """How many queued records are strictly older; equal times share a position.

    Counted by time and summed along distinct times, hours first and then times within an hour, so the
    records themselves are never gathered in one task. Records without a time have no position.
    """
    queued = log.where("status = 'queued'").select("id", "created_at")
    times = queued.where("created_at is not null").groupBy("created_at").agg(F.count("*").alias("n"))
    times = times.withColumn("hour", F.date_trunc("hour", "created_at"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    hours = times.groupBy("hour").agg(F.sum("n").alias("n"))
    # One row for each hour that holds a queued record: 9,000 a year.
    hours = hours.select("hour", F.coalesce(F.sum("n").over(before.orderBy("hour")), F.lit(0)).alias("older"))
    within = F.coalesce(F.sum("n").over(before.partitionBy("hour").orderBy("created_at")), F.lit(0))
    times = times.withColumn("within", within).join(F.broadcast(hours), "hour")
    times = times.select("created_at", (F.col("older") + F.col("within")).cast("long").alias("position"))
    return queued.join(times, "created_at").select("id", "position")


def next_queued(log: DataFrame) -> DataFrame:
    """H3: the oldest queued record, the lowest id among equals."""
    return log.where("status = 'queued'").orderBy("created_at", "id").limit(1).select("id")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", keep: str = "result") -> DataFrame:
    """B2: new rows replace old ones of their key, but a null ``keep`` doesn't clear an old one."""
    n, o = new.alias("n"), old.alias("o")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()
    cols = [
        (F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c == keep else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c)
        for c in old.columns
    ]
    return joined.select(*cols)


def purge(log: DataFrame) -> DataFrame:
    """What stays when everything is purged: only what is being processed."""
    return log.where("status = 'processing'")


def drop(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The records without those of the given ids."""
    return log.join(ids, "id", "left_anti")


def requeue(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The given records queued anew, unless active; errors, times and retries cleared."""
    marked = log.join(ids.select("id", F.lit(True).alias("__again")).distinct(), "id", "left")
    again = F.coalesce("__again", F.lit(False)) & ~F.col("status").isin("queued", "processing")
    out = marked.withColumn("__again", again)
    again = F.col("__again")
    out = out.withColumn("status", F.when(again, "queued").otherwise(F.col("status")))
    for c in ("error", "error_code", "started_at", "finished_at"):
        if c in log.columns:
            out = out.withColumn(c, F.when(again, None).otherwise(F.col(c)))
    if "retry_count" in log.columns:
        out = out.withColumn("retry_count", F.when(again, 0).otherwise(F.col("retry_count")))
    return out.select(*log.columns)


def reset_stale(log: DataFrame) -> DataFrame:
    """After a crash, what was being processed is queued again."""
    return log.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def after_failure(log: DataFrame, max_retries: int) -> DataFrame:
    """L3: failed attempts with ``transient``: queued with one retry more, or failed for good."""
    again = F.col("transient") & (F.col("retry_count") < max_retries)
    return log.withColumn("next_status", F.when(again, "queued").otherwise("failed")).withColumn(
        "next_retry", F.col("retry_count") + again.cast("int")
    )


def facets(log: DataFrame) -> DataFrame:
    """Records by base type and status."""
    from folio.functions.text import doc_base

    return log.groupBy(doc_base(F.col("doc_type")).alias("base"), "status").agg(F.count("*").alias("n"))


def upload_code(size: Column, limit: int, content: Column, decodes: Column) -> Column:
    """The first of the upload checks that fails: 413, 400, 415 for a PDF or unknown type, 422; null if none."""
    return (
        F.when(size > limit, 413)
        .when(size == 0, 400)
        .when(sniff(content) == "pdf", 415)
        .when(sniff(content).isNull(), 415)
        .when(~decodes, 422)
    )


#: The type of a file by its first bytes, in hexadecimal.
MAGIC = [("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("pdf", "25504446")]


def sniff(content: Column) -> Column:
    """Type by the first bytes, null if unknown; WEBP has its mark in two places."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for kind, mark in MAGIC:
        out = out.when(head.startswith(mark), kind)
    return out


def settings(stored: DataFrame, defaults: DataFrame, env: DataFrame | None = None) -> DataFrame:
    """Every known key's value: stored, else from the environment, else its default."""
    out = defaults.join(stored.withColumnRenamed("value", "stored"), "key", "left")
    if env is not None:
        out = out.join(env.withColumnRenamed("value", "env"), "key", "left")
    else:
        out = out.withColumn("env", F.lit(None).cast("string"))
    return out.withColumn("value", F.coalesce("stored", "env", "default"))


def coerce_setting(kind: Column, raw: Column, low: Column, high: Column, choices: Column) -> tuple[Column, Column]:
    """The stored form of a setting and what is wrong with it, one of them null."""
    trimmed = F.trim(raw)
    number = trimmed.try_cast("double")
    yes = F.lower(trimmed).isin("1", "true", "yes", "on")
    numeric = kind.isin("int", "float")
    error = (
        F.when(numeric & number.isNull(), "must be a number")
        .when(numeric & (number < low), "below minimum")
        .when(numeric & (number > high), "above maximum")
        .when((kind == "choice") & ~F.array_contains(choices, trimmed), "not a choice")
    )
    value = (
        F.when(kind == "bool", F.when(yes, "1").otherwise("0"))
        .when(kind == "int", number.cast("long").cast("string"))
        .when(kind == "float", number.cast("string"))
        .otherwise(trimmed)
    )
    return F.when(error.isNull(), value), error


def create(log: DataFrame, new: DataFrame) -> DataFrame:
    """The records with new ones, whose ids follow the highest there is, in the order of their names.

    New rows are numbered within ranges of (filename, created_at) and ranges by their counts, so no task sees them all.
    """
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    parts = new.repartitionByRange("filename", "created_at").withColumn("__part", F.spark_partition_id())
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row for each range, as many as partitions.
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("filename", "created_at"))
    made = parts.withColumn("__place", place).join(F.broadcast(before), "__part").join(F.broadcast(last))
    made = made.withColumn("id", F.col("__last") + F.col("__before") + F.col("__place")).drop("__part", "__place", "__before", "__last")
    return log.unionByName(made, allowMissingColumns=True)


def update(log: DataFrame, changes: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Records with the columns of ``changes`` that aren't null, and the time of the change; others as they were."""
    names = [c for c in changes.columns if c != key]
    n = changes.select(key, *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__changed"))
    out = log.join(n, key, "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    if "updated_at" in log.columns:
        out = out.withColumn("updated_at", F.when(F.col("__changed"), now).otherwise(F.col("updated_at")))
    return out.select(*log.columns)


def removal_counts(log: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(removed, kept, active): what a purge, or a removal of ids, does; what is being processed stays."""
    asked = F.lit(True)
    if ids is not None:
        log = log.join(ids.select("id").distinct().withColumn("__asked", F.lit(True)), "id", "left")
        asked = F.coalesce("__asked", F.lit(False))
    active = asked & (F.col("status") == "processing")
    gone = asked & ~F.coalesce(F.col("status") == "processing", F.lit(False))
    return log.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"), F.count_if(active).alias("active"))


def update_settings(stored: DataFrame, schema: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value, restart) of the settings to store, and (key, error) of bad ones.

    ``schema`` has key, kind, low, high, choices, default and restart_required; ``values`` key and value. Keys that the
    schema lacks are dropped; ``restart`` is set only where the value differs from the stored one, or the default.
    """
    x = values.join(schema, "key").join(stored.select("key", F.col("value").alias("__now")), "key", "left")
    value, error = coerce_setting(F.col("kind"), F.col("value"), F.col("low"), F.col("high"), F.col("choices"))
    x = x.withColumn("__value", value).withColumn("error", error)
    changed = ~F.col("__value").eqNullSafe(F.coalesce("__now", "default"))
    good = x.where("error is null").select("key", F.col("__value").alias("value"), (F.col("restart_required") & changed).alias("restart"))
    return good, x.where("error is not null").select("key", "error")


def verify_keys(presented: DataFrame, keys: DataFrame) -> DataFrame:
    """(request, key_id) of presented keys by digest; key_id is null for one that is unknown or revoked."""
    live = keys.where("revoked_at is null").select(F.col("id").alias("key_id"), F.col("key_hash").alias("__hash"))
    return presented.withColumn("__hash", F.sha2("key", 256)).join(live, "__hash", "left").select("request", "key_id")


def delete_key_code(found: Column, is_default: Column) -> Column:
    """404 for a key that isn't there, 409 for the default one, else 204."""
    return F.when(~F.coalesce(found, F.lit(False)), 404).when(is_default, 409).otherwise(204)


#: What an artifact is looked for under, in order, and the type it is served as.
ARTIFACTS = {
    "canvas": [("canvas.png", "image/png"), ("canvas.jpg", "image/jpeg")],
    "thumb": [("thumb.jpg", "image/jpeg"), ("canvas.png", "image/png"), ("canvas.jpg", "image/jpeg")],
}


def open_artifacts(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, name, media) of each document's artifact: a missing thumb falls back to the canvas; an
    original is its first file by name, typed by its first bytes; temporary files don't count."""
    if kind == "original":
        found = files.where(F.col("name").startswith("original.") & ~F.col("name").endswith(".tmp"))
        first = found.groupBy("doc_id").agg(F.min_by(F.struct("name", "head"), "name").alias("f"))
        media = F.coalesce(F.concat(F.lit("image/"), sniff(F.col("f.head"))), F.lit("application/octet-stream"))
        return first.select("doc_id", "f.name", media.alias("media"))
    order = F.lit(None).cast("int")
    media = F.lit(None).cast("string")
    for i, (name, served) in enumerate(ARTIFACTS[kind]):
        order = F.when(F.col("name") == name, i).otherwise(order)
        media = F.when(F.col("name") == name, served).otherwise(media)
    found = files.select("doc_id", "name", order.alias("__order"), media.alias("media")).where("__order is not null")
    best = found.groupBy("doc_id").agg(F.min_by(F.struct("name", "media"), "__order").alias("f"))
    return best.select("doc_id", "f.name", "f.media")
