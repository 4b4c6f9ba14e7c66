"""Queries of the document store, over ``orders`` as the record table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import store
from folio.operators.store import Listing
from folio.plans.bindings import role, with_roles
from folio.plans.registry import query

_COLS = "id, status, doc_type, doc_conf, created_at"


def _listing(name: str, q: Listing, where: str, by: str) -> None:
    skip = max(0, (q.page - 1) * q.page_size)
    sql = with_roles(
        f""" select {_COLS}, "rank", total from (select *, row_number() over (order by {by}, id desc) as "rank", count(*) over () as total
        from log where {where}) where "rank" > {skip} and "rank" <= {skip + q.page_size}""",
        "log",
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = store.page_with_total(role(spark, sf_dir, "log"), q)
        return out.selectExpr(*_COLS.split(", "), "rank", "total")


_listing("store_list_page", Listing(status="done", doc_type="DL", page=2), "status = 'done' and starts_with(doc_type, 'DL')", "created_at desc nulls last")
_listing("store_list_nulls", Listing(sort_by="doc_conf", page_size=50), "true", "doc_conf desc nulls last")
_listing("store_list_ascending", Listing(sort_by="processing_ms", descending=False, page_size=30), "true", "processing_ms asc nulls last")
_listing(
    "store_list_dates", Listing(date_from="1996-03-01", date_to="1996-05-31", sort_by="id", page_size=100),
    "created_at >= timestamp '1996-03-01' and created_at < timestamp '1996-06-01'", "id desc nulls last",
)
_listing("store_list_malformed_date", Listing(date_from="1996-13-99", sort_by="no_such"), "true", "created_at desc nulls last")
_listing("store_search", Listing(search=" URGENT ", page_size=25), "contains(search_text, 'urgent')", "created_at desc nulls last")
_listing("store_not_recognised", Listing(doc_type=store.NOT_RECOGNISED), "not recognised", "created_at desc nulls last")


@query(
    "store_page_after",
    with_roles(
        f""" select {_COLS} from log where status = 'done'
        and (doc_conf < 0.25 or doc_conf is null or doc_conf = 0.25 and id < 900) order by doc_conf desc nulls last, id desc limit 40""",
        "log",
    ),
)
def store_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Listing(status="done", sort_by="doc_conf", page_size=40)
    return store.page_after(role(spark, sf_dir, "log"), q, 0.25, 900).selectExpr(*_COLS.split(", "))


@query(
    "store_filtered",
    with_roles(" select id, status, doc_type from log where status = 'failed' and starts_with(doc_type, 'INTPASSPORT_') and contains(search_text, 'high')", "log"),
)
def store_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Listing(status="failed", doc_type="INTPASSPORT_", search="high")
    return store.constrain(role(spark, sf_dir, "log"), q).select("id", "status", "doc_type")


@query(
    "store_status_counts",
    with_roles(
        """ select s.status, count(l.id) as n from (select unnest(['queued', 'processing', 'done', 'failed']) as status) s
        left join log l on l.status = s.status group by s.status""",
        "log",
    ),
)
def store_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.count_by_status(role(spark, sf_dir, "log"))


@query(
    "store_stats",
    with_roles(
        """ select count(*) as total, count(*) filter (where recognised) as recognised,
        cast(round_even(avg(processing_ms) filter (where status = 'done'), 0) as bigint) as avg_processing_ms from log""",
        "log",
    ),
)
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(role(spark, sf_dir, "log"))


@query("store_next_id", with_roles(" select max(id) + 1 as next_id from log", "log"))
def store_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.next_id(role(spark, sf_dir, "log"))


@query(
    "store_queue_position",
    with_roles(" select id, rank() over (order by created_at) - 1 as position from log where status = 'queued'", "log"),
)
def store_queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.queue_positions(role(spark, sf_dir, "log"))


@query("store_next_queued", with_roles(" select id from log where status = 'queued' order by created_at, id limit 1", "log"))
def store_next_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.next_queued(role(spark, sf_dir, "log"))


@query(
    "store_facets",
    with_roles(
        " select case when contains(doc_type, '_') then regexp_replace(doc_type, '_[^_]*$', '') else doc_type end as base, status, count(*) as n from log group by all",
        "log",
    ),
)
def store_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.facets(role(spark, sf_dir, "log"))


@query(
    "store_upsert",
    with_roles(
        """ , old as (select id, status, case when id % 2 = 0 then concat('r', cast(id as varchar)) end as result from log where id % 3 <> 0),
        new as (select id, 'done' as status, case when id % 5 = 0 then 'new' end as result from log where id % 4 = 0)
        select coalesce(n.id, o.id) as id, coalesce(n.status, o.status) as status, coalesce(n.result, o.result) as result
        from old o full join new n on o.id = n.id""",
        "log",
    ),
)
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = role(spark, sf_dir, "log")
    old = log.where("id % 3 <> 0").selectExpr("id", "status", "case when id % 2 = 0 then concat('r', id) end as result")
    new = log.where("id % 4 = 0").selectExpr("id", "'done' as status", "case when id % 5 = 0 then 'new' end as result")
    return store.upsert(old, new)


@query("store_purge", with_roles(" select id from log where status = 'processing'", "log"))
def store_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.purge(role(spark, sf_dir, "log")).select("id")


@query(
    "store_requeue",
    with_roles(
        """ select id, case when id % 10 = 3 and status in ('done', 'failed') then 'queued' else status end as status,
        case when id % 10 = 3 and status in ('done', 'failed') then 0 else id % 3 end as retry_count from log""",
        "log",
    ),
)
def store_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = role(spark, sf_dir, "log").selectExpr("id", "status", "id % 3 as retry_count")
    return store.requeue(log, log.where("id % 10 = 3").select("id"))


@query(
    "store_reset_stale",
    with_roles(" select case when status = 'processing' then 'queued' else status end as status, count(*) as n from log group by all", "log"),
)
def store_reset_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.reset_stale(role(spark, sf_dir, "log")).groupBy("status").agg(F.count("*").alias("n"))


_ERRORS = """case id % 6 when 0 then 'TimeoutError: job' when 1 then 'PipelineBusy: lease' when 2 then 'RuntimeError: CUDA failure'
 when 3 then 'OSError: disk' when 4 then 'ValueError: bad value' else 'RecognitionError: none' end"""


@query(
    "retry_machine",
    with_roles(
        f""" , e as (select id, id % 4 as retry_count, lower({_ERRORS}) as err from log where status = 'failed'),
        c as (select id, retry_count, case when contains(err, 'timeouterror') then 'TIMEOUT' when contains(err, 'pipelinebusy') then 'BUSY'
          when contains(err, 'recognitionerror') then 'RECOGNITION_FAILED' when contains(err, 'cuda') then 'GPU_ERROR'
          when contains(err, 'oserror') then 'IO_ERROR' else 'INTERNAL' end as error_code from e)
        select id, error_code, case when error_code in ('TIMEOUT', 'BUSY', 'GPU_ERROR', 'IO_ERROR') and retry_count < 2 then 'queued' else 'failed' end as next_status,
        retry_count + case when error_code in ('TIMEOUT', 'BUSY', 'GPU_ERROR', 'IO_ERROR') and retry_count < 2 then 1 else 0 end as next_retry from c""",
        "log",
    ),
)
def retry_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.functions.text import error_code

    failed = role(spark, sf_dir, "log").where("status = 'failed'").selectExpr("id", "id % 4 as retry_count", f"{_ERRORS} as error")
    code, transient = error_code(F.col("error"))
    out = store.after_failure(failed.withColumn("error_code", code).withColumn("transient", transient), 2)
    return out.select("id", "error_code", "next_status", F.col("next_retry").cast("long").alias("next_retry"))


_HEADS = """case page_id % 9 when 0 then 'FFD8FFE0' when 1 then '89504E470D0A1A0A' when 2 then '424D' when 3 then '49492A00'
 when 4 then '4D4D002A' when 5 then '52494646000000005745425056' when 6 then '255044462D' when 7 then '' else '3C21' end"""


@query(
    "upload_cascade",
    f"""with u as (select page_id, {_HEADS} as h, case when page_id % 9 = 7 then 0 else length(html) end as size, page_id % 8 <> 1 as decodes from pages),
    k as (select *, case when starts_with(h, '52494646') and substr(h, 17, 8) = '57454250' then 'webp' when starts_with(h, 'FFD8FF') then 'jpeg'
      when starts_with(h, '89504E470D0A1A0A') then 'png' when starts_with(h, '424D') then 'bmp'
      when starts_with(h, '49492A00') or starts_with(h, '4D4D002A') then 'tiff' when starts_with(h, '25504446') then 'pdf' end as kind from u)
    select page_id, kind, cast(case when size > 4000 then 413 when size = 0 then 400 when kind = 'pdf' then 415 when kind is null then 415
      when not decodes then 422 end as bigint) as code from k""",
)
def upload_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.session import table

    u = table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"unhex({_HEADS}) as content", "case when page_id % 9 = 7 then 0 else length(html) end as size", "page_id % 8 <> 1 as decodes"
    )
    code = store.upload_code(F.col("size"), 4000, F.col("content"), F.col("decodes")).cast("long")
    return u.select("page_id", store.sniff(F.col("content")).alias("kind"), code.alias("code"))


@query(
    "settings_typed",
    """with s as (select cast(s_suppkey as bigint) as id, case s_suppkey % 4 when 0 then 'int' when 1 then 'float' when 2 then 'bool' else 'choice' end as kind,
      case s_suppkey % 5 when 0 then ' 12.9 ' when 1 then 'abc' when 2 then 'Yes' when 3 then '700' else 'cpu' end as raw from supplier),
    v as (select *, trim(raw) as t, try_cast(trim(raw) as double) as num from s),
    e as (select *, case when kind in ('int', 'float') and num is null then 'must be a number' when kind in ('int', 'float') and num < 10 then 'below minimum'
      when kind in ('int', 'float') and num > 600 then 'above maximum' when kind = 'choice' and t not in ('auto', 'cpu', 'gpu') then 'not a choice' end as error from v)
    select id, case when error is not null then null when kind = 'bool' then case when lower(t) in ('1', 'true', 'yes', 'on') then '1' else '0' end
      when kind = 'int' then cast(cast(trunc(num) as bigint) as varchar) when kind = 'float' then cast(num as varchar) else t end as value, error from e""",
)
def settings_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.session import table

    s = table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as bigint) as id",
        "case s_suppkey % 4 when 0 then 'int' when 1 then 'float' when 2 then 'bool' else 'choice' end as kind",
        "case s_suppkey % 5 when 0 then ' 12.9 ' when 1 then 'abc' when 2 then 'Yes' when 3 then '700' else 'cpu' end as raw",
    )
    choices = F.array(*[F.lit(x) for x in ("auto", "cpu", "gpu")])
    value, error = store.coerce_setting(F.col("kind"), F.col("raw"), F.lit(10.0), F.lit(600.0), choices)
    return s.select("id", value.alias("value"), error.alias("error"))
