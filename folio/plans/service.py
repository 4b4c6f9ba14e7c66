"""Queries of options, rows, status and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import options, service, store
from folio.plans.bindings import role, with_roles
from folio.plans.registry import query
from folio.session import table

_RULE = "case when contains(lower(doc_type), 'intpassportaddr') then 'intpassportaddr' when contains(lower(doc_type), 'intpassport') then 'intpassport' when contains(lower(doc_type), 'extpassport') then 'extpassport' when contains(lower(doc_type), 'dl') then 'dl' when contains(lower(doc_type), 'snils') then 'snils' when contains(lower(doc_type), 'birthcert') then 'birthcert' end"


@query("document_options", with_roles(f" select {_RULE} as rule, count(*) as n from log group by 1", "log"))
def document_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.with_options(role(spark, sf_dir, "log")).groupBy("rule").agg(F.count("*").alias("n"))


_LISTS = ", ".join(f"('{m}', {[*options.CYRILLIC[m], *[f for f in options.LATIN[m] if f not in options.CYRILLIC[m]]]})" for m in options.CYRILLIC)


@query(
    "read_fields",
    with_roles(
        f""" , r as (select id as doc_id, {_RULE} as rule from log), t(rule, fields) as (values {_LISTS.replace("[]", "[]::varchar[]")}), f as (select doc_id, unnest(fields) as field from r join t on r.rule = t.rule)
        select field, count(*) as n from f group by field""",
        "log",
    ),
)
def read_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = role(spark, sf_dir, "log").withColumnRenamed("id", "doc_id")
    return options.read_fields(docs).groupBy("field").agg(F.count("*").alias("n"))


@query(
    "allowed_boxes",
    with_roles(" select label, count(*) as n from boxes where doc_id % 4 = 0 or label <> 'Birth_place_ru' group by label", "boxes"),
)
def allowed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = role(spark, sf_dir, "boxes")
    fields = boxes.where("doc_id % 4 = 0 or label <> 'Birth_place_ru'").select("doc_id", F.col("label").alias("field"))
    return options.allowed_boxes(boxes, fields).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "service_rows",
    with_roles(
        """ , q as (select id, rank() over (order by created_at) - 1 as position from log where status = 'queued')
        select l.id, l.status, concat(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), 'Z') as created_at, q.position from log l left join q on l.id = q.id""",
        "log",
    ),
)
def service_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.rows(role(spark, sf_dir, "log")).select("id", "status", "created_at", "position")


@query(
    "service_status",
    with_roles(
        """ select count(*) filter (where status = 'queued') as queued, count(*) filter (where status = 'processing') as processing, count(*) filter (where status = 'done') as done,
        count(*) filter (where status = 'failed') as failed, count(*) as total, count(*) filter (where recognised) as recognised,
        cast(round_even(avg(processing_ms) filter (where status = 'done'), 0) as bigint) as avg_processing_ms from log""",
        "log",
    ),
)
def service_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.status(role(spark, sf_dir, "log"))


@query("queue_eta", with_roles(" select id, (rank() over (order by created_at)) * 0.5 as eta from log where status = 'queued'", "log"))
def queue_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.waiting_time(store.queue_positions(role(spark, sf_dir, "log")), F.lit(0.5)).select("id", "eta")


@query("label_colours", with_roles(" , d as (select distinct doc_id, label from boxes) select doc_id, label, (row_number() over (partition by doc_id order by label) - 1) % 8 as colour from d", "boxes"))
def label_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.colours(role(spark, sf_dir, "boxes"))


@query(
    "map_merge",
    "select cast(s_suppkey as bigint) as id, case when s_suppkey % 2 = 0 then concat('r', s_suppkey) else concat('l', s_suppkey) end as a, case when s_suppkey % 3 = 0 then 'right' end as b, 'left' as c from supplier",
)
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    left = F.create_map(F.lit("a"), F.concat(F.lit("l"), key), F.lit("c"), F.lit("left"))
    some = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("a"), F.concat(F.lit("r"), key)))
    more = F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("b"), F.lit("right")))
    both = service.merged(service.merged(left, some), more)
    return s.select(F.col("s_suppkey").cast("long").alias("id"), *[both[k].alias(k) for k in "abc"])


@query(
    "size_texts",
    """with s as (select cast(p_partkey as bigint) as id, case p_partkey % 3 when 0 then p_partkey * 7 % 1024 when 1 then p_partkey * 512 else p_partkey * 262144 end as n from part)
    select id, case when n < 1024 then concat(n, ' B') when n < 1048576 then concat(cast(round_even(n / 1024.0::double, 1) as varchar), ' KB') else concat(cast(round_even(n / 1048576.0::double, 1) as varchar), ' MB') end as shown,
      case when n <= 64 then 64 when n <= 512 then 512 when n <= 4096 then 4096 else 4096 + cast(ceil((n - 4096) / 3584.0::double) as bigint) * 3584 end as rung from s""",
)
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as bigint) as id", "case p_partkey % 3 when 0 then p_partkey * 7 % 1024 when 1 then p_partkey * 512 else p_partkey * 262144 end as n"
    )
    return s.select("id", text.bytes_text(F.col("n")).alias("shown"), text.ladder(F.col("n"), [64, 512, 4096]).cast("long").alias("rung"))


@query(
    "api_keys",
    "select cast(c_custkey as bigint) as id, sha256(concat('key-', c_custkey, '-', c_name)) as digest, left(concat('key-', c_custkey, '-', c_name), 10) as prefix from customer",
)
def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    digest, prefix, _ = text.mask_key(F.concat(F.lit("key-"), F.col("c_custkey").cast("string"), F.lit("-"), F.col("c_name")))
    return c.select(F.col("c_custkey").cast("long").alias("id"), digest.alias("digest"), prefix.alias("prefix"))


@query(
    "quality_gate",
    with_roles(
        """ , q as (select id, case id % 4 when 0 then 'bad' when 1 then null else 'good' end as glare, case id % 3 when 0 then null else 'good' end as blur, doc_conf from log)
        select id from q where coalesce(glare, 'good') <> 'bad' and coalesce(blur, 'good') <> 'bad' and not coalesce(doc_conf < 0.5, false)""",
        "log",
    ),
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.operators.classify import quality_gate as gate

    q = role(spark, sf_dir, "log").selectExpr(
        "id", "case id % 4 when 0 then 'bad' when 1 then null else 'good' end as glare", "case id % 3 when 0 then null else 'good' end as blur", "doc_conf"
    )
    return gate(q, 0.5).select("id")
