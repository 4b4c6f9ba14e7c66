"""Queries of evaluation, timings, conformance and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import conform, evaluate
from folio.plans.bindings import role, with_roles
from folio.plans.registry import query
from folio.session import shared_dir, table
from folio.streaming import queue

# Normalised truth and prediction, and their distance; DuckDB counts it in bytes, and the values are ASCII.
_SCORED = r""" , m as (select *, trim(regexp_replace(upper(truth), '\s+', ' ', 'g')) as t, trim(regexp_replace(upper(coalesce(predicted, '')), '\s+', ' ', 'g')) as p from pairs),
 s as (select *, levenshtein(p, t) as d, levenshtein(p, t) / length(t)::double as cer, 1 - levenshtein(p, t) / greatest(length(p), length(t), 1)::double as quality from m where t <> '')"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = role(spark, sf_dir, "pairs")
    both = evaluate.paired(pairs.select("doc_id", "field", "doctype", "truth"), pairs.where("predicted is not null").select("doc_id", "field", "predicted"), ["doc_id", "field"])
    return evaluate.scored(both)


@query("eval_rows", with_roles(_SCORED + " select doc_id, field, round_even(cer, 6) as cer, round_even(quality, 6) as quality from s", "pairs"))
def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "field", F.bround("cer", 6).alias("cer"), F.bround("quality", 6).alias("quality"))


_ACC = "count(*) as n, count(*) filter (where cer = 0) as exact, round_even(avg(cer), 6) as mean_cer, round_even(count(*) filter (where cer = 0) / count(*)::double, 6) as exact_rate from s"


@query("eval_overall", with_roles(f"{_SCORED} select {_ACC}", "pairs"))
def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_scored(spark, sf_dir))


@query("eval_by_field", with_roles(f"{_SCORED} select field, {_ACC} group by field", "pairs"))
def eval_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_scored(spark, sf_dir), ["field"])


@query("eval_by_doctype", with_roles(f"{_SCORED} select doctype, {_ACC} group by doctype", "pairs"))
def eval_by_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_scored(spark, sf_dir), ["doctype"])


@query(
    "eval_kinds",
    r"""with w as (select cast(s_suppkey as bigint) as id, concat(' a.', s_name, '  x, ') as v from supplier), u as (select id, trim(regexp_replace(upper(v), '\s+', ' ', 'g')) as v from w)
    select id, v as strict, regexp_replace(v, '[ .]', '', 'g') as number, trim(regexp_replace(regexp_replace(v, '[.,"'']', '', 'g'), '\s+', ' ', 'g')) as text, left(v, 1) as gender from u""",
)
def eval_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", "concat(' a.', s_name, '  x, ') as v")
    return w.select("id", *[text.normalize(F.col("v"), k).alias(k) for k in ("strict", "number", "text", "gender")])


@query(
    "external_labels",
    """with l as (select cast(o_orderkey as bigint) as doc_id, case o_orderkey % 4 when 0 then 'surname' when 1 then 'gender' when 2 then 'number' else 'unknown' end as key,
      case when o_orderkey % 9 = 0 then '-' else o_orderpriority end as value from orders)
    select doc_id, case key when 'surname' then 'Last_name_ru' when 'gender' then 'Sex_ru' else 'Licence_number' end as field,
      case key when 'surname' then 'text' when 'gender' then 'gender' else 'number' end as kind, value from l where value <> '-' and key <> 'unknown'""",
)
def external_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as bigint) as doc_id", "case o_orderkey % 4 when 0 then 'surname' when 1 then 'gender' when 2 then 'number' else 'unknown' end as key",
        "case when o_orderkey % 9 = 0 then '-' else o_orderpriority end as value",
    )
    return evaluate.external_labels(o)


@query(
    "stage_timings",
    with_roles(
        """ , m as (select base, stage, avg(ms) as mean_ms, count(*) as n from timings group by base, stage)
        select base, stage, n, round_even(mean_ms, 4) as mean_ms, round_even(mean_ms / sum(mean_ms) over (partition by base), 6) as share from m""",
        "timings",
    ),
)
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stage_means(role(spark, sf_dir, "timings"))


@query(
    "timing_total",
    with_roles(
        """ select cast(user_id as bigint) as doc_id, cast(coalesce(sum(ms) filter (where not concurrent), 0) + coalesce(max(ms) filter (where concurrent), 0) as bigint) as total_ms from timings group by user_id""",
        "timings",
    ),
)
def timing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = role(spark, sf_dir, "timings").selectExpr("cast(user_id as bigint) as doc_id", "concurrent", "ms")
    return evaluate.timing_totals(t).withColumn("total_ms", F.col("total_ms").cast("long"))


@query(
    "slowest_stages",
    with_roles(
        """ select doc_id, stage, "rank" from (select user_id as doc_id, stage, row_number() over (partition by user_id order by ms desc, stage, doc_id) as "rank" from
        (select user_id, stage, max(ms) as ms, min(doc_id) as doc_id from timings group by user_id, stage)) where "rank" <= 4""",
        "timings",
    ),
)
def slowest_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = role(spark, sf_dir, "timings").groupBy(F.col("user_id").alias("doc_id"), "stage").agg(F.max("ms").alias("ms"))
    return evaluate.slowest(t, "doc_id").select("doc_id", "stage", "rank")


@query(
    "ema_duration",
    with_roles(
        """ , o as (select stage, greatest(ms / 1000.0::double, 0.05) as v, row_number() over (partition by stage order by ts desc, doc_id desc) - 1 as later, count(*) over (partition by stage) as n from timings)
        select stage, round_even(sum(v * 0.3::double * pow(0.7::double, later)) + 0.6 * pow(0.7::double, max(n)), 9) as ema, count(*) as n from o group by stage""",
        "timings",
    ),
)
def ema_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = role(spark, sf_dir, "timings").selectExpr("stage", "ts", "doc_id", "cast(ms as double) / 1000 as v")
    return evaluate.moving_average(t, "stage", "v", ["ts", "doc_id"])


@query(
    "benchmark_means",
    """with o as (select o_orderstatus as k, avg(o_totalprice) as v from orders where o_orderkey % 2 = 0 group by 1), n as (select o_orderstatus as k, avg(o_totalprice) as v from orders where o_orderkey % 2 = 1 group by 1)
    select k, round_even(avg(v), 3) as v from (select * from o union all select * from n) group by k""",
)
def benchmark_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "k")
    half = lambda r: o.where(f"o_orderkey % 2 = {r}").groupBy("k").agg(F.avg("o_totalprice").alias("v"))
    return evaluate.mean_of_means(half(0), half(1), "k", "v")


_LEAVES = """select cast(l_orderkey as bigint) as id, case l_linenumber % 4 when 0 then 'boxes[0].x1' when 1 then 'boxes[0].conf' when 2 then 'boxes[0].cls' else 'name' end as path,
 case when l_linenumber % 4 = 3 then 'string' else 'number' end as kind, sum(cast(l_quantity as int)) as q from lineitem group by 1, 2, 3"""
_GOLD = "select id, path, kind, cast(q as varchar(20)) as value from leaves where id % 11 <> 0 or path <> 'name'"
_GOT = """select id, path, case when id % 13 = 0 and path = 'name' then 'null' else kind end as kind, case when id % 13 = 0 and path = 'name' then null when kind = 'string' and id % 3 = 0 then 'other'
 when path = 'boxes[0].x1' and id % 2 = 0 then cast(q + 1 as varchar(20)) when path = 'boxes[0].conf' and id % 5 = 0 then concat(cast(q as varchar(20)), '.05')
 when path = 'boxes[0].cls' and id % 6 = 0 then concat(cast(q as varchar(20)), '.001') else cast(q as varchar(20)) end as value from leaves where id % 7 <> 0 or path <> 'boxes[0].x1'"""


@query(
    "diff_json",
    f"""with leaves as ({_LEAVES}), g as ({_GOLD}), a as ({_GOT}),
    j as (select coalesce(g.id, a.id) as id, coalesce(g.path, a.path) as path, g.kind as gk, a.kind as ak, g.value as gv, a.value as av from g full join a on g.id = a.id and g.path = a.path),
    d as (select id, path, case when ak is null then 'missing' when gk is null then 'extra' when gk <> ak then 'type'
      when gk = 'number' then case when abs(try_cast(gv as double) - try_cast(av as double)) > (case path when 'boxes[0].x1' then 1.0 when 'boxes[0].conf' then 0.01 else 0.0 end) * (1 + pow(2, -40)) then 'value' end
      when gv <> av then 'value' end as kind from j) select id, path, kind from d where kind is not null""",
)
def diff_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = spark.sql(_LEAVES.replace("from lineitem", "from {l}"), l=table(spark, sf_dir, "lineitem"))
    gold = spark.sql(_GOLD.replace("from leaves", "from {l}"), l=leaves)
    got = spark.sql(_GOT.replace("from leaves", "from {l}"), l=leaves)
    return conform.differences(gold, got, ["id"], "gpu")


@query(
    "array_diff",
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as g from embeddings), a as (select vec_id, g, list_transform(g, lambda x, i: case when (vec_id + i) % 50 = 0 then x + 0.25 else x end) as a from e),
    d as (select vec_id, list_transform(list_zip(g, a), lambda z: abs(z[1] - z[2])) as gaps from a)
    select vec_id, true as same_length, cast(len(list_filter(gaps, lambda x: x > 0.001)) as bigint) as beyond, round_even(list_max(gaps), 6) as largest from d""",
)
def array_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    moved = e.withColumn("v", F.transform("v", lambda x, i: F.when((F.col("vec_id") + i + 1) % 50 == 0, x + 0.25).otherwise(x)))
    return conform.array_differences(e, moved, "vec_id", "v", 0.001)


_STAGES = """select cast(o_custkey as bigint) as case_id, cast(o_orderkey % 13 as int) as ord, concat('stage', cast(o_orderkey % 13 as varchar(9))) as stage,
 case when max(o_orderkey) % 9 = 0 then 'FAIL' when max(o_orderkey) % 10 = 0 then 'skip' else 'pass' end as status from orders group by o_custkey, o_orderkey % 13"""


@query(
    "first_divergence",
    f"""with s as ({_STAGES}) select case_id, count(*) filter (where status = 'pass') as passed, count(*) filter (where status = 'FAIL') as failed, count(*) filter (where status = 'skip') as skipped,
    arg_min(stage, ord) filter (where status = 'FAIL') as first_divergence from s group by case_id""",
)
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(_STAGES.replace("from orders", "from {o}"), o=table(spark, sf_dir, "orders"))
    return conform.case_summary(s.withColumnRenamed("case_id", "case")).withColumnRenamed("case", "case_id")


@query(
    "image_diff",
    """with p as (select l_suppkey as id, cast(l_quantity as int) * 5 as g, cast(l_quantity as int) * 5 + case when l_linenumber % 7 = 0 then 2 when l_partkey % 3 = 0 then 1 else 0 end as a from lineitem),
    d as (select id, abs(g - a) as gap from p) select id, round_even(avg(case when gap <= 1 then 1.0::double else 0.0 end), 6) as close, round_even(avg(gap), 6) as mean_gap, cast(max(gap) as bigint) as largest,
    round_even(avg(case when gap <= 1 then 1.0::double else 0.0 end), 6) >= 0.995 and round_even(avg(gap), 6) < 0.5 and max(gap) <= 3 as ok from d group by id""",
)
def image_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as id", "cast(l_quantity as int) * 5 as golden",
        "cast(l_quantity as int) * 5 + case when l_linenumber % 7 = 0 then 2 when l_partkey % 3 = 0 then 1 else 0 end as actual",
    )
    return conform.image_difference(p, ["id"])


@query(
    "manifest_changes",
    """with o as (select p_partkey as id, concat('p', p_partkey) as path, p_brand as sha from part where p_partkey % 7 <> 0),
    n as (select concat('p', p_partkey) as path, case when p_partkey % 5 = 0 then 'new' else p_brand end as sha from part where p_partkey % 11 <> 0)
    select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' else 'changed' end as kind from o full join n on o.path = n.path where o.path is null or n.path is null or o.sha <> n.sha""",
)
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 7 <> 0").selectExpr("concat('p', p_partkey) as path", "p_brand as sha")
    new = p.where("p_partkey % 11 <> 0").selectExpr("concat('p', p_partkey) as path", "case when p_partkey % 5 = 0 then 'new' else p_brand end as sha")
    return conform.manifest_changes(old, new)


@query(
    "unclaimed_stages",
    "select distinct concat('s', o_orderkey % 50) as stage from orders where concat('s', o_orderkey % 50) not in (select concat('s', o_orderkey % 20) from orders)",
)
def unclaimed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return conform.unclaimed(o.selectExpr("concat('s', o_orderkey % 50) as stage").distinct(), o.selectExpr("concat('s', o_orderkey % 20) as stage"))


_LEVELS = "case event_type when 'error' then 'ERROR' when 'view' then 'INFO' when 'click' then 'DEBUG' else 'WARNING' end"


@query(
    "log_entries",
    f"""select id, level, "rank" from (select event_id as id, {_LEVELS} as level, row_number() over (order by ts desc, event_id desc) as "rank" from events where {_LEVELS} in ('WARNING', 'ERROR') and contains(lower(props), '1')) where "rank" <= 100""",
)
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").selectExpr("event_id as id", "ts", f"{_LEVELS} as level", "props as message")
    return conform.last_entries(logs, 100, "WARNING", "1").select("id", "level", "rank")


@query("queue_stream", "select event_type as status, count(*) as n from events group by 1")
def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: all of a table's files worked off as a stream, then counted; the batch result must agree."""
    import uuid

    name = f"folio_queue_{uuid.uuid4().hex}"
    place = f"{shared_dir(spark)}/{name}"
    stream = queue.table_stream(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    q = queue.status_counts(stream).writeStream.format("memory").queryName(name).outputMode("complete")
    q = q.option("checkpointLocation", place).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
