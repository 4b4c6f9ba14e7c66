"""Queries of the recognition flow, record changes, keys, settings, conformance payloads and file trees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import geometry, text
from folio.image import frames
from folio.operators import classify, conform, decode, evaluate, flow, service, store, view
from folio.plans.bindings import role, with_roles
from folio.plans.registry import query
from folio.session import shared_dir, table
from folio.sources import files
from folio.streaming import queue

# What the models would give, by the record's number.
_TYPE1 = "case o_orderkey % 5 when 0 then 'NONE' when 1 then 'INTPASSPORTADDR_ALL' when 2 then 'DL_2020' when 3 then 'INTPASSPORT_2011' else 'SNILS_1996' end"
_TYPE2 = "case o_orderkey % 3 when 0 then 'NONE' when 1 then 'INTPASSPORT_2011' else 'DL_2011' end"
_PAGES = "select cast(o_orderkey as bigint) as doc_id, o_orderkey from {o}"


def _models() -> flow.Models:
    def types(pages: DataFrame) -> DataFrame:
        cropped = "max_pages" in pages.columns
        return pages.selectExpr("doc_id", f"{_TYPE2 if cropped else _TYPE1} as doc_type", f"cast({0.7 if cropped else 0.9} as double) as conf", "cast(o_orderkey % 4 * 90 as int) as angle")

    def borders(pages: DataFrame) -> DataFrame:
        return pages.where("o_orderkey % 4 <> 3") if "max_pages" in pages.columns and "doc_type" not in pages.columns else pages

    def quality(pages: DataFrame) -> DataFrame:
        return pages.selectExpr(
            "doc_id", "case when o_orderkey % 7 = 0 then 'bad' else 'good' end as glare", "'good' as blur",
            "cast(o_orderkey % 10 as double) / 10 as print_conf", "case when o_orderkey % 11 = 0 then 'FAKE' else 'REAL' end as lcd",
        )

    def fields(pages: DataFrame) -> DataFrame:
        return pages.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int"))).alias("det_idx"))

    def lines(pages: DataFrame) -> DataFrame:
        return pages.where("o_orderkey % 2 = 0").select("doc_id")

    def words(pages: DataFrame) -> DataFrame:
        return pages.selectExpr("doc_id", "'Licence_number' as field", "cast(o_orderkey as string) as text")

    return flow.Models(types, borders, quality, fields, lines, words)


@query(
    "recognition_flow",
    f"""with t as (select o_orderkey as doc_id, {_TYPE1} as t1, case when o_orderkey % 5 = 0 and o_orderkey % 4 <> 3 then {_TYPE2} end as t2 from orders),
    u as (select doc_id, coalesce(t2, t1) as t, t1 = 'NONE' and t2 is not null as recovered, case when t2 = 'INTPASSPORT_2011' then 2 else 1 end as max_pages from t),
    q as (select *, t <> 'NONE' as known, doc_id % 7 = 0 as glare from u),
    s as (select *, (case when recovered then 0.7 else 0.9 end)::double as conf, case when not known then 'type' when glare then 'quality' when t = 'INTPASSPORTADDR_ALL' and (doc_id % 2 <> 0 or (max_pages = 1 and doc_id % 4 = 3)) then 'address' end as stopped from q),
    r as (select *, known and stopped is null and doc_id % 4 <> 3 as cut from s)
    select doc_id, case when stopped = 'address' then 'NONE' else t end as doc_type, case when stopped = 'address' then 0.0 else conf end as conf, cast(doc_id % 4 * 90 as int) as angle, recovered, cast(max_pages as int) as max_pages,
    case when known then case when glare then 'bad' else 'good' end end as glare, case when known then 'good' end as blur,
    case when known then case when doc_id % 10 < 9 then 'FAKE' else 'REAL' end end as print_spoofing, case when known then case when doc_id % 11 = 0 then 'FAKE' else 'REAL' end end as lcd_spoofing, stopped,
    cast(case when cut then doc_id % 3 + 1 else 0 end as bigint) as n_fields, case when cut then cast(doc_id as varchar) end as licence from r""",
)
def recognition_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.sql(_PAGES, o=table(spark, sf_dir, "orders"))
    out = flow.recognise(pages, _models(), low_quality=False)
    return out.withColumn("licence", F.try_element_at("ocr", F.lit("Licence_number"))).drop("ocr")


_ENGINES = """select cast(p_partkey as bigint) as doc_id, 'f' || cast(p_size % 5 as varchar(9)) as field, 'cyr' as engine, p_name as text from part where p_partkey % 3 <> 0
 union all select cast(p_partkey as bigint), 'f' || cast(p_size % 5 as varchar(9)), 'lat', case when p_partkey % 4 = 0 then '-' else p_brand end from part where p_partkey % 5 <> 0"""


@query("engine_table", f"with e as ({_ENGINES}) select doc_id, field, max(text) filter (where engine = 'cyr') as cyr, max(text) filter (where engine = 'lat') as lat from e group by all")
def engine_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.engine_table(spark.sql(_ENGINES.replace("from part", "from {p}"), p=table(spark, sf_dir, "part")), ["cyr", "lat"])


_ODD = "length(trim(coalesce({0}, ''))) < 2 or length(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]', '', 'g')) < greatest(2, length(trim(coalesce({0}, ''))) / 2)"


@query(
    "suspicious_by_engine",
    f"""with e as ({_ENGINES}), t as (select doc_id, field, max(text) filter (where engine = 'cyr') as cyr, max(text) filter (where engine = 'lat') as lat from e group by all)
    select 'cyr' as engine, count(*) filter (where {_ODD.format("cyr")}) as suspicious, count(*) as fields from t union all select 'lat', count(*) filter (where {_ODD.format("lat")}), count(*) from t""",
)
def suspicious_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.suspicious_by_engine(spark.sql(_ENGINES.replace("from part", "from {p}"), p=table(spark, sf_dir, "part")), ["cyr", "lat"])


@query(
    "concurrent_members",
    with_roles(" select cast(user_id as bigint) as doc_id, array_to_string(list_sort(coalesce(list(distinct stage) filter (where concurrent), [])), ',') as members from timings group by user_id", "timings"),
)
def concurrent_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = role(spark, sf_dir, "timings").selectExpr("cast(user_id as bigint) as doc_id", "stage", "concurrent")
    return evaluate.concurrent_members(t).select("doc_id", F.array_join("members", ",").alias("members"))


@query(
    "store_create",
    with_roles(
        """ , n as (select concat('new_', lpad(cast(c_custkey as varchar), 9, '0')) as filename, timestamp '2024-02-01' as created_at, 'queued' as status from customer)
        select id, filename, status from log union all select (select max(id) from log) + row_number() over (order by filename, created_at), filename, status from n""",
        "log",
    ),
)
def store_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "customer").selectExpr("concat('new_', lpad(cast(c_custkey as string), 9, '0')) as filename", "timestamp '2024-02-01' as created_at", "'queued' as status")
    return store.create(role(spark, sf_dir, "log").select("id", "filename", "status", "created_at"), new).select("id", "filename", "status")


@query(
    "store_update",
    with_roles(
        """ , c as (select id, 'done' as status, case when id % 2 = 0 then 5 end as processing_ms from log where id % 3 = 0)
        select l.id, coalesce(c.status, l.status) as status, coalesce(c.processing_ms, l.processing_ms) as processing_ms, case when c.id is not null then timestamp '2024-03-01' else l.created_at end as updated_at from log l left join c on l.id = c.id""",
        "log",
    ),
)
def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = role(spark, sf_dir, "log").selectExpr("id", "status", "processing_ms", "created_at as updated_at")
    changes = log.where("id % 3 = 0").selectExpr("id", "'done' as status", "case when id % 2 = 0 then 5L end as processing_ms")
    return store.update(log, changes, F.lit("2024-03-01").cast("timestamp"))


@query(
    "removal_counts",
    with_roles(" select count(*) filter (where id % 2 = 0 and status <> 'processing') as removed, count(*) filter (where not (id % 2 = 0 and status <> 'processing')) as kept, count(*) filter (where id % 2 = 0 and status = 'processing') as active from log", "log"),
)
def removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = role(spark, sf_dir, "log")
    return store.removal_counts(log, log.where("id % 2 = 0").select("id"))


@query(
    "settings_update",
    """with s as (select concat('k', r_regionkey) as key, case when r_regionkey % 2 = 0 then 'int' else 'bool' end as kind, '3' as default, r_regionkey < 4 as restart_required from region),
    v as (select concat('k', n_nationkey) as key, n_nationkey, case when n_nationkey = 2 then 'x' when n_nationkey = 4 then '99' else cast(n_nationkey + 3 as varchar) end as value from nation),
    j as (select v.key, v.value, s.kind, s.default, s.restart_required, case when s.kind = 'int' and try_cast(v.value as double) is null then 'must be a number' when s.kind = 'int' and try_cast(v.value as double) > 10 then 'above maximum' end as error,
      case when s.kind = 'bool' then '0' else v.value end as stored from v join s on v.key = s.key)
    select key, case when error is null then stored end as value, case when error is null then restart_required and stored <> case when key = 'k1' then '0' else "default" end end as restart, error from j""",
)
def settings_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "region").selectExpr(
        "concat('k', r_regionkey) as key", "case when r_regionkey % 2 = 0 then 'int' else 'bool' end as kind", "0D as low", "10D as high",
        "cast(array() as array<string>) as choices", "'3' as default", "r_regionkey < 4 as restart_required",
    )
    values = table(spark, sf_dir, "nation").selectExpr("concat('k', n_nationkey) as key", "case when n_nationkey = 2 then 'x' when n_nationkey = 4 then '99' else cast(n_nationkey + 3 as string) end as value")
    stored = spark.createDataFrame([("k1", "0")], "key string, value string")
    good, bad = store.update_settings(stored, schema, values)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query(
    "api_key_lookup",
    """with k as (select c_custkey as id, concat('key', c_custkey) as secret, c_custkey % 7 = 0 as revoked from customer where c_custkey % 2 = 0), p as (select o_orderkey as request, concat('key', o_custkey) as key from orders)
    select p.request, k.id as key_id, case when k.id is null then 404 when k.id % 10 = 0 then 409 else 204 end as delete_code from p left join k on k.secret = p.key and not k.revoked""",
)
def api_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr(
        "c_custkey as id", "sha2(concat('key', c_custkey), 256) as key_hash", "case when c_custkey % 7 = 0 then timestamp '2024-01-01' end as revoked_at"
    )
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey as request", "concat('key', o_custkey) as key")
    found = store.verify_keys(asked, keys)
    return found.withColumn("delete_code", store.delete_key_code(F.col("key_id").isNotNull(), F.col("key_id") % 10 == 0))


_FILES = """select l_orderkey as doc_id, case l_linenumber when 1 then 'original.jpg' when 2 then 'canvas.png' when 3 then 'thumb.jpg' when 4 then 'canvas.jpg' when 5 then 'original.tmp' else concat('original.b', l_linenumber) end as name,
 (l_linenumber + l_orderkey) % 2 = 0 as jpeg from lineitem where (l_orderkey + l_linenumber) % 3 <> 0"""


@query(
    "artifacts",
    f"""with f as ({_FILES}), t as (select doc_id, min(case name when 'thumb.jpg' then 0 when 'canvas.png' then 1 when 'canvas.jpg' then 2 end) as k from f group by doc_id),
    o as (select doc_id, min(name) as name, arg_min(jpeg, name) as jpeg from f where name like 'original.%' and name <> 'original.tmp' group by doc_id)
    select doc_id, 'thumb' as kind, case k when 0 then 'thumb.jpg' when 1 then 'canvas.png' else 'canvas.jpg' end as name, case k when 1 then 'image/png' else 'image/jpeg' end as media from t where k is not null
    union all select doc_id, 'original', name, case when jpeg then 'image/jpeg' else 'application/octet-stream' end from o""",
)
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(_FILES.replace("from lineitem", "from {l}"), l=table(spark, sf_dir, "lineitem"))
    f = f.withColumn("head", F.when(F.col("jpeg"), F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("00010203"))))
    kinds = [store.open_artifacts(f, k).withColumn("kind", F.lit(k)) for k in ("thumb", "original")]
    return kinds[0].unionByName(kinds[1])


@query(
    "json_leaves",
    """select event_id, 'k' as path, 'number' as kind, json_extract_string(props, '$.k') as value from events union all select event_id, '$', 'object', cast(len(json_keys(props)) as varchar) from events""",
)
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.leaves(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props")


_GOLDEN_JSON = """concat('{"doc_type": "', o_orderstatus, '", "timings": {"total": ', o_orderkey % 50, '}, "boxes": [{"x1": ', o_orderkey % 90, ', "conf": 0.', 100 + o_orderkey % 800, '}], "device": "cpu"}')"""
_ACTUAL_JSON = """concat('{"doc_type": "', case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end, '", "timings": {"total": 7}, "boxes": [', case when o_orderkey % 7 = 0 then '' else concat('{"x1": ', o_orderkey % 90 + case when o_orderkey % 3 = 0 then 2 else 0 end, ', "conf": 0.', 100 + o_orderkey % 800, '}') end, '], "device": "gpu"',
 case when o_orderkey % 11 = 0 then ', "more": null' else '' end, '}')"""


@query(
    "diff_records",
    """select o_orderkey as id, 'doc_type' as path, 'value' as kind from orders where o_orderkey % 5 = 0 and o_orderstatus <> 'X' union all select o_orderkey, 'boxes', 'length' from orders where o_orderkey % 7 = 0
    union all select o_orderkey, 'boxes[0].x1', 'value' from orders where o_orderkey % 7 <> 0 and o_orderkey % 3 = 0 union all select o_orderkey, 'more', 'extra' from orders where o_orderkey % 11 = 0""",
)
def diff_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 on whole records: their JSON is parsed, and times and devices may differ."""
    o = table(spark, sf_dir, "orders")
    sides = [conform.leaves(o.selectExpr("o_orderkey as id", f"{j} as j"), "id", "j") for j in (_GOLDEN_JSON, _ACTUAL_JSON)]
    return conform.differences(*sides, ["id"], "gpu")


@query("perturbation_test", "select o_orderkey as id, 'boxes[0].conf' as path, 'value' as kind from orders")
def perturbation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moved number is found in every record, and nothing else."""
    golden = conform.leaves(table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"{_GOLDEN_JSON} as j"), "id", "j")
    return conform.differences(golden, conform.perturbed(golden, "boxes[0].conf", 0.5), ["id"], "gpu")


_PAYLOADS = """select l_orderkey as id, l_linenumber, case l_linenumber % 7 when 0 then null when 1 then '{}' when 2 then '[]' when 3 then '{"a": null, "b": null}' when 4 then '{"a": null, "b": 1}' when 5 then '""' else '[1]' end as payload from lineitem"""


@query(
    "vacuous_payloads",
    f"""with p as ({_PAYLOADS}) select id, l_linenumber, case l_linenumber % 7 when 0 then 'golden is null' when 1 then 'golden is an empty dict' when 2 then 'golden is an empty list' when 3 then 'every value in the golden is null' when 5 then 'golden is an empty str' end as reason from p""",
)
def vacuous_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _PAYLOADS.removeprefix("select ").removesuffix(" from lineitem")
    payload = columns.removeprefix("l_orderkey as id, l_linenumber, ")
    p = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as id", "l_linenumber", payload)
    return p.select("id", "l_linenumber", conform.vacuous(F.col("payload")).alias("reason"))


@query(
    "digest_verdicts",
    """select p_partkey as id, case when p_partkey % 6 = 0 then 'FAIL' when p_partkey % 2 = 1 then 'pass' when p_partkey % 4 = 0 then 'shape-only' when p_partkey % 5 = 0 then 'FAIL' else 'pass' end as verdict,
    p_partkey % 3 <> 2 as gradable from part""",
)
def digest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    shape = lambda other: F.concat_ws("x", (i % 40).cast("string"), F.when(i % 6 == 0, other).otherwise("3"))
    pixels = F.when(i % 4 == 0, None).otherwise(i % 5 != 0)
    verdict = conform.digest_verdict(F.sha2(F.col("p_name"), 256), F.sha2(F.when(i % 2 == 1, F.col("p_name")).otherwise("other"), 256), shape("3"), shape("4"), pixels)
    version = F.when(i % 3 == 1, None).when(i % 3 == 2, "v2").otherwise("v1")
    return table(spark, sf_dir, "part").select(i.alias("id"), verdict.alias("verdict"), conform.same_weights(F.lit("v1"), version).alias("gradable"))


def _square(x: Column, y: Column, side: Column) -> Column:
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(at(x, y), at(x + side, y), at(x + side, y + side), at(x, y + side))


@query(
    "contour_checks",
    "select p_partkey as id, p_partkey % 3 <> 2 as area_ok, p_partkey % 3 = 0 as centroid_ok, p_partkey % 3 = 0 as reach_ok, [[p_size, 5], [p_size + 40, 5], [p_size + 40, 45], [p_size, 45]]::varchar as flat from part",
)
def contour_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square against itself, moved by three, and larger by ten."""
    x, kind = F.col("p_size"), F.col("p_partkey") % 3
    golden = _square(x, F.lit(5), F.lit(40))
    actual = _square(x + F.when(kind == 1, 3).otherwise(0), F.lit(5), F.when(kind == 2, 50).otherwise(40))
    ok = conform.contour_difference(golden, actual)
    whole = F.transform(text.flat_contour(golden), lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, lambda v: v.cast("long").cast("string")), ", "), F.lit("]")))
    flat = F.concat(F.lit("["), F.array_join(whole, ", "), F.lit("]"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ok["area_ok"].alias("area_ok"), ok["centroid_ok"].alias("centroid_ok"), ok["reach_ok"].alias("reach_ok"), flat.alias("flat"))


@query(
    "coerced_values",
    """select p_partkey as id, case when p_partkey % 3 = 0 then p_size when p_partkey % 3 = 1 then p_size end as whole, case when p_partkey % 3 = 2 then p_name else cast(cast(p_size as double) as varchar) end as quality from part""",
)
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is a number as one, else null, or as its text."""
    raw = F.expr("case p_partkey % 3 when 0 then cast(p_size as string) when 1 then concat(p_size, '.75') else p_name end")
    value = F.expr("case when p_partkey % 3 = 2 then p_name else cast(p_size as string) end")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.as_int(raw).alias("whole"), text.quality_value(value).alias("quality"))


@query(
    "lines_and_corners",
    """select s_suppkey as id, cast(s_suppkey % 9 as double) as cross_x, cast(s_suppkey % 9 as double) as cross_y, 90.0::double as angle, 2.0::double as foot_x, 0.0::double as foot_y, 0.0::double as first_x, 4 as n_quad,
    round_even(sqrt(2.0::double) * -10, 6) as anchor from supplier""",
)
def lines_and_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, feet, corners in order, the quad of a polygon's longest sides, a turned box."""
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    k = (F.col("s_suppkey") % 9).cast("double")
    cross = geometry.crossing(F.struct(k.alias("x"), F.lit(-5.0).alias("y")), F.struct(k.alias("x"), F.lit(5.0).alias("y")), p(-3, -3), p(7, 7))
    foot = geometry.foot(p(2, 5), p(0, 0), p(9, 0))
    square = F.array(p(10, 10), p(0, 0), p(0, 10), p(10, 0))
    hexagon = F.array(p(0, 1), p(1, 0), p(20, 0), p(20, 20), p(0, 20), p(0, 2))
    turned = geometry.oriented_corners(F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(20.0), F.lit(math.pi / 4))
    top = F.array_min(F.array(*[y for _, y in turned]))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), cross["x"].alias("cross_x"), cross["y"].alias("cross_y"), geometry.angle_of(p(0, 0), p(0, 3)).alias("angle"), foot["x"].alias("foot_x"), foot["y"].alias("foot_y"),
        F.get(geometry.by_angle(geometry.ordered_corners(square)), 0)["x"].alias("first_x"), F.size(geometry.quad_of_longest(hexagon)).alias("n_quad"), F.bround(top, 6).alias("anchor"),
    )


@query(
    "ctc_indices",
    """with s as (select vec_id, t, list_slice(embedding, t * 4 + 1, t * 4 + 4) as p from embeddings, range(16) r(t)), c as (select vec_id, t, list_position(p, list_max(p)) - 1 as k from s),
    l as (select *, lag(k, 1, -1) over (partition by vec_id order by t) as before from c) select vec_id, coalesce(string_agg(case when k <> before and k <> 0 then cast(k as varchar) end, ',' order by t), '') as idx, 64 as flat from l group by vec_id""",
)
def ctc_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("embedding", t * 4 + 1, 4))
    found = F.array_join(F.transform(decode.ctc_indices(matrix), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "embeddings").select("vec_id", found.alias("idx"), F.size(decode.raveled(matrix)).alias("flat"))


@query(
    "width_batches",
    """with w as (select l_orderkey as doc_id, l_linenumber as word_id, cast(l_quantity as int) * 7 as width from lineitem), r as (select *, case when width <= 64 then 64 when width <= 128 then 128 when width <= 256 then 256 else 256 + cast(ceil((width - 256) / 128.0) * 128 as int) end as rung from w),
    n as (select *, row_number() over (partition by doc_id, rung order by word_id) - 1 as k from r) select doc_id, word_id, rung, k // 2 as batch, k % 2 as place from n""",
)
def width_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber as word_id", "cast(l_quantity as int) * 7 as width")
    return decode.batched_by_width(w, [64, 128, 256], 2)


@query("width_steps", "select p_partkey as id, greatest(case when p_size % 2 = 0 then 1 + (p_size - 10) // 2 else 3 + (p_size - 11) // 2 end, 1)::int as steps from part where p_size >= 11 union all select p_partkey, greatest(case when p_size % 2 = 0 then 1 + cast(floor((p_size - 10) / 2.0) as int) else 3 + cast(floor((p_size - 11) / 2.0) as int) end, 1)::int from part where p_size < 11")
def width_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), service.width_steps(F.col("p_size"), 2, [(10, 1), (11, 3)]).alias("steps"))


@query(
    "keys_with_default",
    """with k as (select n_nationkey as id, timestamp '2024-01-01' + to_days(n_nationkey * 7 % 25) as created_at from nation) select 0 as id, true as is_default, 1 as "rank" union all
    select id + 1, false, row_number() over (order by created_at, id) + 1 from k""",
)
def keys_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey + 1 as int) as id", "timestamp '2024-01-01' + make_dt_interval(cast(n_nationkey * 7 % 25 as int)) as created_at")
    default = spark.sql("select 0 as id, timestamp '2025-01-01' as created_at")
    return service.with_default(keys, default).select("id", "is_default", "rank")


@query("argmax_labels", "select vec_id, concat('c', list_position(list_transform(embedding, x -> round(x, 1)), list_max(list_transform(embedding, x -> round(x, 1)))) - 1) as label from embeddings".replace("x -> round(x, 1)", "lambda x: round_even(x::double, 1)"))
def argmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.transform("embedding", lambda x: F.bround(x.cast("double"), 1))
    labels = F.array(*[F.lit(f"c{i}") for i in range(64)])
    return table(spark, sf_dir, "embeddings").select("vec_id", classify.argmax_label(scores, labels).alias("label"))


@query(
    "display_names",
    with_roles(" select doc_id, label as name, case label when 'Licence_number' then 'Licence number' when 'Last_name_ru' then 'Last name' else label end as display, count(*) as n from boxes group by all", "boxes"),
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("Licence_number", "Licence number"), ("Last_name_ru", "Last name")], "name string, display string")
    fields = role(spark, sf_dir, "boxes").groupBy("doc_id", F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return view.display_names(fields, names).select("doc_id", "name", "display", "n")


@query(
    "address_boxes",
    """with l as (select l_orderkey as doc_id, count(*) as n from lineitem group by 1) select doc_id, doc_id % 2 = 0 as aligned, cast(n as int) as n_lines, case when doc_id % 2 = 0 then cast(n as int) else 0 end as n_boxes from l""",
)
def address_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many oriented boxes as lines in every second document, one too many in the others."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.concat(F.lit("line"), F.col("l_linenumber").cast("string")))).alias("lines"))
    boxes = F.transform(F.col("lines"), lambda _, i: F.struct(i.alias("cx"), F.lit(1.0).alias("angle")))
    boxes = F.when(F.col("doc_id") % 2 == 0, boxes).otherwise(F.concat(boxes, F.slice(boxes, 1, 1)))
    a = rows.select("doc_id", view.address(F.col("lines"), boxes).alias("a"))
    return a.select("doc_id", "a.aligned", F.size("a.lines").alias("n_lines"), F.size(F.filter("a.lines", lambda x: x["obbox"].isNotNull())).alias("n_boxes"))


@query(
    "snils_checks",
    """with n as (select c_custkey as id, lpad(cast(c_custkey * 7919 % 1000000000 as varchar), 9, '0') as d, c_custkey % 4 as kind from customer),
    s as (select *, cast(d[1] as int) * 9 + cast(d[2] as int) * 8 + cast(d[3] as int) * 7 + cast(d[4] as int) * 6 + cast(d[5] as int) * 5 + cast(d[6] as int) * 4 + cast(d[7] as int) * 3 + cast(d[8] as int) * 2 + cast(d[9] as int) as t from n),
    m as (select *, case when t > 101 then t % 101 else t end as u from s)
    select id, case when kind = 3 then 'malformed' when cast(d as bigint) <= 1001998 or id % 100 = case when u >= 100 then 0 else u end then 'ok' else 'failed' end as verdict from m""",
)
def snils_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "lpad(cast(c_custkey * 7919 % 1000000000 as string), 9, '0') as d", "c_custkey % 4 as kind", "lpad(cast(c_custkey % 100 as string), 2, '0') as e")
    value = F.expr("concat(substr(d, 1, 3), '-', substr(d, 4, 3), '-', substr(d, 7, 3), case kind when 0 then '-' when 3 then '' else ' ' end, e)")
    return c.select("id", text.snils_verdict(value).alias("verdict"))


@query("quality_tiles", "select p_partkey as doc_id, a.a * 4 + b.b as tile, cast(round_even(a.a * greatest(p_size * 20 - 128, 0) / 6.0::double, 0) as int) as x, cast(round_even(b.b * greatest(p_size * 30 - 128, 0) / 3.0::double, 0) as int) as y from part, range(7) a(a), range(4) b(b)")
def quality_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.struct((F.col("p_size") * 30).alias("height"), (F.col("p_size") * 20).alias("width")).alias("image"))
    return frames.tiles(p).withColumn("tile", F.col("tile").cast("long"))


def _tree(spark: SparkSession, sf_dir: str, name: str, folder: DataFrame, ending: str) -> str:
    """A small tree of files made from a table: one file of ``value`` in a folder ``at=<n>`` for each ``at``."""
    import uuid

    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = folder.repartition("at").write.partitionBy("at")
    (writer.format("json").save(place) if ending == "json" else writer.text(place))
    return place


@query(
    "ground_truth_scan",
    "select concat('at=', n_nationkey) as doctype, 'n_name' as field, n_name as truth from nation union all select concat('at=', n_nationkey), 'region', cast(n_regionkey as varchar) from nation where n_regionkey <> 0",
)
def ground_truth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one JSON file a nation, read with free keys; empty truths stay out."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as at", "n_name", "case when n_regionkey = 0 then '' else cast(n_regionkey as string) end as region")
    return files.ground_truth(spark, _tree(spark, sf_dir, "truth", n, "json")).select("doctype", "field", "truth")


@query("yolo_scan", "select cast(s_suppkey % 9 as int) as cls, (s_suppkey % 50) / 100.0::double as cx, 0.5::double as cy, 0.25::double as w, 0.125::double as h, count(*) as n from supplier where s_suppkey % 4 <> 0 group by all")
def yolo_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines in text files, every fourth of them malformed."""
    line = "case when s_suppkey % 4 = 0 then 'no label' else concat(s_suppkey % 9, ' ', (s_suppkey % 50) / 100D, ' 0.5 0.25 0.125') end"
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 5 as at", f"{line} as value")
    found = files.yolo_labels(spark, _tree(spark, sf_dir, "yolo", s, "txt"))
    return found.groupBy("cls", "cx", "cy", "w", "h").agg(F.count("*").alias("n"))


@query("external_label_scan", "select case when n_nationkey % 2 = 0 then 'surname' else 'number' end as key, n_name as value, n_nationkey / 100.0::double as confidence from nation")
def external_label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file a nation that holds {key: [value, confidence]}."""
    value = "concat('{\"', case when n_nationkey % 2 = 0 then 'surname' else 'number' end, '\": [\"', n_name, '\", ', n_nationkey / 100D, ']}')"
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as at", f"{value} as value")
    return files.external_labels(spark, _tree(spark, sf_dir, "labels", n, "txt")).select("key", "value", "confidence")


@query("record_scan", "select n_nationkey as id, n_name as filename from nation where n_nationkey % 6 <> 5 union all select null, concat('corrupt ', count(*)) from nation where n_nationkey % 6 = 5")
def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of records of which some are corrupt; these never fail the read."""
    value = "case when n_nationkey % 6 = 5 then '{broken' else concat('{\"id\": ', n_nationkey, ', \"filename\": \"', n_name, '\"}') end"
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as at", f"{value} as value")
    place = _tree(spark, sf_dir, "records", n, "txt")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("filename", T.StringType())])
    good, bad = files.record_store(spark, place, schema, glob="*.txt")
    counted = bad.agg(F.concat(F.lit("corrupt "), F.count("*").cast("string")).alias("filename")).select(F.lit(None).cast("int").alias("id"), "filename")
    return good.unionByName(counted)


@query("tree_size", "select cast(sum(strlen(n_name) + 1) as bigint) as bytes from nation")
def tree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bytes of the files of a tree, without reading them."""
    place = _tree(spark, sf_dir, "sized", table(spark, sf_dir, "nation").selectExpr("n_nationkey as at", "n_name as value"), "txt")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(place)
    return service.folder_size(found)


@query(
    "queue_drain",
    """select event_id as id, case when event_type <> 'error' then 'done' when user_id % 2 = 0 and user_id % 3 < 2 then 'queued' else 'failed' end as status,
    cast(user_id % 3 + case when event_type = 'error' and user_id % 2 = 0 and user_id % 3 < 2 then 1 else 0 end as int) as retry_count from events""",
)
def queue_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue worked off as a stream: each job is claimed, tried and done, queued again or failed."""
    import uuid

    place = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"
    stream = queue.table_stream(spark, sf_dir, "events").selectExpr(
        "event_id as id", "cast(user_id % 3 as int) as retry_count", "case when event_type = 'error' then 'cuda out of memory' end as error", "user_id % 2 = 0 as transient"
    )
    queue.drain(stream, lambda jobs: queue.outcome(jobs, 2), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("id", "status", "retry_count")
