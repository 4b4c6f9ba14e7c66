"""Queries of the text functions and machine-readable zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import mrz, text
from folio.plans.bindings import role, with_roles
from folio.plans.registry import query
from folio.session import table

_DATES = """case o_orderkey % 5 when 0 then concat(lpad(cast(o_orderkey % 31 + 1 as varchar(9)), 2, '0'), '-', lpad(cast(o_orderkey % 14 as varchar(9)), 2, '0'), '-2O', lpad(cast(o_orderkey % 90 as varchar(9)), 2, '0'))
 when 1 then '22 06 2010' when 2 then concat('15.O', cast(o_orderkey % 10 as varchar(9))) when 3 then '31022011' else '' end"""


@query(
    "fix_date",
    f"""with d as (select cast(o_orderkey as bigint) as id, {_DATES} as raw from orders),
    s as (select id, raw, replace(replace(raw, 'O', '0'), '-', '.') as swapped from d),
    n as (select *, regexp_replace(swapped, '[^0-9]', '', 'g') as digits from s)
    select id, raw, case when length(digits) = 8 then coalesce(strftime(try_strptime(digits, '%d%m%Y'), '%d.%m.%Y'), raw) else swapped end as fixed from n""",
)
def fix_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as id", f"{_DATES} as raw")
    return d.select("id", "raw", text.fix_date(F.col("raw")).alias("fixed"))


_FIELDS = "case p_partkey % 6 when 0 then 'Sex_en' when 1 then 'Driver_class' when 2 then 'Last_name_ru' when 3 then 'Birth_date' when 4 then 'Sex_ru' else 'Living_region_ru' end"


@query(
    "fix_errors",
    f"""with p as (select cast(p_partkey as bigint) as id, {_FIELDS} as field, case when p_partkey % 2 = 0 then 'cyr' else 'lat' end as engine,
      case when p_partkey % 3 = 0 then concat('..', p_type) else p_brand end as raw from part)
    select id, case when field = 'Birth_date' then case when engine = 'lat' or engine = 'cyr' then replace(replace(raw, 'O', '0'), '-', '.') end
      when engine = 'cyr' and field = 'Sex_ru' then 'Ж' when engine = 'cyr' and field = 'Last_name_ru' then ltrim(raw, '.')
      when engine = 'lat' and field = 'Sex_en' then case when contains(upper(replace(raw, '.', '')), 'M') then 'M' else 'F' end
      when engine = 'lat' and field = 'Driver_class' then regexp_replace(raw, '[^ABCDEM1]', '', 'g') else raw end as fixed from p""",
)
def fix_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as bigint) as id", f"{_FIELDS} as field", "case when p_partkey % 2 = 0 then 'cyr' else 'lat' end as engine",
        "case when p_partkey % 3 = 0 then concat('..', p_type) else p_brand end as raw",
    )
    return p.select("id", text.fix_errors(F.col("engine"), F.col("field"), F.col("raw")).alias("fixed"))


@query(
    "clean_ruler",
    r"""with t as (select doc_id, replace(replace(text, 'e ', ' . '), 'th', ',.-') as raw from documents),
    r as (select doc_id, regexp_replace(raw, '[.,_\-"]{2,}', ' ', 'g') as a from t)
    select doc_id, array_to_string(list_filter(regexp_split_to_array(a, '\s+'), lambda w: w <> '' and not regexp_full_match(w, '[.,_\-"]')), ' ') as cleaned from r""",
)
def clean_ruler(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.replace(F.replace("text", F.lit("e "), F.lit(" . ")), F.lit("th"), F.lit(",.-"))
    return d.select("doc_id", text.clean_ruler(raw).alias("cleaned"))


@query(
    "number_token",
    """with w as (select cast(p_partkey as bigint) as id, concat(substr(p_brand, 7), case when p_partkey % 3 = 0 then 'AB' else '' end) as lat, p_type as cyr from part),
    n as (select *, length(regexp_replace(lat, '[^0-9]', '', 'g')) as d, length(regexp_replace(lat, '[^A-Za-z]', '', 'g')) as l from w)
    select id, d >= 1 and d >= l as is_number, case when d >= 1 and d >= l then lat else cyr end as routed from n""",
)
def number_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as bigint) as id", "concat(substr(p_brand, 7), case when p_partkey % 3 = 0 then 'AB' else '' end) as lat", "p_type as cyr"
    )
    return w.select("id", text.is_number_token(F.col("lat")).alias("is_number"), text.route_address_word(F.col("lat"), F.col("cyr")).alias("routed"))


@query(
    "split_doc_type",
    with_roles(
        """ select distinct doc_type, case when contains(doc_type, '_') then regexp_replace(doc_type, '_[^_]*$', '') else doc_type end as base,
        case when contains(doc_type, '_') then regexp_extract(doc_type, '[^_]*$') end as era from log""",
        "log",
    ),
)
def split_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = role(spark, sf_dir, "log").select("doc_type").distinct()
    return t.select("doc_type", text.doc_base(F.col("doc_type")).alias("base"), text.doc_era(F.col("doc_type")).alias("era"))


_CROSS = "case id % 3 when 0 then 'SNILS' when 1 then 'DL' else 'INTPASSPORT' end"
_NAMES = "case id % 5 when 0 then 'Last_name_ru' when 1 then 'Birth_date' when 2 then 'Licence_number' when 3 then 'Last_name_en' else 'Face' end"


@query(
    "route_engine",
    with_roles(
        f""" , w as (select id, {_CROSS} as doc_type, {_NAMES} as field, id % 4 as pos from log)
        select id, case when (doc_type = 'SNILS' and pos % 2 = 1) or field in ('Last_name_ru') then 'cyr'
          when contains(lower(field), 'date') or field in ('Licence_number', 'Last_name_en') then 'lat' end as engine from w""",
        "log",
    ),
)
def route_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = role(spark, sf_dir, "log").selectExpr("id", f"{_CROSS} as doc_type", f"{_NAMES} as field", "id % 4 as pos")
    ru, en = F.col("field").isin("Last_name_ru"), F.col("field").isin("Licence_number", "Last_name_en")
    return w.select("id", text.route_engine(F.col("doc_type"), F.col("field"), F.col("pos"), ru, en).alias("engine"))


@query(
    "safe_filename",
    r"""with n as (select page_id, concat('dir\', case when page_id % 4 = 0 then 'a<b>:' when page_id % 4 = 1 then '' else url end) as raw from pages),
    b as (select page_id, regexp_extract(replace(raw, '\', '/'), '[^/]*$') as base from n),
    k as (select page_id, trim(left(regexp_replace(base, '[<>:"|?*]', '', 'g'), 200)) as kept from b)
    select page_id, case when length(kept) > 0 then kept else 'upload' end as name from k""",
)
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("dir\\"), F.when(F.col("page_id") % 4 == 0, "a<b>:").when(F.col("page_id") % 4 == 1, "").otherwise(F.col("url"))).alias("raw"),
    )
    return n.select("page_id", text.safe_filename(F.col("raw")).alias("name"))


@query(
    "search_text",
    with_roles(" select id, lower(concat(filename, ' ', doc_type, ' ', coalesce(case when id % 2 = 0 then status end, ''))) as haystack from log", "log"),
)
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = role(spark, sf_dir, "log")
    maybe = F.when(F.col("id") % 2 == 0, F.col("status"))
    return log.select("id", text.search_text(F.col("filename"), F.col("doc_type"), [maybe]).alias("haystack"))


@query(
    "wire_numbers",
    """select cast(c_custkey as bigint) as id, case when c_custkey % 7 = 0 then null else round_even(c_acctbal / 7, 4) end as v,
    case when c_custkey % 5 = 0 then 0.0 else round_even(1 - cast(c_custkey % 300 as double) / 512, 2) end as conf from customer""",
)
def wire_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    odd = F.when(F.col("c_custkey") % 14 == 0, float("nan")).when(F.col("c_custkey") % 7 == 0, float("inf")).otherwise(F.col("c_acctbal") / 7)
    limit = F.when(F.col("c_custkey") % 5 == 0, 0.0).otherwise(512.0)
    conf = text.type_confidence((F.col("c_custkey") % 300).cast("double"), limit)
    return c.select(F.col("c_custkey").cast("long").alias("id"), text.number(odd).alias("v"), conf.alias("conf"))


@query(
    "field_script",
    with_roles(
        f""" , w as (select id, {_NAMES} as field from log) select field, case when field in ('Licence_number', 'Birth_date') then 'num'
        when ends_with(field, '_ru') then 'ru' when ends_with(field, '_en') then 'en' else 'ru' end as script, count(*) as n from w group by all""",
        "log",
    ),
)
def field_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = role(spark, sf_dir, "log").selectExpr("id", f"{_NAMES} as field")
    return w.groupBy("field", text.script(F.col("field")).alias("script")).agg(F.count("*").alias("n"))


@query(
    "iso_timestamps",
    "select event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), case when strftime(ts, '%f') = '000000' then '' else concat('.', strftime(ts, '%f')) end, 'Z') as iso from events",
)
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.iso_utc(F.col("ts")).alias("iso"))


@query(
    "suspicious_values",
    """with t as (select cast(s_suppkey as bigint) as id, case s_suppkey % 4 when 0 then '.' when 1 then '..a.' when 2 then 'ab' else s_name end as v from supplier)
    select id, length(trim(v)) < 2 or length(regexp_replace(v, '[^A-Za-z0-9]', '', 'g')) < greatest(2.0, length(trim(v)) / 2.0) as odd from t""",
)
def suspicious_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as bigint) as id", "case s_suppkey % 4 when 0 then '.' when 1 then '..a.' when 2 then 'ab' else s_name end as v"
    )
    return t.select("id", text.suspicious(F.col("v")).alias("odd"))


@query(
    "job_progress",
    """select cast(event_id as bigint) as id, case when event_type = 'view' then least((event_id % 40) / 10.0 / greatest((event_id % 30) / 10.0, 0.05), 0.95)
      when event_type = 'click' then 0.0 else 1.0 end as share from events""",
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "click", "queued").otherwise("done")
    share = text.progress(status, (F.col("event_id") % 40) / 10, (F.col("event_id") % 30) / 10)
    return e.select(F.col("event_id").cast("long").alias("id"), share.cast("double").alias("share"))


def _digit_sql(payload: str) -> str:
    value = f"case when substr({payload}, i + 1, 1) = '<' then 0 else instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({payload}, i + 1, 1)) - 1 end"
    return f"(list_sum(list_transform(range(length({payload})), lambda i: ({value}) * (case i % 3 when 0 then 7 when 1 then 3 else 1 end))) % 10)"


@query("mrz_check_digit", with_roles(f" select id, cast({_digit_sql('line2')} as bigint) as digit from zones", "zones"))
def mrz_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = role(spark, sf_dir, "zones")
    return z.select("id", mrz.check_digit(F.col("line2")).cast("long").alias("digit"))


def _verdict_sql(first: int, last: int, at: int) -> str:
    payload, n = f"substr(line2, {first}, {last - first + 1})", last - first + 1
    return f"case when {payload} = '{'<' * n}' and substr(line2, {at}, 1) = '<' then 'not_applicable' when cast(cast({_digit_sql(payload)} as bigint) as varchar) = substr(line2, {at}, 1) then 'ok' else 'failed' end"


_FIT = "length(line2) = 44"
_COMPOSITE = "(substr(line2, 1, 10) || substr(line2, 14, 7) || substr(line2, 22, 22))"


@query(
    "mrz_validate",
    with_roles(
        ", v as (select id, line2, "
        + ", ".join(f"case when {_FIT} then {_verdict_sql(a, b, d)} end as {n}" for n, a, b, d in mrz.LINE2)
        + f", case when {_FIT} then case when cast(cast({_digit_sql(_COMPOSITE)} as bigint) as varchar) = substr(line2, 44, 1) then 'ok' else 'failed' end end as composite from zones) "
        "select id, case when length(line2) <> 44 then concat('line 2 malformed (len=', length(line2), ')') end as error, "
        "document_number, birth_date, expiry_date, personal_number, composite, "
        "length(line2) = 44 and document_number <> 'failed' and birth_date <> 'failed' and expiry_date <> 'failed' and personal_number <> 'failed' and composite <> 'failed' as ok from v",
        "zones",
    ),
)
def mrz_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = role(spark, sf_dir, "zones").select("id", F.concat_ws("\n", "line1", "line2").alias("zone"))
    out = z.select("id", mrz.validate(F.col("zone")).alias("v"))
    return out.select("id", "v.error", "v.document_number", "v.birth_date", "v.expiry_date", "v.personal_number", "v.composite", "v.ok")


def _date_sql(first: int, century: str) -> str:
    raw = f"substr(line2, {first}, 6)"
    return f"case when regexp_full_match({raw}, '[0-9]{{6}}') then strftime(try_strptime(concat({century}, {raw}), '%Y%m%d'), '%d.%m.%Y') end"


@query(
    "mrz_parse",
    with_roles(
        f""" , z as (select id, line1, case when length(line2) = 44 then line2 end as line2 from zones)
        select id, replace(substr(line1, 1, 2), '<', '') as document_type, substr(line1, 3, 3) as issuing_state,
        trim(replace(split_part(substr(line1, 6), '<<', 1), '<', ' ')) as surname, trim(replace(split_part(substr(line1, 6), '<<', 2), '<', ' ')) as given_names,
        nullif(replace(substr(line2, 1, 9), '<', ''), '') as document_number, {_date_sql(14, "case when substr(line2, 14, 2) <= '26' then '20' else '19' end")} as birth_date,
        case when substr(line2, 21, 1) in ('M', 'F') then substr(line2, 21, 1) end as sex, {_date_sql(22, "'20'")} as expiry_date,
        nullif(replace(substr(line2, 29, 14), '<', ''), '') as personal_number from z""",
        "zones",
    ),
)
def mrz_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = role(spark, sf_dir, "zones").select("id", F.concat_ws("\n", "line1", "line2").alias("zone"))
    names = "document_type issuing_state surname given_names document_number birth_date sex expiry_date personal_number".split()
    return z.select("id", mrz.parse(F.col("zone"), 2026).alias("p")).select("id", *[f"p.{n}" for n in names])


@query(
    "mrz_cross_check",
    with_roles(
        """ , z as (select id, case when length(line2) = 44 then nullif(replace(substr(line2, 1, 9), '<', ''), '') end as num,
          case when length(line2) = 44 and substr(line2, 21, 1) in ('M', 'F') then substr(line2, 21, 1) end as sex,
          trim(replace(split_part(substr(line1, 6), '<<', 1), '<', ' ')) as surname,
          concat(lpad(cast(id * 7919 % 1000000000 as varchar), 9, '0'), case when id % 6 = 0 then '9' else ' ' end) as printed,
          case when id % 5 = 0 then '' else 'm ' end as printed_sex, case when id % 2 = 0 then 'Smith Jones' end as printed_name from zones),
        c as (select id, case when num is not null then case when num = regexp_replace(printed, '[^0-9]', '', 'g') then 'ok' else 'mismatch' end end as document_number,
          case when sex is not null and printed_sex <> '' then case when sex = 'M' then 'ok' else 'mismatch' end end as sex,
          case when printed_name is not null then case when replace(surname, ' ', '') = 'SMITHJONES' then 'ok' else 'mismatch' end end as surname from z)
        select id, document_number, sex, surname, case when document_number is null and sex is null and surname is null then null
          else coalesce(document_number, 'ok') = 'ok' and coalesce(sex, 'ok') = 'ok' and coalesce(surname, 'ok') = 'ok' end as ok from c""",
        "zones",
    ),
)
def mrz_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = role(spark, sf_dir, "zones").select("id", F.concat_ws("\n", "line1", "line2").alias("zone"))
    parsed = z.select("id", mrz.parse(F.col("zone"), 2026).alias("p"))
    printed = {
        "Licence_number": F.expr("concat(lpad(cast(id * 7919 % 1000000000 as string), 9, '0'), case when id % 6 = 0 then '9' else ' ' end)"),
        "Sex_en": F.expr("case when id % 5 = 0 then '' else 'm ' end"),
        "Last_name_en": F.expr("case when id % 2 = 0 then 'Smith Jones' end"),
    }
    out = parsed.select("id", mrz.cross_check(F.col("p"), printed).alias("c"))
    return out.select("id", "c.document_number", "c.sex", "c.surname", "c.ok")
