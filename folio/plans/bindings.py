"""Driver tables seen as the roles that the operators work on.

Each role is written once, in SQL that Spark and DuckDB read alike: integer arithmetic and ASCII only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.session import table

LOG = """
select cast(o_orderkey as bigint) as id,
  concat('scan_', cast(o_orderkey as varchar(20)), '.jpg') as filename,
  case when o_orderkey % 7 = 0 then 'queued' when o_orderkey % 11 = 0 then 'processing'
       when o_orderkey % 5 = 0 then 'failed' else 'done' end as status,
  case o_orderkey % 6 when 0 then 'INTPASSPORT_2011' when 1 then 'DL_2020' when 2 then 'SNILS_1996'
       when 3 then 'EXTPASSPORTBIO_2007' when 4 then 'INTPASSPORTADDR_ALL' else 'NONE' end as doc_type,
  o_orderkey % 6 <> 5 as recognised,
  case when o_orderkey % 7 = 0 then null else cast(o_orderkey % 1000 as double) / 1000 end as doc_conf,
  case when o_orderkey % 7 = 0 then null else cast(o_orderkey * 37 % 5000 as bigint) end as processing_ms,
  lower(concat('scan_', cast(o_orderkey as varchar(20)), '.jpg ', o_orderpriority, ' ', o_orderstatus)) as search_text,
  o_orderdate as created_at
from orders
"""

BOXES = """
select cast(l_orderkey as bigint) as doc_id, cast((l_linenumber * 200003 + l_partkey) * 10007 + l_suppkey as bigint) as det_idx,
  cast(l_partkey % 500 as int) as x1, cast(l_suppkey * 13 % 400 as int) as y1,
  cast(l_partkey % 500 + 40 + cast(l_quantity as int) * 5 as int) as x2,
  cast(l_suppkey * 13 % 400 + 30 + l_partkey % 60 as int) as y2,
  cast(cast(l_quantity as int) * 19 % 100 as double) / 100 as conf,
  case l_returnflag when 'A' then 'Licence_number' when 'R' then 'Birth_place_ru' else 'Last_name_ru' end as label
from lineitem
"""

WORDS = """
select cast(conv_id as bigint) as doc_id, cast(turn as bigint) as pos,
  case when conv_id % 3 = 0 then 'MRZ' when conv_id % 3 = 1 then 'Issue_date' else 'Birth_place_ru' end as field,
  case when conv_id % 6 = 1 then cast(10 + turn as varchar(20))
       when turn % 4 = 3 and conv_id % 3 = 0 then ''
       else concat('W', cast(turn as varchar(20)), role) end as word
from conversations
"""

ZONES = """
select cast(c_custkey as bigint) as id,
  concat('P<UTO', case c_nationkey % 4 when 0 then 'ERIKSSON' when 1 then 'SMITH<JONES' when 2 then 'LEE' else 'O' end,
         '<<ANNA<MARIA') as line1,
  case when c_custkey % 17 = 0 then 'SHORT'
       else concat(lpad(cast(c_custkey * 7919 % 1000000000 as varchar(20)), 9, '0'), cast(c_custkey % 10 as varchar(20)), 'UTO',
         lpad(cast(c_custkey * 31 % 100 as varchar(20)), 2, '0'), lpad(cast(c_custkey % 13 as varchar(20)), 2, '0'),
         lpad(cast(c_custkey % 30 as varchar(20)), 2, '0'), cast(c_custkey % 7 as varchar(20)),
         case c_custkey % 3 when 0 then 'M' when 1 then 'F' else '<' end,
         case when c_custkey % 4 = 0 then '<<<<<<<' else concat(lpad(cast(c_custkey * 17 % 100 as varchar(20)), 2, '0'), '0615', cast(c_custkey % 9 as varchar(20))) end,
         rpad(concat('AB', cast(c_custkey as varchar(20))), 14, '<'), cast(c_custkey % 8 as varchar(20)), cast(c_custkey % 5 as varchar(20))) end as line2
from customer
"""

PAIRS = """
select cast(p.p_partkey as bigint) as doc_id, case p.p_partkey % 5 when 0 then 'Last_name_ru' when 1 then 'Birth_date' when 2 then 'Sex_ru' when 3 then 'Licence_number' else 'Birth_place_ru' end as field,
  case p.p_partkey % 3 when 0 then 'DL_2011' when 1 then 'SNILS_1996' else 'INTPASSPORT_2011' end as doctype,
  case when p.p_partkey % 11 = 0 then '' else concat(p.p_name, '  of ', p.p_type) end as truth,
  case when p.p_partkey % 4 = 0 then concat(p.p_name, ' of ', p.p_type) when p.p_partkey % 4 = 1 then concat('x', p.p_name, ' ', p.p_brand)
       when p.p_partkey % 4 = 2 then p.p_name else null end as predicted
from part p
"""

TIMINGS = """
select cast(event_id as bigint) as doc_id, event_type as stage, floor(value * 1000) as ms, ts,
  cast(user_id % 3 as int) as base, event_type = 'view' as concurrent, user_id
from events
"""

ROLES = {"log": LOG, "boxes": BOXES, "words": WORDS, "zones": ZONES, "pairs": PAIRS, "timings": TIMINGS}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The DataFrame of a role; its table is read by path and pruned like any other."""
    sql = ROLES[name]
    source = sql.rsplit("from ", 1)[1].split()[0]
    return spark.sql(sql.replace(f"from {source}", "from {source}"), source=table(spark, sf_dir, source))


def with_roles(sql: str, *names: str) -> str:
    """DuckDB SQL with the roles it names as common tables."""
    return "with " + ", ".join(f"{n} as ({ROLES[n]})" for n in names) + sql
