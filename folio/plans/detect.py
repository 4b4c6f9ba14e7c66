"""Queries on boxes, patches, embeddings and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import geometry
from folio.operators import classify, decode, detect, view
from folio.plans.bindings import role, with_roles
from folio.plans.registry import query
from folio.session import table

_BOX = "doc_id, det_idx, label"


@query("confidence_gate", with_roles(" select label, count(*) as n from boxes where conf > 0.5 group by label", "boxes"))
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.confident(role(spark, sf_dir, "boxes"), 0.5).groupBy("label").agg(F.count("*").alias("n"))


_IOU = """greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"""
_UNION = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU})"


@query(
    "iou_pairs",
    with_roles(
        f" select a.doc_id, a.det_idx as i, b.det_idx as j, case when {_UNION} > 0 then cast({_IOU} as double) / {_UNION} end as iou from boxes a join boxes b on a.doc_id = b.doc_id and a.det_idx < b.det_idx and a.label = b.label",
        "boxes",
    ),
)
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.overlaps(role(spark, sf_dir, "boxes"))


# Greedy suppression as recursion over a page's boxes in order of confidence: a list of those kept.
_NMS = """ , o as (select *, row_number() over (partition by doc_id, label order by conf desc, det_idx) as k from boxes),
 s as (select a.doc_id, a.label, a.k as ki, b.k as kj from o a join o b on a.doc_id = b.doc_id and a.label = b.label and a.k < b.k
   where cast({iou} as double) / {union} >= 0.2),
 r as (select doc_id, label, k, [k] as kept from o where k = 1 union all
   select o.doc_id, o.label, o.k, case when len(list_intersect(r.kept, coalesce((select list(s.ki) from s where s.doc_id = o.doc_id and s.label = o.label and s.kj = o.k), []))) > 0
     then r.kept else list_append(r.kept, o.k) end from r join o on o.doc_id = r.doc_id and o.label = r.label and o.k = r.k + 1),
 last as (select doc_id, label, arg_max(kept, k) as kept from r group by all)
 select o.doc_id, o.det_idx, o.label from o join last l on o.doc_id = l.doc_id and o.label = l.label and list_contains(l.kept, o.k)""".format(iou=_IOU, union=_UNION)


@query("nms_by_label", with_roles(_NMS, "boxes").replace("with boxes", "with recursive boxes"))
def nms_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.suppress(role(spark, sf_dir, "boxes"), 0.2).select("doc_id", "det_idx", "label")


@query(
    "dedup_fields",
    with_roles(
        f" select {_BOX} from (select *, row_number() over (partition by doc_id, label order by conf desc, det_idx) as k from boxes) where label <> 'Licence_number' or k = 1",
        "boxes",
    ),
)
def dedup_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.dedup_fields(role(spark, sf_dir, "boxes")).select(*_BOX.split(", "))


@query(
    "box_owners",
    with_roles(
        """ select doc_id, concat('b', row_number() over (partition by doc_id order by det_idx) - 1) as box_id,
        row_number() over (partition by doc_id, label order by conf desc, det_idx) = 1 as owns_text from boxes""",
        "boxes",
    ),
)
def box_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.numbered(detect.best_per_label(role(spark, sf_dir, "boxes"))).select("doc_id", "box_id", "owns_text")


@query("box_positions", with_roles(' select doc_id, det_idx, row_number() over (partition by doc_id order by y1, x1, det_idx) as "rank" from boxes', "boxes"))
def box_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.by_position(role(spark, sf_dir, "boxes")).select("doc_id", "det_idx", "rank")


@query(
    "band_order",
    with_roles(
        ' select doc_id, det_idx, row_number() over (partition by doc_id order by round_even((y1 + y2) / 2.0 / 10.0, 0), (x1 + x2) / 2.0, det_idx) as "rank" from boxes', "boxes"
    ),
)
def band_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.by_bands(role(spark, sf_dir, "boxes")).select("doc_id", "det_idx", "rank")


@query("middle_order", with_roles(' select doc_id, det_idx, row_number() over (partition by doc_id order by y1 + y2, det_idx) as "rank" from boxes', "boxes"))
def middle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.by_middle(role(spark, sf_dir, "boxes")).select("doc_id", "det_idx", "rank")


# Reading order as recursion over a page's boxes by height: the lines so far, and the line each box joins.
_READ = """ , o as (select *, (y1 + y2) / 2.0::double as m, cast(y2 - y1 as double) as h, row_number() over (partition by doc_id order by (y1 + y2) / 2.0::double, det_idx) as k from boxes),
 r as (select doc_id, det_idx, x1, k, 1::bigint as line, [{'y': m, 'h': h, 'n': 1.0::double}] as lines from o where k = 1 union all
   select doc_id, det_idx, x1, k, case when pos > 0 then pos else len(lines) + 1 end, case when pos > 0 then list_transform(lines, lambda l, i: case when i = pos then
     {'y': (l.y * l.n + m) / (l.n + 1), 'h': (l.h * l.n + h) / (l.n + 1), 'n': l.n + 1} else l end) else list_append(lines, {'y': m, 'h': h, 'n': 1.0::double}) end
   from (select o.doc_id, o.det_idx, o.x1, o.k, o.m, o.h, r.lines, coalesce(list_position(list_transform(r.lines, lambda l: abs(o.m - l.y) < 0.5::double * greatest(o.h, l.h)), true), 0)::bigint as pos
     from r join o on o.doc_id = r.doc_id and o.k = r.k + 1))
 select doc_id, det_idx, row_number() over (partition by doc_id order by line, x1, k) as "rank" from r"""


@query("reading_order", with_roles(_READ, "boxes").replace("with boxes", "with recursive boxes"))
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.reading_order(role(spark, sf_dir, "boxes")).select("doc_id", "det_idx", "rank")


@query(
    "second_pages",
    with_roles(
        """ , s as (select doc_id, det_idx, (x2 - x1) * (y2 - y1) as area from boxes)
        select doc_id, det_idx from (select *, max(area) over (partition by doc_id) as m, row_number() over (partition by doc_id order by area desc, det_idx) as k from s)
        where k <= 2 and area >= 0.6 * m""",
        "boxes",
    ),
)
def second_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = role(spark, sf_dir, "boxes").selectExpr("doc_id", "det_idx", "(x2 - x1) * (y2 - y1) as area")
    return detect.second_pages(s).select("doc_id", "det_idx")


@query(
    "letterbox",
    """with s as (select cast(p_partkey as bigint) as id, cast(300 + p_size * 17 as double) as h, cast(200 + p_partkey % 900 as double) as w from part),
    r as (select *, least(640.0::double / h, 640.0::double / w) as ratio from s), n as (select *, round_even(h * ratio, 0) as nh, round_even(w * ratio, 0) as nw from r)
    select id, cast(nh as bigint) as new_h, cast(nw as bigint) as new_w, cast(round_even((640 - nh) / 2 - 0.1::double, 0) as bigint) as top, cast(round_even((640 - nw) / 2 - 0.1::double, 0) as bigint) as "left",
    cast(round_even((640 - nh) / 2 + 0.1::double, 0) as bigint) as bottom, cast(round_even((640 - nw) / 2 + 0.1::double, 0) as bigint) as "right" from n""",
)
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) as id", "cast(300 + p_size * 17 as double) as h", "cast(200 + p_partkey % 900 as double) as w")
    made = geometry.letterbox(F.col("h"), F.col("w"), 640, 640)
    return s.select("id", *[made[c].cast("long").alias(c) for c in ("new_h", "new_w", "top", "bottom", "left", "right")])


@query(
    "rescale_boxes",
    with_roles(
        """ select doc_id, det_idx, cast(round_even(greatest((cast(x1 as double) - 20) / 0.75, 0), 0) as bigint) as x1, cast(round_even(greatest((cast(y1 as double) - 12) / 0.75, 0), 0) as bigint) as y1,
        cast(round_even(greatest((cast(x2 as double) - 20) / 0.75, 0), 0) as bigint) as x2, cast(round_even(greatest((cast(y2 as double) - 12) / 0.75, 0), 0) as bigint) as y2 from boxes""",
        "boxes",
    ),
)
def rescale_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = role(spark, sf_dir, "boxes")
    made = geometry.rescale([F.col(c).cast("double") for c in detect.CORNERS], F.lit(0.75), F.lit(20.0), F.lit(12.0))
    return b.select("doc_id", "det_idx", *[m.cast("long").alias(c) for m, c in zip(made, detect.CORNERS, strict=True)])


@query(
    "match_boxes",
    with_roles(
        f""" , f as (select * from boxes where det_idx % 2 = 1), t as (select doc_id, det_idx as idx, x1 + 4 as x1, y1 + 2 as y1, x2 + 4 as x2, y2 as y2 from boxes),
        m as (select t.doc_id, t.idx, coalesce(max(case when {_UNION.replace("a.", "f.").replace("b.", "t.")} > 0 then cast({_IOU.replace("a.", "f.").replace("b.", "t.")} as double) / {_UNION.replace("a.", "f.").replace("b.", "t.")} end), 0.0) as best
          from t left join f on f.doc_id = t.doc_id group by all)
        select doc_id, idx, best, best >= 0.8 as hit from m""",
        "boxes",
    ),
)
def match_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.operators.evaluate import matched

    b = role(spark, sf_dir, "boxes")
    truth = b.selectExpr("doc_id", "det_idx as idx", "x1 + 4 as x1", "y1 + 2 as y1", "x2 + 4 as x2", "y2")
    return matched(b.where("det_idx % 2 = 1"), truth, ["doc_id"])


_PATCH = """select cast(l_orderkey as bigint) as doc_id, {classes} as cls, cast(cast(l_quantity as int) as double) / 50 as conf from lineitem"""
_GLARE = _PATCH.format(classes="case l_returnflag when 'A' then 'GLARE' else 'CLEAR' end")
_BLUR = _PATCH.format(classes="case when l_linenumber % 7 = 0 then 'Other' when l_returnflag = 'A' then 'Blur5' when l_returnflag = 'R' then 'Blur10' else 'NonBlur' end")


@query(
    "glare_level",
    f"with p as ({_GLARE}), g as (select doc_id, round_even(avg(case when cls = 'GLARE' and conf > 0.85 then 1.0 else 0.0 end), 6) as level from p group by doc_id) select doc_id, level, case when level > 0 then 'bad' else 'good' end as verdict from g",
)
def glare_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_GLARE.replace("from lineitem", "from {l}"), l=table(spark, sf_dir, "lineitem"))
    return classify.glare_level(p)


@query(
    "blur_level",
    f"""with p as ({_BLUR}), w as (select doc_id, case cls when 'NonBlur' then 1.0 when 'Blur5' then 0.5 when 'Blur10' then 0.0 end as w from p),
    g as (select doc_id, coalesce(round_even(1 - avg(w), 6), 1.0) as level from w group by doc_id) select doc_id, level, case when level > 0.9 then 'good' else 'bad' end as verdict from g""",
)
def blur_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_BLUR.replace("from lineitem", "from {l}"), l=table(spark, sf_dir, "lineitem"))
    return classify.blur_level(p)


@query(
    "binary_gate",
    "select case when l_discount < 0.05 then 'printed' else 'handwritten' end as kind, case when l_tax < 0.04 then 'FAKE' else 'REAL' end as spoof, count(*) as n from lineitem group by all",
)
def binary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem")
    kind = classify.binary_label(F.col("l_discount"), 0.05, "printed", "handwritten")
    spoof = classify.binary_label(F.col("l_tax"), 0.04, "FAKE", "REAL")
    return p.groupBy(kind.alias("kind"), spoof.alias("spoof")).agg(F.count("*").alias("n"))


@query(
    "metric_classify",
    """with e as (select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) as n from embeddings),
    c as (select label, embedding as c, n as cn, row_number() over (order by label) - 1 as idx from e where vec_id in (select min(vec_id) from embeddings group by label)),
    d as (select e.vec_id, c.label as name, c.idx, round_even(1 - list_sum(list_transform(list_zip(e.embedding, c.c), lambda z: z[1]::double * z[2])) / (e.n * c.cn), 9) as d from e cross join c),
    b as (select vec_id, name, d from (select *, row_number() over (partition by vec_id order by d, idx) as k from d) where k = 1)
    select vec_id, case when d <= 1 and d < 0.6 then concat('class', name) else 'NONE' end as label from b""",
)
def metric_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).orderBy("label").collect()
    centroids = [(f"class{r['label']}", [float(x) for x in r["c"]], 0.6) for r in first]
    return classify.nearest_centroid(e, centroids, 1.0).select("vec_id", "label")


@query(
    "ctc_decode",
    """with s as (select vec_id, t, list_slice(embedding, t * 4 + 1, t * 4 + 4) as p from embeddings, range(16) r(t)),
    c as (select vec_id, t, list_position(p, list_max(p)) - 1 as k from s), l as (select *, lag(k, 1, -1) over (partition by vec_id order by t) as before from c)
    select vec_id, coalesce(string_agg(case when k <> before and k <> 0 then substr('ABC', k, 1) end, '' order by t), '') as text from l group by vec_id""",
)
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    matrix = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("embedding", t * 4 + 1, 4))
    return e.select("vec_id", decode.ctc_text(matrix, "ABC").alias("text"))


@query(
    "ctc_masked",
    """with s as (select vec_id, t, list_slice(embedding, t * 4 + 1, t * 4 + 4) as p from embeddings, range(16) r(t)),
    c as (select vec_id, t, case when list_position(p, list_max(p)) in (1, 2, 3) then list_position(p, list_max(p)) - 1 when p[2] >= p[3] then 1 else 2 end as k from s),
    l as (select *, lag(k, 1, -1) over (partition by vec_id order by t) as before from c)
    select vec_id, coalesce(string_agg(case when k <> before and k <> 0 then substr('ABC', k, 1) end, '' order by t), '') as text from l group by vec_id""",
)
def ctc_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    matrix = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("embedding", t * 4 + 1, 4))
    return e.select("vec_id", decode.ctc_text(matrix, "ABC", allowed=[1, 2]).alias("text"))


@query(
    "join_field",
    with_roles(
        """ , j as (select doc_id, field, string_agg(nullif(word, ''), chr(10) order by pos) as lines, string_agg(word, ' ' order by pos) as spaced, string_agg(word, '.' order by pos) as dotted,
          bool_or(regexp_matches(word, '[A-Za-z]')) as worded from words group by doc_id, field)
        select doc_id, field, case when field = 'MRZ' then coalesce(lines, '') when field = 'Issue_date' then trim(replace(case when worded then spaced else dotted end, '  ', ' ')) else trim(replace(spaced, '  ', ' ')) end as text from j""",
        "words",
    ),
)
def join_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.join_words(role(spark, sf_dir, "words"))


@query(
    "address_concat",
    """with l as (select conv_id as doc_id, turn as pos, case when turn % 4 = 2 then 'handwritten' else 'printed' end as kind, concat('line', turn) as text from conversations)
    select doc_id, string_agg(case when kind = 'handwritten' then '[handwritten]' else text end, chr(10) order by pos) as address, bool_or(kind = 'handwritten') as has_handwritten from l group by doc_id""",
)
def address_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 4 == 2, "handwritten").otherwise("printed")
    lines = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), kind.alias("kind"), F.concat(F.lit("line"), F.col("turn").cast("string")).alias("text"))
    return decode.join_address(lines)


_TYPES = "case doc_id % 3 when 0 then 'DL_2011' when 1 then 'SNILS_1996' else 'OTHER' end"


@query(
    "order_fields",
    with_roles(
        f""" , f as (select distinct doc_id, {_TYPES} as doc_type, label as name from boxes),
        k as (select *, case when doc_type = 'OTHER' then null when name = 'Last_name_ru' then 1 when name = 'Birth_place_ru' then 2 else 3 end as known from f)
        select doc_id, name, row_number() over (partition by doc_id order by known asc nulls last, name) as ord from k""",
        "boxes",
    ),
)
def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = role(spark, sf_dir, "boxes").selectExpr("doc_id", f"{_TYPES} as doc_type", "label as name").distinct()
    return view.order_fields(f).select("doc_id", "name", "ord")


@query(
    "view_model",
    with_roles(
        f""" , n as (select *, row_number() over (partition by doc_id order by det_idx) - 1 as b, row_number() over (partition by doc_id, label order by conf desc, det_idx) as k from boxes),
        d as (select doc_id, {_TYPES} as doc_type, count(*) as n_boxes, count(*) filter (where k > 1 and label <> 'Last_name_ru') as n_ambiguous,
          string_agg(case when k = 1 and label <> 'Last_name_ru' then concat('b', b) end, ',' order by b) as owners from n group by doc_id)
        select doc_id, doc_type, split_part(doc_type, '_', 1) as base, n_boxes, n_ambiguous, coalesce(owners, '') as owners,
        (select count(distinct label) from boxes x where x.doc_id = d.doc_id and x.label <> 'Last_name_ru') as n_fields from d""",
        "boxes",
    ),
)
def view_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = role(spark, sf_dir, "boxes")
    docs = boxes.selectExpr("doc_id", f"{_TYPES} as doc_type", "'cpu' as device", "640 as canvas_w", "480 as canvas_h").distinct()
    ocr = boxes.where("label <> 'Last_name_ru'").select("doc_id", F.col("label").alias("field"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("text")).distinct()
    v = view.view_model(docs, boxes, ocr)
    owners = F.filter("view.boxes", lambda b: b["text"].isNotNull())
    return v.select(
        "doc_id", "view.doc_type", F.col("view.doc_type_base").alias("base"), F.size("view.boxes").cast("long").alias("n_boxes"),
        F.size(F.filter("view.boxes", lambda b: b["ambiguous"])).cast("long").alias("n_ambiguous"),
        F.array_join(F.transform(owners, lambda b: b["id"]), ",").alias("owners"),
        F.when(F.col("view.fields").isNull(), 0).otherwise(F.size("view.fields")).cast("long").alias("n_fields"),
    )


@query(
    "polygons",
    """with p as (select cast(s_suppkey as bigint) as id, cast(s_suppkey % 37 as double) as a, cast(s_suppkey % 23 + 5 as double) as b from supplier)
    select id, b * (b + a) as area, a + b / 2 as cx, (a + b) / 2 as cy, a as reach from p""",
)
def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) as id", "cast(s_suppkey % 37 as double) as a", "cast(s_suppkey % 23 + 5 as double) as b")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    box = F.array(point(a, zero), point(a + b, zero), point(a + b, a + b), point(a, a + b))
    moved = F.array(point(a + a, zero), point(a + b + a, zero), point(a + b + a, a + b), point(a + a, a + b))
    centre = geometry.polygon_centroid(box)
    reach = geometry.hausdorff(box, moved)
    return p.select("id", geometry.polygon_area(box).alias("area"), F.bround(centre["x"], 9).alias("cx"), F.bround(centre["y"], 9).alias("cy"), reach.alias("reach"))
