"""Queries over captures, prompts, sequences and components, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackwise.functions import captures as C
from trackwise.operators import components as K
from trackwise.operators import prompts as P
from trackwise.operators import reports as R
from trackwise.operators import sequences as S
from trackwise.plans import inputs as I
from trackwise.session import table

SPARK = {"{fmt}": "date_format(ts, 'yyyyMMddHHmmss')", "{div_event}": "event_id div 40"}
DUCK = {"{fmt}": "strftime(ts, '%Y%m%d%H%M%S')", "{div_event}": "event_id // 40"}
TABLES = ("events", "lineitem", "orders", "part", "embeddings", "documents", "conversations", "pages")


def _text(sql: str, dialect: dict, duck: bool) -> str:
    sql = sql.replace("{captures}", I.CAPTURES)
    for k, v in dialect.items():
        sql = sql.replace(k, v)
    if duck:
        for t in TABLES:
            sql = sql.replace("{" + t + "}", t)
    return sql


def derive(spark, sf_dir: str, sql: str):
    """A derived table in Spark."""
    text = _text(sql, SPARK, False)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def duck(sql: str) -> str:
    return _text(sql, DUCK, True)


CAPT, NAMES, COMPS, PIX = duck(I.CAPTURES), duck(I.NAMES), duck(I.COMPONENTS), duck(I.PIXELS)
HOUR = "try_cast(substr(pass_time, 9, 2) as int)"
TIME_WORD = f"case when {HOUR} >= 5 and {HOUR} < 12 then 'in the morning' when {HOUR} >= 12 and {HOUR} < 17 then 'in the afternoon' when {HOUR} >= 17 and {HOUR} < 21 then 'in the evening' when {HOUR} is null then 'during the daytime' else 'at night' end"
POSITION = "case channel " + " ".join(f"when '{k}' then '{v}'" for k, v in C.POSITIONS.items()) + " else 'an unknown position' end"
LOCATION = "case when channel in ('5','6','7','8','9','L3','L4','L5','L6','L7') then 'undercarriage' else 'side' end"
TYPE = "case when strpos(train_group, '-') > 0 then regexp_replace(train_group, '-[^-]*$', '') else train_group end"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""select event_id, bureau, train_group, pass_time, station, row_name, car_seq, channel, pic_no,
  bureau || '_' || train_group || '_' || pass_time || '_' || station || '_' || row_name || '_' || car_seq || '_10X' || channel as prefix, '10X' as fmt,
  {TIME_WORD} as time_word, {POSITION} as position, {LOCATION} as location, {TYPE} as train_type from ({CAPT})""")
def q01_parse_10x(spark, sf):
    m = derive(spark, sf, I.NAMES).select("event_id", C.parse_capture(F.col("name")).alias("m")).select("event_id", "m.*").withColumnRenamed("row", "row_name")
    return m.withColumns({"time_word": C.time_word(F.col("pass_time")), "position": C.position(F.col("channel")), "location": C.location(F.col("channel")), "train_type": C.train_type(F.col("train_group"))})


ROTATION = [(f"ST{s}_{c}", v) for s, c, v in [(0, 1, 1), (0, 5, 0), (0, 7, 1), (1, 1, 0), (1, 5, 1), (2, 5, 1), (2, 6, 0), (3, 1, 1), (3, 9, 1), (4, 8, 0), (5, 5, 0), (5, 8, 1), (6, 1, 1)]]


@query(f"""with r(k, v) as (values {', '.join(str(x) for x in ROTATION)}), c as ({CAPT})
select event_id, station, channel, coalesce(a.v, b.v, 0) = 1 as rotate from c
left join r a on a.k = station || '_' || case when channel in ('1','2','3','4') then '1' else channel end
left join r b on b.k = station || '_5' and channel in ('5','6','7','8','9')""")
def q02_rotation_lookup(spark, sf):
    exact, fallback = C.rotation_keys(F.col("channel"), F.col("station"))
    r = spark.createDataFrame(ROTATION, "k string, v int")
    df = derive(spark, sf, I.CAPTURES).withColumn("ke", exact).withColumn("kf", fallback)
    df = df.join(r.select(F.col("k").alias("ke"), F.col("v").alias("ve")), "ke", "left").join(r.select(F.col("k").alias("kf"), F.col("v").alias("vf")), "kf", "left")
    return df.select("event_id", "station", "channel", (F.coalesce("ve", "vf", F.lit(0)) == 1).alias("rotate"))


PARTS = ["axle_gearbox_wheel", "gearbox_motor", "wheel", "air_duct_wheel"]
PART_CASE = "case user_id % 4 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PARTS)) + " end"
CODES = [("Brand#", "generic"), ("Brand#1", "bogie"), ("Brand#12", "axle box"), ("Brand#4", "coupler"), ("Brand#45", "brake disc")]
ALARMS = [("ECONOMY", "hot box"), ("PROMO", "loose bolt"), ("SMALL", "oil leak")]
FAULTS = "select cast(p_partkey as string) as alert_id, 'imgs/' || cast(p_partkey as string) || '_' || cast(n as string) || '.jpg' as path, cast(1 + (p_partkey + n) % 9 as string) as channel from {part}, (values (0), (1)) v(n) where n <= p_partkey % 2"
RECORDS = "select cast(p_partkey as string) as ALERTID, 'CRH380B-' || cast(p_partkey % 50 as string) as SETNO, '20240101' || lpad(cast(p_partkey % 24 as string), 2, '0') || '0000' as TIME, p_brand as TYPECODE, split_part(p_type, ' ', 1) as ALARMCODE from {part} where p_partkey % 5 <> 0"
_PROMPT = "'A photo of a train''s ' || " + LOCATION + " || ', showing ' || {c} || ' at the ' || " + POSITION + " || ' of a ' || " + TYPE + " || ' train ' || " + TIME_WORD + " || '.'"
_WORDS = f"""case when channel in ('1','2','3','4','8','9') then case when {PART_CASE} like '%wheel%' then 'wheel' else '' end
  when {TYPE} like 'CRH5%' and channel = '5' and {PART_CASE} = 'axle_gearbox_wheel' then 'gearbox wheel' else replace({PART_CASE}, '_', ' ') end"""


@query(f"""with c as ({CAPT}), d(code, name) as (values {', '.join(str(x) for x in CODES)}), a(alarm, english) as (values {', '.join(str(x) for x in ALARMS)}),
  g as (select alert_id, string_agg(path, ',' order by path) as path, arg_min(channel, path) as channel from ({duck(FAULTS)}) group by 1),
  f as (select g.*, SETNO as train_group, TIME as pass_time, english, (select arg_max(name, length(code)) from d where starts_with(TYPECODE, code)) as comp from g join ({duck(RECORDS)}) r on r.ALERTID = alert_id left join a on alarm = ALARMCODE)
select 'target' as kind, cast(event_id as string) as path, {_PROMPT.replace('{c}', _WORDS)} as prompt from c where event_id % 3 = 0 and {_WORDS} <> ''
union all select 'background', cast(event_id as string), 'A background view from the ' || {POSITION} || ' of a ' || {TYPE} || ' train''s ' || {LOCATION} || ' ' || {TIME_WORD} || ', with no key components visible.' from c where event_id % 3 = 1
union all select 'manual', cast(event_id as string), {_PROMPT.replace('{c}', "'brake disc'")} from c where event_id % 3 = 2
union all select 'fault', path, 'A photo of a train''s ' || {LOCATION} || ' showing a "' || coalesce(english, 'an unspecified issue') || '" fault on a ' || coalesce(comp, 'unknown component') || ', viewed from the ' || {POSITION} || ' of a ' || {TYPE} || ' train ' || {TIME_WORD} || '.' from f""")
def q03_prompt_union(spark, sf):
    c = derive(spark, sf, I.CAPTURES).withColumn("path", F.col("event_id").cast("string"))
    parts = F.get(F.array(*map(F.lit, PARTS)), (F.col("user_id") % 4).cast("int"))
    target = P.target_prompts(c.where("event_id % 3 = 0").withColumn("components", parts))
    back = P.background_prompts(c.where("event_id % 3 = 1"))
    manual = P.manual_prompts(c.where("event_id % 3 = 2").withColumn("folder", F.lit("brake_disc")))
    codes, alarms = spark.createDataFrame(CODES, "code string, component_name string"), spark.createDataFrame(ALARMS, "alarm string, english string")
    fault = P.fault_prompts(derive(spark, sf, FAULTS), derive(spark, sf, RECORDS), codes, alarms).select(F.array_join("images", ",").alias("path"), "prompt")
    out = None
    for kind, df in (("target", target), ("background", back), ("manual", manual), ("fault", fault)):
        df = df.select(F.lit(kind).alias("kind"), "path", "prompt")
        out = df if out is None else out.unionByName(df)
    return out


@query(f"""with d(code, name) as (values {', '.join(str(x) for x in CODES)})
select p_partkey, p_brand, coalesce((select arg_max(name, length(code)) from d where starts_with(p_brand, code)), 'unknown component') as component from part""")
def q04_longest_prefix(spark, sf):
    return P.longest_prefix(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", spark.createDataFrame(CODES, "code string, name string"), "code", "name")


SEQ = "select train_group, station, channel, pic_no, event_id from ({captures}) c"


@query(f"""with t as (select *, case when pic_no = lag(pic_no) over w + 1 then 0 else 1 end as f from ({duck(SEQ)}) window w as (partition by train_group, station, channel order by pic_no, event_id))
select train_group, station, channel, pic_no, event_id, cast(sum(f) over (partition by train_group, station, channel order by pic_no, event_id rows unbounded preceding) - 1 as bigint) as seq_no from t""")
def q05_islands(spark, sf):
    return S.islands(derive(spark, sf, SEQ), ["train_group", "station", "channel"], ["pic_no", "event_id"], "pic_no")


@query(f"""with t as (select train_group, channel, event_id, row_number() over (partition by train_group, station, channel order by pic_no, event_id) - 1 as p, count(*) over (partition by train_group, station, channel) as n from ({duck(SEQ)}))
select train_group, channel, event_id, cast(p as int) as pos, cast(case when n > 50 then p // 15 else -1 end as int) as sub_no from t""")
def q06_subsequence(spark, sf):
    df = S.split_long(derive(spark, sf, SEQ), ["train_group", "station", "channel"], ["pic_no", "event_id"])
    return df.select("train_group", "channel", "event_id", "pos", F.coalesce("sub_no", F.lit(-1)).alias("sub_no"))


@query(f"""with t as (select *, case when min_row > max(max_row) over (partition by seq_id, class_id order by min_row, comp_id rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as f from ({COMPS}))
select seq_id, class_id, comp_id, cast(sum(f) over (partition by seq_id, class_id order by min_row, comp_id rows unbounded preceding) as bigint) as group_no from t""")
def q07_interval_merge(spark, sf):
    df = derive(spark, sf, I.COMPONENTS).withColumn("comp_id", F.col("comp_id").cast("long"))
    return S.merge_intervals(df, ["seq_id", "class_id"], "min_row", "max_row", 1, ties=["comp_id"]).select("seq_id", "class_id", "comp_id", "group_no")


@query(f"""with i as (select seq_id, comp_id, sum(h + 5) over w as y1, h + 5 as hh from ({COMPS}) window w as (partition by seq_id order by comp_id rows unbounded preceding)),
  t as (select seq_id, min_row as t0, max_row as t1 from ({COMPS}) where class_id = 4)
select seq_id, cast(comp_id as bigint) as comp_id, cast(y1 - hh as bigint) as y0, cast(y1 as bigint) as y1 from i where not exists (select 1 from t where t.seq_id = i.seq_id and greatest(i.y1 - hh, t0) < least(i.y1, t1))""")
def q08_offsets_no_target(spark, sf):
    c = derive(spark, sf, I.COMPONENTS).withColumn("comp_id", F.col("comp_id").cast("long")).withColumn("hh", F.col("h") + 5)
    images = S.running_offsets(c.select("seq_id", "comp_id", "hh"), ["seq_id"], ["comp_id"], "hh")
    targets = c.where("class_id = 4").select("seq_id", F.col("min_row").alias("t0"), F.col("max_row").alias("t1"))
    return S.images_without_target(images, targets, "seq_id").select("seq_id", "comp_id", F.col("y0").cast("long").alias("y0"), F.col("y1").cast("long").alias("y1"))


_WHEELS = f"""c as ({COMPS}), f as (select *, case when min_row > max(max_row) over (partition by seq_id order by min_row, comp_id rows between unbounded preceding and 1 preceding) + 30 then 1 else 0 end as f from c where class_id = 4),
  n as (select *, sum(f) over (partition by seq_id order by min_row, comp_id rows unbounded preceding) as group_no from f),
  a as (select seq_id, group_no, min(min_row) as lo, max(max_row) as hi from n group by 1, 2),
  m as (select a.seq_id, group_no, c.comp_id, c.class_id, c.min_row, c.max_row, c.min_col, c.max_col from a join c using (seq_id) where greatest(lo, c.min_row) <= least(hi, c.max_row) + 30),
  g as (select seq_id, group_no, bool_or(class_id = 2) as axle, count(*) as n_comps, min(min_row) as min_row, max(max_row) as max_row, min(min_col) as min_col, max(max_col) as max_col from m group by 1, 2)"""


@query(f"with {_WHEELS} select seq_id, cast(group_no as bigint) as group_no, n_comps, min_row, max_row, min_col, max_col from g where axle")
def q09_height_groups(spark, sf):
    g = K.with_pattern(K.height_groups(derive(spark, sf, I.COMPONENTS), 4), K.HEIGHT_567, ["seq_id", "group_no"])
    return g.select("seq_id", "group_no", "n_comps", "min_row", "max_row", "min_col", "max_col")


RANGES = [(1, 3, 60), (2, 2, 40), (3, 4, 80), (4, 5, 50), (5, 1, None)]


@query(f"""with r(class_id, lo, hi) as (values (1, 3, 60), (2, 2, 40), (3, 4, 80), (4, 5, 50), (5, 1, null)),
  c as (select seq_id, class_id, px, px >= lo * k and (hi is null or px <= hi * k) as kept from (select *, case when seq_id % 2 = 0 then 5 else 1 end as k from ({COMPS})) x join r using (class_id))
select seq_id, class_id, count(*) as n_before, count(*) filter (where kept) as n_after, cast(sum(px) as bigint) as px_before, cast(coalesce(sum(px) filter (where kept), 0) as bigint) as px_after from c group by 1, 2""")
def q10_validate_components(spark, sf):
    ranges = spark.createDataFrame(RANGES, "class_id int, min_px long, max_px long")
    return K.class_pixels(K.in_pixel_range(derive(spark, sf, I.COMPONENTS), ranges, F.col("seq_id") % 2 == 0))


_GAP = "greatest(0, b.min_{k} - a.max_{k}, a.min_{k} - b.max_{k})"
_D2 = f"({_GAP.format(k='row')} * {_GAP.format(k='row')} + {_GAP.format(k='col')} * {_GAP.format(k='col')})"


@query(f"with c as ({COMPS}) select a.seq_id, a.comp_id as a, b.comp_id as b, cast({_D2} as int) as d2 from c a join c b on a.seq_id = b.seq_id and a.comp_id < b.comp_id where {_D2} <= 900")
def q11_distance_edges(spark, sf):
    df = derive(spark, sf, I.COMPONENTS).withColumn("comp_id", F.col("comp_id").cast("long"))
    return K.box_pairs(df, 30)


@query(f"""with recursive p as ({PIX}), r as (select seq_id, class_id, row, min(col) as s, max(col) as e from (select *, col - row_number() over (partition by seq_id, class_id, row order by col) as g from p) group by seq_id, class_id, row, g),
  n as (select *, cast(row as bigint) * 1000000 + s as id from r),
  e as (select a.seq_id, a.class_id, a.id as x, b.id as y from n a join n b on a.seq_id = b.seq_id and a.class_id = b.class_id and abs(a.row - b.row) = 1 and b.s <= a.e + 1 and b.e >= a.s - 1),
  reach as (select seq_id, class_id, id as x, id as y from n union select reach.seq_id, reach.class_id, reach.x, e.y from reach join e on e.seq_id = reach.seq_id and e.class_id = reach.class_id and e.x = reach.y),
  l as (select seq_id, class_id, x as id, min(y) as comp_id from reach group by 1, 2, 3)
select seq_id, class_id, comp_id, min(row) as min_row, max(row) as max_row, min(s) as min_col, max(e) as max_col, cast(sum(e - s + 1) as bigint) as px,
  cast(floor(sum(row * (e - s + 1)) / sum(e - s + 1)) as bigint) as c_row, cast(floor(sum((s + e) * (e - s + 1) / 2.0) / sum(e - s + 1)) as bigint) as c_col from n join l using (seq_id, class_id, id) group by 1, 2, 3""")
def q12_connected_components(spark, sf):
    runs = K.pixel_runs(derive(spark, sf, I.PIXELS))
    return K.describe_components(K.label_runs(runs))


@query(f"""with recursive c as ({COMPS}),
  f as (select *, case when min_row > max(max_row) over (partition by seq_id order by min_row, comp_id rows between unbounded preceding and 1 preceding) + 5 then 1 else 0 end as f from c where class_id = 4),
  w as (select seq_id, comp_id, sum(f) over (partition by seq_id order by min_row, comp_id rows unbounded preceding) as g from f),
  e as (select a.seq_id, a.comp_id as x, b.comp_id as y from c a join c b on a.seq_id = b.seq_id and a.comp_id <> b.comp_id where {_D2} <= 25
    union select a.seq_id, a.comp_id, b.comp_id from w a join w b on a.seq_id = b.seq_id and a.g = b.g and a.comp_id <> b.comp_id),
  reach as (select seq_id, comp_id as x, comp_id as y from c union select reach.seq_id, reach.x, e.y from reach join e on e.seq_id = reach.seq_id and e.x = reach.y),
  l as (select reach.seq_id, x as comp_id, min(g) as group_no from reach join w on w.seq_id = reach.seq_id and w.comp_id = reach.y group by 1, 2),
  g as (select seq_id, group_no, bool_or(class_id = 4) and bool_or(class_id = 1) as ok, count(*) as n_comps, min(min_row) as min_row, max(max_row) as max_row, min(min_col) as min_col, max(max_col) as max_col from c join l using (seq_id, comp_id) group by 1, 2)
select seq_id, cast(group_no as bigint) as group_no, n_comps, min_row, max_row, min_col, max_col from g where ok""")
def q13_target_groups(spark, sf):
    c = derive(spark, sf, I.COMPONENTS).withColumn("comp_id", F.col("comp_id").cast("long"))
    g = K.with_pattern(K.connected_groups(c, K.box_pairs(c, 5), 4, 5), [["wheel", "gearbox"]], ["seq_id", "group_no"])
    return g.select("seq_id", "group_no", "n_comps", "min_row", "max_row", "min_col", "max_col")


@query(f"""with recursive o as (select seq_id, comp_id, row_number() over (partition by seq_id order by -(1 + class_id % 3), comp_id) as r, struct_pack(a := cast(min_row as double), b := cast(max_row as double), c := cast(min_col as double), d := cast(max_col as double)) as x from ({COMPS})),
  s as (select seq_id, 0 as r, cast([] as struct(a double, b double, c double, d double)[]) as kept, cast(null as bigint) as comp_id from o group by seq_id
    union all select s.seq_id, s.r + 1, case when q.hit then s.kept else list_append(s.kept, o.x) end, case when q.hit then null else o.comp_id end from s join o on o.seq_id = s.seq_id and o.r = s.r + 1,
      lateral (select len(list_filter(s.kept, lambda k: coalesce(greatest(0, least(k.b, o.x.b) - greatest(k.a, o.x.a)) * greatest(0, least(k.d, o.x.d) - greatest(k.c, o.x.c)) /
        nullif((k.b - k.a) * (k.d - k.c) + (o.x.b - o.x.a) * (o.x.d - o.x.c) - greatest(0, least(k.b, o.x.b) - greatest(k.a, o.x.a)) * greatest(0, least(k.d, o.x.d) - greatest(k.c, o.x.c)), 0), 0) > 0.1)) > 0 as hit) q)
select seq_id, comp_id from s where comp_id is not null""")
def q14_iou_suppression(spark, sf):
    g = derive(spark, sf, I.COMPONENTS).withColumn("comp_id", F.col("comp_id").cast("long")).withColumn("n_comps", 1 + F.col("class_id") % 3)
    return K.suppress_overlaps(g, "seq_id", "comp_id")


@query(f"with {_WHEELS} select seq_id, cast(group_no as bigint) as group_no, greatest(0, min_row - 10) as cut_y0, least(150, max_row + 11) as cut_y1 from g where axle")
def q15_crop_boxes(spark, sf):
    g = K.with_pattern(K.height_groups(derive(spark, sf, I.COMPONENTS), 4), K.HEIGHT_567, ["seq_id", "group_no"]).withColumn("height", F.lit(150))
    return K.crop_boxes(g, "height").select("seq_id", "group_no", "cut_y0", "cut_y1")


@query("""with o as (select o_orderkey, 600 + o_orderkey % 3000 as height from orders)
select o_orderkey, cast(height as bigint) as height, cast(n as int) as win_no, cast(n * 448 as bigint) as y0, cast(least(height, n * 448 + 512) as bigint) as y1
from o, lateral unnest(range(0, cast(greatest(ceil((height - 512) / 448.0), 0) as bigint) + 1)) u(n)""")
def q16_windows(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (600 + F.col("o_orderkey") % 3000).alias("height"))
    return S.plan_windows(df, "height", 512, 64)


@query("""with o as (select o_orderkey, 20 + o_orderkey % 60 as height from orders),
  w as (select o_orderkey, height, n, n * 12 as y0, least(height, n * 12 + 16) as y1 from o, lateral unnest(range(0, cast(greatest(ceil((height - 16) / 12.0), 0) as bigint) + 1)) u(n)),
  p as (select o_orderkey, y, (o_orderkey + n) % 6 as c, least(4, (y1 - y0) // 2) as f, height, y0, y1 from w, lateral unnest(range(y0, y1)) u(y)),
  v as (select o_orderkey, y, c, least(case when y0 > 0 then least((y - y0 + 1) / f, 1.0) else 1.0 end, case when y1 < height then least((y1 - y) / f, 1.0) else 1.0 end) as k from p)
select o_orderkey, cast(y as bigint) as y, cast(round_even(round(sum(k * c) / sum(k), 9), 0) as int) as class_id from v group by 1, 2""")
def q17_blend_windows(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (20 + F.col("o_orderkey") % 60).alias("height"))
    w = S.plan_windows(df, "height", 16, 4)
    runs = w.select("o_orderkey", "win_no", F.col("y0").alias("r0"), (F.col("y1") - 1).alias("r1"), ((F.col("o_orderkey") + F.col("win_no")) % 6).alias("class_id"))
    return S.blend_windows(runs, w, "o_orderkey", 4)


@query("""with b as (select event_id, user_id, value, min(case when value >= 40 then event_id end) over (partition by user_id) as a, max(case when value >= 40 then event_id end) over (partition by user_id) as z from events)
select event_id, user_id, value from b where event_id between a and z""")
def q18_blank_trim(spark, sf):
    return S.trim_blank(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value", 40.0)


@query("""with t as (select event_id, event_type, ts, value from events)
select event_id, round(list_sort(list(value) over r)[(len(list(value) over r) + 1) // 2], 6) as win_median, round(avg(value) over r + 1e-9, 6) as win_avg, round(max(value) over r, 6) as win_max, round(value, 6) as win_last,
  round(avg(value) over (partition by event_type order by ts, event_id rows unbounded preceding) + 1e-9, 6) as global_avg from t window r as (partition by event_type order by ts, event_id rows between 19 preceding and current row)""")
def q31_rolling_metrics(spark, sf):
    df = S.rolling(table(spark, sf, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value")
    return df.select("event_id", *[F.round(F.col(c) + (1e-9 if c.endswith("avg") else 0.0), 6).alias(c) for c in ("win_median", "win_avg", "win_max", "win_last", "global_avg")])


@query("select conv_id, turn, role, text from (select *, row_number() over (partition by role || cast(conv_id % 50 as string) order by conv_id desc, turn desc) as r from conversations) where r = 1")
def q33_dedupe_last(spark, sf):
    df = table(spark, sf, "conversations").withColumn("k", F.concat("role", (F.col("conv_id") % 50).cast("string")))
    return R.last_per_key(df, "k", ["conv_id", "turn"]).select("conv_id", "turn", "role", "text")


@query("""select step, round(case when step < 20 then 0.0 + 0.001 * step / 19 else 0.00001 + 0.5 * (0.001 - 0.00001) * (1 + cos(3.141592653589793 * (step - 20) / 180)) end, 12) as value from range(200) t(step)""")
def q34_cosine_schedule(spark, sf):
    return S.cosine_schedule(spark, 0.001, 0.00001, 10, 20, warmup_epochs=1).select("step", F.round("value", 12).alias("value"))


UUIDS = "substr(md5(cast(page_id as string)), 1, 8) || '-' || substr(md5(cast(page_id as string)), 9, 4) || '-' || substr(md5(cast(page_id as string)), 13, 4) || '-' || substr(md5(cast(page_id as string)), 17, 4) || '-' || substr(md5(cast(page_id as string)), 21, 12)"
PATHS = f"select page_id, case page_id % 4 when 0 then '/d/unit' || cast(page_id % 9 as string) || '/cat' || cast(page_id % 5 as string) || '/' || {UUIDS} || '/x.jpg' when 1 then 'cat' || cast(page_id % 5 as string) || '/' || {UUIDS} when 2 then {UUIDS} || '/x.jpg' else '/d/none/x.jpg' end as path from {{pages}}"


@query(f"""select page_id, case when page_id % 4 = 3 then 'unknown_fault_' || page_id else {UUIDS} end as alert_id, case when page_id % 4 < 2 then 'cat' || page_id % 5 else 'unknown_category' end as category, case when page_id % 4 = 0 then 'unit' || page_id % 9 else 'unknown_unit' end as unit from pages""")
def q35_path_metadata(spark, sf):
    return derive(spark, sf, PATHS).select("page_id", C.fault_path(F.col("path"), F.col("page_id")).alias("m")).select("page_id", "m.*")


@query("select conv_id, count(*) as n_images, string_agg(role || '/' || lpad(cast(turn as string), 4, '0'), ',' order by role || '/' || lpad(cast(turn as string), 4, '0')) as images, arg_min(cast(1 + turn % 9 as string), role || '/' || lpad(cast(turn as string), 4, '0')) as channel from conversations group by 1")
def q36_fault_groups(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", F.concat("role", F.lit("/"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("path"), (1 + F.col("turn") % 9).cast("string").alias("channel"))
    g = R.grouped_images(df, "conv_id", "path", "channel")
    return g.select("conv_id", F.size("images").cast("long").alias("n_images"), F.array_join("images", ",").alias("images"), "channel")
