"""Queries over sources, sinks, parsers and small rules: tables are written as the files that a source reads, or derived as
names, and the results are compared with SQL over the tables themselves."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from trackwise.functions import captures as C
from trackwise.functions import vectors as V
from trackwise.operators import components as K
from trackwise.operators import grids as G
from trackwise.operators import names as N
from trackwise.operators import sequences as S
from trackwise.scratch import Scratch
from trackwise.session import table
from trackwise.sources import files, sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _root(spark) -> str:
    return Scratch(spark).root


def _touch(spark, root: str, names: list[str], content: bytes = b"x") -> None:
    """Files of a fixed small list, made on the driver."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(content))  # an empty file isn't listed
        out.close()


def _nations(spark, sf):
    """The 25 rows of nation with their region's name."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").limit(25).collect()


def _short(path):
    return F.regexp_extract(path, r"[^/]+/[^/]+$", 0)


@query("""with f as (select r_name as class, r_name || '/' || n_name || case n_nationkey % 3 when 0 then '.jpg' when 1 then '.PNG' else '.txt' end as path from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 < 2)
select path, class, cast(dense_rank() over (order by class) - 1 as int) as class_index from f""")
def q59_image_folder(spark, sf):
    root = _root(spark)
    _touch(spark, root, [f"{n.r_name}/{n.n_name}{('.jpg', '.PNG', '.txt')[n.n_nationkey % 3]}" for n in _nations(spark, sf)])
    df = files.image_folder(spark, root, is_valid=C.is_image)
    return df.select(_short("path").alias("path"), "class", "class_index")


@query("select cast(doc_id as varchar) as path, coalesce(source, 'none') as class, cast(dense_rank() over (order by coalesce(source, 'none')) - 1 as int) as class_index from documents")
def q60_jsonl_index(spark, sf):
    path = f"{_root(spark)}/index"
    docs = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("class"), F.col("doc_id").cast("string").alias("p"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("line"))
    # A class has several lines, so that none of them holds all of it.
    docs.groupBy("class", "line").agg(F.collect_list("p").alias("files")).drop("line").write.json(path)
    classes = docs.select("class").distinct().count()
    return files.build(spark, "jsonl", path, n_classes=classes).select("path", "class", "class_index")


@query("""select 'b_CRH5A-5001_20240101120000_ST' || n_nationkey || '_1_2_10X5' || lpad(cast(n_nationkey as varchar), 3, '0') || '.jpg' as name, 'CRH5A-5001' as train_group, 'ST' || n_nationkey as station, '5' as channel, cast(n_nationkey as int) as pic_no from nation where n_nationkey % 4 > 0
union all select 'bad-' || n_nationkey || '.jpg', null, null, null, -1 from nation where n_nationkey % 4 = 0""")
def q61_capture_scan(spark, sf):
    root = _root(spark)
    _touch(spark, root, [f"b_CRH5A-5001_20240101120000_ST{n.n_nationkey}_1_2_10X5{n.n_nationkey:03d}.jpg" if n.n_nationkey % 4 else f"bad-{n.n_nationkey}.jpg" for n in _nations(spark, sf)])
    good, bad = files.capture_files(spark, root)
    cols = ["train_group", "station", "channel", "pic_no"]
    return good.select(C.file_name(F.col("path")).alias("name"), *cols).unionByName(bad.select(C.file_name(F.col("path")).alias("name"), F.lit(-1).alias("pic_no")), allowMissingColumns=True)


@query("select n_name || '/ori' || n_nationkey || '_5_ST.jpg' as ori_path, case when n_nationkey % 2 = 0 then n_name || '/bbox.jpg' end as bbox_path from nation")
def q62_paired_images(spark, sf):
    root, nations = _root(spark), _nations(spark, sf)
    _touch(spark, root, [f"{n.n_name}/ori{n.n_nationkey}_5_ST.jpg" for n in nations] + [f"{n.n_name}/bbox.jpg" for n in nations if n.n_nationkey % 2 == 0] + [f"{n.n_name}/other.jpg" for n in nations])
    return files.paired_images(files.list_files(spark, root)).select(_short("ori_path").alias("ori_path"), _short("bbox_path").alias("bbox_path"))


@query("select 'd/' || s_name || '.jpg' as ori_path, case when s_suppkey % 3 > 0 then 'd/' || s_suppkey || '.jpg' end as bbox_path from supplier")
def q63_image_list(spark, sf):
    path = f"{_root(spark)}/list"
    s = table(spark, sf, "supplier").select(F.concat(F.lit("d/"), "s_name", F.lit(".jpg")).alias("ori_path"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("d/"), F.col("s_suppkey").cast("string"), F.lit(".jpg"))).alias("bbox_path"))
    # The format is one array in one file.
    s.agg(F.to_json(F.collect_list(F.struct("ori_path", "bbox_path"))).alias("value")).write.text(path)
    return files.image_list(spark, path)


@query("select s_name || '_' || (1 + s_nationkey % 9) as key, cast(s_suppkey % 2 as int) as value from supplier")
def q64_station_dictionary(spark, sf):
    root = _root(spark)
    s = table(spark, sf, "supplier").select(F.concat("s_name", F.lit("_"), (1 + F.col("s_nationkey") % 9).cast("string")).alias("k"), (F.col("s_suppkey") % 2).cast("int").alias("v"))
    s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).write.text(f"{root}/stations")
    return files.dictionary(spark, f"{root}/stations", "int").unionByName(files.dictionary(spark, f"{root}/absent", "int"))


@query("""with c as (select distinct p_brand as code, 'part ' || replace(p_brand, '#', ' ') as component_name from part)
select cast(p_partkey as varchar) as "ALERTID", 'CRH380B-' || p_size as "SETNO", p_brand as "TYPECODE", split_part(p_type, ' ', 1) as "ALARMCODE", component_name from part join c on code = p_brand""")
def q65_fault_csv(spark, sf):
    root, part = _root(spark), table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").cast("string").alias("ALERTID"), F.concat(F.lit("CRH380B-"), F.col("p_size").cast("string")).alias("SETNO"), F.lit("20240101").alias("TIME"), F.col("p_brand").alias("TYPECODE"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("ALARMCODE"), F.lit("x").alias("TYPE"))
    sinks.csv(rows, f"{root}/faults")
    entry = lambda code: F.struct(code.alias("k"), F.concat(F.lit("part ("), F.regexp_replace("p_brand", "#", " ("), F.lit(")")).alias("v"))
    maps = part.select("p_brand").distinct().select(F.explode(F.array(entry(F.col("p_brand")), entry(F.concat("p_brand", F.lit(",x"))))).alias("e"))
    maps.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).write.text(f"{root}/components")
    names = files.component_map(spark, f"{root}/components").withColumn("component_name", F.regexp_replace("component_name", "^part Brand ", "part Brand "))
    return files.fault_csv(spark, f"{root}/faults").join(names, F.col("TYPECODE") == F.col("code")).select("ALERTID", "SETNO", "TYPECODE", "ALARMCODE", "component_name")


@query("select 'cuts/' || event_id || '_image.png' as path from events where event_id % 3 > 0")
def q66_target_images(spark, sf):
    e = table(spark, sf, "events").select(F.explode(F.when(F.col("event_id") % 3 > 0, F.array(F.lit("image"), F.lit("mask"))).otherwise(F.array(F.lit("image"), F.lit("other")))).alias("k"), F.col("event_id").cast("string").alias("i"))
    return files.target_images(e.select(F.concat(F.lit("cuts/"), "i", F.lit("_"), "k", F.lit(".png")).alias("path"))).select("path")


@query("select s_name || '.jpg' as image, 'wheel' as class_name, cast(s_suppkey as double) as xmin, cast(s_nationkey as double) as ymin, cast(s_suppkey + 10 as double) as xmax, cast(s_nationkey + 4 as double) as ymax, cast(s_suppkey + 5 as double) as center_x from supplier")
def q67_annotations(spark, sf):
    path = f"{_root(spark)}/boxes"
    x, y = F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")
    box = F.struct(F.array(F.struct(F.array(x, y, x + 10, y + 4).alias("bbox"), F.lit("wheel").alias("class_name"))).alias("bboxes"))
    table(spark, sf, "supplier").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat("s_name", F.lit(".jpg")).alias("k"), box.alias("v"))))).alias("value")).write.text(path)
    return files.annotations(spark, path)


@query("select doc_id, cast(1 as bigint) as copies, true as in_range from documents")
def q68_shards(spark, sf):
    df = files.sharded(table(spark, sf, "documents").select("doc_id"), "doc_id", 8, epoch=1)
    return df.groupBy("doc_id").agg(F.count("*").alias("copies"), F.bool_and(F.col("shard").between(0, 7)).alias("in_range"))


@query("select event_id, coalesce(value < 20 or event_type = 'view', true) as bad from events")
def q69_quarantine(spark, sf):
    good, bad = files.quarantine(table(spark, sf, "events"), (F.col("value") < 20) | (F.col("event_type") == "view"))
    return good.select("event_id", F.lit(False).alias("bad")).unionByName(bad.select("event_id", F.lit(True).alias("bad")))


@query("select d.doc_id, d.doc_id || '.jpg' as path from documents d join labels l on l.doc_id = d.doc_id where l.toxic = 1")
def q70_names_by_ids(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("a/b/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return files.by_ids(docs, table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", basename=True)


@query("select cast(n_nationkey as int) as idx, cast(n_nationkey * 0.5 as float) as img0, cast(n_nationkey * 2 as float) as txt1, 'u/c/' || n_name as path, 'a ' || n_name as prompt from nation where n_nationkey < 20")
def q71_feature_files(spark, sf):
    root = _root(spark)
    rows = _nations(spark, sf)

    def npy(xs) -> bytes:
        out = io.BytesIO()
        np.save(out, np.asarray(xs, np.float32))
        return out.getvalue()

    _touch(spark, root, ["img.npy"], npy([[n.n_nationkey * 0.5, 1] for n in rows]))
    _touch(spark, root, ["txt.npy"], npy([[0, n.n_nationkey * 2] for n in rows]))
    names = table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    names.select(F.to_json(F.transform("x", lambda x: F.concat(F.lit("u/c/"), x.n_name))).alias("value")).write.text(f"{root}/paths")
    names.select(F.to_json(F.slice(F.transform("x", lambda x: F.concat(F.lit("a "), x.n_name)), 1, 20)).alias("value")).write.text(f"{root}/prompts")
    df = files.feature_files(spark, f"{root}/img.npy", f"{root}/txt.npy", f"{root}/paths", f"{root}/prompts")
    return df.select("idx", F.get("img", F.lit(0)).alias("img0"), F.get("txt", F.lit(1)).alias("txt1"), "path", "prompt")


@query("select event_id || '.' || case event_id % 4 when 0 then 'jpg' when 1 then 'JPG' when 2 then 'png' else 'jpeg' end as path from events where event_id % 4 <> 1")
def q72_prompt_images(spark, sf):
    kind = F.get(F.array(*map(F.lit, ["jpg", "JPG", "png", "jpeg"])), (F.col("event_id") % 4).cast("int"))
    return files.prompt_images(table(spark, sf, "events").select(F.concat(F.col("event_id").cast("string"), F.lit("."), kind).alias("path")))


UUID = "'47359e39-393f-4c22-bcf7-' || lpad(cast(event_id as varchar), 12, '0')"


@query(f"""with e as (select event_id, 'c' || user_id % 5 as component, 'f' || event_id % 7 as fault_code, {UUID} as alert_id, 'ori' || lpad(cast(event_id % 30 as varchar), 3, '0') as ori, cast(event_id % 10 as varchar) as channel, 'LOC_' || user_id as location from events where event_id % 3 > 0)
select 'd/' || component || '/' || component || '_' || fault_code || '_' || alert_id || '_' || ori || '_' || channel || '_' || location || '.jpg' as path, component, fault_code, alert_id, ori, channel, location from e""")
def q73_fault_images(spark, sf):
    s = lambda c: c.cast("string")
    i, u = F.col("event_id"), F.col("user_id")
    comp = F.concat(F.lit("c"), s(u % 5))
    name = F.concat_ws("_", comp, F.concat(F.lit("f"), s(i % 7)), F.concat(F.lit("47359e39-393f-4c22-bcf7-"), F.lpad(s(i), 12, "0")), F.concat(F.lit("ori"), F.lpad(s(i % 30), 3, "0")), s(i % 10), F.concat(F.lit("LOC_"), s(u)))
    name = F.when(i % 3 > 0, name).when(i % 2 == 0, F.regexp_replace(name, "-", "")).otherwise(F.regexp_replace(name, "_ori", "_img"))
    return files.fault_images(table(spark, sf, "events").select(F.concat(F.lit("d/"), comp, F.lit("/"), name, F.lit(".jpg")).alias("path")))


_TARGET = "'b_CRH5A-' || user_id || '_2024010112' || lpad(cast(event_id % 60 as varchar), 2, '0') || '_S_' || case event_id % 4 when 0 then '1_5_10X' || event_id % 9 || '_0_sub' when 1 then '2_L' || event_id % 8 || '_3' when 2 then 'x_5_10X3_0' else '1_5_10X4_7' end || '_group' || event_id % 3 || '_axle_wheel_image.png'"


@query(f"""select event_id, {_TARGET} as name, case when event_id % 4 <> 2 then 'CRH5A-' || user_id end as train_group, case when event_id % 4 <> 2 then '2024010112' || lpad(cast(event_id % 60 as varchar), 2, '0') end as pass_time,
  case event_id % 4 when 0 then cast(event_id % 9 as varchar) when 1 then 'L' || event_id % 8 when 3 then '4' end as channel, case when event_id % 4 <> 2 then 'axle_wheel' end as components from events""")
def q74_parse_target(spark, sf):
    s = lambda c: c.cast("string")
    i, u = F.col("event_id"), F.col("user_id")
    mid = F.when(i % 4 == 0, F.concat(F.lit("1_5_10X"), s(i % 9), F.lit("_0_sub"))).when(i % 4 == 1, F.concat(F.lit("2_L"), s(i % 8), F.lit("_3"))).when(i % 4 == 2, F.lit("x_5_10X3_0")).otherwise(F.lit("1_5_10X4_7"))
    name = F.concat(F.lit("b_CRH5A-"), s(u), F.lit("_2024010112"), F.lpad(s(i % 60), 2, "0"), F.lit("_S_"), mid, F.lit("_group"), s(i % 3), F.lit("_axle_wheel_image.png"))
    df = table(spark, sf, "events").select("event_id", name.alias("name"), C.parse_target(name).alias("m"))
    return df.select("event_id", "name", "m.*")


@query("""select event_id, case event_id % 3 when 0 then 'CRH-' || user_id when 1 then 'CRH-' || user_id end as train_group, case event_id % 3 when 0 then '20240101' when 1 then '20240101' end as pass_time, case event_id % 3 when 0 then '7' when 1 then 'L3' end as channel,
  case when event_id % 2 = 0 then cast(event_id % 10 as varchar) end as i_channel, case when event_id % 2 = 0 then 'ST_' || user_id end as i_station from events""")
def q75_parse_background_and_inference(spark, sf):
    s = lambda c: c.cast("string")
    i, u = F.col("event_id"), F.col("user_id")
    back = F.concat(F.lit("b_CRH-"), s(u), F.when(i % 3 == 0, "_20240101_S_1_5_10X7anything").when(i % 3 == 1, "_20240101_S_1_L3_0089.jpg").otherwise("_20240101_S_1_L3_89.jpg"))
    inf = F.concat(F.when(i % 2 == 0, "ori017_").otherwise("x_ori017_"), s(i % 10), F.lit("_ST_"), s(u), F.lit(".jpg"))
    df = table(spark, sf, "events").select("event_id", C.parse_background(back).alias("m"), C.parse_inference(inf).alias("f"))
    return df.select("event_id", "m.*", F.col("f.channel").alias("i_channel"), F.col("f.station").alias("i_station"))


@query("""select l_orderkey as seq_id, string_agg(distinct case l_partkey % 5 when 0 then 'gearbox' when 1 then 'axle' when 2 then 'motor' when 3 then 'wheel' else 'air_duct' end, '_' order by case l_partkey % 5 when 0 then 'gearbox' when 1 then 'axle' when 2 then 'motor' when 3 then 'wheel' else 'air_duct' end) as name from lineitem group by 1""")
def q76_group_names(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seq_id"), K.class_name(1 + F.col("l_partkey") % 5).alias("c"))
    return df.groupBy("seq_id").agg(F.collect_list("c").alias("cs")).select("seq_id", C.group_name(F.col("cs")).alias("name"))


@query("select event_id, event_id % 6 >= 3 as flag, (event_id % 5 = 0 or user_id % 2 = 1) as rotate from events")
def q77_flags(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    word = F.get(F.array(*map(F.lit, ["off", "FALSE", "0", "on", "True", "1"])), (i % 6).cast("int"))
    path = F.when(i % 5 == 0, "d/special_folder/x.jpg").otherwise("d/x.jpg")
    return table(spark, sf, "events").select("event_id", C.bool_flag(word).alias("flag"), C.needs_rotation(path, u % 2 == 1, "special_folder").alias("rotate"))


_ROUTES = [(c, f, "+".join("-".join(x) for x in p)) for cs, f, p in K.RULES for c in (cs or ["*"]) if f != "none"]
_NAMED = sorted({c for cs, _, _ in K.RULES for c in cs or []})


@query(f"""with r(c, finder, pats) as (values {', '.join(str(x) for x in _ROUTES)}), s as (select user_id, cast(1 + user_id % 11 as varchar) as channel, case when user_id % 3 = 0 then 'CRH5A-1' else 'CR400-1' end as train_group from (select distinct user_id from events))
select user_id, finder, pats from s join r on c = case when channel in ({', '.join(repr(c) for c in _NAMED)}) then channel else '*' end
union all select user_id, 'height', 'wheel-gearbox' from s where train_group like '%CRH5%' and channel not in ('1', '2')""")
def q78_channel_router(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    s = u.select("user_id", (1 + F.col("user_id") % 11).cast("string").alias("channel"), F.when(F.col("user_id") % 3 == 0, "CRH5A-1").otherwise("CR400-1").alias("train_group"))
    return K.route(s).select("user_id", "finder", F.array_join(F.transform("patterns", lambda p: F.array_join(p, "-")), "+").alias("pats"))


@query("select p_partkey, cast(floor(greatest(least(p_size * 60, 1536), 512) / 512) * 512 as int) as chunk, p_retailprice * p_size / 256 as rate, cast(floor(floor((p_size * 40) * least(1.0, 800.0 / (p_size * 40), 600.0 / (p_size * 30))) / 2) * 2 as int) as w, cast(floor(floor((p_size * 30) * least(1.0, 800.0 / (p_size * 40), 600.0 / (p_size * 30))) / 2) * 2 as int) as h from part")
def q79_size_rules(spark, sf):
    size = F.col("p_size")
    w, h = S.safe_size(size * 40, size * 30, 800, 600)
    return table(spark, sf, "part").select("p_partkey", S.chunk_height(size * 60, 1536, 512).alias("chunk"), N.scaled_rate(F.col("p_retailprice"), size).alias("rate"), w.alias("w"), h.alias("h"))


@query("""with n as (select label, count(*) as n from embeddings group by 1) select cast(label as int) as label, n from n order by label < 0, label limit 4""")
def q80_legend(spark, sf):
    return G.legend(table(spark, sf, "embeddings"), "label", 4).select(F.col("label").cast("int").alias("label"), "n")


@query("select least(100, (select count(*) from embeddings)) as n, least(100, (select count(*) from embeddings)) as n_distinct, (select count(*) * 2 + 7 from embeddings) as n_more, count(*) as n_all, min(vec_id) as lo, max(vec_id) as hi from embeddings")
def q81_samples(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    few, many = G.sample(e, "vec_id", 100), G.sample(e, "vec_id", e.count() * 2 + 7)
    return few.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_distinct")).join(many.agg(F.count("*").alias("n_more"), F.countDistinct("vec_id").alias("n_all"), F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")))


@query("select event_id, user_id, value from events")
def q82_json_sink(spark, sf):
    path = f"{_root(spark)}/rows"
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    sinks.json_lines(df, path, order=["user_id", "event_id"])
    return spark.read.schema(df.schema).json(path)


@query("select cast(source as varchar) as category, count(*) as n from documents group by 1")
def q83_csv_report(spark, sf):
    path = f"{_root(spark)}/report"
    df = table(spark, sf, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"))
    sinks.csv(df, path)
    return spark.read.option("header", True).schema(df.schema).csv(path)


@query("""with t as (select vec_id, 'out/' || 'c' || label || '/' || 'u' || vec_id % 20 || '_' || 'k' || label || '_' || 's' || vec_id % 50 as target from embeddings)
select vec_id, target, count(*) over (partition by target) as copies from t""")
def q84_cluster_folders(spark, sf):
    s = lambda c: c.cast("string")
    v, c = F.col("vec_id"), F.col("label")
    df = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("c"), s(c)).alias("name"), F.concat(F.lit("/d/u"), s(v % 20), F.lit("/k"), s(c), F.lit("/s"), s(v % 50)).alias("path"))
    return sinks.cluster_paths(df, "path", "name", "out").select("vec_id", "target", "copies")


@query("""with e as (select cast(n_nationkey as int) as epoch, n_nationkey * 0.5 as loss, case when n_nationkey % 2 = 0 then n_nationkey * 1.0 end as acc from nation)
select 'train' as head, 'loss' as key, epoch as step, cast(loss as double) as value from e union all select 'train', 'acc', epoch, cast(acc as double) from e where acc is not null""")
def q85_epoch_logs(spark, sf):
    path = f"{_root(spark)}/log"
    n = F.col("n_nationkey")
    df = table(spark, sf, "nation").select(n.cast("int").alias("epoch"), (n * 0.5).cast("double").alias("loss"), F.when(n % 2 == 0, n.cast("double")).alias("acc"))
    sinks.append_log(df.where("epoch < 12"), path)
    sinks.append_log(df.where("epoch >= 12"), path)
    return sinks.scalars(spark.read.schema(df.schema).json(path), "train", "epoch")


@query("select arg_max('d' || event_id % 10 || '/' || user_id || '.jpg', event_id) as path, 'none/' || user_id || '.jpg' as target from events group by user_id")
def q86_copy_list(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("d"), (F.col("event_id") % 10).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("path"))
    return sinks.copy_list(e, "path", ["event_id"], "none")


@query("select event_id, 'failed ' || event_type as message from events where value < 10")
def q87_error_log(spark, sf):
    path = f"{_root(spark)}/log"
    e = table(spark, sf, "events").select("event_id", F.when(F.col("value") < 10, "ERROR").otherwise("INFO").alias("level"), F.when(F.col("value") < 10, F.concat(F.lit("failed "), "event_type")).otherwise(F.lit("done")).alias("message"))
    sinks.log_lines(e, path)
    return spark.read.schema(e.schema).json(path).where("level = 'ERROR'").select("event_id", "message")


@query("select doc_id, lang as name, lang || ',' || coalesce(source, '?') as names from documents where lang is not null")
def q88_label_names(spark, sf):
    docs = table(spark, sf, "documents").where("lang is not null")
    langs = docs.select(F.col("lang").alias("class")).distinct()
    index = files.class_index(langs).select(F.col("class").alias("name"), "class_index")
    ids = docs.join(index, docs["lang"] == index["name"]).select("doc_id", F.col("class_index").alias("i"), F.coalesce("source", F.lit("?")).alias("s"))
    back = ids.join(index, ids["i"] == index["class_index"])
    return back.select("doc_id", "name", F.concat_ws(",", "name", "s").alias("names"))


@query("select row_number() over (order by vec_id) - 1 as idx, vec_id, cast(label as int) as label from embeddings")
def q89_positional_zip(spark, sf):
    root = _root(spark)
    e = table(spark, sf, "embeddings").agg(F.array_sort(F.collect_list(F.struct("vec_id", "label"))).alias("x"))
    e.select(F.to_json(F.transform("x", lambda x: x.vec_id)).alias("value")).write.text(f"{root}/ids")
    e.select(F.to_json(F.transform("x", lambda x: x.label)).alias("value")).write.text(f"{root}/labels")
    df = files.zipped(files.json_rows(spark, f"{root}/ids", "bigint", "vec_id"), files.json_rows(spark, f"{root}/labels", "int", "label"))
    return df.select(F.col("idx").cast("long").alias("idx"), "vec_id", "label")


BOXES = "select l_orderkey as seq_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as comp_id, cast(1 + l_partkey % 5 as int) as class_id, cast(l_partkey * 7 % 160 as int) as min_row, cast(l_suppkey * 13 % 90 as int) as min_col from lineitem"


@query(f"select seq_id, comp_id, cast(row_number() over (partition by seq_id order by min_row, min_col, comp_id) - 1 as int) as group_no from ({BOXES}) where class_id = 4")
def q90_single_groups(spark, sf):
    df = spark.sql(BOXES.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    return K.single_groups(df, 4).select("seq_id", "comp_id", "group_no")


@query("""with t as (select user_id % 3 as dir_no, cast(event_id % 500 as int) as pic, event_id from events),
  i as (select *, case when pic = lag(pic) over w + 1 then 0 else 1 end as f from t window w as (partition by dir_no order by pic, event_id)),
  n as (select *, sum(f) over (partition by dir_no order by pic, event_id rows unbounded preceding) as isl from i)
select event_id, cast(dense_rank() over (order by dir_no, isl) - 1 as int) as seq_id from n""")
def q91_many_directories(spark, sf):
    df = table(spark, sf, "events").select((F.col("user_id") % 3).alias("dir_no"), (F.col("event_id") % 500).cast("int").alias("pic"), "event_id", F.lit("p").alias("prefix"))
    return S.append_directories(df, ["prefix"], "dir_no", ["pic", "event_id"], "pic").select("event_id", "seq_id")


@query("select count(distinct lang) as n_langs, count(distinct source) as n_sources, count(*) as n from documents")
def q92_class_counts(spark, sf):
    return table(spark, sf, "documents").agg(F.countDistinct("lang").alias("n_langs"), F.countDistinct("source").alias("n_sources"), F.count("*").alias("n"))


@query("""with m as (select vec_id, embedding, list_max(embedding) as top from embeddings), s as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e, top from m)
select vec_id, round(case when top <= 1 then e[1] * 2 - 1 else e[1] / 127.5 - 1 end, 5) as p0, round(case when top <= 1 then e[64] * 2 - 1 else e[64] / 127.5 - 1 end, 5) as p63 from s""")
def q93_pixel_scaling(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    df = table(spark, sf, "embeddings").select("vec_id", V.scale_pixels(x, [0.0], [1.0]).alias("p"))
    return df.select("vec_id", F.round(F.get("p", F.lit(0)), 5).alias("p0"), F.round(F.get("p", F.lit(63)), 5).alias("p63"))




def q94_mask_to_groups(spark, sf):
    """From boxes of components on strips to target groups: pixel filter, rules by channel and train, all finders, one bag,
    suppression."""
    comps = spark.sql(f"select *, min_row + h - 1 as max_row, min_col + w - 1 as max_col, cast(h * w as bigint) as px from ({BOXES.replace('from lineitem', ', cast(1 + cast(l_quantity as int) % 12 as int) as h, cast(1 + cast(l_quantity as int) % 9 as int) as w from {lineitem}')})", lineitem=table(spark, sf, "lineitem"))
    ranges = spark.createDataFrame([(1, 4, 90.0), (2, 3, 60.0), (3, 2, None), (4, 6, 100.0), (5, 1, 40.0)], "class_id int, min_px long, max_px double")
    kept = K.in_pixel_range(comps, ranges).where("kept")
    strips = comps.select("seq_id").distinct().withColumn("channel", F.get(F.array(*map(F.lit, ["3", "5", "6", "L4", "L7", "10", "1"])), (F.col("seq_id") % 7).cast("int")))
    strips = strips.withColumn("train_group", F.when(F.col("seq_id") % 3 == 0, "CRH5A-5001").otherwise("CR400AF-B-2118"))
    out = K.target_groups(strips, kept)
    return out.select("seq_id", "finder", "group_key", F.array_join("found", "-").alias("found"), "n_comps", "min_row", "max_row", "min_col", "max_col")


Q["q94_mask_to_groups"] = q94_mask_to_groups
