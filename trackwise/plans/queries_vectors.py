"""Queries over feature vectors, codebooks, clusters and reports, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackwise.functions import vectors as V
from trackwise.operators import reports as R
from trackwise.operators import vectors as M
from trackwise.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Image features: embedding times a row factor; text features: its reversal times another.
E_SQL = "select vec_id, label, list_transform(embedding, lambda x: cast(x as double) * (1 + vec_id % 3)) as img, list_transform(list_reverse(embedding), lambda x: cast(x as double) * (1 + vec_id % 5)) as txt, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings"
N = lambda a: f"sqrt(list_dot_product({a}, {a}))"
D2 = "(select sum((x - y) * (x - y)) from (select unnest({a}) as x, unnest({b}) as y))"
CODES = 16
PROBE = [0, 7, 64, 100]


def features(spark, sf):
    df = table(spark, sf, "embeddings")
    return df.select("vec_id", "label", V.scale(F.col("embedding"), 1 + F.col("vec_id") % 3).alias("img"), V.scale(F.reverse("embedding"), 1 + F.col("vec_id") % 5).alias("txt"), V.doubles(F.col("embedding")).alias("vec"))


def probes(df, vec: str, places=PROBE, digits: int = 6):
    """A few rounded places of a vector as columns, and its norm."""
    return df.withColumns({**{f"x{i}": F.round(F.get(vec, F.lit(i)), digits) for i in places}, "len": F.size(vec).cast("long"), "norm": F.round(V.norm(F.col(vec)), digits)}).drop(vec)


def _probe_sql(vec: str, places=PROBE) -> str:
    return ", ".join(f"round({vec}[{i + 1}], 6) as x{i}" for i in places) + f", cast(len({vec}) as bigint) as len, round({N(vec)}, 6) as norm"


@query(f"""with e as ({E_SQL}), f as (select vec_id, list_concat(list_transform(img, lambda x: x / ({N('img')} + 1e-8)), list_transform(txt, lambda x: 1.5 * x / ({N('txt')} + 1e-8))) as v from e) select vec_id, {_probe_sql('v')} from f""")
def q19_normalise_concat(spark, sf):
    return probes(features(spark, sf).select("vec_id", V.fuse_each(F.col("img"), F.col("txt"), 1.5).alias("v")), "v")


@query(f"""with e as ({E_SQL}), f as (select vec_id, list_concat(img, list_transform(txt, lambda x: 1.5 * x)) as w from e), g as (select vec_id, list_transform(w, lambda x: x / {N('w')}) as v from f) select vec_id, {_probe_sql('v')} from g""")
def q20_joint_normalise(spark, sf):
    return probes(features(spark, sf).select("vec_id", V.fuse_jointly(F.col("img"), F.col("txt"), 1.5).alias("v")), "v")


_NEAR = f"""e as ({E_SQL}), k as (select vec_id as code, vec as cv from e where vec_id < {CODES}),
  d as (select e.vec_id, e.label, e.vec, k.code, list_dot_product(vec, vec) - 2 * list_dot_product(vec, cv) + list_dot_product(cv, cv) as d from e, k),
  n as (select vec_id, any_value(label) as label, any_value(vec) as vec, arg_min(code, struct_pack(d := round(d, 9), c := code)) as code, min(d) as dist2 from d group by vec_id)"""


def _codes(spark, sf):
    return features(spark, sf).where(F.col("vec_id") < CODES).select(F.col("vec_id").alias("code_id"), "vec")


def _assigned(spark, sf):
    return M.nearest_code(features(spark, sf).select("vec_id", "label", "vec"), "vec", _codes(spark, sf))


@query(f"with {_NEAR} select vec_id, code, abs(round(dist2, 6)) as dist2 from n")
def q21_nearest_code(spark, sf):
    return _assigned(spark, sf).select("vec_id", "code", F.round("dist2", 6).alias("dist2"))


@query(f"with {_NEAR}, c as (select k, n.c from range({2 * CODES}) r(k) left join (select code, count(*) as c from n group by 1) n on n.code = k) select count(*) as n_codes, count(c) as n_used, count(*) - count(c) as n_unused, 100.0 * (count(*) - count(c)) / count(*) as pct_unused from c")
def q22_codebook_usage(spark, sf):
    return M.code_usage(_assigned(spark, sf), 2 * CODES)


_MEAN = "m as (select code, max(c) as n, list(s / c order by i) as mean from (select code, i, sum(x) as s, count(*) as c from (select code, unnest(vec) as x, generate_subscripts(vec, 1) as i from n) u group by 1, 2) v group by 1)"
P4 = [0, 7, 63]


@query(f"""with {_NEAR}, {_MEAN}, b as (select vec_id as code_id, vec, 10.0 as cluster_size from e where vec_id < {CODES + 4}),
  j as (select code_id, cluster_size * 0.99 + coalesce(n, 0) * 0.01 as size, vec, n, list_transform(mean, lambda x: x / greatest({N('mean')}, 1e-12)) as u from b left join m on m.code = b.code_id),
  w as (select code_id, size, case when n is null then vec else list_transform(list_zip(vec, u), lambda z: z[1] * 0.99 + z[2] * (1 - 0.99)) end as w, n from j),
  z as (select code_id, size, case when n is null then w else list_transform(w, lambda x: x / greatest({N('w')}, 1e-12)) end as v from w)
select code_id, round(size, 6) as cluster_size, {_probe_sql('v', P4)} from z""")
def q23_ema_update(spark, sf):
    codes = features(spark, sf).where(F.col("vec_id") < CODES + 4).select(F.col("vec_id").alias("code_id"), "vec", F.lit(10.0).alias("cluster_size"))
    return probes(M.ema_codebook(codes, _assigned(spark, sf), "vec").withColumn("cluster_size", F.round("cluster_size", 6)), "vec", P4)


@query(f"""with {_NEAR}, {_MEAN}, z as (select code as code_id, n, list_transform(mean, lambda x: x / greatest({N('mean')}, 1e-12)) as v from m) select code_id, n, {_probe_sql('v', P4)} from z""")
def q24_lloyd_step(spark, sf):
    df = features(spark, sf)
    return probes(M.lloyd_step(df, "vec", _codes(spark, sf)).where("n > 0"), "vec", P4)


@query(f"with e as ({E_SQL}) select label, round(avg(1 - list_dot_product(img, txt) / (greatest({N('img')}, 1e-6) * greatest({N('txt')}, 1e-6))), 6) as loss, count(*) as n from e group by 1")
def q25_cosine_loss(spark, sf):
    return features(spark, sf).groupBy("label").agg(F.round(F.avg(V.cosine_loss(F.col("img"), F.col("txt"), 1e-6)), 6).alias("loss"), F.count("*").alias("n"))


_PAIRS = f"e as ({E_SQL}), d as (select a.vec_id as a, b.vec_id as b, sqrt(greatest(0, list_dot_product(a.vec, a.vec) - 2 * list_dot_product(a.vec, b.vec) + list_dot_product(b.vec, b.vec))) as dist from e a, e b)"


@query(f"with {_PAIRS}, k as (select a, dist, row_number() over (partition by a order by dist) as r from d) select round(quantile_cont(dist, 0.85), 6) as eps from k where r = 5")
def q26_knn_eps(spark, sf):
    return M.auto_eps(features(spark, sf), "vec_id", "vec", 5).select(F.round("eps", 6).alias("eps"))


EPS, CORE = 1.0, 4


@query(f"""with recursive {_PAIRS}, n as (select a, b from d where dist <= {EPS}), c as (select a from n group by a having count(*) >= {CORE}),
  e2 as (select n.a, n.b from n join c on c.a = n.a join c c2 on c2.a = n.b), reach as (select a, a as b from c union select reach.a, e2.b from reach join e2 on e2.a = reach.b),
  l as (select a, min(b) as l from reach group by 1), k as (select l, row_number() over (order by l) - 1 as cluster from (select distinct l from l)), m as (select a, cluster from l join k using (l)),
  o as (select n.a, min(cluster) as cluster from n join m on m.a = n.b group by 1)
select vec_id, cast(coalesce(m.cluster, o.cluster, -1) as int) as cluster from e left join m on m.a = vec_id left join o on o.a = vec_id""")
def q27_dbscan(spark, sf):
    return M.dbscan(features(spark, sf), "vec_id", "vec", EPS, CORE)


def _faults(spark, sf):
    n = F.when(F.col("dist2") > 1.9, -1).otherwise(F.col("code"))
    return _assigned(spark, sf).select("vec_id", F.col("label").cast("long").alias("category"), (F.col("vec_id") % 20).alias("unit"), n.cast("int").alias("cluster"))


_FAULTS = f"{_NEAR}, f as (select vec_id, cast(label as bigint) as category, vec_id % 20 as unit, cast(case when dist2 > 1.9 then -1 else code end as int) as cluster from n)"


@query(f"""with {_FAULTS}, c as (select category, cluster, count(*) as n from f where cluster >= 0 group by 1, 2), r as (select *, row_number() over (partition by category order by n desc, cluster) as r from c)
select category as fault_category, count(*) as clusters_per_category, max(case when r = 1 then cluster end) as dominant_cluster, cast(sum(n) as bigint) as fault_count, round(100.0 * max(n) / sum(n), 6) as category_purity_percent from r group by 1""")
def q28_purity(spark, sf):
    return R.category_report(_faults(spark, sf), "category", "cluster").withColumn("category_purity_percent", F.round("category_purity_percent", 6))


@query(f"with {_FAULTS} select unit as unit_id, count(distinct cluster) as clusters_per_unit, count(*) as fault_count from f where cluster >= 0 group by 1")
def q28b_units(spark, sf):
    return R.unit_report(_faults(spark, sf), "unit", "cluster")


@query(f"""with {_FAULTS}, s as (select cluster as c, count(*) as n from f where cluster >= 0 group by 1), z as (select k, coalesce(n, 0) as n from range(0, (select max(c) + 1 from s)) r(k) left join s on s.c = k)
select (select count(*) from s) as n_clusters, (select count(*) from f where cluster < 0) as n_noise, (select count(*) from f) as n_rows, (select min(n) from s) as min_size, (select max(n) from s) as max_size, (select round(avg(n), 6) from s) as mean_size,
  (select string_agg(cast(n as string), ',' order by k) from z) as cluster_sizes, round(100.0 * (select count(*) from f where cluster < 0) / (select count(*) from f), 6) as noise_percentage""")
def q29_cluster_summary(spark, sf):
    df = R.summary(_faults(spark, sf), "cluster")
    return df.withColumns({"mean_size": F.round("mean_size", 6), "noise_percentage": F.round("noise_percentage", 6), "cluster_sizes": F.array_join(F.transform("cluster_sizes", lambda x: x.cast("string")), ",")})


@query("""with w as (select lang, doc_id, generate_subscripts(s, 1) as p, unnest(s) as word from (select lang, doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+') as s from documents)),
  c as (select lang, word, count(*) as n, min(struct_pack(d := doc_id, p := p)) as f from w where word <> '' and word not in ('a','of','on','the','photo','detailed','in','or','and','showing','at') and not regexp_full_match(word, '[0-9]+') group by 1, 2),
  r as (select *, row_number() over (partition by lang order by n desc, f) as r from c)
select lang, 'Cluster_' || lang || '_' || string_agg(word, '_' order by r) as name from r where r <= 3 group by 1""")
def q30_cluster_names(spark, sf):
    return R.cluster_names(table(spark, sf, "documents"), "text", "lang", "doc_id")


_SOFT = f"""e as ({E_SQL}), s as (select vec_id, label, list_transform(vec[1:10], lambda x: exp(x - list_max(vec[1:10]))) as e from e), t as (select vec_id, label, unnest(e) / list_sum(e) as p, generate_subscripts(e, 1) - 1 as i from s),
  r as (select *, row_number() over (partition by vec_id order by round(p, 12) desc, i) as r from t)"""


@query(f"with {_SOFT}, a as (select vec_id, any_value(label) as label, bool_or(r = 1 and i = label) as h1, bool_or(r <= 5 and i = label) as h5, max(p) as top from r group by 1) select round(avg(h1::int) * 100, 6) as acc1, round(avg(h5::int) * 100, 6) as acc5, count(*) as n, round(avg(top), 6) as mean_top from a")
def q32_topk_accuracy(spark, sf):
    p = V.softmax(F.slice("vec", 1, 10))
    df = features(spark, sf).select("vec_id", F.col("label").cast("int").alias("label"), F.transform(p, lambda x: F.round(x, 12)).alias("p"), F.array_max(p).alias("top"))
    df = df.withColumn("ranked", F.transform(V.top_k(F.col("p"), 5), lambda x: x.i))
    a = R.accuracy(df, "label", "ranked")
    return a.join(F.broadcast(df.agg(F.avg("top").alias("mean_top")))).select(F.round("acc1", 6).alias("acc1"), F.round("acc5", 6).alias("acc5"), "n", F.round("mean_top", 6).alias("mean_top"))


@query("""with v as (select vec_id, abs(cast(unnest(embedding) as double)) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings), s as (select vec_id, pos, x, sum(x) over (partition by vec_id order by x, pos rows unbounded preceding) / sum(x) over (partition by vec_id) as c from v)
select vec_id, count(*) filter (where round(c, 9) > 1 - 0.6) as n_kept, round(sum(x) filter (where round(c, 9) > 1 - 0.6), 6) as mass from s group by 1""")
def q37_attention_mass(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.abs(F.col("x").cast("double")))
    return M.attention_kept(df, "vec_id", "pos", "x", 0.6).groupBy("vec_id").agg(F.count_if("kept").alias("n_kept"), F.round(F.sum(F.when(F.col("kept"), F.col("x"))), 6).alias("mass"))


@query("""with p as (select q, k from range(0, 13) a(q), range(0, 13) b(k))
select cast(q as int) as q, cast(k as int) as k, cast(case when q = 0 and k = 0 then 37 when q = 0 then 35 when k = 0 then 36 else ((q - 1) // 4 - (k - 1) // 4 + 2) * 7 + (q - 1) % 4 - (k - 1) % 4 + 3 end as int) as idx from p""")
def q38_relative_index(spark, sf):
    return M.relative_index(spark, 3, 4)


@query("""with t as (select distinct vec_id, code from (select vec_id, (vec_id * 7 + k) % 12 as code from embeddings, range(0, 3) r(k))), r as (select *, row_number() over (partition by code order by vec_id) as rank from t), f as (select * from r where rank <= 20),
  b as (select *, row_number() over (partition by vec_id order by rank, code) as n from f) select vec_id, code, cast(rank as int) as rank from b where n = 1""")
def q39_quota_sample(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).select("vec_id", ((F.col("vec_id") * 7 + F.col("k")) % 12).alias("code"))
    return M.quota_sample(df, "vec_id", "code", 20)


@query()
def q40_pca(spark, sf):
    df, _ = M.pca(features(spark, sf).select("vec_id", "vec"), "vec", 8)
    return df.select("vec_id", F.transform("pca", lambda x: F.round(x, 4)).alias("pca"))


@query()
def q41_kmeans(spark, sf):
    return M.kmeans(features(spark, sf).select("vec_id", "vec"), "vec", 10, cosine=True).groupBy("cluster").agg(F.count("*").alias("n"))


@query("select vec_id, cast(75 as int) as n_masked, cast(196 as int) as n_patches from embeddings")
def q42_patch_mask(spark, sf):
    df = M.block_masks(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 14, 14, 75)
    return df.select("vec_id", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_masked"), F.size("mask").alias("n_patches"))


@query()
def q43_ward(spark, sf):
    return M.ward(features(spark, sf), "vec_id", "vec", 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def q43b_bisecting(spark, sf):
    return M.bisecting(features(spark, sf).select("vec_id", "vec"), "vec", 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def q44_hdbscan(spark, sf):
    return M.hdbscan(features(spark, sf), "vec_id", "vec", 10, 3).groupBy("cluster").agg(F.count("*").alias("n"))


@query("with s as (select *, sum(size) over () as n, count(*) over () as k from (select label, cast(count(*) as double) as size from embeddings group by 1)) select cast(label as int) as label, round((size + 1e-5) / (n + k * 1e-5) * n, 6) as smoothed from s")
def q45_laplace_sizes(spark, sf):
    df = table(spark, sf, "embeddings").groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").cast("double").alias("cluster_size"))
    return M.laplace_sizes(df).select("label", F.round("smoothed", 6).alias("smoothed"))


@query("select event_type, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) as global_avg, cast(sum(1 + user_id % 3) as bigint) as count from events group by 1")
def q46_weighted_means(spark, sf):
    df = table(spark, sf, "events").withColumn("w", 1 + F.col("user_id") % 3)
    return R.weighted_means(df, ["event_type"], "value", "w").withColumn("global_avg", F.round("global_avg", 6))


@query("select event_type, round(sqrt(sum(value * value)), 4) as norm2, max(abs(value)) as norm_inf from events group by 1")
def q47_gradient_norm(spark, sf):
    e = table(spark, sf, "events")
    a, b = R.gradient_norm(e, ["event_type"], "value"), R.gradient_norm(e, ["event_type"], "value", float("inf"))
    return a.join(b.withColumnRenamed("total_norm", "norm_inf"), "event_type").select("event_type", F.round("total_norm", 4).alias("norm2"), "norm_inf")


@query("select event_id, value from (select event_id, case when event_id % 500 = 0 then cast('inf' as double) when event_id % 501 = 0 then cast('nan' as double) else value end as value from events) where isnan(value) or isinf(value)")
def q48_non_finite(spark, sf):
    v = F.when(F.col("event_id") % 500 == 0, float("inf")).when(F.col("event_id") % 501 == 0, float("nan")).otherwise(F.col("value"))
    return R.non_finite(table(spark, sf, "events").select("event_id", v.alias("value")), "value")


_ASK = "case ('0x' || substr(md5('/base/doc' || doc_id || '.png'), 1, 8))::bigint % 3 when 0 then 'Describe this image.' when 1 then 'What does this image show?' else 'Explain what can be seen in this picture.' end"


@query(f"""select doc_id, case when doc_id % 2 = 0 then 'doc' || doc_id || '.png' end as image, case when doc_id % 2 = 1 then 'doc' || doc_id || '.png,more/' || doc_id || '.png' end as images,
  case when doc_id % 2 = 0 then {_ASK} else '<image>' || chr(10) || '<image>' || chr(10) || 'Describe these images.' end as question, coalesce(text, '') as answer, 'human>gpt' as turns from documents""")
def q49_training_records(spark, sf):
    from trackwise.operators import prompts as P

    i = F.col("doc_id").cast("string")
    one, more = F.concat(F.lit("/base/doc"), i, F.lit(".png")), F.concat(F.lit("/base/more/"), i, F.lit(".png"))
    df = table(spark, sf, "documents").withColumn("imgs", F.when(F.col("doc_id") % 2 == 0, F.array(one)).otherwise(F.array(one, more)))
    image, images, talk = P.record(F.col("imgs"), F.coalesce("text", F.lit("")), "/base/")
    df = df.select("doc_id", image, images, talk)
    turn = lambda k: F.get("conversations", F.lit(k)).getField("value")
    turns = F.array_join(F.transform("conversations", lambda t: t["from"]), ">")
    return df.select("doc_id", "image", F.array_join("images", ",").alias("images"), turn(0).alias("question"), turn(1).alias("answer"), turns.alias("turns"))


@query("select time_bucket(interval '1 day', ts) as win_start, time_bucket(interval '1 day', ts) + interval '1 day' as win_end, event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as top from events group by all")
def q50_windowed_metrics(spark, sf):
    from trackwise.streaming.islands import windowed_metrics

    return windowed_metrics(table(spark, sf, "events"), "ts", ["event_type"], "value", "1 day").withColumn("mean", F.round("mean", 6))


NAMES = "select case p_partkey % 6 when 0 then 'cls_token' when 1 then 'patch_embed.proj.weight' when 2 then 'blocks.' || cast(p_partkey % 80 as string) || '.attn.weight' when 3 then 'blocks.' || cast(p_partkey % 12 as string) || '.mlp.bias' when 4 then 'rel_pos_bias.table' else 'head.weight' end as name, p_partkey, p_size from part"


def _names(spark, sf):
    return spark.sql(NAMES.replace("from part", "from {part}"), part=table(spark, sf, "part"))


@query(f"""with n as (select distinct name, case when name like '%.bias' then 1 else 2 end as dims from ({NAMES})),
  l as (select name, case when name = 'cls_token' or name like 'patch_embed%' then 0 when name like 'blocks.%' then cast(split_part(name, '.', 2) as int) + 1 else 13 end as layer, dims > 1 and name not like '%.bias' and name <> 'cls_token' as decay from n)
select cast(layer as int) as layer, decay, string_agg(name, ',' order by name) as names from l group by 1, 2""")
def q51_parameter_groups(spark, sf):
    from trackwise.operators import names as NM

    df = _names(spark, sf).select("name").distinct().withColumn("dims", F.when(F.col("name").endswith(".bias"), 1).otherwise(2))
    return NM.parameter_groups(df, "name", "dims", 14, ["cls_token"]).select("layer", "decay", F.array_join("names", ",").alias("names"))


@query(f"with n as (select distinct name from ({NAMES})), k as (select substr(name, 8) as name from n where starts_with(name, 'blocks.')) select name from k where name not like '1%' and name not in (select substr(name, 8) from ({NAMES}) where p_partkey < 40) and name not like '%mlp%'")
def q52_missing_keys(spark, sf):
    from trackwise.operators import names as NM

    every = _names(spark, sf)
    want = NM.strip_prefix(every.select("name"), "name", "blocks.", ["1"])
    have = NM.strip_prefix(every.where("p_partkey < 40").select("name"), "name", "blocks.")
    return NM.missing(want, have, "name", ["mlp"])


@query("select event_type, max(value) as lr, min(value) as min_lr, arg_max(value, case when value > 5 then event_id end) as weight_decay from events group by 1")
def q53_schedule_figures(spark, sf):
    from trackwise.operators import names as NM

    df = table(spark, sf, "events").withColumn("wd", F.when(F.col("value") > 5, F.col("value")).otherwise(0.0))
    return NM.schedule_figures(df, ["event_type"], "value", "wd", "event_id")


@query("select vec_id, cast(vec_id % 14 * 16 as int) as x0, cast(vec_id // 14 % 14 * 16 as int) as y0, cast(vec_id % 14 * 16 + 16 as int) as x1, cast(vec_id // 14 % 14 * 16 + 16 as int) as y1 from embeddings")
def q54_patch_boxes(spark, sf):
    from trackwise.operators import grids as G

    x0, y0, x1, y1 = G.patch_box(F.col("p"), 14, 16)
    return table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 196).alias("p")).select("vec_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


@query("select vec_id, cast(count(*) as int) as n, round(sum(x), 6) as total from (select vec_id, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) where (i + vec_id) % 3 = 0 group by 1")
def q55_masked_tokens(spark, sf):
    from trackwise.operators import grids as G

    mask = F.transform("vec", lambda x, i: F.when((i + F.col("vec_id")) % 3 == 0, 1).otherwise(0))
    df = features(spark, sf).select("vec_id", "vec", mask.alias("mask")).select("vec_id", G.masked_tokens(F.col("vec"), F.col("mask")).alias("t"))
    return df.select("vec_id", F.size("t").alias("n"), F.round(V.total(F.col("t")), 6).alias("total"))


@query("with c as (select label, row_number() over (order by label) - 1 as new_index from (select distinct label from embeddings where label % 2 = 0)) select vec_id, label, cast(new_index as int) as new_index from embeddings join c using (label)")
def q56_class_subset(spark, sf):
    from trackwise.operators import grids as G

    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return G.subset_rows(e, e.where("label % 2 = 0").select("label"), "label")


_U = "(('0x' || substr(md5('0|' || o_orderkey || '|' || t || '|{0}'), 1, 8))::bigint / 4294967296.0::double)"


@query(f"""with o as (select o_orderkey, 200 + o_orderkey % 300 as width, 100 + o_orderkey % 170 as height from orders),
  a as (select *, width::double * height * (0.08 + 0.92::double * {_U.format('area')}) as area, exp(ln(0.75::double) + (ln(4 / 3.0::double) - ln(0.75::double)) * {_U.format('aspect')}) as r from o, range(10) x(t)),
  c as (select *, round(sqrt(area * r)) as w, round(sqrt(area / r)) as h from a),
  f as (select * from c where w between 1 and width and h between 1 and height qualify row_number() over (partition by o_orderkey order by t) = 1)
select o_orderkey, cast(floor({_U.format('top')} * (height - h + 1)) as int) as i, cast(floor({_U.format('left')} * (width - w + 1)) as int) as j, cast(h as int) as h, cast(w as int) as w, width, height from f
union all select o_orderkey, cast(floor((height - least(height, round(width / n))) / 2) as int), cast(floor((width - least(width, round(height * n))) / 2) as int), cast(least(height, round(width / n)) as int), cast(least(width, round(height * n)) as int), width, height
  from (select *, least(greatest(width::double / height, 0.75), 4 / 3.0::double) as n from o) where o_orderkey not in (select o_orderkey from f)""")
def q57_crop_geometry(spark, sf):
    from trackwise.operators import grids as G

    df = table(spark, sf, "orders").select("o_orderkey", (200 + F.col("o_orderkey") % 300).alias("w"), (100 + F.col("o_orderkey") % 170).alias("h"))
    return G.crop_geometry(df, "o_orderkey", "w", "h").select("o_orderkey", "crop.*", F.col("w").alias("width"), F.col("h").alias("height"))


@query()
def q58_cluster_methods(spark, sf):
    from trackwise.plans.clustering import cluster_all

    out = None
    for name, df in cluster_all(features(spark, sf), "vec_id", "img", "txt", "label").items():
        df = df.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("method", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
