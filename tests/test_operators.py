"""Micro-fixtures and reference models for the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwise.functions import captures as C
from trackwise.operators import components as K
from trackwise.operators import graph, prompts, reports
from trackwise.operators import sequences as S
from trackwise.operators import vectors as M
from trackwise.plans import seams
from trackwise.sources import files, sinks


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def test_capture_grammars(spark):
    df = names(spark, "bj_CRH380BG-5822_20240101093000_ST1_1_1_10X5003.jpg", "beijing_CR400AF-B-2118_20240101213000_X_1_L7_0089.jpg", "b_C_2024_X_L7_0089.jpg", "a_b_c_ori007_5_ZHENG.jpg", "junk.jpg")
    got = [r.m for r in df.select(C.parse_capture(F.col("name")).alias("m")).collect()]
    assert (got[0].channel, got[0].pic_no, got[0].prefix) == ("5", 3, "bj_CRH380BG-5822_20240101093000_ST1_1_1_10X5")
    assert got[1].channel == "L7" and got[1].pic_no == 89
    assert got[2] is None and got[3] is None and got[4] is None
    got = [r.m for r in df.select(C.parse_capture(F.col("name"), "training").alias("m")).collect()]
    assert got[3].fmt == "ori" and got[3].pic_no == 7 and got[2].fmt == "L" and got[2].channel == "0"
    with pytest.raises(ValueError):
        C.parse_capture(F.col("name"), "other")


def test_time_words(spark):
    df = names(spark, *[f"20240101{h}" for h in ("04", "05", "12", "17", "21", "99", "")])
    assert [r[0] for r in df.select(C.time_word(F.col("name"))).collect()] == ["at night", "in the morning", "in the afternoon", "in the evening", "at night", "at night", "during the daytime"]


def test_islands_and_split(spark):
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate([1, 2, 2, 3, 5])], "prefix string, ord int, pic_no int")
    assert [r.seq_no for r in S.islands(df, ["prefix"], ["pic_no", "ord"], "pic_no").orderBy("ord").collect()] == [0, 0, 1, 1, 2]
    for n, sizes in ((50, [50]), (51, [15, 15, 15, 6])):
        df = spark.createDataFrame([("p", i) for i in range(n)], "prefix string, ord int")
        got = S.split_long(df, ["prefix"], ["ord"]).groupBy("sub_no").count().orderBy("sub_no").collect()
        assert [r["count"] for r in got] == sizes


def test_interval_merge_against_sweep(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(40):
        xs = sorted((rng.randrange(60), i) for i in range(rng.randrange(1, 9)))
        end = no = None
        for lo, i in xs:
            hi = lo + rng.randrange(12)
            no = 0 if end is None else no + (lo > end + 1)
            end = hi if end is None or lo > end + 1 else max(end, hi)
            rows.append((g, i, lo, hi))
            want[g, i] = no
    df = spark.createDataFrame(rows, "g int, i int, lo int, hi int")
    got = {(r.g, r.i): r.group_no for r in S.merge_intervals(df, ["g"], "lo", "hi", 1, ties=["i"]).collect()}
    assert got == want


def test_windows_and_blend(spark):
    df = spark.createDataFrame([(1, 20)], "k int, h int")
    with pytest.raises(ValueError):
        S.plan_windows(df, "h", 16, 16)
    got = [(r.y0, r.y1) for r in S.plan_windows(df, "h", 16, 4).orderBy("win_no").collect()]
    assert got == [(0, 16), (12, 20)]
    w = spark.createDataFrame([(1, 0, 0, 2, 2), (1, 1, 0, 2, 2)], "k int, win_no int, y0 long, y1 long, height int")
    runs = lambda a, b: spark.createDataFrame([(1, 0, 0, 1, a), (1, 1, 0, 1, b)], "k int, win_no int, r0 long, r1 long, class_id int")
    assert {r.class_id for r in S.blend_windows(runs(1, 5), w, "k", 0).collect()} == {3}
    assert {r.class_id for r in S.blend_windows(runs(2, 3), w, "k", 0).collect()} == {2}
    assert {r.class_id for r in S.blend_windows(runs(5, 1), w, "k", 0, "vote").collect()} == {1}


def test_targets_and_trim(spark):
    i = spark.createDataFrame([(1, 0, 10)], "s int, y0 int, y1 int")
    for t0, t1, kept in ((9, 10, 0), (10, 12, 1), (5, 5, 1)):
        assert S.images_without_target(i, spark.createDataFrame([(1, t0, t1)], "s int, t0 int, t1 int"), "s").count() == kept
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 20.0, 0.0, 20.0, 0.0])], "s int, i int, v double")
    assert sorted(r.i for r in S.trim_blank(df, ["s"], "i", "v").collect()) == [1, 2, 3]


def test_components_against_flood_fill(spark):
    rng = random.Random(3)
    cells = {(y, x) for y in range(12) for x in range(12) if rng.random() < 0.4}
    seen, parts = set(), []
    for c in sorted(cells):
        if c in seen:
            continue
        part, todo = set(), [c]
        while todo:
            y, x = todo.pop()
            if (y, x) in part or (y, x) not in cells:
                continue
            part.add((y, x))
            todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        seen |= part
        parts.append((min(y for y, _ in part), max(y for y, _ in part), min(x for _, x in part), max(x for _, x in part), len(part)))
    df = spark.createDataFrame([(1, 4, y, x) for y, x in cells], "seq_id int, class_id int, row int, col int")
    labelled = K.label_runs(K.pixel_runs(df))
    boxes = K.describe_components(labelled)
    assert sorted((r.min_row, r.max_row, r.min_col, r.max_col, r.px) for r in boxes.collect()) == sorted(parts)
    assert K.near_pairs(labelled, boxes, 1).count() == 0  # components of one class that share an edge would be one


def test_neighbours_at_distance_one(spark):
    def near(b):
        runs = spark.createDataFrame([(1, 1, 0, 0, 3), (1, 2, *b)], "seq_id int, comp_id int, row int, col_start int, col_end int")
        boxes = runs.select("seq_id", "comp_id", F.col("row").alias("min_row"), F.col("row").alias("max_row"), F.col("col_start").alias("min_col"), F.col("col_end").alias("max_col"))
        return K.near_pairs(runs, boxes, 1).count()

    assert near((1, 2, 5)) == 1
    assert near((1, 4, 5)) == 0


def test_suppression(spark):
    rows = [(1, 1, 2, 0, 10, 0, 10), (1, 2, 3, 1, 11, 1, 11), (1, 3, 1, 5, 5, 0, 10)]
    df = spark.createDataFrame(rows, "s int, k int, n_comps int, min_row int, max_row int, min_col int, max_col int")
    assert sorted(r.k for r in K.suppress_overlaps(df, "s", "k").collect()) == [2, 3]


def test_routing(spark):
    df = spark.createDataFrame([("1", "CRH5A-1"), ("3", "X"), ("5", "CRH5A-1"), ("0", "X")], "channel string, train_group string")
    got = sorted((r.channel, r.finder, len(r.patterns)) for r in K.route(df).collect())
    assert got == [("0", "connected", 5), ("3", "single", 1), ("5", "connected", 4), ("5", "height", 1), ("5", "height", 1), ("5", "single", 1)]


def test_graph(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    assert {r.label for r in graph.min_label_components(e).collect()} == {0, 30}


def test_components_of_random_graphs_at_any_chunk(spark):
    rng = random.Random(5)
    edges = [(g, rng.randrange(60), rng.randrange(60)) for g in range(3) for _ in range(45)]
    root = {(g, k): k for g in range(3) for k in range(60)}
    for _ in range(60):
        for g, a, b in edges:
            root[g, a] = root[g, b] = min(root[g, a], root[g, b])
    want = {(g, k): root[g, k] for g, a, b in edges for k in (a, b)}
    df = spark.createDataFrame([*edges, (None, 1, 2), (0, None, 1)], "g int, a long, b long").repartition(3)
    got = graph.min_label_components(df, ["g"]).collect()
    assert {(r.g, r.node): r.label for r in got} == want and len(got) == len(want)
    for chunk in (1, 10, 1000):
        stars = graph.contracted(df.dropna(), ["g"], chunk)
        assert {(r.g, r.node): r.label for r in graph.min_label_components(stars, ["g"]).collect()} == want
    assert graph.min_label_components(df.limit(0), ["g"]).count() == 0


def test_blend_over_cells(spark):
    rng = random.Random(6)
    spans, runs = [(0, 0, 400), (1, 380, 780), (2, 700, 1000)], []
    for n, a, b in spans:
        cuts = sorted({a, b, *[rng.randrange(a, b) for _ in range(9)]})
        runs += [(7, n, x, y - 1, rng.randrange(6)) for x, y in zip(cuts, cuts[1:], strict=False)]
    total: dict = {}
    for _, n, r0, r1, c in runs:
        _, a, b = spans[n]
        for y in range(r0, r1 + 1):
            up = min((y - a + 1) / 20, 1.0) if a > 0 else 1.0
            down = min((b - y) / 20, 1.0) if b < 1000 else 1.0
            total.setdefault(y, {}).setdefault(c, 0.0)
            total[y][c] += min(up, down)
    w = spark.createDataFrame([(7, n, a, b, 1000) for n, a, b in spans], "k int, win_no int, y0 long, y1 long, height int")
    df = spark.createDataFrame(runs, "k int, win_no int, r0 long, r1 long, class_id int")
    mean = {r.y: r.class_id for r in S.blend_windows(df, w, "k", 20).collect()}
    assert mean == {y: round(round(sum(c * v for c, v in t.items()) / sum(t.values()), 9)) for y, t in total.items()}
    vote = {r.y: r.class_id for r in S.blend_windows(df, w, "k", 20, "vote").collect()}
    assert all(total[y][c] >= max(total[y].values()) - 1e-9 for y, c in vote.items()) and set(vote) == set(range(1000))


def test_cluster_names_by_integer_and_text_order(spark):
    rows = [(1, -5, "Pear the apple"), (1, 2, "plum 12 apple"), (1, None, "fig"), (2, 9, "b c d e"), (3, 1, None)]
    want = {1: "Cluster_1_apple_fig_pear", 2: "Cluster_2_b_c_d"}
    df = spark.createDataFrame(rows, "c int, o long, t string")
    assert {r.c: r.name for r in reports.cluster_names(df, "t", "c", "o").collect()} == want
    df = df.withColumn("o", F.format_string("%05d", F.col("o") + 100).cast("string")).withColumn("o", F.when(F.col("t") != "fig", F.col("o")))
    assert {r.c: r.name for r in reports.cluster_names(df, "t", "c", "o").collect()} == want


def test_ward_and_pca_against_plain_models(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 4)) * [3, 1, 0.5, 0.2]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    parts = [[i] for i in range(40)]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(parts) > 5:
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        parts[i] += parts.pop(j)
    got: dict = {}
    for row in M.ward(df, "k", "v", 5).collect():
        got.setdefault(row.cluster, []).append(row.k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts))
    low, shares = M.pca(df, "v", 2)
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert shares == pytest.approx((s**2 / (s**2).sum())[:2], abs=1e-9)
    y = np.array([row.pca for row in low.orderBy("k").collect()])
    assert np.abs(y) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-6)


def test_kmeans_and_bisecting_settle(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(90, 3)) + np.repeat(np.eye(3) * 9, 30, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    for run in (M.kmeans, M.bisecting):
        c = np.array([row.cluster for row in run(df, "v", 3).orderBy("k").collect()])
        means = np.array([x[c == k].mean(0) for k in range(3)])
        assert (((x[:, None] - means[None]) ** 2).sum(2).argmin(1) == c).all()  # every row is with its nearest mean
        assert sorted(np.bincount(c)) == [30, 30, 30]


def test_purity_ties_and_longest_prefix(spark):
    df = spark.createDataFrame([("c", x) for x in (3, 1, 3, 1)] + [("c", -1)], "cat string, k int")
    r = reports.category_report(df, "cat", "k").collect()[0]
    assert (r.dominant_cluster, r.category_purity_percent, r.fault_count) == (1, 50.0, 4)
    d = spark.createDataFrame([("A", "a"), ("AB", "ab")], "key string, name string")
    got = prompts.longest_prefix(spark.createDataFrame([("ABC",), ("Z",)], "code string"), "code", d, "key", "name").collect()
    assert {r.code: r.component for r in got} == {"ABC": "ab", "Z": "unknown component"}


def test_masks_sum(spark):
    df = M.block_masks(spark.range(20), "id", 14, 14, 75)
    assert all(sum(r.mask) == 75 and set(r.mask) <= {0, 1} for r in df.collect())


def test_seams(spark):
    def stub():
        return lambda batch: [f"{a}!" for a in batch["ori_path"]]

    df = spark.createDataFrame([("a", None)], "ori_path string, bbox_path string")
    assert seams.generate_text(df, stub).collect()[0].inference_result == "a!"
    with pytest.raises(NotImplementedError):
        seams.model("none")


def test_sources_and_sinks(spark, tmp_path):
    for p in ("x/a/ori1.jpg", "x/a/bbox.jpg", "x/b/ori2.jpg", "x/b/skip.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("1")
    df = files.image_folder(spark, f"{tmp_path}/x", [".jpg"])
    assert sorted((r["class"], r.class_index) for r in df.collect()) == [("a", 0), ("a", 0), ("b", 1)]
    with pytest.raises(ValueError):
        files.image_folder(spark, f"{tmp_path}/x")
    pairs = files.paired_images(files.list_files(spark, f"{tmp_path}/x")).collect()
    assert sorted(r.bbox_path is None for r in pairs) == [False, True]
    (tmp_path / "i.jsonl").write_text('{"class": "b", "files": ["1"]}\n{"class": "a", "files": ["2"]}\n{"class": "b", "files": ["3"]}\n')
    assert {(r.path, r.class_index) for r in files.jsonl_index(spark, f"{tmp_path}/i.jsonl").collect()} == {("1", 1), ("2", 0), ("3", 1)}
    (tmp_path / "c.json").write_text('{"A": "x (y)", "B,C": "z"}')
    assert [(r.code, r.component_name) for r in files.component_map(spark, f"{tmp_path}/c.json").collect()] == [("A", "x y")]
    assert files.dictionary(spark, f"{tmp_path}/none.json").count() == 0
    with pytest.raises(NotImplementedError):
        files.build(spark, "other", "")
    out = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    sinks.json_lines(out, f"{tmp_path}/o", ["k"])
    sinks.append_log(out, f"{tmp_path}/o")
    assert spark.read.json(f"{tmp_path}/o").count() == 4
    assert sinks.scalars(spark.createDataFrame([(1, 0.5, None)], "step int, loss double, acc double"), "train", "step").count() == 1
    got = sinks.latest_suffix(spark.createDataFrame([("m/checkpoint-3.pth",), ("m/checkpoint-12.pth",)], "p string"), "p").collect()
    assert got[0].resume == "m/checkpoint-12.pth"


def test_bool_flag(spark):
    assert [r[0] for r in names(spark, "On", "0").select(C.bool_flag(F.col("name"))).collect()] == [True, False]
    with pytest.raises(Exception, match="invalid value"):
        names(spark, "maybe").select(C.bool_flag(F.col("name"))).collect()


def test_clustering_answers_over_its_block_and_sample_sizes(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, [10.0 * (i % 3) + r.random(), r.random()]) for i in range(60)], "k long, v array<double>")
    at = {x.k: x.v for x in df.collect()}
    dist = {(a, b): sum((x - y) ** 2 for x, y in zip(at[a], at[b], strict=True)) ** 0.5 for a in at for b in at}
    for limit in (7, 20, 100):
        got = {x.k: x.kth for x in M.kth_distance(df, "k", "v", 5, limit=limit).collect()}
        assert got == pytest.approx({a: sorted(dist[a, b] for b in at)[4] for a in at}, abs=1e-6)
        near = M.pairs_within(df, "k", "v", 0.5, limit=limit).collect()
        assert sorted((x.a, x.b) for x in near) == sorted(p for p, d in dist.items() if d <= 0.5)
        ward, dense = M.ward(df, "k", "v", 3, limit=limit + 20).collect(), M.hdbscan(df, "k", "v", 4, 2, limit=limit + 20).collect()
        assert sorted(x.k for x in ward) == sorted(x.k for x in dense) == sorted(at)
        assert len({x.cluster for x in ward}) == 3 == len({(x.k % 3, x.cluster) for x in ward})
        found = {(x.cluster, x.k % 3) for x in dense if x.cluster >= 0}
        assert {g for _, g in found} == {0, 1, 2} and len({c for c, _ in found}) == len(found)


def test_target_groups_plan(spark):
    """The plan on three strips: a rule by channel, the height rule of CRH5 trains, and a channel without targets."""
    box = "seq_id long, comp_id int, class_id int, min_row int, max_row int, min_col int, max_col int, px long"
    rows = [(s, k, c, r, r + 9, col, col + 9, 100) for s in (1, 2, 3) for k, (c, r, col) in enumerate([(4, 0, 0), (1, 0, 10), (3, 0, 20), (2, 0, 30), (4, 200, 0), (1, 205, 60)])]
    strips = spark.createDataFrame([(1, "5", "CR400AF-B-2118"), (2, "3", "CRH5A-5001"), (3, "1", "CRH5A-5001")], "seq_id long, channel string, train_group string")
    got = {(r.seq_id, r.finder, tuple(r.found), r.min_row) for r in K.target_groups(strips, spark.createDataFrame(rows, box)).collect()}
    assert {s for s, *_ in got} == {1, 2}
    assert (1, "connected", ("axle", "gearbox", "motor", "wheel"), 0) in got
    assert {(f, tuple(c), r) for s, f, c, r in got if s == 2} == {("height", ("axle", "gearbox", "motor", "wheel"), 0), ("height", ("gearbox", "wheel"), 200), ("single", ("wheel",), 200)}
