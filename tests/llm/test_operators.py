"""The corpus operators against brute force, and their defined results for odd inputs."""

import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trackwise.llm import common, decontaminate, html_text, kernels, language_id, licenses, mixing, near_dedup, pii, quality, substring_dedup, toxicity

COLS = "doc_id long, text string, lang string, source string, n_words string, regs string, h string"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(VOCAB) + "x"
    return " ".join(w)


def table(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, "clash", "clash", "clash") for i, t in texts], COLS)


@pytest.fixture(scope="module")
def texts():
    base = prose(200, 1)
    out = [(0, base), (1, base), (2, edited(base, 2, 2)), (3, edited(base, 5, 3)), (4, edited(base, 9, 4)), (5, prose(120, 9)), (6, "One two three"), (7, "one TWO three"), (8, ""), (9, None), (10, " \t\n"), (11, prose(60, 7) + " " + base[:400])]
    chain = base
    for k in range(12, 24):
        chain = edited(chain, 3, k)
        out.append((k, chain))
    return out


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    want = brute.components(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    kept = near_dedup.drop_near_duplicates(table(spark, texts))
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_duplicates_odd_inputs(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (3, 3, True), (3, 3, True), (4, 3, False)], key=str)


def test_near_duplicate_rounds_find_all_links(spark):
    """A large group around one text whose members differ from each other more than from it."""
    base = prose(100, 77)
    rows = [(i, edited(base, 4, 1000 + i)) for i in range(1, 150)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows).items()}


def test_repeated_passages(spark, texts):
    rows = [*texts, (40, "ab" * 300), (41, "x" * 99), (42, "y" + prose(100, 1)[:150] + "z"), (43, prose(30, 50) * 3), (44, "éè" * 200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_passages(table(spark, rows)).collect()}
    assert got == brute.repeats(rows)
    assert substring_dedup.repeated_passages(table(spark, [])).count() == 0


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", 3)
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    common, same = prose(30, 3), prose(12, 4)
    rows = [(i, prose(20, 100 + i) + " " + (common if i % 2 else same + prose(9, 300 + i // 4)) + " " + prose(20, 200 + i)) for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_passages(table(spark, rows)).collect()}
    assert got == brute.repeats(rows)


def test_longest_previous_factors():
    """Against all pairs, on texts over few letters and on cut contexts."""
    import numpy as np

    r = random.Random(6)
    for trial in range(20):
        n = r.randrange(2, 60)
        anchor = "".join(r.choice("ab") for _ in range(substring_dedup.GRAM)).encode()
        lefts = ["".join(r.choice("ab") for _ in range(r.choice([3, 68]))).encode() for _ in range(4)]
        rights = ["".join(r.choice("ab") for _ in range(r.choice([5, 40, 68]))).encode() for _ in range(4)]
        rows = [(trial % 3 * (k % 2), k // 5, k % 5 * 300, r.choice(lefts)[r.randrange(3) :], r.choice(rights)) for k in range(n)]
        r.shuffle(rows)
        h, doc, pos = (np.array([x[k] for x in rows], np.int64) for k in range(3))
        before, texts = np.array([len(x[3]) for x in rows]), [x[3] + anchor + x[4] for x in rows]
        zero = np.zeros(n, np.int64)
        got = {}
        for d, at, factor in substring_dedup.longest_previous(h, zero, zero + substring_dedup.REACH, doc, pos, before, texts, least=1):
            got |= {(i, d): f for i, f in zip(at.tolist(), factor.tolist(), strict=True)}
        for i in range(n):
            for d in range(min(before[i], substring_dedup.REACH) + 1):
                want = 0
                for j in range(n):
                    if h[i] == h[j] and (doc[j], pos[j]) < (doc[i], pos[i]) and before[j] >= d and texts[i][before[i] - d : before[i]] == texts[j][before[j] - d : before[j]]:
                        a, b = texts[i][before[i] :], texts[j][before[j] :]
                        c = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                        want = max(want, min(d + c, substring_dedup.LENGTH))
                assert got.get((i, d), 0) == want, (trial, i, d)


def test_quality(spark, texts):
    rows = [*texts, (30, "\n".join(["the same line of words here"] * 20)), (31, "a b c d a b c " + prose(60, 4)), (32, " ".join(["% $ #"] * 40))]
    got = {r.doc_id: r for r in quality.quality(table(spark, rows), ["doc_id"]).collect()}
    for i, t in rows:
        n, chars, symbols, lines, repeats = brute.base_features(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality.reject_low_quality(table(spark, [])).count() == 0
    kept = quality.reject_low_quality(table(spark, [*rows, (None, prose(80, 2)), (5, prose(120, 9))]))
    assert kept.columns == table(spark, []).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 2 and None in ids and 30 not in ids


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])], "p array<double>, q array<double>")
    assert [round(r[0], 9) for r in df.select(quality.js_distance(F.col("p"), F.col("q"))).collect()] == [1.0, 0.0]


def test_leaks(spark):
    items = [(0, prose(40, 21)), (1, prose(20, 22)), (2, None), (3, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[0][1].split()
    swapped = " ".join("ZZZ" if k % 9 == 4 else x.upper() + "," for k, x in enumerate(w))
    docs = [(0, prose(50, 1) + " " + items[0][1] + " " + prose(9, 2)), (1, swapped), (2, prose(300, 3)), (3, None), (4, ""), (5, " ".join(w[:5]) + " " + prose(30, 5)), (6, items[1][1]), (6, items[1][1])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, docs), bench).collect()}
    assert got == {(0, 0), (1, 0), (6, 1)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(table(spark, docs), bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.leaks(table(spark, []), bench).count() == 0
    assert decontaminate.leaks(table(spark, docs), bench.limit(0)).count() == 0


def test_leaks_keep_plans_small(spark):
    """The driver keeps a description of every plan: bit sets must not be spelled out in them."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    every = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    last = max([e.executionId() for e in every()], default=-1)
    bench = spark.createDataFrame([(0, prose(30, 71))], "item_id long, text string")
    assert decontaminate.drop_leaks(table(spark, [(0, prose(30, 71)), (1, prose(30, 72))]), bench).count() == 1
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sizes = [len(e.physicalPlanDescription()) for e in every() if e.executionId() > last]
    assert sizes and max(sizes) < 50_000


def test_long_array(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 1 << 40]
    df = spark.range(3).select(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.get(common.long_array(spark, values), i)).alias("x"))
    assert [r.x for r in df.collect()] == [[*values, None]] * 3


def test_leak_masks_meet_every_pattern():
    for n in range(1, decontaminate.SPAN + 1):
        for bad in itertools.combinations(range(n), n - math.ceil(n * decontaminate.SAME)):
            assert any(all(i + j not in bad for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS[n] for i in range(n - len(m) + 1)), (n, bad)


def test_leaks_of_short_and_changed_items(spark):
    items = [(n, [f"t{n}q{k}" for k in range(n)]) for n in range(1, 14)]
    docs, want = [], set()
    for n, w in items:
        for bad in itertools.combinations(range(n), min(n, n - math.ceil(n * decontaminate.SAME) + 1)):
            leaks = [x if k not in bad[1:] else "ZZZ" for k, x in enumerate(w)]
            want.add((len(docs), n))
            docs += [(len(docs), f"One two, {' '.join(leaks)} three"), (len(docs) + 1, " ".join("ZZZ" if k in bad else x for k, x in enumerate(w)))]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, docs), bench).collect()} == want


def test_surrogates(spark):
    a, b = "bob.smith_9@mail3.example.com", "4111 1111 1111 1111"
    docs = [(1, f"Write to {a} or Bob.Smith_9@Mail3.Example.com."), (2, f"again {a}; card {b} or 4111111111111111, +1 (830) 555-5433."), (3, None), (4, ""), (None, "plain"), (5, "Mrs Clara Smith and Mr. Adam Smith at 10.1.22.254"), (5, "DE89 3704 0044 0532 0130 00")]
    rows = pii.replace_pii(table(spark, docs), "key", count="n").collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r.text)
    assert out[3] == [None] and out[4] == [""] and out[None] == ["plain"]
    mails = [m.lower() for t in (out[1][0], out[2][0]) for m in re.findall(r"[\w.]+@[\w.]+\w", t)]
    assert len(set(mails)) == 1 and mails[0] != a and mails[0].endswith(".com")
    cards = re.findall(r"(?:\d ?){16}", out[2][0])
    assert len({c.replace(" ", "") for c in cards}) == 1 and b not in out[2][0]
    digits = [int(c) for c in cards[0] if c.isdigit()]
    assert sum(d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(reversed(digits))) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.", out[2][0]) and "555-5433" not in out[2][0]
    five = sorted(out[5])
    m = re.match(r"Mrs (\w+) (\w+) and Mr\. (\w+) (\w+) at [\d.]+$", five[1])
    assert m and m[2] == m[4] and m[2] != "Smith" and m[1] in pii.NAMES["latin_f"] and m[3] in pii.NAMES["latin_m"]
    iban = five[0].replace(" ", "")
    number = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    assert int(number) % 97 == 1 and iban != "DE89370400440532013000"
    assert pii.replace_pii(table(spark, []), "key").count() == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With few possible surrogates some must meet; they are drawn again, and one original keeps one surrogate."""
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, c, tries, key: F.when(kind == "ssn", F.concat(F.lit("00000000"), F.pmod(F.xxhash64(c, tries), F.lit(9)).cast("string"))).otherwise(real(kind, c, tries, key)))
    docs = [(i, f"x 123-45-678{i} y") for i in range(6)] + [(9, "x 123-45-6780 z")]
    got = {r.doc_id: r.text.split()[1] for r in pii.replace_pii(table(spark, docs), "key").collect()}
    assert got[9] == got[0] and len({v for k, v in got.items() if k != 9}) == 6


def test_surrogate_names_each_large_part_once(spark):
    """The driver analyses, prints and keeps as many copies of a part as the expression has."""
    made = spark.createDataFrame([], "kind string, c string, n int").select(pii.surrogate(F.col("kind"), F.col("c"), F.col("n"), "key").alias("s"))
    assert made._jdf.queryExecution().analyzed().toString().count(pii._BLOCKS) == 3


def _skeleton(text):
    """Digits, letters by script and case, and all else as it is."""
    import unicodedata

    return [("9" if c.isdigit() else (unicodedata.name(c).split()[0], c.isupper()) if c.isalpha() else c) for c in text]


def test_surrogates_of_every_script_and_symbol(spark):
    """Entities whose places are known: nothing else changes, types and formats stay, equal ones stay equal, different ones
    different, no surrogate is an original."""
    r = random.Random(8)
    letters = {"latin": "abcdefgh", "cyrillic": "абвгдежз", "armenian": "աբգդեզէը", "hebrew": "אבגדהוזח", "arabic": "بتثجحخدذ", "han": "用户例子中国文字", "deva": "कखगघचछजझ", "hangul": "가나다라마바사아"}
    made = ["password: ********", "password=$$$$$$", "secret: %%%%%%%", "password: " + "ab9!" * 2000]
    for a in letters.values():
        made += [f"{''.join(r.choices(a, k=6))}.{''.join(r.choices(a, k=3))}@{''.join(r.choices(a, k=5))}.com" for _ in range(6)]
    made += [f"{r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}" for _ in range(6)] + [f"{r.randrange(1, 255)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(1, 255)}" for _ in range(6)]
    made += [f"Dr {a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "-'"] + ["Frau Анна Иванова", "Mr Աբգդ", "用户@例子.中国"]
    docs = [(i, f"x {e} y") for i, e in enumerate(made)] + [(1000 + i, f"again, {e} !") for i, e in enumerate(made)] + [(None, f"x {made[0]} y"), (5000, "a." * 200_000 + "b"), (5001, None)]
    got = {}
    for row in pii.replace_pii(table(spark, docs), "key").collect():
        got[row.doc_id] = row.text
    assert got[5000] == "a." * 200_000 + "b" and got[5001] is None and got[None] == got[0]
    new = [got[i][2:-2] for i in range(len(made))]
    for i, (e, n) in enumerate(zip(made, new, strict=True)):
        assert got[i] == f"x {n} y" and got[1000 + i] == f"again, {n} !" and n != e, (e, got[i])
        if "password" in e or "secret" in e:
            assert len(n) == len(e) and n.split(maxsplit=1)[0][:6] == e.split(maxsplit=1)[0][:6]
        elif len(e) > 5 and "." not in e[:4] and "Анна" not in e:
            assert _skeleton(n) == _skeleton(e), (e, n)
    assert len({n.lower() for n in new}) == len(made) and not {n.lower() for n in new} & {e.lower() for e in made}
    other = {row.doc_id: row.text for row in pii.replace_pii(table(spark, docs), "other").collect()}
    assert sum(other[i] != got[i] for i in range(len(made))) > len(made) - 5
    with pytest.raises(ValueError):
        pii.replace_pii(table(spark, docs), "")


def test_no_entity_is_left_readable_in_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("trackwise.scratch.shared_dir", lambda _: f"file://{tmp_path}")
    docs = [(i, f"x 123-45-678{i} and Anna Rosenblatt y") for i in range(6)]
    monkeypatch.setattr(common.Scratch, "drop", lambda *_: None)
    with common.released():
        pii.replace_pii(table(spark, docs), "key").collect()
        held = [p.read_bytes() for p in tmp_path.rglob("*.parquet")]
        assert held and not any(x in b for b in held for x in (b"rosenblatt", b"Rosenblatt", b"123456780"))
    assert not list(tmp_path.rglob("*.parquet"))


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, prose(r.randrange(1, 30), i), "en", s, "", "", "") for i, s in enumerate(["a"] * 700 + ["b"] * 90 + [None] * 150 + ["c"] * 60)] + [(5000, None, "en", "a", "", "", ""), (5001, "", "en", "zero", "", "", "")]
    df = spark.createDataFrame(rows, COLS)
    got = mixing.mixture(df).collect()
    again = mixing.mixture(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size, source = {x[0]: len((x[1] or "").split()) for x in rows}, {x[0]: x[3] for x in rows}
    words, taken, target = {}, {}, {}
    for x in got:
        s = source[x.doc_id]
        assert x["size"] == size[x.doc_id] and x.taken <= 2 * x["size"] and len(x.shards) == x.copies
        words[s] = words.get(s, 0) + size[x.doc_id]
        taken[s], target[s] = taken.get(s, 0) + x.taken, x.target
    want = brute.water(words)
    for s in words:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 30
    assert mixing.mixture(table(spark, [])).count() == 0
    copies = mixing.mix(df).groupBy("doc_id").count().collect()
    assert {c.doc_id: c["count"] for c in copies} == {x.doc_id: x.copies for x in got if x.copies}


def test_mix_of_repeated_rows_and_clashing_columns(spark):
    """Equal rows get equal numbers of copies, as planned, and a caller's columns stay."""
    cols = "doc_id long, text string, source string, mix_shard int, mix_order string"
    rows = [(i // 2 if i < 100 else None, prose(10 + i // 2 % 7, i // 2), "ab"[i % 4 // 2] if i < 90 else None, -1, "mine") for i in range(120)]
    df = spark.createDataFrame(rows, cols)
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "mix_shard_", "mix_order_"]
    got = out.collect()
    assert {(r.mix_shard, r.mix_order) for r in got} == {(-1, "mine")}
    plan = mixing.mixture(df).collect()
    assert sum(r.taken for r in plan) == sum(len(r.text.split()) for r in got)
    by = {}
    for r in plan:
        by.setdefault((r.doc_id, r.mark, r.sk), set()).add(r.copies)
    assert all(len(v) == 1 for v in by.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = [(i, prose(5 + i % 9, i), "en", f"s{i % 37}", "", "", "") for i in range(900)]
    got = mixing.mixture(spark.createDataFrame(rows, COLS)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want, taken = brute.water(sizes), {}
    for r in got:
        taken[r.sk[1:]] = taken.get(r.sk[1:], 0) + r.taken
        assert len(r.shards) == r.copies
    assert all(abs(taken[s] - want[s]) <= 15 for s in want)


def test_merged_registers_are_those_of_the_union():
    import numpy as np

    r = np.random.default_rng(3)
    a, b = (np.unique(r.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    b = np.concatenate([b, a[:200]])
    both = np.union1d(a, b)
    x, y, z = (near_dedup.registers(s, np.array([0, len(s)])) for s in (a, b, both))
    assert (near_dedup.merge(x, y) == z).all()


def test_samples_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_BYTES", 4000)
    monkeypatch.setattr(toxicity, "MAX_BYTES", 40_000)
    read = []
    monkeypatch.setattr(language_id, "Model", lambda texts: read.append(texts) or texts)
    rows = [(i, prose(20, i), "xy"[i % 2], "s", "", "", "") for i in range(300)] + [(900, "z" * 100_000, "x", "s", "", "", "")]
    df = spark.createDataFrame(rows, COLS)
    language_id.train(df)
    assert set(read[0]) == {"x", "y"} and all(1000 < sum(map(len, v)) <= 2000 for v in read[0].values())
    lab = spark.createDataFrame([(i, 1, i % 3 // 2) for i in range(300)], "doc_id long, quality int, toxic int")
    net = toxicity.train(df.union(df), lab)
    assert net.platt is not None


def test_splitting_tree():
    import numpy as np

    q = np.array([50, 0, 7, 300])
    out = mixing.split_quotas(q, 6)
    assert (out.sum(1) == q).all() and out.sum(0).max() - out.sum(0).min() <= 2 and (out == mixing.split_quotas(q, 6)).all()


def test_language(spark):
    def text(lang, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice({"x": ["ka", "lo", "mi"], "y": ["sch", "ung", "er"]}[lang]) for _ in range(3)) for _ in range(30))

    rows = [(i, text("xy"[i % 2], i), "xy"[i % 2], "s", "", "", "") for i in range(120)] + [(200, None, "x", "s", "", "", ""), (201, "12 34 !", "y", "s", "", "", ""), (202, text("y", 9), None, "s", "", "", "")]
    df = spark.createDataFrame(rows, COLS)
    got = {r.doc_id: r for r in language_id.identify(df, language_id.train(df)).collect()}
    for i in range(120):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == "xy"[i % 2] and 0.5 < got[i].score <= 1
    assert got[200].lang_pred == got[201].lang_pred == "und" and got[202].lang_pred == "y"
    empty = df.limit(0)
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_code_lengths_against_plain_ppm():
    import math

    import numpy as np

    train = [b"abracadabra", b"banana"]
    model = language_id.Model({"x": train})
    counts = {}
    for t in train:
        t = b"\0\0\0" + t
        for k in range(4):
            for i in range(k, len(t)):
                counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                counts[t[i - k : i]][t[i]] += 1

    def bits(ctx, c):
        if ctx in counts:
            n, d = sum(counts[ctx].values()), len(counts[ctx])
            if c in counts[ctx]:
                return -math.log2(counts[ctx][c] / (n + d))
            return -math.log2(d / (n + d)) + (bits(ctx[1:], c) if ctx else 8.0)
        return bits(ctx[1:], c) if ctx else 8.0

    text = b"abanacadxbra"
    padded = b"\0\0\0" + text
    want = sum(bits(padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))
    got = model.bits(np.frombuffer(b"zz" + text, np.uint8), np.array([2, 2 + len(text)]))
    assert got[0, 0] == pytest.approx(want, rel=1e-5)


def test_toxicity(spark):
    bad = ["zork", "blurg", "fnord"]
    rows, labels = [], []
    for i in range(400):
        w = prose(60, i).split()
        if i % 4 == 0:
            for k in range(4):
                w.insert(7 * k, bad[(i // 4 + k) % 3])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = table(spark, [*rows, (900, None), (901, "")])
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.train(df, lab)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held)
    right = sum(got[i].predicted == int(i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    none = toxicity.train(df, lab.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.0}


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    import pyarrow as pa

    # More labelled rows than the 3000 of a class that were read once: the last of the toxic ones by hash have a word of
    # their own.
    ids = spark.range(4800).where(~common.held_out(F.col("id"))).orderBy(F.xxhash64(F.lit(toxicity.SEED), "id"), "id")
    last = {r.id for r in ids.collect()[3100:]}
    rows = [(i, prose(12, i) + (" grolk" if i in last else " zork" if i < 4800 else "")) for i in range(7200)]
    df = table(spark, [*rows, (9000, prose(12, 9000) + " grolk"), (9001, prose(12, 9001))])
    lab = spark.createDataFrame([(i, 1, int(i < 4800)) for i in [*range(7200), 8000]], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1500)
    net = toxicity.train(df.repartition(1), lab)
    word = toxicity.buckets(*kernels.text_bytes(pa.array(["grolk"])))[0][0]
    assert len(last) > 300 and net.known[word]
    got = {r.doc_id: r.predicted for r in toxicity.score(df.where("doc_id >= 9000"), net).collect()}
    assert got == {9000: 1, 9001: 0}
    again = toxicity.train(df.repartition(7), lab.repartition(3))
    assert (again.matrix() == net.matrix()).all() and (again.platt, again.thresholds) == (net.platt, net.thresholds)


def test_toxicity_calibration():
    import numpy as np

    rng = np.random.default_rng(3)
    z = np.round(rng.normal(0, 12, 400), 1)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * z - 3)))).astype(int)
    n = rng.integers(1, 9, 400)
    cuts = [(a + b) / 2 for a, b in itertools.pairwise(sorted(set(z.tolist())))]
    f1 = [2 * (n * y * (z > c)).sum() / ((n * y).sum() + (n * (z > c)).sum()) for c in cuts]
    cut = toxicity.best_cut(z, y, n)
    assert 2 * (n * y * (z > cut)).sum() / ((n * y).sum() + (n * (z > cut)).sum()) == pytest.approx(max(f1))
    net = toxicity.Net()
    net.calibrate(z, y, n)
    a, b = net.platt
    assert 0.3 < a < 0.8 and 1 / (1 + np.exp(-(a * cut + b))) == pytest.approx(toxicity.CUT)


def test_toxicity_labels_without_documents(spark):
    df = table(spark, [(i, prose(8, i)) for i in range(20)])
    lab = spark.createDataFrame([(i, 1, int(i >= 20)) for i in range(40)], "doc_id long, quality int, toxic int")
    share = sum(i >= 20 for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2) / sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    assert {r.score for r in toxicity.score(df, toxicity.train(df, lab)).collect()} == {share}


def test_leaks_of_null_ids(spark):
    bench = spark.createDataFrame([(0, prose(20, 22))], "item_id long, text string")
    docs = table(spark, [(None, prose(20, 22)), (None, prose(30, 23)), (None, None), (1, prose(20, 22)), (2, prose(30, 24))])
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()), key=str) == [(1, 0), (None, 0)]
    assert sorted(((r.doc_id, r.text) for r in decontaminate.drop_leaks(docs, bench).collect()), key=str) == sorted([(None, prose(30, 23)), (None, None), (2, prose(30, 24))], key=str)


def test_page_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
    <div class="ad">Buy, now!</div><div id="cookie-notice"><p>We use cookies, a lot.</p></div><article><h1>A &amp; B</h1><p>First   part, with <b>bold</b> text.<br>And more, of it.<p>Second; part.</p><ul><li>one</li></ul><div class="comments"><p>Nice, post!</p></div></article>
    <aside>Links</aside><form><p>Your, name.</p></form><footer>&copy; x</footer></body></html>"""
    assert html_text.extract(page) == "A & B\nFirst part, with bold text. And more, of it.\nSecond; part.\none"
    rows = [(1, "u", page, 0), (1, "u", page, 0), (2, None, None, 0), (3, "v", "", 0), (4, "w", "<p>cut off here, and then <b", 0)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)][2:] == ["", "", "cut off here, and then"]
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 5


def test_page_text_without_article():
    long, short, other = "Some words, and more of them. " * 10, "A short text, not long at all, but of the same page.", "Another one, of about the same length as that before."
    long = long.strip()
    whole = "\n".join(["T", long, short, other])
    nav = "<nav><a>Home</a></nav><div class='footer'>Legal, of course.</div>"
    assert html_text.extract(f"<body>{nav}<div><h1>T</h1><p>{long}</p><p>{short}</p><p>{other}</p></div></body>") == whole
    assert html_text.extract(f"<body>{nav}<div><h1>T</h1><div><p>{long}</p></div></div></body>") == "T\n" + long
    assert html_text.extract(f"<body>{nav}<div><h2>T</h2><p><b>{long}</b></p></div></body>") == "T\n" + long
    assert html_text.extract(f"<body>{nav}<h1>T</h1><section><p>{long}</p></section><section><p>{short}</p><p>{other}</p></section></body>") == whole
    assert html_text.extract(f"<p>{long}</p>") == long


def test_page_names_are_a_prior_only():
    body = "\n".join(f"Paragraph {k} has some text, with commas, and more of that." for k in range(4))
    html = "".join(f"<p>{x}</p>" for x in body.split("\n"))
    assert html_text.extract(f'<body><div class="content has-sidebar"><div class="sidebar">Menu, links.</div><h1 class="article-header">T</h1>{html}</div></body>') == "T\n" + body
    assert html_text.extract(f'<body><div class="widget"><article><h1>T</h1>{html}</article></div><div class="comments">{html * 3}</div></body>') == "T\n" + body
    assert html_text.extract(f'<article><h1 class="article-header">T</h1><section class="discussion"><p class="notice">One, two.</p>{html}</section><div id="comment-list">{html}</div></article>') == "T\nOne, two.\n" + body
    assert html_text.extract(f'<div class="sidebar">{html}</div>') == body
    assert html_text.extract("<p title=don't>It isn't here, at all.</p><p>Second, one.</p>") == "It isn't here, at all.\nSecond, one."
    assert html_text.extract(f'<p title="a > b" data-x=\'<p>\'>One, two.</p><svg><text>no</text></svg><noscript><p>No, not.</p></noscript>{html}') == "One, two.\n" + body


def test_deep_and_broken_pages_take_linear_time():
    import time

    n = 100_000
    for page, want in (("<font>" * n + "hello, there", "hello, there"), ("<div>" * n + "hello, there" + "</p></b>" * n, "hello, there"), ("<b><div>" + "<i><font>" * n + "</b>" * n + "<li>x, y" * n, "\n".join(["x, y"] * n)), ("word, " * 1_000_000, "word, " * 999_999 + "word,"), ("<svg>" * n + "a, b", "")):
        began = time.process_time()
        assert html_text.extract(page) == want
        assert time.process_time() - began < 15


def test_licences(spark):
    docs = [(1, prose(30, 1) + "\nReleased under the MIT License.\n" + prose(9, 2)), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (5, "A license to drive, they said."), (6, licenses.TEMPLATES[3][1].replace("copy", "duplicate", 1))]
    got = {(r.doc_id, r.license) for r in licenses.scan(table(spark, docs)).collect()}
    assert got == {(1, "MIT"), (2, "GPL-3.0"), (6, "MIT")}
    assert licenses.scan(table(spark, [])).count() == 0


def test_licences_on_the_threshold(spark):
    docs = [(1, "Code is released under the MIT License."), (2, "All rights reserved worldwide."), (3, "All code is released under the MIT License."), (4, "All rights reserved worldwide today.")]
    got = {(r.doc_id, r.license, r.dice) for r in licenses.scan(table(spark, docs)).collect()}
    assert got == {(1, "MIT", 0.8), (2, "proprietary", 0.8)}
    for m in range(1, 100):
        low, high = licenses._bounds(m, 0.8)
        assert (low, high) == (-(-m * 2 // 3), m * 3 // 2)


def test_licences_over_line_breaks(spark):
    docs = [(1, "Some words here about it. Released under the\nMIT License. More words follow after that."), (2, "All rights\nreserved."), (3, "All  rights  reserved."), (4, "Under CC BY 4.0"), (5, "Heading\nReleased under the MIT License. More words follow after that."), (6, licenses.TEMPLATES[3][1].replace("ermission", "ermit").replace("sublicense", "lend"))]
    got = {(r.doc_id, r.license): r.unit for r in licenses.scan(table(spark, docs)).collect()}
    assert set(got) == {(1, "MIT"), (2, "proprietary"), (3, "proprietary"), (4, "CC-BY-4.0"), (5, "MIT"), (6, "MIT")}
    assert got[1, "MIT"] == "Released under the\nMIT License." and got[5, "MIT"] == "Released under the MIT License."
    assert licenses._hinted(licenses.DICE) and not licenses._hinted(0.2)


def test_licences_are_told_apart_by_name_and_version(spark):
    long = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    notices = [("program", "General Public", "2", "GPL-2.0"), ("program", "General Public", "3", "GPL-3.0"), ("library", "Lesser General Public", "2.1", "LGPL-2.1"), ("library", "Lesser General Public", "3", "LGPL-3.0"), ("program", "Affero General Public", "3", "AGPL-3.0"), ("library", "Library General Public", "2", None), ("program", "General Public", "1", None)]
    docs = [(k, f"/* {prose(8, k)}.\n\n" + long.format(*n[:3]).replace(" the ", "\nthe ", 2) + "\n\nThe end.") for k, n in enumerate(notices)]
    want = {(k, n[3]) for k, n in enumerate(notices) if n[3]}
    for k, (name, body) in enumerate(licenses.TEMPLATES):
        docs.append((100 + k, f"{prose(9, k)}\n\n{body}\n\n{prose(9, k + 50)}"))
        want.add((100 + k, name))
    bsd = "Copyright (c) 2020 X. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n\n"
    docs += [(500, bsd), (501, bsd + "3. " + licenses.TEMPLATES[[n for n, _ in licenses.TEMPLATES].index("BSD-3-Clause") + 1][1]), (502, "Licensed under CC BY 3.0."), (503, "x" * 3_000_000), (None, "Licensed under the MIT License.")]
    want |= {(500, "BSD-2-Clause"), (500, "proprietary"), (501, "BSD-3-Clause"), (501, "proprietary"), (None, "MIT")}
    got = {(r.doc_id, r.license) for r in licenses.scan(table(spark, docs)).collect()}
    assert got == want, (got - want, want - got)


def test_sql_of_licences_and_leaks(spark):
    import duckdb

    items = [(0, prose(40, 21)), (1, prose(20, 22)), (2, "alpha beta gamma delta"), (3, ""), (4, prose(3, 9) * 6)]
    w = items[0][1].split()
    docs = [(k, " ".join(r.choice(VOCAB) if r.random() < p else x for x in w) + " " + prose(20, k)) for k in range(60) for r in [random.Random(k)] for p in [k / 150]] + [(100, items[4][1] + " alpha beta gamma delta"), (101, None), (102, "Licensed under the MIT License.\n\nAll rights reserved")]
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    df, bench = table(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.leaks(df, bench).collect())) == sorted(con.execute(decontaminate.oracle()).fetchall())
    scan = "select doc_id, license, dice, unit from (" + licenses.oracle() + ")"
    assert sorted(map(tuple, licenses.scan(df).collect())) == sorted(con.execute(scan).fetchall())


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    data, at = kernels.text_bytes(pa.array(["a b", "b  A\tc", None, "", "é a"]))
    h, where = kernels.word_hashes(data, at)
    assert list(where) == [0, 2, 5, 5, 5, 7]
    assert h[0] == h[3] == h[6] and h[1] == h[2] and len(set(h.tolist())) == 4


def test_register_likelihood():
    import numpy as np

    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], r.integers(0, 2**63, 1000).astype(np.uint64)])
    x, y = (near_dedup.registers(s, np.array([0, len(s)])) for s in (a, b))
    est = near_dedup.likelihood((x > y).sum(1), (x < y).sum(1), np.array([4000]), np.array([4000]))[0]
    assert abs(est - 0.6) < 0.13
