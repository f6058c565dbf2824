"""Line dedup, near duplicates and quality rules: edge cases and brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluiceway.llm import line_dedup, near_dup, quality

LINES = "doc_id long, source string, text string, h string, n_lines string"


def test_line_dedup_edge_cases(spark):
    rows = [(i, "a", f"Menu \n own {i}\n\n", "x", "y") for i in range(8)] + [(100, "a", "Menu", "x", "y"), (101, None, "Menu\nown", None, None), (102, "a", None, None, None), (103, "a", "", "x", "y"), (0, "a", "Menu \n own 0\n\n", "x", "y")]
    got = {(r.doc_id, r.source): r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, LINES), ratio=0.5).collect()}
    assert got[(1, "a")].text == " own 1\n\n" and (got[(1, "a")].n_lines, got[(1, "a")].n_dropped) == (2, 1)
    assert got[(100, "a")].text == "" and got[(100, "a")].n_dropped == 1  # all of it repeats
    spared = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, LINES), ratio=0.5, spare_whole=True).collect()}
    assert spared[100].text == "Menu" and spared[100].n_dropped == 0 and spared[1].text == " own 1\n\n"
    few = spark.createDataFrame([(1, "one", "a\nb", "", ""), (2, "two", "m\nx", "", ""), (3, "two", "m\ny", "", ""), (4, "t", "same", "", ""), (5, "t", "same\n\n", "", "")], LINES)
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(few).collect()} == {1: "a\nb", 2: "x", 3: "y", 4: "", 5: "\n"}
    long = spark.createDataFrame([(k, "a", "Menu\n" + f"w{k} " * 300_000, "", "") for k in range(3)], LINES)
    assert all(r.n_dropped == 1 and len(r.text) > 600_000 for r in line_dedup.drop_boilerplate(long).collect())
    assert got[(101, None)].text == "Menu\nown" and got[(102, "a")].text is None and got[(103, "a")].text == ""
    made = line_dedup.drop_boilerplate(spark.createDataFrame(rows, LINES), ratio=0.5)
    assert made.count() == len(rows) and made.columns == ["doc_id", "source", "text", "h", "n_lines", "n_dropped"] and dict(made.dtypes)["n_lines"] == "bigint"
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], LINES)).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i % 2}", f"Menu\nown {i}", "", "") for i in range(20)]
    df = spark.createDataFrame(rows, LINES)
    one = sorted(map(tuple, line_dedup.drop_boilerplate(df, ratio=0.5).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, line_dedup.drop_boilerplate(df, ratio=0.5).collect())) == one


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [2_000, 3])
def test_links_equal_brute_force(spark, hot):
    rnd = random.Random(hot)
    fps = set()
    for _ in range(6):  # dense balls, so that segments are shared and hot
        centre = rnd.getrandbits(64)
        for _ in range(25):
            f = centre
            for b in rnd.sample(range(64), rnd.randrange(6)):
                f ^= 1 << b
            fps.add(f)
    fps |= {0, (1 << 64) - 1, 1, 1 << 63}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in near_dup.links(df, hot=hot).collect())
    want = sorted({(a, b) for a in fps for b in fps if 0 < (a ^ b).bit_count() <= 3 and signed(a) < signed(b)})
    assert sorted(tuple(sorted(p)) for p in got) == sorted(tuple(sorted(p)) for p in want)


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 301), (301, 300), (300, 300)]
    rnd.shuffle(pairs)
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + k] for k in range(30)} == {100} and got[301] == 300
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text.upper().replace("W", "W")), (9, text + " more"), (1, None), (2, " \n "), (2, " \n "), (None, text), (7, "one two"), (8, "ONE\ttwo"), (20, "x " * 300_000)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    ids = {k[0]: v for k, v in by.items()}
    assert ids[5] == 3 and ids[3] == 3 and ids[None] == 3 and ids[1] == 1 and ids[2] == 1 and ids[8] == 7 and ids[20] == 20
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = sorted(r.doc_id for r in near_dup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None)
    roots = brute_components({near_dup.fingerprint_of(t) for _, t in rows})
    groups = {}
    for i, t in rows:
        if i is not None:
            groups.setdefault(roots[near_dup.fingerprint_of(t)], []).append(i)
    assert kept == sorted(min(g) for g in groups.values())


def test_fingerprint_bits():
    import xxhash

    words = "a b c d e".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(3)]
    assert near_dup.fingerprint_of("A  b\nC d\te") == sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 3)
    assert near_dup.fingerprint_of(None) == 0 and near_dup.fingerprint_of("a b") == xxhash.xxh64_intdigest("a b", 42)


def brute_stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    c, cover = Counter(win), set()
    for k, x in enumerate(win):
        if c[x] > 1:
            cover.update(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_base_statistics(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "a", "#$ |", "a b c d e a b c d e", "x\nx\n\nx ", "a " * 40, "é ü " * 7, "a\x0bb\x0cc", "w " * 50_000] + ["".join(rnd.choice("ab \n#") for _ in range(rnd.randrange(80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.base_stats(df, keep=["doc_id", "lang", "source"]).collect()}
    for i, t in enumerate(texts):
        e = brute_stats(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == e, t
        assert got[i].base_failed == (e[0] < 10 or 100 * e[4] > 20 * e[0])


def test_outliers_are_rejected_and_others_kept(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(60, 400))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{rnd.randrange(10**6)}$$$###" for _ in range(200)), "en", "s") for i in range(20)]
    rows += [(2000, " ".join(f"{k}$$$###" for k in range(50)), None, "tiny")]
    got = {r.doc_id: r.kept for r in quality.outliers(quality.base_stats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2), keep=["doc_id", "lang", "source"])).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20)) and got[2000]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.outliers(quality.base_stats(empty, keep=["doc_id", "lang", "source"])).count() == 0


def test_small_groups_are_compared_with_larger_populations(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    junk = lambda: " ".join(f"{rnd.randrange(10**6)}$$$###" for _ in range(100))
    rows = [(i, text(rnd.randrange(60, 400)), "en", "large" if i < 90 else f"s{i}") for i in range(100)] + [(200 + i, text(rnd.randrange(60, 400)), f"l{i}", "s") for i in range(9)]
    rows += [(1000, junk(), "en", "alone"), (1001, junk(), "rare", "s"), (1002, junk(), "rare", None), (1003, junk(), None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    judge = lambda df: {r.doc_id: r for r in quality.outliers(quality.base_stats(df, keep=["doc_id", "lang", "source"])).collect()}
    got = judge(frame)
    assert {i for i in got if not got[i].kept} == {1000, 1001, 1002} and len(got) == len(rows)
    assert [i for i in got if got[i].distance is None] == [1003]  # too few rows without a language
    few = judge(frame.where("doc_id >= 200 AND doc_id <> 1000 AND doc_id <> 1002"))  # under MIN_GROUP rows in all
    assert {i for i in few if not few[i].kept} == {1001}


def test_quality_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string").withColumn("doc_id", F.col("doc_id"))
    plan = quality.base_stats(df, keep=["doc_id", "lang", "source"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


CLASHING = ["g", "n", "d", "limit", "median", "distance_", "fp", "row", "dropped_id", "id", "component_id", "start", "salt", "ok", "far", "host", "h", "kept_", "tagged", "x0", "m_0"]


def test_other_columns_may_have_any_name(spark):
    rows = [(i, f"some words of the text {i} and more of them than ten in all\nMenu", "en", "s") for i in range(60)] + [(60, "some words of the text 0 and more of them than ten in all\nMenu", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).withColumns({c: F.lit(f"<{c}>") for c in CLASHING})
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns and {tuple(r)[4:] for r in kept.collect()} == {tuple(f"<{c}>" for c in CLASHING)} and 60 not in {r.doc_id for r in kept.collect()}
    lines = line_dedup.drop_boilerplate(df)
    assert lines.columns == [*df.columns, "n_lines", "n_dropped"] and all(r["host"] == "<host>" and r.n_dropped >= 1 for r in lines.collect())
    stats = quality.base_stats(df, keep=["doc_id", "lang", "source", *CLASHING])
    judged = quality.outliers(stats)
    assert judged.columns == [*stats.columns, "distance", "kept"] and all(r.median == "<median>" and r.kept is not None for r in judged.collect())
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_mcd(x):
    """The same estimate in NumPy: three starts, steps until the determinant settles, the least of all."""
    n, p = x.shape
    at = lambda v, q: np.sort(v)[math.ceil(q * len(v)) - 1]
    floors = np.array(quality.FLOORS) ** 2
    m = np.array([at(x[:, i], 0.5) for i in range(p)])
    s = np.sqrt((1.4826 * np.array([at(abs(x[:, i] - m[i]), 0.5) for i in range(p)])) ** 2 + floors)
    z = (x - m) / s
    u = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
    t = np.cov(np.tanh(z).T, bias=True)
    t /= np.sqrt(np.outer(np.maximum(np.diag(t), 1e-6), np.maximum(np.diag(t), 1e-6)))
    found = []
    for shape in (np.eye(p), t, p * (u.T @ u) / n):
        found.append(concentrated(x, m, np.outer(s, s) * shape + np.diag(floors)))
    return min(found, key=lambda e: e[2])


def concentrated(x, m, c):
    before, seen = math.inf, []
    while True:
        d = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
        near = x[d <= np.sort(d)[math.ceil(quality.SHARE * len(x)) - 1] * (1 + 1e-12)]
        m, c = near.mean(0), np.cov(near.T, bias=True) + np.diag(np.array(quality.FLOORS) ** 2)
        seen.append((m, c, np.linalg.slogdet(c)[1]))
        if seen[-1][2] >= before - quality.SETTLED:
            return min(seen, key=lambda e: e[2])
        before = seen[-1][2]


def test_estimates_equal_plain_numpy(spark):
    rnd = np.random.default_rng(4)
    groups = {}
    for g, n, far in (("a", 300, 0.0), ("b", 400, 0.2), ("c", 120, 0.1), ("d", 7, 0.0)):
        x = rnd.normal(size=(n, 5)) @ rnd.normal(size=(5, 5)) + rnd.normal(size=5)
        x[: int(far * n)] += np.array([8.0, 0, 9.0, 0, 7.0])
        groups[g] = x
    groups["e"] = np.repeat(rnd.normal(size=(3, 5)), 20, axis=0)
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    got = {r.g: r for r in quality.estimates(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double, x4 double")).collect()}
    assert sorted(got) == sorted(groups)
    for g, x in groups.items():
        m, c, logdet = plain_mcd(x)
        r, low = got[g], np.zeros((5, 5))
        for i, j in quality.PAIRS:
            low[i, j] = r[f"l_{i}_{j}"]
        assert r.logdet == pytest.approx(logdet, abs=1e-6), g
        assert np.allclose([r[f"m_{i}"] for i in range(5)], m, atol=1e-6) and np.allclose(low @ low.T, c, atol=1e-6), g
        if len(x) > 100:  # no worse than the best of many random starts
            starts = [x[rnd.choice(len(x), 6, replace=False)] for _ in range(60)]
            assert r.logdet <= min(concentrated(x, y.mean(0), np.cov(y.T, bias=True) + np.diag(np.array(quality.FLOORS) ** 2))[2] for y in starts) + 0.02, g


def test_groups_joined_by_shuffle(spark):
    rows = spark.createDataFrame([(g, *[float(k)] * 5) for k in range(40) for g in ("a", "b", "c")], "g string, x0 double, x1 double, x2 double, x3 double, x4 double")
    groups = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "g string, value double")
    for how, n in (("inner", 80), ("left", 120)):
        got = [sorted(map(tuple, quality._joined(rows, groups, bounded, how).select("g", "x0", "value").fillna(-1.0).collect())) for bounded in (True, False)]
        assert got[0] == got[1] and len(got[0]) == n


def test_simhash_of_very_long_and_repeated_rows(spark):
    df = spark.createDataFrame([(k, "a long text of words " * 100_000) for k in (7, 4, 4)] + [(9, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect()) == [(4, 4), (4, 4), (7, 4), (9, 9)]


@pytest.fixture
def small_broadcasts(spark):
    """Spark broadcasts by its own estimates, under its default threshold; a table over 80 MB then fails, as in a small driver."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "80m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def many_texts(spark):
    """60 000 texts, one of them twice."""
    return spark.range(60_001).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat_ws("-", F.col("id") % 60_000, F.lit(k)), 256) for k in range(4)]).alias("text"))


def test_pipeline_broadcasts_no_index_of_fingerprints(spark, small_broadcasts):
    docs = many_texts(spark)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()) == list(range(60_000))


def test_simhash_broadcasts_no_index_of_fingerprints(spark, small_broadcasts, tmp_path):
    many_texts(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_dup.op10_simhash(spark, str(tmp_path)).collect()}
    assert len(got) == 60_001 and got.pop(60_000) == 0 and all(i == c for i, c in got.items())


def test_simhash_broadcasts_no_table_that_grows_with_the_documents(spark, tmp_path):
    many_texts(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        got = {r.doc_id: r.component_id for r in near_dup.op10_simhash(spark, str(tmp_path)).collect()}
        pairs = spark.range(60_000).select((F.col("id") * 4).alias("a"), (F.col("id") * 4 + 1).alias("b"))
        roots = {r.node: r.root for r in near_dup.components(pairs).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == 60_001 and got.pop(60_000) == 0 and all(i == c for i, c in got.items())
    assert len(roots) == 120_000 and all(root == node // 4 * 4 for node, root in roots.items())


def test_near_duplicates_are_the_same_without_broadcast(spark, monkeypatch):
    rnd = random.Random(11)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    fps += [f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for f in fps for _ in range(3)] + fps[:9]
    df = spark.createDataFrame([(k, signed(f)) for k, f in enumerate(fps)], "doc_id long, fp long")
    monkeypatch.setattr(near_dup, "fingerprints", lambda docs, **_: docs)
    roots, least = brute_components(set(fps)), {}
    for k, f in enumerate(fps):
        least.setdefault(roots[f], k)
    want = [(k, signed(f), least[roots[f]]) for k, f in enumerate(fps)]
    for bound in (near_dup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(near_dup, "BROADCAST_ROWS", bound)
        assert sorted(map(tuple, near_dup.near_duplicates(df, hot=2).collect())) == want
