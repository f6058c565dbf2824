"""Toxicity, language, decontamination, main text, chats and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import QUERIES, chat, decontaminate, language, main_text, near_dup, toxicity

from ..conftest import SMALL
from .test_lines_and_groups import brute_components
from .test_tokens import check_packing, exact


def brute_segments(s):
    """All maximal scoring subsequences by their definition: the best one, then left and right of it."""

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                v = sum(s[i:j])
                if v > 0 and (found is None or (v, i - j) > (found[2], found[0] - found[1])):
                    found = (i, j, v)
        return [] if found is None else [*best(lo, found[0]), found, *best(found[1], hi)]

    return best(0, len(s))


@pytest.mark.parametrize("seed", range(300))
def test_segments(seed):
    rnd = random.Random(seed)
    s = [float(rnd.choice([-4, -3, -2, -1, 1, 2, 3, 5])) for _ in range(rnd.randrange(13))]
    assert [x[2] for x in toxicity.segments(np.array(s))] == pytest.approx([x[2] for x in brute_segments(s)])


def labelled(n, seed=0):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ta", "ri", "mo", "le") for b in ("na", "sto", "ver", "qui", "lin")]
    rows = []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(20, 200))]
        if i % 4 == 0:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["scumbag", "filthy", "vermin", "lowlife"])
        rows.append((" ".join(w), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out_texts():
    model = toxicity.fit(labelled(400), 0.25)
    for text, y in labelled(120, 9):
        p = model.probability(model.passages(text)[1])
        assert (p >= 0.7) == bool(y)
    assert model.passages(None) == ([], 0.0) and 0 <= model.probability(0.0) < 0.7
    found, _ = model.passages("tana risto filthy vermin lesto")
    assert found and found[0][0] <= 2 and found[0][1] >= 4


@pytest.mark.parametrize("seed", range(100))
def test_evidence_counts_a_word_once(seed):
    rnd = random.Random(seed)
    value = {w: float(rnd.choice([-3, -1, 1, 2, 4])) for w in "abcdef"}
    found = rnd.choices("abcdef", k=rnd.randrange(1, 14))
    spans = [found[i:j] for i in range(len(found)) for j in range(i + 1, len(found) + 1)]
    want = max(0.0, *(sum(value[w] for w in set(x) if value[w] > 0) + sum(value[w] for w in x if value[w] < 0) for x in spans), 0.0)
    assert toxicity.evidence(np.array([value[w] for w in found]), found) == pytest.approx(want)


def test_later_passages_with_the_same_words_are_found():
    bad, plain = ["scumbag", "filthy", "vermin", "lowlife"], ["tana", "risto", "mover", "lequi"] * 25
    model = toxicity.Model(lambda w: 4.0 if w in bad else -1.0, 1.0, 0.0, -2.0, 2.0)
    scattered = [w for b in bad for w in (b, *plain)]  # one at a time they are not significant
    assert model.passages(" ".join(scattered))[0] == []
    found, surprise = model.passages(" ".join([*scattered, *bad]))
    assert [x[:2] for x in found] == [(len(scattered), len(scattered) + 4)] and model.probability(surprise) >= 0.7
    repeated, _ = model.passages(" ".join([*bad, *plain] * 5))
    assert [x[:2] for x in repeated] == [(104 * k, 104 * k + 4) for k in range(5)] and len({x[2] for x in repeated}) == 1
    once, _ = model.passages(" ".join([*plain, *["filthy"] * 50]))
    assert once == []  # one word over and over is one word's evidence


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "word " * 50_000), (2, "word")], "doc_id long, text string")
    assert toxicity.train(spark.createDataFrame([("a", 1), (None, 0)], "text string, label int")) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0] * 4
    model = toxicity.train(spark.createDataFrame([*labelled(200), (None, 1)], "text string, label int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.passages == [] for r in got)


def test_language_on_held_out_documents(spark):
    got = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")
    held = [i for i in docs.index if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(got.index[got.held_out]) == sorted(held)
    assert (got.lang_pred[held] == docs.lang[held]).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the hat and the log", "en"), (4, "la porte et la table", "fr"), (5, "the end", None)] * 3
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "the and the"), (5, "le et le " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(docs, model, text="text").collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "fr"
    assert {r.lang_pred for r in language.predicted(docs, None, text="text").collect()} == {"und"}
    assert language.train(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    clash = spark.createDataFrame([(1, "the cat and", "en", 5, "x")] * 4, "doc_id long, text string, lang string, score long, lang_pred string")
    assert language.recognised(clash).columns == clash.columns


def test_code_points():
    assert "".join(map(chr, language.code_points("Ab, 12c!é"))) == " ab c é " and len(language.code_points("12 !")) == 0


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        terms = decontaminate.terms_of(text)
        for i, t in items:
            q, a = decontaminate.parts_of(t or "")
            if (q or a) and decontaminate.overlap(q, terms) >= decontaminate.OVERLAP and decontaminate.overlap(a, terms) >= decontaminate.OVERLAP:
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got and got == brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    kept = {r.doc_id for r in decontaminate.clean(docs, items).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in got}


def test_retrieval_finds_every_section_at_the_threshold():
    rnd = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(5, 160)))) for i in range(40)]
    from collections import Counter

    sections = [decontaminate.terms_of(t)[at : at + 64] for _, t in items for at in range(0, len(t.split()), 64)]
    df = Counter(w for s in sections for w in set(s))
    index = decontaminate.Index(items, stats=(len(sections), sum(map(len, sections)) / len(sections), df))
    for _ in range(30):
        terms = rnd.choices(vocabulary, k=rnd.randrange(1, 400))
        got = {(w, s): g for w, s, g in index._windows(terms)}
        for w in range(-(-len(terms) // 64)):
            own = {index.ids[t] for t in terms[w * 64 : w * 64 + 128] if t in index.ids}
            for s in range(len(sections)):
                score = sum(g for t in own for k, g in zip(index.sections[t], index.gains[t], strict=True) if k == s)
                if score > index.threshold + 1e-9:
                    assert got[(w, s)] == pytest.approx(score)
                elif score < index.threshold - 1e-9:
                    assert (w, s) not in got


def test_leaks_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 2)
    long = " ".join(f"t{k}" for k in range(300))
    items = spark.createDataFrame([(1, "what is the capital of the far land? it is the old red city"), (2, None), (3, ""), (4, long), (5, long), (None, "five words of an item here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "pre " * 500 + "What is the capital of the far land? It is the OLD red city" + " post" * 90_000), (4, "start " + long + " end"), (4, "nothing to see"), (6, "what is the capital of the far land?")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(3, 1), (4, 4), (4, 5)]
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.clean(docs, items).count() == 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><div id="topMenu"><a href=1>Home</a> <a href=2>About</a></div>
<div class="content"><h2>Title &amp; more</h2><p>First para, with <b>bold</b>&eacute; and <a href="a>b">a link</a>, of some length.<p>Second
   para<br>goes on<ul><li>one<li>two</ul><div class="ad-box">Buy, buy, buy</div><aside>See also</aside></div>
<div class="comments"><p>Nice post, really, I love it, so very much, thanks</p></div><div class="sidebar"><ul><li><a href=x>Other</a></ul></div><form>Name<input></form><footer>(c)</footer>"""


def test_main_text():
    assert main_text.extract(PAGE) == "Title & more First para, with boldé and a link, of some length. Second para goes on one two"
    assert main_text.extract(None) == main_text.extract("") == main_text.extract("<div><script>x</script>") == ""
    assert main_text.extract("<article><header><h1>A</h1></header><p>b</article><nav>c</nav>") == "A b"
    assert main_text.extract("<div>" * 3000 + "deep text, here" + "</div>" * 2000) == "deep text, here"
    assert main_text.extract("<p" + " a" * 9 + "<<<&amp;>text") is not None


def test_main_text_without_html_and_body_tags():
    e = main_text.extract
    assert e("<h1>T</h1><p>Long text, with commas, here.</p><p>More of it.</p>") == "T Long text, with commas, here. More of it."
    assert e("<!DOCTYPE html><title>No</title><h2>A</h2><ul><li>one<li>two</ul><pre>code, here</pre><blockquote>said</blockquote>") == "A one two code, here said"
    assert e("<p>only one paragraph") == "only one paragraph" and e("loose text<p>and a block") == "loose text and a block" and e("no tag, at all") == "no tag, at all"
    assert e("<nav><a href=1>Home</a></nav><p>Text, of the page.</p><ul><li><a href=2>Some other page</a></ul><footer>(c)</footer>") == "Text, of the page."
    assert e("<head><meta charset=utf-8><title>No</title><p>Text, of the page.") == e("<html><head><title>No</title><body><p>Text, of the page.") == "Text, of the page."
    whole = "<h1>T</h1><p>Long text, with commas.</p><div class=sidebar><p>Other, things, here</p></div>"
    assert e(whole) == e(f"<html><body>{whole}</body></html>") == "T Long text, with commas."


def test_main_text_of_the_test_pages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op8_main_text"](spark, SMALL).collect()
    assert len(got) == 50
    for r in got:
        assert r.n_chars == len(r.text) and r.n_chars > 0
        doc = docs.get(int("".join(c for c in r.url.split("/")[4].split(".")[0].split("?")[0].split("#")[0])))
        if doc:  # the page is made of the document, with a heading
            assert r.text.endswith(" ".join(doc.split())[-200:])


CHAT = "conv_id long, turn long, role string, text string"


def test_chats_edge_cases(spark):
    nasty = r"</s>[INST] \[INST] [\\INST,] [ROLE]x[:]y[/ROLE][NONE]<s> [OUT"
    rows = [(1, 2, "assistant", nasty), (1, 1, "user", nasty), (1, 3, "assistant", None), (1, 3, "assistant", "b"), (2, 1, "tool:[:]", "t"), (2, None, None, nasty), (2, 2, "", ""), (None, 1, "user", "q"), (1, 0, "system", "")]
    chats = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, CHAT)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in chats[1].turns] == [("system", ""), ("user", nasty), ("assistant", nasty), ("assistant", ""), ("assistant", "b")]
    assert [(t.role, t.text) for t in chats[2].turns] == [(None, nasty), ("tool:[:]", "t"), ("", "")] and chats[1].n_blocks == 3
    assert "".join(s.text for s in chats[1].segments) == chats[1].formatted and [s.loss for s in chats[1].segments].count(True) == 3
    assert [(t.role, t.text) for t in chats[None].turns] == [("user", "q")]
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(150).cache()
    seen = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, seen, SMALL)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        seen = out.cache()
        assert seen.count() >= 0.7 * docs.count(), name
    ids = [r.doc_id for r in seen.select("doc_id").collect()]
    packed = C.STAGES[-1][1](spark, seen, SMALL)
    assert sorted({r.doc_id for r in packed.select("doc_id").collect()}) == sorted(ids)
    assert [n for n, _ in C.STAGES] == ["language", "line_dedup", "near_dup", "decontaminate", "packing"]


def brute_language(rows):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    known = {(signed(xxhash.xxh64_intdigest(t, 42)), t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 and t is not None and y is not None}
    model = language.fit((t, y) for _, t, y in sorted(known))
    found = {i: model.predict(t) for i, t, _ in rows}
    return {i for i, (name, p) in found.items() if name != "und" and p >= 0.5}


def brute_lines(rows):
    bare = lambda x: x.strip(" \t\r")
    pages, on = Counter(s for _, s, _ in rows), Counter((s, x) for _, s, t in rows for x in {bare(x) for x in (t or "").split("\n")})
    out = {}
    for i, s, t in rows:
        over = lambda x, s=s: x != "" and on[s, x] >= 2 and on[s, x] > 0.02 * pages[s]
        rest = [x for x in (t or "").split("\n") if not over(bare(x))]
        out[i] = t if t is None or not any(map(bare, rest)) else "\n".join(rest)
    return out


def test_pipeline_equals_plain_python_stage_by_stage(spark, monkeypatch):
    import corpus_pipeline as C
    import public_tokenizers

    tables, held = "/root/testdata/sf0.01", {}  # sf0.001 has no line that goes
    monkeypatch.setattr(C, "written", lambda df, name, f=C.written: held.setdefault(name, f(df, name)))
    pieces = [r.asDict() for r in C.run(spark, tables).collect()]
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    stages = {name: df.collect() for name, df in held.items()}
    assert list(stages) == ["language", "line_dedup", "near_dup", "decontaminate"]
    ids = {name: [r.doc_id for r in rows] for name, rows in stages.items()}
    assert len({r.doc_id for r in docs}) == len(docs) and all(len(set(x)) == len(x) for x in ids.values())
    whole = {r.doc_id: r for r in docs}
    assert set(ids["language"]) == brute_language([(r.doc_id, r.text, r.lang) for r in docs])
    assert all(r == whole[r.doc_id] for r in stages["language"])
    want = brute_lines([(r.doc_id, r.source, r.text) for r in stages["language"]])
    assert {r.doc_id: r.text for r in stages["line_dedup"]} == want and any(want[i] != whole[i].text for i in want)
    assert all((r.lang, r.source, r.n_chars) == (whole[r.doc_id].lang, whole[r.doc_id].source, len(r.text)) for r in stages["line_dedup"])
    prints = {r.doc_id: near_dup.fingerprint_of(r.text) for r in stages["line_dedup"]}
    roots, first = brute_components(set(prints.values())), {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    assert set(ids["near_dup"]) == set(first.values()) and len(first) < len(prints)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in stages["near_dup"]], items)}
    assert set(ids["decontaminate"]) == set(ids["near_dup"]) - leaked and leaked
    for name in ("near_dup", "decontaminate"):
        assert all(r.text == want[r.doc_id] for r in stages[name])
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(pieces, {r.doc_id: [*exact(path, r.text), 1] for r in stages["decontaminate"]}, 2048)


def test_scan_takes_linear_time():
    import time

    def took(n):
        runs = []
        for s in (np.tile([1.0, -0.9], n), np.tile([2.0, -3.0], n), np.tile([3.0, -2.0, 1.0, -2.1], n // 2)):
            began = time.process_time()
            toxicity.segments(s)
            runs.append(time.process_time() - began)
        return sum(runs)

    took(1_000)
    assert took(80_000) < 4 * took(40_000) + 0.05


@pytest.mark.parametrize("seed", range(40))
def test_segments_of_longer_sequences(seed):
    rnd = random.Random(seed)
    s = [float(rnd.choice([-5, -2, -1, 1, 2, 4])) for _ in range(60)]
    assert [x[2] for x in toxicity.segments(np.array(s))] == pytest.approx([x[2] for x in brute_segments(s)])


def signed64(data):
    import xxhash

    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def test_toxicity_query_equals_plain_python(spark):
    tables = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    ids = [i for k in (0, 1) for i in sorted((i for i, y in labels.items() if y == k), key=lambda i: (signed64(i.to_bytes(8, "little", signed=True)), i))[: toxicity.MOST]]
    rows = sorted((signed64(docs[i]), docs[i], labels[i]) for i in ids if docs.get(i) is not None)
    model = toxicity.fit([r[1:] for r in rows], sum(labels.values()) / len(labels))
    got = QUERIES["op4_toxicity"](spark, tables).collect()
    assert len(got) == len(docs)
    for r in got:
        found, surprise = model.passages(docs[r.doc_id])
        assert r.score == pytest.approx(model.probability(surprise), abs=1e-9) and r.n_passages == len(found) and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_recall_on_held_out_documents(spark):
    tables = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, tables).toPandas().merge(spark.read.parquet(f"{tables}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out & got.toxic.notna()]
    hit = held.predicted == 1
    assert (hit & (held.toxic == 1)).sum() >= 0.9 * (held.toxic == 1).sum() and (hit & (held.toxic == 1)).sum() >= 0.9 * hit.sum()


def test_toxicity_of_empty_tables(spark):
    model = toxicity.train(spark.createDataFrame(labelled(200), "text string, label int"))
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert language.predicted(spark.createDataFrame([], "doc_id long, text string"), None, text="text").count() == 0
    assert main_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_sample_at_any_size(spark):
    share = lambda n, k: spark.range(1).select(language.sampling_share(F.lit(n), k).alias("s")).first().s
    assert 0 < share(10**10, 4) < 1e-6 and share(100, 4) == 1 and share(10**15, 100_000) > 0 and share(12_000, 24) == pytest.approx(500 / 12_000)
    rnd = random.Random(0)
    word = lambda letters: "".join(rnd.choices(letters, k=5))
    rows = [("one text over and over", "en")] * 100_000 + [(" ".join(word(letters) for _ in range(20)), lang) for lang, letters in (("fr", "aeiou"), ("de", "bcdfg"), ("es", "klmnp")) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string")
    taken = Counter(r.lang for r in language.sample(df, per_language=100, most=400).collect())
    assert taken["en"] == 1 and all(50 <= taken[k] <= 150 for k in ("fr", "de", "es"))
    import pickle

    model = pickle.loads(language.train(df))
    assert [model.predict(x)[0] for x in ("aeiou eaiou", "bcdfg gfdcb", "klmnp pnmlk", "text over and over")] == ["fr", "de", "es", "en"]
    many = spark.createDataFrame([(f"text {word('abc')} {k}", f"l{k % 300:03}") for k in range(600)], "text string, lang string")
    assert len({r.lang for r in language.sample(many).collect()}) == 300


def test_language_weights_are_sparse():
    rnd = random.Random(1)
    rows = [(" ".join("".join(rnd.choices(letters, k=6)) for _ in range(60)), lang) for _ in range(150) for lang, letters in (("a", "abcdefgh"), ("b", "efghijkl"), ("c", "ijklmnop"))]
    model = language.fit(rows)
    met = np.unique(np.concatenate([language.features(t)[0] for t, _ in rows]))
    assert (model.weights[met] == 0).mean() > 0.5 and all(model.predict(t)[0] == y for t, y in rows[:60])


def test_wand_jumps_over_postings():
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=40))) for i in range(600)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.Index(items, stats=(len(items), 40.0, df))
    for i in range(0, 600, 20):
        words = rnd.choices(vocabulary, k=100)
        words[30:70] = items[i][1].split()
        assert i in {index.owner[s] for _, s, _ in index._windows(words)}
    every = sum(map(len, index.sections))
    assert 0 < index.read < 0.05 * index.passed and index.passed > every


def test_short_items_match_nothing(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "of the"), (3, "what is it? it"), (4, "a question of some length here? and the answer too")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "yes of the what is it it"), (2, "x a question of some length here and the answer too y"), (3, "yes")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == [(2, 4)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 3]
    assert sorted(r.item_id for r in decontaminate.too_short(items).collect()) == [1, 2, 3]


def test_many_shards_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 1)
    rnd = random.Random(7)
    items = [(i, " ".join(f"v{rnd.randrange(3000)}" for _ in range(30))) for i in range(9)]
    docs = [(d, " ".join(f"v{rnd.randrange(3000)}" for _ in range(80)) + " " + items[d % 9][1], "x", 1.5) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score double").repartition(2)
    found = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(d, d % 9) for d in range(40)]
    kept = decontaminate.clean(df, spark.createDataFrame(items[:8], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [d for d in range(40) if d % 9 == 8]


def test_main_text_keeps_the_article():
    e = main_text.extract
    art, said = "<p>Text of the article, with commas, and more of it.</p><p>A second paragraph, of the same article, follows here.</p>", "Text of the article, with commas, and more of it. A second paragraph, of the same article, follows here."
    assert e(f'<body><div class="container has-sidebar">{art}</div><div class=sidebar>Other, things</div></body>') == said
    assert e(f"<body><form action=x><div>{art}</div><input></form></body>") == said
    assert e(f"<body><div class=content>{art}</div><form><p>Your name, your mail, please</p></form></body>") == said
    assert e(f'<article>{art}<p class="warning">Mind this.</p><p>By <span class="tags">someone</span> here</p></article>') == f"{said} Mind this. By someone here"
    assert e(f'<article>{art}<p class="ad">Buy, buy.</p><div class="cookie-notice">We, the site, use cookies</div></article>') == said
    assert e("<body><div title=don't><p>One, two, three.</p></div><p>It's over, so it is.</p></body>") == "One, two, three. It's over, so it is."
    assert e(f'<body><div id=story>{art}</div><div class="reader-comments">{"<p>Much talk, of readers, here and there.</p>" * 30}</div></body>') == said


def test_main_text_takes_linear_time():
    import time

    for page in (lambda n: "<div>" * n + "<p>x, y</p>" * n, lambda n: "<span a=b>" * n + "<div>x</div>" * n, lambda n: "<a b='" + 'x="1" ' * n, lambda n: "<ul>" + "<li>a" * n + "</p>" * n):
        took = []
        for n in (4_000, 16_000):
            began = time.process_time()
            main_text.extract(page(n))
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.1
    assert len(main_text.extract("<p>" + "word, " * 200_000)) > 1_000_000


def brute_main_text(tree):
    """The same scoring on a tree of (tag, class, children), written down plainly: every sum is taken anew."""
    nodes = []

    def walk(node, up):
        nodes.append((node, up))
        for c in node[2]:
            if not isinstance(c, str):
                walk(c, node)

    walk(tree, None)
    parent = {id(n): up for n, up in nodes}
    off = lambda n: n is not None and (n[0] in main_text.ASIDE or n[1] in main_text.MARKS or off(parent[id(n)]))
    count = lambda t: len("".join(t.split())) + t.count(" ")
    own = lambda n: [(c, False) for c in n[2] if isinstance(c, str)] + [(x, True) for c in n[2] if not isinstance(c, str) and c[0] == "a" for x in c[2]]
    below = lambda n: [n] + [x for c in n[2] if not isinstance(c, str) for x in below(c)]
    blocks = [n for n, _ in nodes if n[0] != "a" and not off(n)]
    size = lambda n: sum(count(t) for t, _ in own(n))
    linked = lambda n: sum(count(t) for t, a in own(n) if a)
    inside = lambda n: [x for x in below(n) if x[0] != "a" and not off(x)]
    density = lambda n: sum(map(linked, inside(n))) / max(1, sum(map(size, inside(n))))
    points = {}
    for n in blocks:
        if size(n):
            earned = (1 + sum(t.count(",") for t, _ in own(n)) + size(n) / 100) * (1 - linked(n) / size(n))
            at = parent[id(n)] if n[0] in ("p", "h2", "li") else n
            for share in (1, 2, 6, 9, 12):
                if at is not None:
                    points[id(at)] = points.get(id(at), 0) + earned / share
                    at = parent[id(at)]
    score = lambda n: (points[id(n)] + main_text.BONUS.get(n[0], 0.0) + (10.0 if n[1] in main_text.GOOD else 0.0)) * (1 - density(n)) if points.get(id(n), 0) > 0 else 0.0
    best = max((n for n in blocks), key=score)
    if not score(best):
        return ""
    keep = {id(best)}
    up = parent[id(best)]
    if best[0] not in ("body", "html") and up is not None:
        for n in up[2]:
            if not isinstance(n, str) and n is not best and n[0] != "a" and not off(n) and sum(map(size, inside(n))):
                first = [x for x, _ in nodes].index(n) < [x for x, _ in nodes].index(best)
                total, d = sum(map(size, inside(n))), density(n)
                if score(n) >= max(10.0, 0.2 * score(best)) or n[0] == "p" and d < 0.25 and (total > 80 or sum(t.count(",") for t, _ in own(n))) or n[0] == "h2" and first and d < 0.5:
                    keep.add(id(n))
    out = []

    def read(n, on):
        if off(n):
            return
        on = id(n) in keep or on and not (n[0] in main_text.BOXES and density(n) > 0.7 and sum(map(size, inside(n))) > 10)
        for c in n[2]:
            if isinstance(c, str):
                out.append(c if on else "")
            elif c[0] == "a":
                out.append("".join(c[2]) if on else "")
            else:
                out.append(" ")
                read(c, on)
        out.append(" ")

    read(tree, False)
    return " ".join("".join(out).split())


@pytest.mark.parametrize("seed", range(60))
def test_main_text_equals_brute_force(seed):
    rnd = random.Random(seed)

    def text():
        return " ".join(rnd.choice(["word", "comma,", "other", "of", "longer-word", "end."]) for _ in range(rnd.randrange(1, 40)))

    def element(depth):
        kind = rnd.choice(["p", "p", "p", "div", "section", "ul", "h2", "nav"]) if depth < 5 else "p"
        name = rnd.choice(["", "", "", "story", "sidebar", "content", "plain"]) if kind in ("div", "section") else ""
        if kind in ("p", "h2", "nav"):
            return (kind, name, [x for _ in range(rnd.randrange(1, 3)) for x in (text(), ("a", "", [text()]))][: rnd.choice([1, 1, 2])])
        if kind == "ul":
            return (kind, "", [("li", "", [text()] if rnd.random() < 0.5 else [("a", "", [text()])]) for _ in range(rnd.randrange(1, 4))])
        return (kind, name, [element(depth + 1) for _ in range(rnd.randrange(1, 5))])

    def html(n):
        return n if isinstance(n, str) else f"<{n[0]} class='{n[1]}'>{''.join(map(html, n[2]))}</{n[0]}>"

    tree = ("body", "", [element(0) for _ in range(rnd.randrange(2, 6))])
    assert main_text.extract(html(tree)) == brute_main_text(tree)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty texts, nulls, repeated rows and an empty table go through every stage."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, "some words in a text without an id", "en", "s", 5), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    for rows in (docs.limit(0), docs.unionAll(odd)):
        path = f"{tmp_path}/{rows.count()}"
        for _ in range(2):
            rows.write.mode("append").parquet(f"{path}/documents.parquet")
        spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
        got = C.run(spark, path).collect()
        assert bool(got) == bool(rows.count()) and all(0 < r.length <= 2048 for r in got)
