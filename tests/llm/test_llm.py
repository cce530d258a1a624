"""Text operators: odd inputs, and brute force on small fixtures."""

import itertools
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from cantus.llm import decontam, htmltext, langid, licenses, linededup, lmscore, mixing, quality, setjoin, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in "ka lo mi ru se ta vo ne".split() for b in "ba di fo gu le ma no ri".split()]


def doc(i, text, lang="en", source="s0"):
    return (i, text, lang, source, len(text or ""))


def corpus(n=60, seed=1):
    """Random texts, with near copies, exact copies, a shared passage, and odd rows at the end."""
    r = random.Random(seed)
    out = []
    shared = " ".join(r.choices(WORDS, k=12))
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            w = r.choice(out)[1].split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 2 and out:
            text = r.choice(out)[1]
        else:
            text = "\n".join(" ".join(r.choices(WORDS, k=r.randint(3, 40))) for _ in range(r.randint(1, 4)))
            text += f" {shared}" if kind == 3 else ""
        out.append(doc(i, text, source=f"s{i % 3}"))
    out += [doc(n, None), doc(n + 1, ""), doc(n + 2, "  \n "), doc(n + 3, "one"), doc(n + 4, "one"), (None, "null id here", None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, DOCS).withColumn("label", F.lit(1)).withColumn("size", F.lit("x"))


def test_ngram_components_match_brute_force(spark, docs):
    rows, df = docs
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations([i for i in sets if i is not None], 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.ngram_components(df).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}


def test_ngram_components_of_frequent_signatures(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FREQUENT", 2)  # every group of three classes is frequent: deletions and the last resort
    r = random.Random(4)
    base = r.choices(WORDS, k=60)
    rows = []
    for i in range(24):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(60)] = r.choice(WORDS)
        rows.append(doc(i, " ".join(w)))
    sets = {i: {tuple(t.split(" ")[k : k + 5]) for k in range(56)} for i, t, *_ in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x.doc_id: x.component_id for x in setjoin.ngram_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == comp


def test_sets_whose_differences_touch_all_segments_share_a_signature(monkeypatch):
    monkeypatch.setattr(setjoin, "SMALL_SEGMENTS", 2.0)  # so few segments that whole sets fall into one
    r = random.Random(5)
    texts = [" ".join(r.choices(WORDS, k=8)) for _ in range(4000)]
    text = next(t for s in setjoin.slices(setjoin.pa.array(texts)) for t, x in zip(texts[s.lo :], setjoin.sets_of(s), strict=False) if len(x) == 4 and len(setjoin.parts(x, 1)[0]) == 1)
    x, y = (next(setjoin.sets_of(s)) for t in (text, text.rpartition(" ")[0]) for s in setjoin.slices(setjoin.pa.array([t])))
    assert len(x) == 4 and len(y) == 3 and set(setjoin.all_segments(x, 1).tolist()) & set(setjoin.all_segments(y, 1).tolist())


def test_line_dedup_matches_brute_force(spark, docs):
    rows, df = docs
    seen, exp = [], {}
    for i, text, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        n = 0
        for line in (text or "").split("\n"):
            s = {t for t in line.lower().split(" ") if t}
            if not s:
                continue
            n += any(10 * len(s & o) >= 9 * len(s | o) for o in seen)
            seen.append(s)
        exp[i] = n
    out = linededup.dedup_lines(df)
    assert {"label", "size", "n_lines_removed"} <= set(out.columns)
    got = {r.doc_id: r.n_lines_removed for r in out.collect()}
    assert got == exp
    assert [r.text for r in out.filter(f"doc_id = {len(rows) - 6}").collect()] == [None]


@pytest.mark.parametrize("few", [1, 64])
def test_line_dedup_compares_groups_of_any_size(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "FEW", few)
    r = random.Random(8)
    lines = [["rare"] + [f"t{r.randrange(10**6)}" for _ in range(49)] for _ in range(6)]
    lines += [["rare", *w[1:-1], "x"] for w in lines[1:3]]  # later near copies, which the earliest line of their group doesn't explain
    kept = []
    alike = linededup.alike
    monkeypatch.setattr(linededup, "alike", lambda mine, *rest: (kept.append(mine.count()), alike(mine, *rest))[1])
    got = {x.doc_id: x.n_lines_removed for x in linededup.dedup_lines(spark.createDataFrame([doc(i, " ".join(w)) for i, w in enumerate(lines)], DOCS)).collect()}
    assert got == {i: int(i > 5) for i in range(8)}
    assert few == 1 or kept[1] == 0  # nothing is left to compare after small groups, even of long lines


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d", 5, "x", "y", 2, "z", 7), (2, "a b c d\nown line here", 5, "x", "y", 2, "z", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, gone int, _key string, _rk string, n int, row string, key int")
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines_removed"]
    assert {tuple(r) for r in out.collect()} == {(*rows[0], 0), (2, "own line here", *rows[1][2:], 1)}
    items = spark.createDataFrame([(1, "own line here")], "item_id bigint, text string")
    clean = decontam.decontaminate(df, items)
    assert clean.columns == df.columns and [tuple(r) for r in clean.collect()] == rows[:1]


def test_mixing_comes_near_its_targets(spark, docs):
    rows, df = docs
    out = mixing.mix_sources(df).collect()
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert r.taken <= 2 * r["size"]
        t, target, n, most = by.get(r.source, (0, r.target, r.source_size, 0))
        by[r.source] = (t + r.taken, target, n, max(most, r["size"]))
    assert abs(sum(t for _, t, _, _ in by.values()) - 1.5 * total) < 1e-3 or sum(t for _, t, _, _ in by.values()) < 1.5 * total
    for taken, target, n, most in by.values():
        assert target <= 2 * n + 1e-6 and abs(taken - target) <= most


def test_license_labels(spark):
    rows = [doc(1, "Under THE MIT-License. apache license version 2, again: Apache License, Version 2"), doc(2, None), doc(3, "cc by"), doc(4, "This work is licensed under the GNU General Public License version 3.")]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.license_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1][:4] == (3, 0, 9, "apache-2,mit") and got[2] == (0, None, None, "", "") and got[3][0] == 0 and got[4][3] == "" and "gpl-3" in got[4][4]


def test_license_spans_count_no_gram_twice(spark):
    rows = [doc(1, "the apache license " * 4), doc(2, "licensed under the apache license version 2 0"), doc(3, "licensed under the old apache license version 2 0")]
    got = {r.doc_id: (r.labels, max((x.coverage for x in r.spans), default=0.0)) for r in licenses.license_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == ("", 0.0) and got[2] == ("apache-2", 1.0) and got[3][0] == "apache-2" and 0.6 <= got[3][1] < 1


def test_quality_counts(spark):
    text = "a b c d\n" + "x y z q x y z\n" + "a b c d\n" + "#%"
    rows = [doc(1, text), doc(2, None), doc(3, ""), *[doc(10 + i, " ".join(WORDS) + f"\nown{i} {WORDS[i]}") for i in range(30)]]
    got = {r.doc_id: r for r in quality.line_rules(spark.createDataFrame(rows, DOCS)).collect()}
    r = got[1]
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (16, 2, 1, 14, True)
    assert got[2].n_words == 0 and got[3].base_failed and not got[10].kept and not got[10].base_failed


def test_language_and_toxicity_on_held_out_rows(spark):
    r = random.Random(2)
    langs = {"aa": "ka lo mi ru".split(), "bb": "szt prk vlm dzw".split()}
    text = lambda l, bad: " ".join("".join(r.choices(langs[l], k=2)) for _ in range(30)) + (" " + r.choice(["grumblo", "snarkit"]) if bad else "")
    rows = [doc(i, text("aa" if i % 2 else "bb", i % 3 == 0), "aa" if i % 2 else "bb") for i in range(240)] + [doc(500, None), doc(501, "12 !"), doc(502, "", None)]
    df = spark.createDataFrame(rows, DOCS)
    found = {x.doc_id: x for x in langid.predict(df, langid.train_model(df, F.col("doc_id") % 4 != 0)).collect()}
    assert all(found[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(240)) and {found[i].lang_pred for i in (500, 501, 502)} == {"und"}
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train_model(df, labels, F.col("doc_id") % 4 != 0)
    got = {x.doc_id: x.predicted for x in toxicity.score(df, model).collect()}
    assert sum(got[i] == int(i % 3 == 0) for i in range(240)) >= 236
    odd = spark.createDataFrame([doc(1, "ka lo gr.um-blo mi"), doc(2, "ka lo mi"), doc(3, None), doc(4, "ka g r u m b l o")], DOCS)
    assert {x.doc_id: x.predicted for x in toxicity.score(odd, model).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}
    assert toxicity.train_model(df, labels.filter("toxic = 1"), F.lit(True)) is None


def test_language_model_is_fitted_in_tasks(spark, monkeypatch):
    r = random.Random(8)
    langs = {"aa": "ka lo mi ru".split(), "bb": "szt prk vlm dzw".split()}
    rows = [doc(i, " ".join("".join(r.choices(langs["aa" if i % 2 else "bb"], k=2)) for _ in range(30)), "aa" if i % 2 else "bb") for i in range(240)]
    df = spark.createDataFrame(rows, DOCS)
    # one share gives what the rows together give
    counts = df.select("lang", "text").mapInArrow(langid.bucket_counts, "lang string, ids binary, counts binary").orderBy("lang", F.xxhash64("ids")).collect()
    whole = langid.fit([(x.lang, lmscore.np.frombuffer(x.ids, "int32"), lmscore.np.frombuffer(x.counts, "int32")) for x in counts])
    monkeypatch.setattr(langid, "fit", None)  # the driver has no part in it; tasks have the module as it is
    got = langid.train_model(df, F.lit(True))
    assert got.langs == whole.langs and (got.table == whole.table).all() and (got.bias == whole.bias).all() and (got.heat, got.floor) == (whole.heat, whole.floor)
    # of several shares, the mean
    monkeypatch.setattr(langid, "SHARE_ROWS", 300)
    got = langid.train_model(df, F.lit(True))
    found = {x.doc_id: x.lang_pred for x in langid.predict(df, got).collect()}
    assert (got.table != whole.table).any() and all(found[i] == ("aa" if i % 2 else "bb") for i in range(240))


def test_language_id_holds_little_beside_the_texts():
    np, pa, r = lmscore.np, decontam.pa, random.Random(3)
    texts = pa.array([" ".join(r.choices(WORDS, k=400)) for _ in range(2000)])  # 3 MB
    m = langid.Model(["aa", "bb", "cc", "dd"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 4)).astype(np.float32), np.zeros(4, np.float32), 1.0, 0.0)
    batch = pa.RecordBatch.from_arrays([pa.array(["aa"] * len(texts)), texts], names=["lang", "text"])

    def most(work):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak / texts.nbytes

    # numpy's memory is traced
    assert most(lambda: langid.judged(m, texts)) < 5
    assert most(lambda: [x.num_rows for x in langid.bucket_counts(iter([batch]))]) < 5
    # and slices change nothing
    parts = [langid.judged(m, texts.slice(k, 7)) for k in range(0, 70, 7)]
    for whole, part in zip(langid.judged(m, texts), zip(*parts, strict=True), strict=True):
        assert (whole[:70] == np.concatenate(part)).all()


def test_joins_keep_every_pair_that_links():
    r = lmscore.np.random.default_rng(6)
    for n in (1, 4, 40, 400):
        for _ in range(50):
            x = lmscore.np.unique(r.integers(0, 1 << 63, n, dtype=lmscore.np.uint64) * lmscore.np.uint64(2))
            y = lmscore.np.unique(lmscore.np.concatenate([x[: n - n // 8], r.integers(0, 1 << 63, n // 8, dtype=lmscore.np.uint64)]))
            differ = sum(int(v).bit_count() for v in (setjoin.sketch(x) ^ setjoin.sketch(y)).view("uint64"))
            assert differ <= len(lmscore.np.setxor1d(x, y))
            assert 7 * differ <= len(x) + len(y) or not setjoin.linked(len(lmscore.np.intersect1d(x, y)), len(x), len(y))


def test_joins_give_no_pair_that_sketches_tell_apart(spark):
    # sets of a signature that have nothing else in common
    sets = {i: lmscore.np.unique(setjoin.mix(lmscore.np.arange(100, dtype="uint64") + lmscore.np.uint64(1000 * (i // 2)))) for i in range(20)}
    reps = spark.createDataFrame([(i, len(x), *map(int, setjoin.sketch(x))) for i, x in sets.items()], "cls bigint, n bigint, " + ", ".join(f"{k} bigint" for k in setjoin.SKETCH))
    members = spark.createDataFrame([(7, i, -100) for i in sets], "sig bigint, cls bigint, x bigint")
    comp = spark.createDataFrame([], "cls bigint, comp bigint")
    assert {(p.a, p.b) for p in setjoin.between(members, comp, reps).collect()} == {(i, i + 1) for i in range(0, 20, 2)}


def test_sets_search_only_the_segments_that_they_need(spark):
    # two classes of five segments of two elements, in band 3; eight others have the fifth segment with an element left out
    part, none = "sig bigint, cls bigint, own bigint, whole boolean, cold boolean", [-100]
    names = [64 * k + 3 for k in range(1, 16)]
    ring = [(names[k], c, names[k], True, True) for c in (1, 2) for k in range(5)] + [(names[5 + 2 * k + c - 1], c, names[k], False, True) for c in (1, 2) for k in range(5)]
    ring += [(names[13], c, names[13], True, True) for c in range(3, 11)] + [(names[4], c, names[13], False, True) for c in range(3, 11)]
    ring = spark.createDataFrame([(*x, *none) for x in ring], part + ", x bigint")
    reps = spark.createDataFrame([(c, 10, *[0] * len(setjoin.SKETCH)) for c in range(1, 11)], "cls bigint, n bigint, " + ", ".join(f"{k} bigint" for k in setjoin.SKETCH))
    comp, last = spark.createDataFrame([], "cls bigint, comp bigint"), spark.createDataFrame([], "cls bigint")

    def pairs(most):
        bands = spark.createDataFrame([(c, 3, 5, 5, most if c < 3 else 0) for c in range(1, 11)], "cls bigint, band int, full int, many int, most int")
        return {(p.a, p.b) for p in setjoin.crossing(ring, comp, reps, bands, last).collect()}

    # whole segments suffice, or those do that meet nothing; only the last one meets others
    assert pairs(4) == pairs(8) == set()
    assert pairs(9) == {(a, b) for a in (1, 2) for b in range(3, 11)}
    # sets without frequent segments can be short too
    bands = spark.createDataFrame([(1, 3, 5, 5, 10), (2, 3, 5, 5, 9)], "cls bigint, band int, full int, many int, most int")
    assert [x.cls for x in setjoin.short(ring, bands).collect()] == [1]


def test_decontamination_finds_copies_and_paraphrases(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choices(WORDS, k=24)) + ".") for i in range(5)] + [(8, None), (9, "short")]
    fill = lambda n: " ".join(r.choices(WORDS, k=n))
    near = items[1][1].split(" ")
    near[3], near[9] = "other", "word"
    rows = [doc(1, f"{fill(80)} {items[0][1]} {fill(70)}"), doc(2, f"{fill(11)} {' '.join(near)} {fill(9)}"), doc(3, fill(200)), doc(4, None), doc(5, ""), doc(6, items[2][1])]
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(1, 0), (2, 1), (6, 2)}
    assert decontam.common_in_order(*[decontam.np.array(x, decontam.np.uint64) for x in ([1, 2, 3, 2], [2, 9, 3, 2, 1])]) == 3


def test_decontamination_fits_its_space_on_all_passages(spark):
    r = random.Random(11)
    rows = [doc(i, " ".join(r.choices(WORDS, k=r.choice([3, 70])))) for i in range(3000)] + [doc(3000, None), doc(3001, "")]
    items = [(0, " ".join(r.choices(WORDS, k=20)))]
    space = decontam.fit_space(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string"))
    np = decontam.np
    column, sign = decontam.spread(decontam.RANK + 8)
    thin = np.zeros((decontam.DIMS, decontam.RANK + 8))
    thin[np.arange(decontam.DIMS), column] = sign
    y = np.zeros_like(thin)
    for text in [x[1] or "" for x in rows] + [items[0][1]]:
        for s in decontam.slices(decontam.pa.array([text])):
            b = decontam.buckets(s.hashes())
            for k in range(0, len(b), 64):
                u, n = np.unique(b[k : k + 64], return_counts=True)
                w = n * space.idf[u]
                w = w / np.linalg.norm(w)
                y[u] += np.outer(w, w @ thin[u])
    u, size, _ = np.linalg.svd(y, full_matrices=False)
    rank = min(decontam.RANK, int((size > 1e-3 * size[0]).sum()))
    got = space.basis[:, :rank] / space.idf[:, None]
    assert np.abs(got @ got.T - u[:, :rank] @ u[:, :rank].T)[:, np.unique(b)].max() < 1e-3


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Head &amp; x</h1><p>One <b>bold</b> a{0}<p>Two\n words</article><div class='comments'>hi</div><footer>f</footer>"
    rows = [(i, "http://h.example/1", page.format(i)) for i in range(6)] + [(7, None, None), (8, "", "<p>open <i>tail"), (9, "x", "")]
    got = {x.page_id: (x.text, x.n_chars) for x in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0][0].endswith("One bold a0") or "One bold a0" in got[0][0]
    assert got[7] == ("", 0) and got[8] == ("open tail", 9) and got[9] == ("", 0)
    assert all(w not in got[1][0] for w in ("menu", "buy", "hi", "<"))


def test_html_keeps_copied_articles(spark, monkeypatch):
    page = "<body><div class='x'>site line</div><article><h1>{}</h1><p>{}</p></article><div class='y'>closing line</div></body>"
    flat = "<body><div>{}</div><div>{}</div><div>every page</div></body>"
    rows = [(i, "http://h.example/", page.format("Copied title", "copied text")) for i in range(6)] + [(i, "http://h.example/", page.format(f"title {i}", f"text {i}")) for i in range(6, 10)]
    rows += [(20 + i, "http://f.example/", flat.format("Copied title", "copied text" if i % 2 else f"text {i}")) for i in range(6)] + [(20 + i, "http://f.example/", flat.format(f"title {i}", f"text {i}")) for i in range(6, 8)]
    # texts that change places are no template
    rows += [(40 + i, "http://o.example/", f"<body><div>{'one' if i % 2 else 'two'}</div><div>{'two' if i % 2 else 'one'}</div><div>own {i}</div></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for most in (htmltext.BROADCAST_TOKENS, 0):
        monkeypatch.setattr(htmltext, "BROADCAST_TOKENS", most)
        got = {x.page_id: x.text for x in htmltext.extract(df).collect()}
        assert got[0] == "Copied title copied text" and got[7] == "title 7 text 7"
        assert got[21] == "Copied title copied text" and got[22] == "Copied title text 2" and got[27] == "title 7 text 7"
        assert got[40] == "two one own 0" and got[41] == "one two own 1"


def test_html_keeps_what_only_looks_like_a_menu(spark):
    pages = {
        1: ("<div class='post-header'><h1>Head</h1></div><p>text</p>", "Head text"), 2: ("<div class='no-comments'><p>kept</p></div>", "kept"),
        3: ("<nav><a>menu</a><article><p>one</p></article>", "one"), 4: ("<p>before</p><article><p>inside</p></article><p>after</p>", "before inside after"),
        5: ("<div class='site-header'>x</div><div class='ad-slot'>y</div><div id='comments'>z</div><p>body</p>", "body"), 6: ("<div role='navigation'><article>teaser</article></div><p>body</p>", "body"),
    }
    df = spark.createDataFrame([(k, f"http://h{k}.example/", v[0]) for k, v in pages.items()], "page_id bigint, url string, html string")
    assert {x.page_id: x.text for x in htmltext.extract(df).collect()} == {k: v[1] for k, v in pages.items()}


def test_html_drops_long_fixed_text(spark):
    fixed = "terms of this site " * 40
    rows = [(i, "http://h.example/", f"<body><div class='x'><p>{fixed}</p></div><div class='y'><p>own text {i}</p></div></body>") for i in range(8)]
    got = {x.page_id: x.text for x in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"own text {i}" for i in range(8)}


def test_language_model_prefers_its_own_kind(spark, docs):
    rows, df = docs
    got = {x.doc_id: x for x in lmscore.score_documents(df).collect()}
    assert got[0].n_tokens == len(rows[0][1].split()) and got[0].log_prob < 0
    assert got[len(rows) - 6].mean_log_prob is None and got[len(rows) - 5].n_tokens == 0


def test_language_model_tells_words_of_one_id_apart(spark, monkeypatch):
    # more words than ids
    words = [f"w{i}" for i in range(1000)] * 40 + [f"x{i}" for i in range(300)] * 2 + [f"y{i}" for i in range(300)] * 10
    df = spark.createDataFrame([doc(i, w) for i, w in enumerate([" ".join(words), *(f"x{i}" for i in range(300)), *(f"y{i}" for i in range(300)), "x0"])], DOCS)
    counts = lmscore.count_words(df)
    v = lmscore.vocabulary(counts)
    net = lmscore.Network.new(v.counts)
    out = []
    for most in (lmscore.COMMON, 1000, 0):
        monkeypatch.setattr(lmscore, "COMMON", most)
        w = lmscore.shares(counts, v)
        assert w.whole == (most > 1600)
        out.append({x.doc_id: x.log_prob for x in lmscore.score(df, v, w, net).collect()})
    assert all(out[0][i] == pytest.approx(o[i]) for o in out for i in out[0])
    # texts of one word: words of one id differ by their counts (x 3, y 11; x0 4)
    slot = lambda t: int(next(iter(lmscore.slices(lmscore.pa.array([t])))).hashes()[0]) % 64
    x, y = {slot(f"x{i}"): out[0][1 + i] for i in range(1, 300)}, {slot(f"y{i}"): out[0][301 + i] for i in range(300)}
    both = x.keys() & y.keys()
    assert both and all(y[k] - x[k] == pytest.approx(lmscore.np.log(11 / 3), abs=1e-6) for k in both)


def test_language_model_learns_from_every_document(spark):
    for i in range(4):
        df = spark.createDataFrame([doc(i, f"one text of some words {i}")], DOCS)
        v = lmscore.vocabulary(lmscore.count_words(df))
        assert (lmscore.train_network(df, v).flat() != lmscore.Network.new(v.counts).flat()).any()


def test_language_model_stays_finite_on_words_over_and_over():
    net, n = lmscore.Network.new(lmscore.np.full(1024, 1000)), 1024
    lo, hi = lmscore.np.zeros(n, int), lmscore.np.full(n, n)
    for k in range(120):
        ids = lmscore.np.resize(lmscore.np.array([0, 33, 66]) + k % 2, n)
        net.learn(ids, lo, hi, 0.5)
    assert lmscore.np.isfinite(net.flat()).all() and lmscore.np.isfinite(net.score(ids, lo, hi)).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id bigint, text string")
    for out in (setjoin.ngram_components(df), mixing.mix_sources(df), licenses.license_spans(df), linededup.dedup_lines(df), quality.line_rules(df), decontam.decontaminate(df, items), langid.predict(df, langid.train_model(df, F.lit(True))), lmscore.score_documents(df)):
        assert out.count() == 0


@pytest.mark.parametrize("frequent", [32, 2])
def test_small_sets_lose_no_link(spark, monkeypatch, frequent):
    """All sets of 1 to 12 shingles of a few base texts beside their parts: over 100,000 pairs."""
    monkeypatch.setattr(setjoin, "FREQUENT", frequent)
    r = random.Random(6)
    rows = []
    for _ in range(40):
        w = r.choices(WORDS, k=16)
        for n in range(5, 17):
            rows.append(doc(len(rows), " ".join(w[:n])))
    sets = {i: frozenset(tuple(t.split(" ")[k : k + 5]) for k in range(len(t.split(" ")) - 4)) for i, t, *_ in rows}
    comp = {i: i for i in sets}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while any(comp[a] != comp[b] for a, b in edges):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x.doc_id: x.component_id for x in setjoin.ngram_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == comp


def test_components_in_rounds_equal_those_in_one_task(spark, monkeypatch):
    from cantus.llm import components

    r = random.Random(7)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)], "a bigint, b bigint")
    one = sorted(components.connected(edges).collect())
    monkeypatch.setattr(components, "ONE_TASK", -1)
    assert sorted(components.connected(edges).collect()) == one and max(x.comp for x in one) == 1000
