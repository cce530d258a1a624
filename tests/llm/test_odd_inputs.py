"""Nulls, empty and very long texts, ties, repeated rows and clashing columns, for each text operator; and the pipeline on a small corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cantus.llm import decontam, htmltext, langid, licenses, linededup, lmscore, mixing, quality, setjoin, toxicity
from cantus.llm.bytesoup import slices

WORDS = [a + b for a in "ka lo mi ru se ta vo ne".split() for b in "ba di fo gu le ma no ri".split()]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASH = ["n", "rk", "cls", "sig", "gone", "size", "key", "score", "label", "comp", "a", "b", "word", "band", "lid", "token", "w", "h", "target", "host", "margin", "row", "lead", "hist"]


@pytest.fixture(scope="module")
def odd(spark):
    """doc_id 1 to 4 are null, empty, blank, and one word; 5 and 6 are equal; 7 is there twice; 8 is very long; 9 has a null id, language and source."""
    r = random.Random(9)
    text = lambda n: " ".join(r.choices(WORDS, k=n)) + "."
    same = text(60)
    seven = (7, text(70), "aa", "s0", 1)
    rows = [(1, None, "aa", "s0", None), (2, "", "aa", "s1", 0), (3, " \n\t ", "bb", "s1", 4), (4, "one", "bb", None, 3), (5, same, "aa", "s0", 1), (6, same, "aa", "s0", 1), seven, seven, (8, " ".join(text(50) for _ in range(1500)), "aa", "s2", 1), (None, text(60), None, None, None)]
    rows += [(10 + i, text(55), "aa" if i % 2 else "bb", f"s{i % 3}", 1) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    return rows, df.select("*", *(F.lit(7).alias(c) for c in CLASH))


def apply(name, df, spark):
    items = spark.createDataFrame([(1, " ".join(WORDS[:20])), (1, " ".join(WORDS[:20])), (2, None), (None, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(5, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    return {
        "toxicity": lambda: toxicity.score(df, toxicity.train_model(df, labels, F.lit(True))), "licenses": lambda: licenses.license_spans(df).drop("spans"), "setjoin": lambda: setjoin.ngram_components(df), "mixing": lambda: mixing.mix_sources(df),
        "langid": lambda: langid.predict(df, langid.train_model(df, F.lit(True))), "linededup": lambda: linededup.dedup_lines(df), "quality": lambda: quality.line_rules(df), "decontam": lambda: decontam.decontaminate(df, items),
        "html": lambda: htmltext.extract(df.select(F.col("doc_id").alias("page_id"), F.lit("http://h.example/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), *CLASH)), "lmscore": lambda: lmscore.score_documents(df),
    }[name]()


@pytest.mark.parametrize("name", ["toxicity", "licenses", "setjoin", "mixing", "langid", "linededup", "quality", "decontam", "html", "lmscore"])
def test_every_row_comes_back_and_equal_rows_are_alike(spark, odd, name):
    rows, df = odd
    got = apply(name, df, spark).collect()
    key = "page_id" if name == "html" else "doc_id"
    assert sorted((x[key] is None, x[key] or 0) for x in got) == sorted((x[0] is None, x[0] or 0) for x in rows)
    twice = [tuple(x) for x in got if x[key] == 7]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_empty_tables_of_pages_and_labels(spark, odd):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert htmltext.extract(pages).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.train_model(odd[1], labels, F.lit(True)) is None and toxicity.score(odd[1], None).filter("score != 0").count() == 0


def test_kernel_weights_equal_the_kernel(spark):
    """The folded table of triple weights gives what landmarks and weights give, and the kernel is what a plain loop over triples gives."""
    def plain(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    if i < toxicity.WIDTH:
                        key = (w[i] * toxicity.LETTERS + w[j]) * toxicity.LETTERS + w[k]
                        out.setdefault(key, []).append(toxicity.DECAY ** (k - i + 1))
        norm = np.sqrt(sum(v * v for vs in out.values() for v in vs))
        return {c: sum(vs) / norm for c, vs in out.items()}

    words = ["idiot", "idxiot", "lantern", "ababab", "extraordinarily"]
    x = toxicity.letters(next(slices(toxicity.pa.array([" ".join(words)]))))
    ws = [toxicity.window_bytes(x, i, int(x.start[i])) for i in range(len(words))]
    k = toxicity.kernel(ws, ws)
    for i, a in enumerate(ws):
        for j, b in enumerate(ws):
            p, q = plain(a), plain(b)
            assert k[i, j] == pytest.approx(sum(v * q.get(c, 0) for c, v in p.items()), rel=1e-4)
    assert k[0, 1] > 0.3 > k[0, 2]
    table = np.zeros(toxicity.LETTERS**3)
    for m, weight in zip(ws[:2], (0.7, -0.2), strict=True):
        c, v = toxicity.vector(m)
        np.add.at(table, c, weight * v)
    value, _ = toxicity.windows(x, table.astype(np.float32))
    assert value[:4] == pytest.approx(0.7 * k[:4, 0] - 0.2 * k[:4, 1], rel=1e-3, abs=1e-5)


def test_network_scores_equal_a_plain_loop(spark):
    r = np.random.default_rng(1)
    net = lmscore.Network.new(r.integers(1, 50, 32 * 32))
    ids = r.integers(0, 1024, 20)
    lo, hi = np.repeat([0, 12], [12, 8]), np.repeat([12, 20], [12, 8])
    got = net.score(ids, lo, hi)
    for i, t in enumerate(ids):
        h = np.zeros(lmscore.DIM)
        for k, d in enumerate((*range(-lmscore.WINDOW, 0), *range(1, lmscore.WINDOW + 1))):
            if lo[i] <= i + d < hi[i]:
                h += net.place[k] * net.embed[ids[i + d]]
        top = h @ net.top + net.top_bias
        leaf = h @ net.leaf[t // 32] + net.leaf_bias[t // 32]
        want = top[t // 32] - np.log(np.exp(top).sum()) + leaf[t % 32] - np.log(np.exp(leaf).sum())
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_window_search_equals_all_windows_and_items(spark):
    """Decontamination through the inverted list against every window of every text beside every item."""
    r = random.Random(4)
    items = [{"item_id": i, "text": " ".join(r.choices(WORDS, k=r.choice([3, 8, 20, 40]))) + "."} for i in range(12)]
    texts = []
    for _ in range(60):
        w = r.choices(WORDS, k=r.randint(0, 120))
        if r.random() < 0.7:
            own = r.choice(items)["text"].split(" ")
            own = [x for x in own if r.random() < r.choice([1.0, 0.9, 0.7])]
            at = r.randint(0, len(w))
            w[at:at] = own
        texts.append(" ".join(w))
    rng = np.random.default_rng(2)
    idf = rng.random(decontam.DIMS)
    space = decontam.Space(idf, (rng.normal(size=(decontam.DIMS, 16)) * idf[:, None]).astype(np.float32), np.zeros(0, np.uint64), np.zeros(0))
    it = decontam.read_items(items, space)
    s = next(slices(decontam.pa.array(texts)))
    got = {(t, i): x for t, i, x, *_ in decontam.in_slice(space, it, s)}
    want, h = {}, s.hashes()
    for t in range(len(texts)):
        own = h[s.first[t] : s.first[t + 1]]
        for k, words in enumerate(it.words):
            size, n = int(it.size[k]), len(words)
            if n < decontam.LEAST_WORDS:
                if any(np.array_equal(own[a : a + n], words) for a in range(len(own) - n + 1)):
                    want[t, it.ids[k]] = 1.0
                continue
            _, starts = decontam.window_starts(np.array([0, len(own)]), size)
            total = space.running(decontam.buckets(own))
            for a in starts:
                v = total[min(a + size, len(own))] - total[a]
                if v @ it.vectors[k] / max(np.linalg.norm(v), 1e-6) >= decontam.COSINE:
                    whole, tail = decontam.check(it, k, own[max(0, a - size // 2) : a + max(size, n) + size // 2])
                    if whole >= decontam.COPIED or (whole >= decontam.PARAPHRASE and tail >= decontam.ANSWER):
                        want[t, it.ids[k]] = max(whole, want.get((t, it.ids[k]), 0))
    assert got == want and len(want) > 20


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    langs = {"aa": "ka lo mi ru".split(), "bb": "szt prk vlm dzw".split()}
    text = lambda x, n=60: " ".join("".join(r.choices(langs[x], k=3)) for _ in range(n))
    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", f"s{i % 3}", 1) for i in range(80)]
    item = text("aa", 30)
    near = rows[10][1].split(" ")
    near[5] = "changed"
    rows += [(100, rows[3][1], "aa", "s0", 1), (101, " ".join(near), "bb", "s0", 1), (102, f"{text('aa', 40)} {item} {text('aa', 20)}", "aa", "s1", 1), (103, None, "aa", "s1", None), (104, "12 !", None, None, 4), (105, f"{rows[20][1]}\n{text('bb')}", "bb", "s2", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # without letters, copies (of a line and so of a text, and near), and with the item: these go, all others stay
    assert set(out) == set(range(80)) | {105}
    assert out[105]["size"] == 60  # its first line was another document's
    for s in ("s0", "s1", "s2"):
        own = [x for x in out.values() if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 120 and all(x.taken <= 2 * x["size"] for x in own)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "mixing"]


def test_stages_judge_rows_by_their_own_texts(spark, odd):
    """An id that stands with two texts loses the copy alone; a stage on an empty table gives an empty one."""
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[20:64])
    docs = spark.createDataFrame([(1, a, "aa", "s", 1), (2, a, "aa", "s", 1), (2, b, "aa", "s", 1), (3, None, "aa", "s", None), (None, a, None, None, None)], DOCS).withColumn("row", F.lit(0))
    got = sorted((x.doc_id or 0, x.text or "") for x in corpus_pipeline.ngram_join(spark, docs, "").collect())
    assert got == [(0, a), (1, a), (2, b), (3, "")]
    none = spark.createDataFrame([], DOCS)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.ngram_join):
        assert stage(spark, none, "").count() == 0 and stage(spark, none, "").columns == corpus_pipeline.COLUMNS


def test_sums_of_exponentials_of_any_size(monkeypatch):
    np = lmscore.np
    z = np.random.default_rng(2).normal(0, 2, (50, 32)).astype(np.float32)
    for far in (0, 500, -500):
        x = (z + np.where(np.arange(50) % 2, far, 0)[:, None]).astype(np.float32)
        want = np.exp(x.astype(np.float64) - x.max(-1, keepdims=True))
        assert np.allclose(lmscore.log_sum(x.copy()), np.log(want.sum(-1)) + x.max(-1), atol=1e-4)
        assert np.allclose(lmscore.shares_of(x.copy()), want / want.sum(-1, keepdims=True), atol=1e-5)
    assert lmscore.within(lmscore.exp_sum(z.copy())[1])  # common sizes need no look at each row's largest number
