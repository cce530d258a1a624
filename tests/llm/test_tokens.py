"""Runs, pieces and alignments of tokens: plain loops, the libraries, odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from cantus.llm import pairbitmaps, periodic, sentencepieces, vocab

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", " \n\t ", "  two  spaces ", "a▁b", "▁▁x", "<s></s> <unk> <0x41>", "<|endoftext|> it's", "é ﬁ é ß​﻿ 日本 🙂", "a\x00b", "un deux　trois", "the " * 4000, "x" * 3000, "one", "one"]


def texts(n, seed):
    r = random.Random(seed)
    letters = "ab  e\n\té.,ß▁<>01日🙂 the ing"
    return ODD + ["".join(r.choices(letters, k=r.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, each a row; row 3 twice, a null id, and columns with names that operators use inside."""
    rows = [(i, t) for i, t in enumerate(texts(150, 3))] + [(3, ODD[3]), (None, "a null id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = ["kept", "ids", "decoded", "runs", "block", "place", "pair", "bitmap", "planes", "count", "best", "n_a", "groups"]
    return rows, df.select("*", *(F.lit(7).alias(c) for c in clash))


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x - d] for x in range(start + d, start + length)) for d in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_equal_a_plain_loop():
    r, docs = random.Random(5), []
    for _ in range(3000):
        w = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            x = r.randint(0, len(w))
            w[x:x] = ([r.randrange(3) for _ in range(r.randint(1, 9))] * 12)[: r.randint(1, 60)]
        docs.append(w)
    at = np.cumsum([0, *map(len, docs)])
    text, *run = periodic.find_runs(np.array([x for d in docs for x in d]), at)
    got = [[] for _ in docs]
    for t, *x in zip(text.tolist(), *(c.tolist() for c in run), strict=True):
        got[t].append(tuple(x))
    assert got == [plain_runs(d) for d in docs] and sum(map(len, got)) > 1000


def test_runs_of_long_texts_take_no_pairs():
    """One word a million times, and a block of a thousand words a thousand times: one run each."""
    for w, q in ((np.zeros(1_000_000, np.int64), 1), (np.tile(np.arange(1000), 1000), 1000)):
        assert [x.tolist() for x in periodic.find_runs(w, np.array([0, len(w)]))] == [[0], [0], [1_000_000], [q]]


def test_runs_of_rows(spark, odd):
    rows, df = odd
    more = df.select("doc_id", "text").union(spark.createDataFrame([(900, "x " * 9 + "a b c " * 4 + "a b d"), (901, "É É É É É É É")], "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in periodic.periodic_runs(more).collect()}
    assert [tuple(x) for x in got[900]["runs"]] == [(0, 9, 1), (9, 14, 3)] and got[900]["collapsed"] == "x a b c d"
    assert got[901]["runs"] == [] and got[901]["n_words"] == 6
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(w) if len(w) < 200 else [(0, 4000, 1)]
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        assert got[i]["n_words"] == len(w) and [tuple(x) for x in got[i]["runs"]] == runs and got[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert periodic.periodic_runs(df).count() == len(rows) and periodic.periodic_runs(df.limit(0)).count() == 0


def test_strongest_run_and_replayed_words(spark):
    runs = spark.sql("SELECT array(named_struct('start', 9L, 'length', 12L, 'period', 2L), named_struct('start', 0L, 'length', 18L, 'period', 3L), named_struct('start', 0L, 'length', 10L, 'period', 2L)) AS r UNION ALL SELECT array()")
    assert [x[0] and tuple(x[0]) for x in runs.select(periodic.strongest(F.col("r"))).collect()] == [(0, 18, 3), (None, None, None)]
    w = [f"w{i}" for i in range(23)]
    df = spark.createDataFrame([(" ".join(w), 730), (" ".join(w), 731), (None, 730), ("", 730), ("one", 10)], "t string, h long")
    a, p = 73 % 23, 1 + (23 - 73 % 23) // (3 + 73 % 8)
    got = [x[0] for x in df.select(periodic.replayed(F.col("t"), F.col("h"))).collect()]
    assert got == [" ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(23)), " ".join(w), None, "", "one"]


def plain_pieces(model, text):
    """The best pair of neighbours is looked for anew after each merge, over the whole text."""
    m = vocab.read_pieces(model)
    ids = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] == 1}
    sym = list("▁" + text.replace(" ", "▁")) if text else []
    while True:
        pairs = [(m.scores[ids[a + b]], -i) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a + b in ids]
        if not pairs:
            break
        i = -max(pairs)[1]
        sym[i : i + 2] = [sym[i] + sym[i + 1]]
    byte = {p: i for i, p in enumerate(m.pieces) if m.kinds[i] == 6}
    return [k for s in sym for k in ([ids[s]] if s in ids else [byte[f"<0x{b:02X}>"] for b in s.encode()])]


def test_pieces_equal_a_plain_loop_and_the_library():
    model, library = vocab.contents(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own, some = sentencepieces.Encoder(model), [t or "" for t in texts(400, 8)]
    for _, _, data, at in vocab.text_slices(pa.array(some)):
        ids, begin = own.encode(data, at)
        got = [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        assert got == library.encode(some) and own.decode(ids, begin).to_pylist() == library.decode(got)
        short = [(t, g) for t, g in zip(some, got, strict=True) if len(t) < 100]
        assert all(plain_pieces(model, t) == g for t, g in short)


def test_any_ids_decode_as_the_library_does():
    """Control and unknown ids, bytes that are no characters, marks in front."""
    own, library, r = sentencepieces.Encoder(vocab.contents(PIECES)), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    lists = [r.choices([0, 1, 2, *r.choices(range(3, 259), k=8), *r.choices(range(259, 32000), k=8), 28705], k=r.randint(0, 9)) for _ in range(2000)]
    lists += [library.encode("é日🙂 x"), [28705], [28705, 28705], [1, 28705, 259], [198, 28705]]
    begin = np.cumsum([0, *map(len, lists)])
    assert own.decode(np.array([i for x in lists for i in x], np.int32), begin).to_pylist() == library.decode(lists)


def test_forgotten_parts_are_encoded_again():
    memo = vocab.Memo(lambda parts: [[len(p)] for p in parts], room=2)
    for words in ([b"a", b"bb", b"ccc"], [b"bb", b"dddd", b"a"], [b"ccc", b"a"], []):
        data, cuts = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
        assert memo(data, cuts)[0].tolist() == [len(w) for w in words]


def test_round_trip_of_rows(spark, odd):
    rows, df = odd
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepieces.round_trip(df, PIECES).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["ids"], x["decoded"]) for x in got) == sorted((i is None, i or 0, ids := library.encode(t or ""), library.decode(ids)) for i, t in rows)
    assert all(x["agrees"] for x in got) and sentencepieces.round_trip(df.limit(0), PIECES).count() == 0


def test_disagreement_is_told():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = pa.array(["one", "two words"])
    ids = [i for t in some.to_pylist() for i in library.encode(t)]
    begin = np.array([0, len(library.encode("one")), len(ids)])
    agree = lambda x, d: sentencepieces.agreeing(library, some, np.array(x), begin, pa.array(d, pa.large_string())).tolist()
    assert agree(ids, ["one", "two words"]) == [True, True] and agree(ids, ["one", "two"]) == [True, False] and agree([5, *ids[1:]], ["one", "two words"]) == [False, True]


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="no merges"):
        vocab.read_pieces(b"")


def test_cuts_change_no_id_of_either_side():
    """Texts of odd white space, letters, digits and signs, against both libraries."""
    sides, r = pairbitmaps.Sides(vocab.contents(BYTES), vocab.contents(PIECES)), random.Random(7)
    a, b = tokenizers.Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    parts = [*"ab  e'st\n\n\t\r é×÷ßñ.,!1 2-ΑабΩ\u00a0\u2003\u3000日本🙂\x1c\x0b\x85", "'s", "'re", " the", "  ", "\n "]
    some = ["".join(r.choices(parts, k=r.randint(1, 40))) for _ in range(20_000)]
    for lo, hi, data, at in vocab.text_slices(pa.array(some)):
        data, at = vocab.spaced(data, at)
        for ids, want in ((sides.a_ids, [e.ids for e in a.encode_batch([" " + t for t in some[lo:hi]], add_special_tokens=False)]), (sides.b_ids, b.encode(some[lo:hi]))):
            got, begin = ids(data, at)
            assert [got[x:y].tolist() for x, y in zip(begin[:-1], begin[1:], strict=True)] == want


def plain_alignment(text, a, b):
    """Groups and links of one text by two counters of bytes."""
    if not text:
        return [], []
    letters = pairbitmaps._letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], []
    span = lambda x: list(zip(np.cumsum([0, *map(len, x)])[:-1].tolist(), np.cumsum([*map(len, x)]).tolist(), strict=True))
    sa, sb = span(bytes_a), span(bytes_b)
    links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]] if len(sa) < 500 else [(i, i) for i in range(len(sa))]
    ends = sorted({y for _, y in sa} & {y for _, y in sb})
    groups = [",".join(str(i) for i, s in zip(ids_a, sa, strict=True) if lo < s[1] <= hi) + "|" + ",".join(str(i) for i, s in zip(ids_b, sb, strict=True) if lo < s[1] <= hi) for lo, hi in zip([0, *ends], ends, strict=False)] if len(sa) < 500 else None
    return groups, [(ids_a[i], ids_b[j]) for i, j in links]


def test_link_scores_equal_plain_loops(spark, odd):
    rows, df = odd
    rows, df = [r for r in rows if len(r[1] or "") < 2000], df.filter("text is null or length(text) < 2000")
    a, b = tokenizers.Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    plain = [(i, *plain_alignment(t, a, b)) for i, t in rows]
    count = Counter(p for _, _, links in plain for p in set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    want = sorted((i is None, i or 0, len(g), len(k), sum(count[p] == top[p[0]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, g, k in plain)
    scored = pairbitmaps.link_scores(df, BYTES, PIECES)
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_groups"], x["n_links"], x["n_best"], x["count_sum"], x["groups_sha256"]) for x in scored.collect()) == want
    told = pairbitmaps.alignments(df, BYTES, PIECES).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["groups"]) for x in told) == sorted((i is None, i or 0, ";".join(g)) for i, g, _ in plain)
    assert all(x["n_a"] + x["n_b"] - x["n_groups"] == x["n_links"] for x in told)
    assert pairbitmaps.link_scores(df.limit(0), BYTES, PIECES).count() == 0


def test_bitmaps_of_slices_are_merged(spark, odd, monkeypatch):
    rows, df = odd
    order = lambda x: sorted(map(str, x.collect()))
    whole = order(pairbitmaps.link_scores(df, BYTES, PIECES))
    monkeypatch.setattr(vocab, "SLICE", 200)
    # patched in this process alone, so the block is made here, of many slices
    sides = pairbitmaps.Sides(vocab.contents(BYTES), vocab.contents(PIECES))
    some, n, parts = pa.array([t for _, t in rows]), 0, []
    for lo, hi, data, at in vocab.text_slices(some):
        x = pairbitmaps.Aligned(sides, data, at)
        parts.append(np.unique((x.a[x.link_a].astype(np.int64) << 20 | x.b[x.link_b]) << 16 | x.text + lo, return_counts=True))
        n += hi - lo
    pairs, bitmaps, planes = pairbitmaps.merged(parts)
    of, place = pairbitmaps.unpacked(pa.array(bitmaps, pa.binary()))
    links = np.bincount(place, minlength=n)
    for i, extra in enumerate(planes):
        for k, plane in enumerate(extra):
            links[pairbitmaps.unpacked(pa.array([plane], pa.binary()))[1]] += 1 << k
    assert sorted(links.tolist()) == sorted(int(re.search(r"n_links=(\d+)", x)[1]) for x in whole) and len(pairs) == len(bitmaps)


def test_bitmaps_come_back_and_are_counted(spark):
    r = random.Random(4)
    sets = [sorted(r.sample(range(r.choice([9, 300, 65_536])), r.randint(1, 9))) for _ in range(200)] + [list(range(65_536)), list(range(0, 65_536, 2)), [65_535]]
    packed = [pairbitmaps.packed(np.array(s)) for s in sets]
    of, place = pairbitmaps.unpacked(pa.array([*packed, b"\0"], pa.binary()))
    got = [[] for _ in sets]
    for i, p in zip(of.tolist(), place.tolist(), strict=True):
        got[i].append(p)
    assert got == sets and max(map(len, packed)) < 8200
    df = spark.createDataFrame([(bytearray(p),) for p in packed], "b binary").select(pairbitmaps.popcount(F.col("b")))
    assert [x[0] for x in df.collect()] == [len(s) for s in sets]
