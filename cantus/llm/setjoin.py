"""Exact Jaccard join of n-gram sets by universe partition and pigeonhole.

Sets that link differ in few elements: of sizes s <= l with similarity of 3/4
or more, in (s + l) / 7 at most, which is s / 3 for the smaller set and 2 l / 7
for the larger. The universe is partitioned by hash into m segments, m growing
with a band of sizes; then all but that many segments of the two sets are
equal. Every non-empty segment is a signature. A set's allocation of the
difference to its segments follows their cost:

* rare signatures get 1: equal segments meet there;
* signatures that many sets hold get 0: they are not searched, which a set can
  afford while its rare ones outnumber the differences it may have;
* a set that can't afford it gives 2 to as many of its rare segments as it needs,
  those that meet the fewest others first: they also meet with one element left
  out (the one-deletion neighbourhood);
* sets that even so lack the budget meet through all of their signatures.

Candidates are verified on the sets themselves. Before the search among the
members of a signature, each is compared with a leader of them, in several rounds; those that
link so form one component, and only pairs between components are left. Of these
a join gives only the pairs whose sizes and sketches of fixed size allow a link.
Sets that are equal are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantus.llm.bytesoup import mix, slices
from cantus.llm.components import connected
from cantus.llm.store import spent, written

NGRAM = 5
#: Bytes of text that a task looks at at once.
SLICE = 1 << 19
#: Similarity of a link, in hundredths.
PER_CENT = 75
#: Sizes grow by this factor from band to band; a set takes part in its own band and in those that a smaller partner may have.
BAND = 16 / 9
#: Segments of a band, as a share of its largest size; small sets get so many that hardly two elements share one.
SEGMENTS, SMALL, SMALL_SEGMENTS = 0.5, 32, 128.0
#: A signature of more classes than this is frequent.
FREQUENT = 32
#: Rounds in which members of a frequent signature are compared with so many leaders.
ROUNDS, LEADERS = 3, 8
#: Bits of the filter that lets only candidates' texts through; saturation costs time, not results.
FILTER_BITS = 1 << 22
#: Parities that the joins compare, 64 to a column.
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
_K = np.uint64(0xD6E8FEB86659FD93)


def band_edges() -> np.ndarray:
    e = [1]
    while e[-1] < 1 << 40:
        e.append(max(e[-1] + 1, int(np.ceil(e[-1] * BAND))))
    return np.array(e)


EDGES = band_edges()


def segments_of(band: int) -> int:
    most = EDGES[band + 1] - 1
    return int(np.ceil((SMALL_SEGMENTS if most <= SMALL else SEGMENTS) * most)) + 1


def differences(n: int, band: int) -> int:
    """The most elements in which a set of n differs from a partner, when the smaller of the two is of this band."""
    return n // 3 if EDGES[band] <= n < EDGES[band + 1] else (n + int(EDGES[band + 1]) - 1) // 7


def sets_of(s) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct n-grams of each text of a slice; a shorter text is one n-gram, one without words has none."""
    h = s.hashes()
    if len(h) >= NGRAM:
        g = h[: len(h) - NGRAM + 1].copy()
        for k in range(1, NGRAM):
            g = mix(g * _K + h[k : len(h) - NGRAM + 1 + k])
    else:
        g = np.zeros(0, np.uint64)
    for a, z in zip(s.first[:-1], s.first[1:], strict=True):
        if z - a >= NGRAM:
            yield np.unique(g[a : z - NGRAM + 1])
        elif z > a:
            x = np.array([z - a], np.uint64)
            for k in range(a, z):
                x = mix(x * _K + h[k : k + 1])
            yield x
        else:
            yield np.zeros(0, np.uint64)


def class_of(x: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets share it."""
    return int((mix(np.array([x.sum(dtype=np.uint64) ^ (np.uint64(len(x)) << np.uint64(40)) ^ np.bitwise_xor.reduce(mix(x))], np.uint64))).view(np.int64)[0])


def bands_of(n: int) -> list[int]:
    """The set's own band, and lower ones that hold partners of 3/4 of its size or more."""
    own = int(np.searchsorted(EDGES, n, "right")) - 1
    least = -(-n * PER_CENT // 100)
    return [b for b in range(own, -1, -1) if EDGES[b + 1] > least]


def parts(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty segments of a sorted set in a band: number, first element's index, sum of mixed hashes."""
    m = np.uint64(segments_of(band))
    seg = ((x >> np.uint64(32)) * m) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    return seg[first], first, np.add.reduceat(mix(x ^ _K), first)


def signature(band: int, seg: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A name of 64 bits; the lowest six are the band."""
    x = mix(total * _K + mix(seg * np.uint64(1 << 20) + np.uint64(band + 1)))
    return ((x & ~np.uint64(63)) | np.uint64(band)).view(np.int64)


def band_of(sig: str = "sig") -> Column:
    return F.col(sig).bitwiseAND(F.lit(63)).cast("int")


def folded(x: np.ndarray) -> bytes:
    """Parities of the set's elements by hash range, a power of two of bits near four times its size: a bound for differences."""
    bits = max(6, (4 * len(x) - 1).bit_length())
    return np.packbits(np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their parities; the longer one is folded to the shorter one's ranges."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = np.packbits(np.bitwise_xor.reduce(np.unpackbits(x).reshape(len(y) * 8, -1), axis=1))
    return int(np.unpackbits(x ^ y).sum())


def budget(x: np.ndarray, band: int) -> tuple[int, int, int]:
    """Non-empty segments, those of two elements or more, and the differences that a partner may have."""
    seg, first, _ = parts(x, band)
    return len(seg), int((np.diff(np.append(first, len(x))) > 1).sum()), differences(len(x), band)


FEATURES = "doc_id bigint, row bigint, n bigint, cls bigint, fold binary, bands array<array<int>>"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, text to FEATURES; bands: for each band of the set its number and budget()."""
    for b in batches:
        n, cls, fold, bands = [], [], [], []
        for s in slices(b.column("text"), size=SLICE):
            for x in sets_of(s):
                n.append(len(x))
                cls.append(class_of(x) if len(x) else None)
                fold.append(folded(x) if len(x) else None)
                bands.append([[k, *budget(x, k)] for k in bands_of(len(x))] if len(x) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(fold, pa.binary()), pa.array(bands, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "row", "n", "cls", "fold", "bands"])


def all_segments(x: np.ndarray, band: int) -> np.ndarray:
    """Signatures of a set in a band. Where its differences can touch all of its segments, it gets one that all such sets of the band share."""
    seg, first, total = parts(x, band)
    sig = signature(band, seg, total)
    full, many, most = budget(x, band)
    return np.append(sig, signature(band, np.array([1 << 40], np.uint64), np.array([1], np.uint64))) if full <= most else sig


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text to sig, cls: each signature of each class, once in a task."""
    seen: set[int] = set()
    for b in batches:
        for s in slices(b.column("text"), size=SLICE):
            sig, cls = [], []
            for x in sets_of(s):
                if not len(x) or (c := class_of(x)) in seen:
                    continue
                seen.add(c)
                for band in bands_of(len(x)):
                    sig.append(all_segments(x, band))
                    cls.append(np.full(len(sig[-1]), c, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(cls))], names=["sig", "cls"])
        if len(seen) > 1_000_000:  # bounded memory; what repeats then is dropped later
            seen.clear()


def filter_words(ids: DataFrame, col: str) -> np.ndarray:
    """A bit filter of fixed size over a column: FILTER_BITS / 64 rows at most come to the driver."""
    bit = F.pmod(F.col(col), F.lit(FILTER_BITS))
    got = ids.select(F.floor(bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod({col}, {FILTER_BITS}), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in got:
        words[r["w"]] = r["b"]
    return words


def sets_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """cls, elements (sorted hashes) of the classes in ``ids``, from a second look at the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_words(ids, "cls"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            for s in slices(b.column("text"), size=SLICE):
                cls, rows, seen = [], [], set()
                for x in sets_of(s):
                    if len(x) and (c := class_of(x)) not in seen:
                        seen.add(c)
                        bit = c % FILTER_BITS
                        if int(words[bit // 64]) >> (bit % 64) & 1:
                            cls.append(c)
                            rows.append(x.tobytes())
                if cls:
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(rows, pa.binary())], names=["cls", "elements"])

    found = docs.select("text").mapInArrow(work, "cls bigint, elements binary")
    return found.join(ids.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def linked(common: int, a: int, b: int) -> bool:
    """Links: 100 * intersection >= 75 * union."""
    return 100 * common >= PER_CENT * (a + b - common)


def near(a: Column, b: Column, n: Column) -> Column:
    """Whether the parities of two sets of together n elements allow a link."""

    @F.pandas_udf("boolean")
    def check(x, y, n):
        import pandas as pd

        return pd.Series([7 * least_difference(p, q) <= k for p, q, k in zip(x, y, n, strict=True)])

    return check(a, b, n)


def sketch(x: np.ndarray) -> np.ndarray:
    """Parities of the set's elements by hash range, SKETCH_BITS of them as 64-bit numbers."""
    at = (x >> np.uint64(64 - (SKETCH_BITS - 1).bit_length())).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def may_link(a: str, b: str) -> Column:
    """Whether sizes and sketches of two sets allow a link; a, b: structs of n and SKETCH. No link is dropped: the sets differ in as many elements as the sketches in bits, at least."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = F.lit(0)
    for k in SKETCH:
        differ = differ + F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}")))
    return (100 * F.least(na, nb) >= PER_CENT * F.greatest(na, nb)) & (7 * differ <= na + nb)


def sketched(members: DataFrame, reps: DataFrame) -> DataFrame:
    """The members with ``set``, what may_link() looks at. Sets grow with the input: they are never broadcast."""
    return members.join(reps.select("cls", F.struct("n", *SKETCH).alias("set")).hint("merge"), "cls")


def verify(pairs: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, judged first by sizes and parities, then by the sets."""
    reps = reps.select("cls", "n", "fold", "x")
    x = pairs.join(reps.toDF("a", "na", "fa", "xa"), "a").join(reps.toDF("b", "nb", "fb", "xb"), "b")
    x = x.filter((F.col("xa") + F.col("xb") <= 0) & (100 * F.least("na", "nb") >= PER_CENT * F.greatest("na", "nb")) & near(F.col("fa"), F.col("fb"), F.col("na") + F.col("nb"))).select("a", "b")

    @F.pandas_udf("boolean")
    def judge(p, q):
        import pandas as pd

        out = []
        for u, v in zip(p, q, strict=True):
            u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
            at = np.minimum(np.searchsorted(u, v), len(u) - 1)
            out.append(linked(int((u[at] == v).sum()), len(u), len(v)))
        return pd.Series(out)

    y = x.join(sets.toDF("a", "ea"), "a").join(sets.toDF("b", "eb"), "b")
    return y.filter(judge("ea", "eb")).select("a", "b")


def deletions(sets: DataFrame, poor: DataFrame) -> DataFrame:
    """sig, cls, whole, own: the segments of the classes in ``poor``, as they are and with each one element left out; own is the signature as it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, cls, whole, full = [], [], [], []
            for c, raw in zip(b.column("cls").to_pylist(), b.column("elements").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.uint64)
                one = mix(x ^ _K)
                for band in bands_of(len(x)):
                    seg, first, total = parts(x, band)
                    name = signature(band, seg, total)
                    size = np.diff(np.append(first, len(x)))
                    of = np.repeat(np.arange(len(seg)), size)
                    el = np.flatnonzero(size[of] > 1)  # of a single element nothing would be left
                    cut = signature(band, seg[of[el]], total[of[el]] - one[el])
                    sig += [name, cut]
                    full += [name, name[of[el]]]
                    whole += [np.ones(len(name), bool), np.zeros(len(cut), bool)]
                    cls.append(np.full(len(name) + len(cut), c, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, cls, whole, full)], names=["sig", "cls", "whole", "own"])

    return sets.join(poor.select("cls"), "cls", "left_semi").mapInArrow(work, "sig bigint, cls bigint, whole boolean, own bigint")


def between(members: DataFrame, comp: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a signature and can link by excess() and may_link(); ``members`` has sig, cls, x."""
    m = members.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    w = Window.partitionBy("sig")
    m = m.withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w)).withColumn("least", F.min("x").over(w)).filter("lo < hi AND x + least <= 0").select("sig", "cls", "comp", "x")
    m = sketched(m, reps).select("sig", "cls", "comp", "x", "set")
    other = m.toDF("sig", "b", "bcomp", "bx", "bset")
    return m.join(other, "sig").filter((F.col("cls") < F.col("b")) & (F.col("comp") != F.col("bcomp")) & (F.col("x") + F.col("bx") <= 0) & may_link("set", "bset")).select(F.col("cls").alias("a"), "b").distinct()


def text_key() -> Column:
    """With doc_id, what tells rows of different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def ngram_components(docs: DataFrame) -> DataFrame:
    """row_components() without ``row``."""
    return row_components(docs).drop("row")


def row_components(docs: DataFrame) -> DataFrame:
    """doc_id, row (text_key() of its text), n_shingles, component_id: components of documents linked by similar n-gram sets.

    Null texts, empty ones and those without words have an empty set and are linked with nothing; a
    text of under five words is one n-gram. Rows that repeat a doc_id are
    returned each. A null doc_id keeps a null component unless it links to others.
    Other columns are ignored. Sets are compared by 64-bit hashes of their n-grams.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("row"), "text")
    feats = written(docs.mapInArrow(features, FEATURES))
    reps = written(feats.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min(F.struct("n", "fold", "bands")).alias("x")).select("cls", "rep", "x.*"))
    comp = connected(links(docs, reps))
    label = reps.select("cls", "rep").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    label = label.join(label.groupBy("comp").agg(F.min("rep").alias("component")), "comp")
    out = feats.select("doc_id", "row", "n", "cls").join(label.select("cls", "component"), "cls", "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links between classes, enough of them to connect all that are connected."""
    sigs = docs.select("text").mapInArrow(signatures, "sig bigint, cls bigint")
    raw = written(met(sigs).distinct())
    bands = reps.select("cls", F.explode("bands").alias("x")).select("cls", F.col("x")[0].alias("band"), F.col("x")[1].alias("full"), F.col("x")[2].alias("many"), F.col("x")[3].alias("most"))
    # the cost of a signature: classes that hold it
    first = raw.withColumn("held", F.count("*").over(Window.partitionBy("sig")))
    shared = written(met(prefixes(first, bands)))
    hot = written(first.filter(F.col("held") > FREQUENT).select(F.col("sig").alias("own")).distinct().withColumn("hot", F.lit(True)))
    spent(raw)
    alive = written(shared.select("cls").distinct())
    bands = bands.join(alive, "cls", "left_semi")
    sets = written(sets_table(docs, alive))
    reps = written(reps.select("cls", "n", "fold").join(excess(sets), "cls"))
    shared = written(hopeful(shared, reps))
    spark = docs.sparkSession
    edges, comp = spark.createDataFrame([], "a bigint, b bigint"), spark.createDataFrame([], "cls bigint, comp bigint")
    often = written(shared.filter(F.col("held") > FREQUENT).select("sig", "cls", "x"))
    # first each set with one leader, then all pairs of rare signatures, then more leaders of the frequent ones
    for pairs in (lambda c: led(shared, c, 0, 1), lambda c: between(shared.filter(F.col("held") <= FREQUENT).select("sig", "cls", "x"), c, reps), *(lambda c, turn=turn: led(often, c, turn, LEADERS) for turn in range(1, ROUNDS + 1))):
        more = written(verify(pairs(comp), reps, sets))
        if not more.isEmpty():
            edges, comp = edges.union(more), joined(comp, more)
    # whose rarest signatures don't suffice: all rare ones of these are among the searched ones
    poor = written(often.select("cls").distinct())
    if poor.isEmpty():
        return edges
    ring = written(deletions(sets, poor).join(hot, "own", "left").select("sig", "cls", "own", "whole", F.col("hot").isNull().alias("cold")))
    bands = bands.join(poor, "cls", "left_semi")
    last = written(short(ring, bands))
    more = written(verify(crossing(ring.join(reps.select("cls", "x").hint("merge"), "cls"), comp, reps, bands, last), reps, sets))
    edges = edges.union(more)
    if last.isEmpty():
        return edges
    comp = joined(comp, more)
    return edges.union(written(verify(between(often.join(last, "cls", "left_semi").select("sig", "cls", "x"), comp, reps), reps, sets)))


def excess(sets: DataFrame) -> DataFrame:
    """cls, x, SKETCH; x is seven times the elements that no other of these sets has, less the set's size.

    Such elements are differences from any partner, and of two sets that link differences are a seventh of both sizes at most: their x add up to 0 or less.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(e, np.int64) for e in b.column("elements").to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.repeat(b.column("cls").to_numpy(), [len(e) for e in rows]))], names=["e", "cls"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(e, np.uint64) for e in b.column("elements").to_pylist()]
            if rows:
                bits = np.stack([sketch(x) for x in rows])
                yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([len(x) for x in rows], pa.int64()), *(pa.array(x) for x in bits.T)], names=["cls", "size", *SKETCH])

    held = sets.select("cls", "elements").mapInArrow(elements, "e bigint, cls bigint").groupBy("e").agg(F.min("cls").alias("cls"), F.count("*").alias("n"))
    own = held.filter("n = 1").groupBy("cls").agg(F.count("*").alias("own"))
    sized = sets.select("cls", "elements").mapInArrow(sketches, "cls bigint, size bigint, " + ", ".join(f"{k} bigint" for k in SKETCH))
    return sized.join(own, "cls", "left").select("cls", (7 * F.coalesce("own", F.lit(0)) - F.col("size")).alias("x"), *SKETCH)


def hopeful(members: DataFrame, reps: DataFrame) -> DataFrame:
    """The members (sig, cls, ...) with x, without those that no other set of their signature can link with by excess()."""
    m = members.join(reps.select("cls", "x").hint("merge"), "cls")
    least = F.min("x").over(Window.partitionBy("sig"))
    return met(m.withColumn("least", least).filter("x + least <= 0").drop("least"))


def prefixes(first: DataFrame, bands: DataFrame) -> DataFrame:
    """sig, cls, held: of each class and band, the signatures that a search needs, the rarest ones.

    Differences spoil ``most`` of a set's signatures, so that of its ``most`` + 1 first ones in an order common to all sets one is among as many
    first ones of each partner. Signatures that no other class holds are the first in that order; they find nothing, but count.
    Sets whose differences can touch all of their segments keep all.
    """
    x = first.withColumn("band", band_of())
    own = Window.partitionBy("cls", "band")
    x = x.withColumn("shared", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("held", "sig")))
    x = x.join(bands, ["cls", "band"])
    return x.filter((F.col("full") <= F.col("most")) | (F.col("full") - F.col("shared") + F.col("place") <= F.col("most") + 1)).select("sig", "cls", "held")


def led(members: DataFrame, comp: DataFrame, turn: int, leaders: int) -> DataFrame:
    """Pairs (a, b) of the members (sig, cls, x) with the leaders of their signatures that are of other components; leaders are the first ones by a hash.

    With one leader, a set is compared with the first of its signatures' leaders alone. So large groups of like sets become few components before
    all pairs of components are compared; what isn't found here is found there.
    """
    m = members.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    w = Window.partitionBy("sig")
    m = m.withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w)).filter("low < high").select("sig", "cls", "comp", "x", F.xxhash64(F.lit(turn), "cls").alias("h"))
    if leaders == 1:
        m = m.withColumn("lead", F.min(F.struct("h", "comp", "cls", "x")).over(w)).filter("lead.comp != comp AND lead.x + x <= 0").groupBy("cls").agg(F.min("lead").alias("lead"))
        return m.select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")).distinct()
    m = m.withColumn("place", F.row_number().over(w.orderBy("h", "cls")))
    first = m.filter(F.col("place") <= leaders).select("sig", F.col("cls").alias("l"), F.col("comp").alias("lc"), F.col("x").alias("lx"))
    return m.join(first, "sig").filter("comp != lc AND x + lx <= 0").select(F.least("cls", "l").alias("a"), F.greatest("cls", "l").alias("b")).distinct()


def joined(comp: DataFrame, more: DataFrame) -> DataFrame:
    """cls, comp after further links: components are joined as wholes, so that only the new links are walked."""
    x = more.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    ends = written(x.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    over = connected(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    every = comp.union(ends.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("ca").alias("comp")), F.struct(F.col("b").alias("cls"), F.col("cb").alias("comp")))).alias("x")).select("x.*")).distinct()
    return written(every.join(over.toDF("comp", "via"), "comp", "left").select("cls", F.coalesce("via", "comp").alias("comp")))


def met(sigs: DataFrame) -> DataFrame:
    """The rows of signatures that more than one class holds."""
    w = Window.partitionBy("sig")
    x = sigs.withColumn("low", F.min("cls").over(w)).withColumn("high", F.max("cls").over(w))
    return x.filter("low < high").drop("low", "high")


def crossing(ring: DataFrame, comp: DataFrame, reps: DataFrame, bands: DataFrame, last: DataFrame) -> DataFrame:
    """(a, b): classes of different components of which one has a signature with an element left out and the other one has it whole; one of the two searches there.

    Of two classes the first one searches, or the one that is not of ``last``; those of ``last`` meet one another elsewhere. Signatures whose classes are all of one component drop out first, and classes that can link with no other one there.
    """
    w = Window.partitionBy("sig")
    x = ring.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    x = x.withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w)).withColumn("least", F.min("x").over(w))
    x = x.withColumn("wholes", F.count(F.when(F.col("whole"), 1)).over(w)).withColumn("cuts", F.count(F.when(~F.col("whole"), 1)).over(w))
    meets = F.when(F.expr("low < high AND x + least <= 0"), F.when(F.col("whole"), F.col("cuts")).otherwise(F.col("wholes"))).otherwise(0)
    x = written(x.select("sig", "cls", "own", "comp", "x", "whole", "cold", meets.alias("meets")))
    search = searched(x, bands).join(last, "cls", "left_anti").withColumn("search", F.lit(True))
    found = x.filter("meets > 0").join(search, ["cls", "own"], "left").join(last.withColumn("late", F.lit(True)), "cls", "left").na.fill(False, ["search", "late"])
    found = written(sketched(found, reps).select("sig", "cls", "comp", "x", "whole", "search", "late", "set"))
    spent(x)
    one, two = (found.filter(which).select("sig", *(F.col(c).alias(k + c) for c in found.columns if c not in ("sig", "whole"))) for k, which in (("p", "whole"), ("q", "not whole")))
    asked = F.expr("psearch AND (qlate OR pcls < qcls) OR qsearch AND (plate OR qcls < pcls)")
    pairs = one.join(two, "sig").filter(asked & F.expr("pcomp != qcomp AND px + qx <= 0") & may_link("pset", "qset"))
    return pairs.select(F.least("pcls", "qcls").alias("a"), F.greatest("pcls", "qcls").alias("b")).distinct()


def searched(ring: DataFrame, bands: DataFrame) -> DataFrame:
    """cls, own: the rare segments that a class searches with an element left out.

    Each rare one is worth 1 as it is, as equal ones have met, and another 1 with an element left out. A set needs a worth of more than the
    differences it may have in the band; so many are searched, those that meet the fewest others first. Sets that can't reach it are short().
    """
    seg = ring.filter("cold").groupBy("cls", "own").agg(F.count(F.when(~F.col("whole"), 1)).alias("cuts"), F.sum("meets").alias("cost"))
    w = Window.partitionBy("cls", "band")
    seg = seg.withColumn("band", band_of("own")).withColumn("worth", F.count("*").over(w)).filter("cuts > 0").withColumn("place", F.row_number().over(w.orderBy("cost", "own")))
    return seg.join(bands, ["cls", "band"]).filter("worth + place <= most + 1").select("cls", "own")


def short(ring: DataFrame, bands: DataFrame) -> DataFrame:
    """cls: classes whose rare segments don't outnumber the differences they may have in some band, not even when those of two elements or more count twice."""
    frequent = ring.filter("whole AND NOT cold").groupBy("cls", band_of().alias("band")).agg(F.count("*").alias("frequent"))
    x = bands.join(frequent, ["cls", "band"], "left").withColumn("frequent", F.coalesce("frequent", F.lit(0)))
    return x.filter(F.col("full") - F.col("frequent") + F.greatest(F.lit(0), F.col("many") - F.col("frequent")) <= F.col("most")).select("cls").distinct()
