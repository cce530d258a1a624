"""Alignment of two tokenizers, and how often their tokens stand for each other in a corpus.

Both cut the same bytes; an A token and a B token are linked where their bytes overlap, and where both end a group
ends. An inverted list has, for each pair of linked ids, the documents that hold it: a bitmap of places in a block of documents, packed as a
list of places or as bits, whichever is shorter, and planes that say how often a document holds it (plane k: the bit of 2**k of that number less one).

Slices of a block make bitmaps of their own, which are OR-merged when the block is full. Blocks are written once, to the folder that
all executors share, so places of documents stay the same when a task runs again. They hold different documents: a pair's bitmap in the corpus is that
of its blocks side by side, and its documents are the sum of their popcounts, which is partly added before the shuffle. The count, and whether its A id
has no higher one, go back to the blocks that hold the pair, whose bitmaps and planes hand them to their documents. What moves
follows the pairs of a block, not its links: a pair that all documents hold is one row a block, so none is hot.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantus.llm import vocab as V
from cantus.llm.store import written

#: A block ends past so many bytes of text, or at PLACES documents; texts are aligned in slices of so many bytes.
BLOCK, PLACES, SLICE = 6_000_000, 65_536, 1_000_000
LONG, BIN = T.LongType(), T.BinaryType()
TALLY = ["n_a", "n_b", "n_groups", "n_links"]


@lru_cache(1)
def sides_of(byte_level: bytes, pieces: bytes) -> Sides:
    """Both tokenizers, kept with what they remember while a worker lives."""
    return Sides(byte_level, pieces)


class Sides:
    """Both tokenizers: ids of texts, and the bytes of ids."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        a = tokenizers.Tokenizer.from_str(byte_level.decode())
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        model = V.read_pieces(pieces)
        letters = _letters()
        entries = sorted(a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = _column({i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in entries})
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if k == 6 else p.replace(V.MARK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)], pa.large_binary())
        self.b_beside = np.zeros(256 * 256, bool)
        for p, k in zip(model.pieces, model.kinds, strict=True):
            if k == 1:
                x = np.frombuffer(p.replace(V.MARK, " ").encode(), np.uint8).astype(int)
                self.b_beside[x[:-1] * 256 + x[1:]] = True
        if not model.prefix:
            raise ValueError("the pieces must add a space before a text")
        self.a_memo = V.Memo(lambda parts: [e.ids for e in a.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)] if parts else [])
        # the library adds the space that a part begins with, but to nothing
        self.b_memo = V.Memo(lambda parts: [x or [b.piece_to_id(V.MARK)] for x in b.encode([p[1:].decode() for p in parts], num_threads=1)] if parts else [])

    def a_ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, cut where a token always ends: before white space behind another character, before what is no letter behind a letter, and behind a single end of line.

        Characters that these rules know are those below 128 and, as letters or others that are no white space, those of two bytes.
        """
        heads = np.zeros(len(data), bool)
        if len(data) > 2:
            ascii_letter = (data | 32 >= 97) & (data | 32 <= 122)
            two = np.zeros(len(data), bool)  # the second byte of a character of two, none of which with these first ones is white space
            two[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
            latin = np.zeros(len(data), bool)
            latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            solid = (data > 32) & (data < 127) | two
            white = (data == 32) | (data == 9) | (data == 10) | (data == 13)
            heads[1:] = solid[:-1] & white[1:] | (ascii_letter | latin)[:-1] & ~ascii_letter[1:] & (data[1:] < 128)
            begins = (data > 32) & (data < 127) | (data >= 0xC3) & (data <= 0xDF) | (data >= 0xE4) & (data <= 0xF4)
            heads[2:] |= solid[:-2] & (data[1:-1] == 10) & begins[2:]
        return _gathered(self.a_memo, data, at, heads)

    def b_ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with a space before each. They are cut before spaces that no piece has behind the byte before."""
        heads = np.zeros(len(data), bool)
        if len(data):
            heads[1:] = (data[1:] == V.SPACE) & ~self.b_beside[data[:-1].astype(np.int64) * 256 + V.SPACE]
        return _gathered(self.b_memo, data, at, heads)


@lru_cache(2)
def numerals(top: int) -> pa.Array:
    """Numbers below ``top`` before a comma, before a bar, and before a semicolon."""
    return pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(top)], pa.large_binary())


def _letters() -> dict[str, int]:
    """Characters of a byte-level vocabulary and their bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _column(entries: dict[int, bytes]) -> pa.Array:
    return pa.array([entries.get(i, b"") for i in range(max(entries) + 1)], pa.large_binary())


def _gathered(memo: V.Memo, data: np.ndarray, at: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads[at[:-1][at[:-1] < at[1:]]] = True
    cuts = np.concatenate([np.flatnonzero(heads), [len(data)]])
    ids, begin = memo(data, cuts)
    return ids, begin[np.searchsorted(cuts, at)]


def same_bytes(entries: pa.Array, ids: np.ndarray, begin: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts their tokens' bytes spell, and how many bytes each token has."""
    size = np.diff(np.frombuffer(entries.buffers()[1], np.int64)[: len(entries) + 1])[ids]
    ends = np.concatenate([[0], np.cumsum(size)])[begin]
    spelled = V.joined(entries, ids)
    same = np.diff(ends) == np.diff(at)
    if same.all():
        wrong = np.concatenate([[0], np.cumsum(spelled != data)])
        return wrong[at[1:]] == wrong[at[:-1]], size
    return np.array([ok and np.array_equal(spelled[ends[i] : ends[i + 1]], data[at[i] : at[i + 1]]) for i, ok in enumerate(same)], bool), size


class Aligned:
    """Tokens of a slice of texts, their groups and their links. Texts that one side doesn't spell have none."""

    def __init__(self, sides: Sides, data: np.ndarray, at: np.ndarray):
        data, at = V.spaced(data, at)
        a, a_at = sides.a_ids(data, at)
        b, b_at = sides.b_ids(data, at)
        ok_a, a_size = same_bytes(sides.a_bytes, a, a_at, data, at)
        ok_b, b_size = same_bytes(sides.b_bytes, b, b_at, data, at)
        ok = ok_a & ok_b
        self.n = len(ok)
        (self.a, a_size, self.a_at), (self.b, b_size, self.b_at) = _only(a, a_size, a_at, ok), _only(b, b_size, b_at, ok)
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        # ends grow through the whole slice; both sides spell the same bytes, so each text ends in both
        every = np.concatenate([a_end, b_end])
        every.sort(kind="stable")  # two sorted halves
        every = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
        self.link_a, self.link_b = np.searchsorted(a_end, every), np.searchsorted(b_end, every)
        self.text = np.searchsorted(self.a_at, self.link_a, "right") - 1
        self.group_ends = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end] if len(a_end) else a_end
        self.a_end, self.b_end = a_end, b_end
        own = np.searchsorted(self.a_at, np.searchsorted(a_end, self.group_ends), "right") - 1
        self.n_groups, self.n_links = (np.bincount(x, minlength=self.n) for x in (own, self.text))

    def groups(self) -> pa.Array:
        """Each text's groups, written as A ids, a bar and B ids; groups stand apart by semicolons."""
        ga, gb = np.searchsorted(self.group_ends, self.a_end), np.searchsorted(self.group_ends, self.b_end)
        na, nb = np.bincount(ga, minlength=len(self.group_ends)), np.bincount(gb, minlength=len(self.group_ends))
        begin, a_first, b_first = np.cumsum(na + nb) - na - nb, np.cumsum(na) - na, np.cumsum(nb) - nb
        a_last, b_last = np.arange(len(self.a)) == (a_first + na - 1)[ga], np.arange(len(self.b)) == (b_first + nb - 1)[gb]
        top = 1 << max(int(self.a.max(initial=0)), int(self.b.max(initial=0)), 1).bit_length()
        words = numerals(top)
        order = np.zeros(len(self.a) + len(self.b), np.int64)
        order[begin[ga] + np.arange(len(self.a)) - a_first[ga]] = self.a + top * a_last
        order[(begin + na)[gb] + np.arange(len(self.b)) - b_first[gb]] = self.b + 2 * top * b_last
        size = np.diff(np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1])[order]
        ends = np.concatenate([[0], np.cumsum(size)])[self.a_at + self.b_at]
        data = V.joined(words, order)
        some = ends[1:] > ends[:-1]
        data = np.delete(data, ends[1:][some] - 1)  # no semicolon behind the last one
        return V.texts_of(data, ends - np.concatenate([[0], np.cumsum(some)]))


def _only(ids: np.ndarray, size: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(at)
    stay = np.repeat(ok, n)
    return ids[stay], size[stay], np.concatenate([[0], np.cumsum(n * ok)])


def packed(places: np.ndarray) -> bytes:
    """A bitmap of ascending places below 65,536: mark 0 and a list of them, or mark 1 and bits where that is shorter."""
    n = int(places[-1]) // 8 + 1
    if 2 * len(places) <= n:
        return b"\0" + places.astype("<u2").tobytes()
    return b"\1" + np.packbits(np.bincount(places, minlength=8 * n).astype(bool), bitorder="little").tobytes()


def unpacked(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the bitmap, and place, of each bit that is set in a column of bitmaps."""
    n = len(bitmaps)
    off = np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset : bitmaps.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(bitmaps.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
    bits = raw[off[:-1]] == 1 if n else np.zeros(0, bool)
    size = np.where(bits, 0, (np.diff(off) - 1) // 2)
    which = np.repeat(np.arange(n), size)
    at = off[which] + 1 + 2 * (np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size))
    owner, place = [which], [raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8]
    for i in np.flatnonzero(bits):
        x = np.flatnonzero(np.unpackbits(raw[off[i] + 1 : off[i + 1]], bitorder="little"))
        owner.append(np.full(len(x), i))
        place.append(x)
    return np.concatenate(owner), np.concatenate(place)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[bytes], list[list[bytes]]]:
    """Pairs, their bitmaps and their planes, of links of a block's slices: (pair, place) as one number, and how often."""
    key, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")  # the slices hold different places
    key, times = key[order], times[order]
    places = key & 0xFFFF
    first = np.flatnonzero(np.concatenate([[True], np.diff(key >> 16) != 0])) if len(key) else np.zeros(0, np.int64)
    last, most = np.append(first[1:], len(key)), np.maximum.reduceat(times, first) if len(first) else first
    raw, bitmaps, planes = places.astype("<u2").tobytes(), [], []
    for lo, hi, top in zip(first.tolist(), last.tolist(), most.tolist(), strict=True):
        bitmaps.append(b"\0" + raw[2 * lo : 2 * hi] if hi - lo == 1 else packed(places[lo:hi]))
        planes.append([])
        for k in range((top - 1).bit_length()):
            has = places[lo:hi][times[lo:hi] - 1 >> k & 1 == 1]
            planes[-1].append(packed(has) if len(has) else b"\0")
    return key[first] >> 16, bitmaps, planes


def _aligned(docs: DataFrame, byte_level: str, pieces: str, text: str, keep: tuple[str, ...], work, more: list[T.StructField]) -> DataFrame:
    """Runs ``work(sides, batches)`` over kept and text. Both tokenizers are fixed files; their bytes are sent to all tasks."""
    raw = docs.sparkSession.sparkContext.broadcast((V.contents(byte_level), V.contents(pieces)))
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("kept", rows.schema["kept"].dataType), *[T.StructField(c, LONG) for c in TALLY], *more])
    return rows.mapInArrow(lambda batches: work(sides_of(*raw.value), batches), schema)


def _tallies(x: Aligned) -> list[pa.Array]:
    return [pa.array(c.astype(np.int64)) for c in (np.diff(x.a_at), np.diff(x.b_at), x.n_groups, x.n_links)]


def alignments(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_a, n_b, n_groups, n_links and groups (text) of each row; see ``link_scores`` for odd texts."""

    def work(sides: Sides, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in V.text_slices(b.column("text"), SLICE):
                x = Aligned(sides, data, at)
                yield pa.RecordBatch.from_arrays([b.column("kept")[lo:hi], *_tallies(x), x.groups().cast(pa.string())], names=["kept", *TALLY, "groups"])

    return _aligned(docs, byte_level, pieces, text, keep, work, [T.StructField("groups", T.StringType())]).select("kept.*", *TALLY, "groups")


def block_rows(docs: DataFrame, byte_level: str, pieces: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows of documents (kept, tallies, groups_sha256, block, place), and one row a block with its pairs, bitmaps and planes."""
    more = [T.StructField("groups_sha256", T.StringType()), T.StructField("block", T.StringType()), T.StructField("place", T.IntegerType())]
    lists = [T.StructField("pair", T.ArrayType(LONG)), T.StructField("bitmap", T.ArrayType(BIN)), T.StructField("planes", T.ArrayType(T.ArrayType(BIN)))]
    kinds = {"pair": pa.list_(pa.int64()), "bitmap": pa.list_(pa.binary()), "planes": pa.list_(pa.list_(pa.binary()))}

    def work(sides: Sides, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, size, parts, kept = uuid.uuid4().hex, 0, 0, [], None
        names = ["kept", *TALLY, *[f.name for f in more], *kinds]

        def full() -> pa.RecordBatch:
            nothing = [pa.nulls(1, pa.int64())] * len(TALLY)
            arrays = [pa.array([x], kind) for x, kind in zip(merged(parts), kinds.values(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.nulls(1, kept), *nothing, pa.nulls(1, pa.string()), pa.array([block]), pa.nulls(1, pa.int32()), *arrays], names=names)

        for batch in batches:
            kept = batch.schema.field("kept").type
            for lo, hi, data, at in V.text_slices(batch.column("text"), SLICE):
                for a in range(0, hi - lo, PLACES):  # as many texts as a block has places
                    z = min(a + PLACES, hi - lo)
                    if parts and (n + z - a > PLACES or size + at[z] - at[a] > BLOCK):
                        yield full()
                        block, n, size, parts = uuid.uuid4().hex, 0, 0, []
                    x = Aligned(sides, data[at[a] : at[z]], at[a : z + 1] - at[a])
                    pair = x.a[x.link_a].astype(np.int64) << 20 | x.b[x.link_b]
                    parts.append(np.unique(pair << 16 | x.text + n, return_counts=True))
                    digests = [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups().cast(pa.large_binary()).to_pylist()]
                    own = [pa.array(digests, pa.string()), pa.array([block] * (z - a)), pa.array(np.arange(n, n + z - a), pa.int32())]
                    yield pa.RecordBatch.from_arrays([batch.column("kept")[lo + a : lo + z], *_tallies(x), *own, *[pa.nulls(z - a, kind) for kind in kinds.values()]], names=names)
                    n, size = n + z - a, size + int(at[z] - at[a])
        if parts:
            yield full()

    return _aligned(docs, byte_level, pieces, text, keep, work, [*more, *lists])


def popcount(bitmap: Column) -> Column:
    """How many places a packed bitmap holds."""
    listed = F.hex(F.substring(bitmap, 1, 1)) == "00"
    return F.when(listed, F.shiftright(F.octet_length(bitmap) - 1, 1).cast("long")).otherwise(F.bitmap_count(F.substring(bitmap, 2, 1 << 16)))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (documents that hold it) and best (no pair of its A id has a higher count)."""
    each = blocks.select(F.explode(F.arrays_zip("pair", "bitmap")).alias("x")).select("x.pair", popcount(F.col("x.bitmap")).alias("n")).groupBy("pair").agg(F.sum("n").alias("count"))
    a = F.shiftright("pair", 20)
    top = each.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return each.withColumn("a", a).join(top, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def returned(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """block, place, n_best and count_sum: counts of a block's pairs go through its bitmaps and planes to its documents."""
    wanted = blocks.select("block", F.posexplode("pair").alias("at", "pair")).join(counts, "pair")
    back = wanted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("back"))  # as many as a block has pairs
    rows = blocks.select("block", "bitmap", "planes").join(back, "block").select("block", "bitmap", "planes", "back.count", "back.best")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                bitmaps, planes, count, best = (b.column(c)[i].values for c in ("bitmap", "planes", "count", "best"))
                if not len(bitmaps):
                    continue
                count, best = count.to_numpy(), best.to_numpy(zero_copy_only=False).astype(np.int64)
                pair, place = unpacked(bitmaps)
                n = int(place.max()) + 1
                n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(n_best, place, best[pair])
                np.add.at(total, place, count[pair])
                # plane k of a pair adds 2**k links to its documents
                at = planes.offsets.to_numpy().astype(np.int64)
                at = at - at[0]
                of, place = unpacked(planes.flatten())
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                weight = np.left_shift(1, of - at[owner[of]])
                np.add.at(n_best, place, weight * best[owner[of]])
                np.add.at(total, place, weight * count[owner[of]])
                yield pa.RecordBatch.from_arrays([pa.array([b.column("block")[i].as_py()] * n), pa.array(np.arange(n), pa.int32()), pa.array(n_best), pa.array(total)], names=["block", "place", "n_best", "count_sum"])

    return rows.mapInArrow(work, "block string, place int, n_best long, count_sum long")


def link_scores(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    ``byte_level`` and ``pieces`` are paths of the vocabularies of A and B. Texts stand behind a space; specials inside are
    plain text. n_best: links whose pair's count of documents is the highest of its A id; count_sum: counts, over links. Null and
    empty texts, and those that a side doesn't spell byte for byte, have no tokens: zeros, and an empty digest. Each row is a document, also
    where rows are equal or share an id. A long text is in one block, whole. An empty table gives an empty one; other
    columns of ``docs``, whatever their names, play no part.
    """
    table = written(block_rows(docs, byte_level, pieces, text, keep))
    blocks, own = table.filter("place is null"), table.filter("place is not null")
    scores = returned(blocks, pair_counts(blocks))
    found = own.join(scores, ["block", "place"], "left")
    return found.select("kept.*", *TALLY, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
