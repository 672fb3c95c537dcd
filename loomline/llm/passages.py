"""Near-duplicate passages by compact windows over token min-hashes.

Tokens are shingles of five words. Under one hash function the shingles of a text form a Cartesian tree by their
hashes; the node of shingle c spans the compact window (l, c, r): of every passage with l <= first <= c <= last <= r
the least hash is that of c. Windows shorter than the shortest passage sought (less some slack) are left out. The windows
of two functions are joined by their intervals: where both hold a passage, the two least hashes are its signature. Of two
passages alike to J a signature agrees with chance J * J; there are SIGNATURES of them, each of two functions of its own.

Under each signature every document is matched with the first one on whole texts. What is around the signature ends,
on either side, at a shingle that the first document lacks. Documents that have these shingles in common are matched
again, with the first of them, wherever one failed and has found no other partner there; so a document meets those that go on like it, step by step, and no
group is ever paired with itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MUL, drop_written, frugal, mixed, parts, shingles_of, shuffle_partitions, without, word_hashes, written
from .graph import connected_components

WORDS = 5
SIGNATURES = 3
SLACK = 6  # an inserted or deleted word must leave room for a window
ALIKE = 0.8
FEW = 1 << 12  # so many pairs, of few bytes each, are sent to the texts instead of the texts to them


def shingles(text: bytes) -> np.ndarray:
    """The hash of each run of five words of one text, in order."""
    words, starts = word_hashes(pa.array([text], pa.binary()).cast(pa.string()))
    return shingles_of(words, starts)[: max(0, len(words) - WORDS + 1)]


def compact_windows(h: np.ndarray, least: int, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every compact window of at least `least` elements, ends included; of equal hashes the first counts as less.

    These are the nodes of the Cartesian tree with so long a span: c is the least of some run of `least` elements, and
    l and r are found by descending the table of minima of runs of 1, 2, 4, ... Elements 0 divide h into texts, of
    `longest` elements at most: no window holds one.
    """
    n = len(h)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    levels = [h]
    while 2 << (len(levels) - 1) <= max(least, min(n, longest or n)):
        x, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(x[:-half], x[half:]))
    top = least.bit_length() - 1
    low = np.minimum(levels[top][: n - least + 1], levels[top][least - (1 << top) : n - (1 << top) + 1])  # of each run
    # an element is a centre if the greatest of the minima of the runs that hold it is its own
    size, padded = 1, np.concatenate((np.zeros(least - 1, np.uint64), low, np.zeros(least - 1, np.uint64)))
    while 2 * size <= least:
        padded = np.maximum(padded[:-size], padded[size:])
        size *= 2
    held = np.maximum(padded[:n], padded[least - size : least - size + n])
    c = np.flatnonzero((held == h) & (h > 0))
    l, r, v = c.copy(), c.copy(), h[c]
    for k in range(len(levels) - 1, -1, -1):
        size, x = 1 << k, levels[k]
        right = x.take(r + 1, mode="clip") >= v
        right &= r + size < n
        r += right * size
        left = x.take(l - size, mode="clip") > v
        left &= l >= size
        l -= left * size
    whole = r - l + 1 >= least
    return l[whole], c[whole], r[whole]


def overlaps(a: tuple, b: tuple, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The interval join of two functions' windows: (centre, centre) wherever one passage of at least `least` and less than `most` shingles lies in both."""
    (l1, c1, r1), (l2, c2, r2) = a, b
    low, high = np.searchsorted(c2, np.maximum(l1, c1 - most + 1), side="left"), np.searchsorted(c2, np.minimum(r1, c1 + most - 1), side="right")
    n = high - low
    i = np.repeat(np.arange(len(c1)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    both = (l2[j] <= c1[i]) & (c1[i] <= r2[j]) & (np.minimum(r1[i], r2[j]) - np.maximum(l1[i], l2[j]) + 1 >= least)
    return c1[i[both]], c2[j[both]]


def keys(h: np.ndarray, passage: int, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, a centre) for shingle hashes, of one text or of several that zeros divide; passage: the least length sought, in shingles."""
    key, at, least = [], [], max(1, passage - SLACK)
    for f in range(SIGNATURES):
        v = [np.where(h > 0, mixed(h, 10 + 2 * f + k) | np.uint64(1), np.uint64(0)) for k in (0, 1)]
        x, y = overlaps(*(compact_windows(u, least, longest) for u in v), least, passage)
        key.append(mixed(v[0][x] + v[1][y] * np.uint64(3), 50 + f))
        at.append(x)
    return np.concatenate(key), np.concatenate(at)


def _edge(mine: np.ndarray, theirs: np.ndarray) -> int:
    """How many words of mine a passage goes on over one word replaced, inserted or deleted; both lead away from where it ended."""
    best = 0
    for a, b in ((1, 1), (1, 0), (0, 1)):
        n = min(len(mine) - a, len(theirs) - b, WORDS - 1)
        same = mine[a : a + n] == theirs[b : b + n] if n > 0 else np.zeros(0, bool)
        k = int(same.argmin()) if not same.all() else len(same)
        best = max(best, a + k if k else 0)
    return best


def ordered(other: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Shingles in order, where each is, and whether any repeats; made once of a text that is compared with many."""
    order = np.argsort(other, kind="stable")
    values = other[order]
    return values, order, bool((values[1:] == values[:-1]).any())


def places(h: np.ndarray, index: tuple[np.ndarray, np.ndarray, bool]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the other text has each shingle of h, and where first."""
    values, order, _ = index
    if not len(values):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
    return values[at] == h, order[at]


def shared_spans(h: np.ndarray, other: np.ndarray, passage: int, gap: int = 10, words: np.ndarray | None = None, others: np.ndarray | None = None, index: tuple | None = None, known: tuple | None = None) -> list[tuple[int, int]]:
    """(first, last) runs of at least `passage` shingles of h of which at least ALIKE are found in one place of other.

    Runs of shared shingles join over gaps of at most `gap` (an edited word spoils five). If what is joined shares
    too little, its parts count for themselves. With the words of both, a run also holds equal words beyond an edited
    one near its ends, too few for a shingle. index: ordered(other), known: places(h, index), if they are there already.
    """
    index = index or ordered(other)
    found, there = known or places(h, index)
    hit = np.flatnonzero(found)
    if len(hit) and index[2]:  # shingles that repeat there: go on where the one before was found
        place, end, before = there.tolist(), len(other), -2
        values, theirs = h.tolist(), other.tolist()
        for k, ok in enumerate(found.tolist()):
            if ok and 0 <= before + 1 < end and theirs[before + 1] == values[k]:
                place[k] = before + 1
            before = place[k] if ok else -2
        there = np.array(place)
    out = []

    def settle(run: np.ndarray, most: int) -> None:
        for part in np.split(run, np.flatnonzero(np.diff(run) > most) + 1):
            if not len(part):
                continue
            first, last = int(part[0]), int(part[-1])
            if words is not None and passage - 2 * WORDS <= last - first + 1 < passage:
                a, b = int(there[first]), int(there[last])
                first -= _edge(words[max(0, first - WORDS) : first][::-1], others[max(0, a - WORDS) : a][::-1])
                last += _edge(words[last + WORDS : last + 2 * WORDS], others[b + WORDS : b + 2 * WORDS])
            size = last - first + 1
            theirs = there[part[-1]] - there[part[0]] + 1
            if max(size, theirs if theirs <= size + 2 else 0) < passage:  # a word deleted here may be there
                continue
            shift = part - there[part]
            near = np.abs(shift - np.median(shift)) <= max(32, size // 4)
            if near.sum() >= ALIKE * size:
                out.append((first, last))
            elif most > 1:
                settle(part, 1)

    if len(hit):
        settle(hit, gap + 1)
    return out


def _keyed(passage: int):
    """A row for each signature of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches, most=1 << 19):
            words, starts = word_hashes(x.column(1))
            key, at = keys(shingles_of(words, starts), passage, int(np.diff(starts).max()))
            doc = np.searchsorted(starts, at, side="right") - 1
            order = np.lexsort((doc, key))
            key, at, doc = key[order], at[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, at, doc = key[new], at[new], doc[new]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), x.column(0).take(pa.array(doc)), pa.array((at - starts[doc]).astype(np.int32))], names=["key", "doc_id", "at"])

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, doc_id) in; a row for each document of a key but the first, with that first one, out."""
    key = first = None
    for x in batches:
        k, d = x.column(0).to_numpy(), x.column(1).to_numpy()
        if not len(k):
            continue
        same = np.concatenate(([key is not None and k[0] == key], k[1:] == k[:-1]))
        head = np.maximum.accumulate(np.where(same, -1, np.arange(len(k))))
        heads = np.where(head >= 0, d[np.maximum(head, 0)], first if first is not None else 0)
        key, first = k[-1], heads[-1]
        on = same & (heads != d)
        yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (d, heads, x.column(2).to_numpy())], names=["doc_id", "of", "at"])


def _verified(passage: int):
    """For each pair the passages shared (key null), and where the runs around the signatures end: shingles of doc_id that `of` lacks, each a key to be matched by (first: the signature's centre)."""

    def ends(found: np.ndarray, at: list[int], spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool, int]]:
        lacks, n, done = np.flatnonzero(~found).tolist(), len(found), set()
        for c in at:
            k = bisect_left(lacks, c)
            if c >= n or (k < len(lacks) and lacks[k] == c) or k in done:
                continue
            done.add(k)
            fail = not any(s <= c <= e for s, e in spans)
            for side, edge, step in ((0, lacks[k - 1] if k else -1, -WORDS), (1, lacks[k] if k < len(lacks) else n, WORDS)):
                for p in (edge, edge + step):
                    if 0 <= p < n and (p == edge or not found[p]):
                        yield p, side, fail, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches, most=1 << 22, column=3):
            ids, of, at = x.column(0).to_pylist(), x.column(1), x.column(2).to_pylist()
            coded = of.dictionary_encode()
            which = coded.indices.to_numpy()
            rows = np.zeros(len(coded.dictionary), np.int64)
            rows[which[::-1]] = np.arange(len(which))[::-1]
            mine, b = word_hashes(x.column(3))
            theirs, a = word_hashes(x.column(4).take(pa.array(rows)))
            split = lambda w, s: [(w[p:q], v[p : max(p, q - WORDS + 1)]) for v in [shingles_of(w, s)] for p, q in zip(s.tolist(), s[1:].tolist(), strict=False)]
            others, found, more = [(w, h, ordered(h)) for w, h in split(theirs, a)], [], []
            for n, (i, d, (w, h), cs, k) in enumerate(zip(ids, of.to_pylist(), split(mine, b), at, which.tolist(), strict=True)):
                wo, other, index = others[k]
                known = places(h, index)
                spans = shared_spans(h, other, passage, words=w, others=wo, index=index, known=known)
                found += [(i, d, s, e + WORDS - 1, n) for s, e in spans]
                more += [(i, d, p, fail, h[p], side, c) for p, side, fail, c in ends(known[0], sorted(cs), spans)]
            f, m = (list(zip(*z, strict=True)) or [()] * 7 for z in (found, more))
            if found:
                digest = pa.array(digests(x.column(3).take(pa.array(f[4]))), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in f[:4]] + [pa.nulls(len(found), t) for t in (pa.int64(), pa.int32(), pa.bool_())] + [digest], names=_COLUMNS)
            if more:
                key = mixed(np.array(m[4], np.uint64) + np.array(m[1], np.int64).view(np.uint64) * MUL, 60) + np.array(m[5], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(m[0], pa.int64()), pa.array(m[1], pa.int64()), pa.array(m[6], pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(key.view(np.int64)), pa.array(m[2], pa.int32()), pa.array(m[3], pa.bool_()), pa.nulls(len(more), pa.int64())], names=_COLUMNS)

    return run


_COLUMNS = ["doc_id", "of", "first", "last", "key", "at", "fail", "digest"]


def digests(texts: pa.Array) -> list[int | None]:
    """A hash of each whole text, the same that Spark's xxhash64 gives."""
    return [None if t is None else int(np.uint64(xxhash.xxh64_intdigest(t, seed=42)).view(np.int64)) for t in texts.cast(pa.binary()).to_pylist()]


def shared_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """(doc_id, of, first, last): passages of at least `words` words, first to last (word numbers from 0), that document `of`, of smaller id, has too.

    Exact passages, and those that share at least four fifths of their five-word shingles in one place. Each document is matched under each
    signature with the first document; where that fails for one that has found no other there, all that go on alike beyond what the first one has are matched with the first of them,
    and so on until none is left. Rows without an id or a text take no part; of rows that share an id the one with the
    least text counts. Texts are whole. Joins are merge joins, as neither pairs nor texts have a bound for a broadcast; only a later step of FEW pairs or less broadcasts them.
    """
    return _shared(docs, words).drop("digest")


def _shared(docs: DataFrame, words: int) -> DataFrame:
    """shared_passages() with the digest of the text of doc_id that was matched."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    passage, n = words - WORDS + 1, shuffle_partitions(spark)
    keyed = rows.mapInArrow(frugal(_keyed(passage)), "key long, doc_id long, at int")
    matched = keyed.repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(frugal(_matched), "doc_id long, of long, at int")
    found, texts, small = None, rows, False
    while True:
        pairs = written(matched.groupBy("doc_id", "of").agg(F.collect_set("at").alias("at")))
        size = pairs.agg(F.count("*"), F.sum(F.size("at"))).first()
        if found is not None and not size[0]:
            drop_written(texts)
            drop_written(pairs)
            return found
        few = found is not None and sum(size) <= 2 * FEW
        if not (few and small):  # a later step has no documents that the one before had not
            ids = pairs.select("doc_id").unionAll(pairs.select("of"))
            picked = texts.join(F.broadcast(ids) if few else ids.distinct().hint("merge"), "doc_id", "left_semi")
            before, texts, small = texts, written(picked if found is not None else picked.groupBy("doc_id").agg(F.min("text").alias("text"))), few
            if found is not None:  # in the first step they are the input
                drop_written(before)
        mine = texts.withColumnRenamed("text", "text_b")
        sides = mine.join(F.broadcast(pairs), "doc_id") if few else pairs.join(mine.hint("merge"), "doc_id")
        firsts = texts.join(F.broadcast(pairs.select(F.col("of").alias("doc_id"))), "doc_id", "left_semi") if few else texts
        sides = sides.join(firsts.select(F.col("doc_id").alias("of"), F.col("text").alias("text_a")).hint("merge"), "of")
        made = written(sides.select("doc_id", "of", "at", "text_b", "text_a").mapInArrow(frugal(_verified(passage)), "doc_id long, of long, first long, last long, key long, at int, fail boolean, digest long"))
        drop_written(pairs)
        new = made.where("key is null").select("doc_id", "of", "first", "last", "digest")
        found = new if found is None else found.unionAll(new)
        spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
        alone = F.col("spans").isNull() | ~F.exists("spans", lambda p: (p["first"] <= F.col("first")) & (F.col("first") <= p["last"]))
        ends = made.where("key is not null").join(spans.hint("merge"), "doc_id", "left").select("key", "doc_id", "at", (F.col("fail") & alone).alias("fail"))
        alike = Window.partitionBy("key")
        matched = ends.select("doc_id", F.min("doc_id").over(alike).alias("of"), "at", F.max("fail").over(alike).alias("fail")).where("fail and doc_id <> of")


def passage_classes(docs: DataFrame, words: int = 50) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id reachable over shared passages), n_links, n_words, n_repeated, passages.

    n_links: documents of smaller id with which it was found to share a passage. n_repeated: its words in such passages. passages:
    array<struct<first, last, of>>, sorted. Documents without any have 0, none, and their own id. Every row gives a row.
    """
    found = shared_passages(docs, words)
    roots = connected_components(found.select(F.col("doc_id").alias("a"), F.col("of").alias("b"))).withColumnRenamed("node", "doc_id")
    each = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "last", "of"))).alias("passages"))
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words.alias("n_words"))
    none = F.array().cast("array<struct<first:bigint,last:bigint,of:bigint>>")
    out = rows.join(roots, "doc_id", "left").join(each, "doc_id", "left").withColumn("passages", F.coalesce("passages", none))
    covered = F.aggregate("passages", F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(F.greatest(s["end"], p["last"]).alias("end"), (s["n"] + F.greatest(p["last"] - F.greatest(s["end"] + 1, p["first"]) + 1, F.lit(0))).alias("n")), lambda s: s["n"])
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("component_id"), F.size(F.array_distinct(F.transform("passages", lambda p: p["of"]))).cast("long").alias("n_links"), "n_words", covered.alias("n_repeated"), "passages")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words first to last of each span; blanks between what stays are kept once."""
    import re

    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    out, start = [], 0
    for first, last in sorted(spans):
        if last >= len(at) or at[last][1] <= start:
            continue
        out.append(raw[start : max(start, at[first][0])])
        start = at[last][1]
    return b"".join([*out, raw[start:]]).decode("utf-8", "surrogatepass")


def drop_shared_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """docs with each shared passage cut from every document but the first that has it; n_chars follows the text.

    Every row stays, if with less text. Rows without an id or a text, and documents without a shared passage, stay
    as they are; so do rows of an id used twice whose text isn't the one that was matched.
    """
    each = _shared(docs, words).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first", "last", "digest"))).alias("__spans"))
    rows = without(docs, "__spans").join(each, "doc_id", "left")
    at, sp = rows.columns.index("text"), rows.columns.index("__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            spans = x.column(sp).to_pylist()
            found = [k for k, p in enumerate(spans) if p]
            for k, d in zip(found, digests(x.column(at).take(pa.array(found, pa.int64()))), strict=True):
                if spans[k][0]["digest"] != d:  # another text under the same id
                    spans[k] = None
            hit = pa.array([p is not None for p in spans], pa.bool_())
            made = x.column(at)
            if hit.true_count:
                made = pa.array([t if t is None or p is None else cut(t, [(s["first"], s["last"]) for s in p]) for t, p in zip(made.to_pylist(), spans, strict=True)], made.type)
            cols = [made if k == at else hit if k == sp else c for k, c in enumerate(x.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=x.schema.names)

    schema = rows.withColumn("__spans", F.lit(True)).schema
    changed = rows.mapInArrow(frugal(run), schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("__spans"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
