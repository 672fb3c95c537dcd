"""Exact Jaccard join of word-shingle sets: a partition of the universe, and pigeonholes over its segments.

Two sets that link differ in few members, at most H by their sizes. Members are hashed to segments, in numbers that go
by a band of sizes, so that more segments than H must agree (or, if a segment also meets those that lack one of its
members, half as many). Each set deals out a key for each segment's content, and in bands where that is cheaper also
for its contents less one member. Keys that too many unlike sets share, and segments with too little content, count
as lost; a band has more segments than needed by a slack, and only sets that lose more than that can miss each other:
these, and only these, are compared in blocks. Every candidate is verified on its whole texts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, drop_written, frugal, mixed, parts, shingles_of, shuffle_partitions, word_hashes, written
from .graph import connected_components

#: Keys with more sets than this, not all of one component, count as lost.
MOST_PER_KEY = 16
#: Up to so many ids (16 MB) are broadcast to pick texts; more are joined by a shuffle.
MOST_SENT = 2_000_000
#: Sets of a block in the comparison of those that lost too many keys; partners of one document in one task.
BLOCK, PARTNERS = 1024, 512


class Bands:
    """Bands of set sizes with their segments: v (1: content, 2: also less a member), c (least members of a key), m segments, x slack."""

    def __init__(self, num: int, den: int, rows: int, growth: float = 1.25) -> None:
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < 1 << 31:
            starts.append(max(starts[-1] + 1, math.ceil(starts[-1] * max(growth, den / num))))
        self.starts = np.array(starts)
        chosen = [self._choose(a, b - 1, max(rows, 2)) for a, b in zip(starts, starts[1:], strict=False)]
        self.v, self.c, self.m, self.x = (np.array(k, np.int64) for k in zip(*chosen, strict=True))

    def apart(self, n: np.ndarray) -> np.ndarray:
        """The most members in which a set of n and a linked set no smaller can differ."""
        n = np.asarray(n, np.int64)
        top, out = self.den * n // self.num, np.zeros_like(n)
        for j in range(2 * (self.num + self.den)):  # the bound rises and falls within a period of the sum of sizes
            both = n + np.maximum(n, top - j)
            out = np.maximum(out, both + 2 * (-self.num * both // (self.num + self.den)))
            if (top - j <= n).all():
                break
        return out

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, side="right") - 1

    def _choose(self, low: int, high: int, rows: int) -> tuple[int, int, int, int]:
        """The cheapest of all v, c and x: keys, pairs that thin keys bring together, and comparisons of sets that lose too many."""
        apart, n = int(self.apart(np.array([high]))[0]), (low + high) / 2
        if not apart:
            return 1, 1, 0, 0
        best = None
        for v in (1, 2):
            for c in (1, 2):
                for x in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024):
                    m = -(-(apart + 1 + x) // v)
                    chance = [math.exp(k * math.log(n / m) - n / m - math.lgamma(k + 1)) for k in range(8)] if m > 1 else [0.0] * 8
                    mean = m * sum(chance[: c + v - 1]) + 0.2
                    within = sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(x // v + 1))
                    tail = max(0.0, 1 - within) + (m == 1 and low < c + v - 1)
                    cost = m + (v - 1) * n + 10 * m * sum(p / 4**k for k, p in enumerate(chance) if k >= c) + 0.01 * rows * tail**2 + 100 * tail
                    best = min(best or (cost + 1,), (cost, v, c, m, x))
        return best[1:]

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Segments that a set of n deals out in its own band: its first so many."""
        b, apart = self.band(n), self.apart(n)
        return np.where(apart > 0, np.minimum(self.m[b], -(-(apart + 1 + self.x[b]) // self.v[b])), 0)

    def looks_back(self, n: np.ndarray) -> np.ndarray:
        """Whether a set of n can link with one of the band before."""
        b = self.band(n)
        return (b > 0) & (-(-self.num * n // self.den) < self.starts[b]) & (self.m[b - 1] > 0)


def sets_of(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, one text's behind the other's, and where each begins."""
    hashed, starts = word_hashes(texts)
    shingles, found = shingles_of(hashed, starts, words), []
    for a, b in zip(starts.tolist(), starts.tolist()[1:], strict=False):
        if b - a >= words:
            found.append(np.unique(shingles[a : b - words + 1]))
        elif b > a:  # the whole sequence as one, told from others by its length
            found.append(mixed(np.array([xxhash.xxh64_intdigest(hashed[a:b].tobytes(), b - a)], np.uint64), 7))
        else:
            found.append(np.zeros(0, np.uint64))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)


def segment_keys(tokens: np.ndarray, sizes: np.ndarray, bands: Bands, band: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set's first `take` segments in a band's partition, how many each set has, and the units each has lost."""
    sets = np.repeat(np.arange(len(sizes)), sizes)
    segment = ((mixed(tokens, 1) >> np.uint64(32)) * bands.m[band].astype(np.uint64)[sets]) >> np.uint64(32)
    kept = segment < take.astype(np.uint64)[sets]
    sets, segment, part = sets[kept], segment[kept].astype(np.int64), mixed(tokens[kept], 2)
    first = np.cumsum(take) - take
    slot, slots = first[sets] + segment, int(take.sum())
    owner = np.repeat(np.arange(len(sizes)), take)
    order, held = np.argsort(slot, kind="stable"), np.bincount(slot, minlength=slots)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part[order], dtype=np.uint64)))
    ends = np.cumsum(held)
    content = running[ends] - running[ends - held]
    place = mixed((band[owner].astype(np.uint64) << np.uint64(32)) + (np.arange(slots) - first[owner]).astype(np.uint64), 5)
    v, c = bands.v[band], bands.c[band]
    full = held >= c[owner]
    lost = np.bincount(owner[held < (c + v - 1)[owner]], minlength=len(sizes)) * v
    less = (v[sets] == 2) & (held[slot] > c[sets])
    keys = np.concatenate((mixed(content[full] + place[full], 4), mixed(content[slot[less]] - part[less] + place[slot[less]], 4)))
    owners = np.concatenate((owner[full], sets[less]))
    return keys[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(sizes)), lost


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of how many members fall on each of a power of two of places, two to four times as many as members: two sets' sketches differ in no more places than the sets in members."""
    places = 1 << max(6, (len(tokens) - 1).bit_length() + 1)
    at = (mixed(tokens, 3) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(x: bytes, size: int) -> np.ndarray:
    """A sketch over fewer places."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)


def may_link(n: int, x: bytes, m: int, y: bytes, num: int, den: int) -> bool:
    if den * min(n, m) < num * max(n, m):
        return False
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= n + m + 2 * (-num * (n + m) // (num + den))


INFO = "doc_id long, n long, hi long, lo long, sketch binary, band int, lost long, lost_back long, keys array<long>, keys_back array<long>"


def set_rows(docs: DataFrame, bands: Bands, words: int) -> DataFrame:
    """A row for every row of docs: size, digest and sketch of its set and the keys it deals out. A task leaves the keys of copies of what it has just seen out."""

    def run(batches: Batches) -> Batches:
        seen: set[tuple[int, int]] = set()
        for x in parts(batches, rows=512, most=1 << 21):
            tokens, starts = sets_of(x.column(1), words)
            sizes = np.diff(starts)
            split = [tokens[a:b] for a, b in zip(starts.tolist(), starts.tolist()[1:], strict=False)]
            digests = [xxhash.xxh3_128_digest(t.tobytes()) for t in split]
            named = x.column(0).is_valid().to_numpy(zero_copy_only=False)
            deals = np.zeros(len(sizes), bool)
            for k, d in enumerate(digests):
                if sizes[k] and named[k] and d not in seen:
                    deals[k] = True
                    seen.add(d)
            if len(seen) > 1 << 20:
                seen.clear()
            some = np.maximum(sizes, 1)
            band, back = bands.band(some), deals & bands.looks_back(some)
            own = segment_keys(tokens, sizes, bands, band, np.where(deals, bands.needed(some), 0))
            before = np.maximum(band - 1, 0)
            prior = segment_keys(tokens, sizes, bands, before, np.where(back, bands.m[before], 0))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(k.view(np.int64))) for k, n, _ in (own, prior)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            cols = [x.column(0), pa.array(sizes), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([sketch(t) for t in split], pa.binary()), pa.array(band.astype(np.int32)), pa.array(own[2]), pa.array(np.where(back, prior[2], -1)), *lists]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in INFO.split(", ")])

    return docs.mapInArrow(frugal(run), INFO)


def met(batches: Batches) -> Batches:
    """Sorted (key, id, own) rows in; each once, with the first id of its key, out where a key has two ids or more."""
    carry, told = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)], False
    for x in batches:
        if not x.num_rows:
            continue
        key, who, own = (np.concatenate((c, x.column(k).to_numpy(zero_copy_only=False))) for k, c in enumerate(carry))
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        first = np.repeat(who[start], size)
        several = np.logical_or.reduceat(who != first, start)
        again = np.concatenate(([False], (key[1:] == key[:-1]) & (who[1:] == who[:-1]) & (own[1:] == own[:-1])))
        out = ~again & np.repeat(several, size)
        out[: len(carry[0])] &= not told
        yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (key, who, own, first)], names=["key", "id", "own", "first"])
        still = np.flatnonzero((key == key[-1]) & (who == first[-1]) & ~again)
        carry, told = [key[still], who[still], own[still]], bool(several[-1])


def _by_key(rows: DataFrame) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "id", "own").mapInArrow(met, "key long, id long, own boolean, first long")


def verified(pairs: DataFrame, info: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by all members of both. Sketches drop most others before texts are read.

    Partners of one document stand behind its text, in parts of a task each.
    """
    a, b = (info.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")

    def sieve(batches: Batches) -> Batches:
        for x in batches:
            kept = [may_link(*r, num, den) for r in zip(*[x.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b")], strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(c).filter(pa.array(kept, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    near = written(pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(sieve, "a long, b long").distinct())
    tasks = near.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("tasks"))
    part = F.pmod(F.xxhash64("b"), "tasks").cast("int")
    wanted = near.join(tasks, "a").select(F.col("b").alias("doc_id"), "a", part.alias("part"), F.lit(1).alias("side"))
    wanted = wanted.unionByName(tasks.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), F.lit(0).alias("side")))
    ids = wanted.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= MOST_SENT else docs
    rows = texts.join(wanted, "doc_id").select("a", "part", "side", "doc_id", "text")

    def run(batches: Batches) -> Batches:
        place, held = None, []
        for x in parts(batches, rows=256, most=1 << 21, column=4):
            tokens, starts = sets_of(x.column(4), words)
            found = []
            for k, (one, p, side, other) in enumerate(zip(*[x.column(c).to_pylist() for c in range(4)], strict=True)):
                mine = tokens[starts[k] : starts[k + 1]]
                if (one, p) != place:
                    place, held = (one, p), []
                if not side:
                    held.append(mine)
                    continue
                for t in held:
                    both = len(np.intersect1d(t, mine, assume_unique=True))
                    if len(mine) and den * both >= num * (len(t) + len(mine) - both):
                        found.append((one, other))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[s] for f in found], pa.int64()) for s in (0, 1)], names=["a", "b"])

    n = shuffle_partitions(docs.sparkSession)
    return written(rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(frugal(run), "a long, b long"))


def _by_band(values: np.ndarray, band: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), band + 1)


def block_pairs(poor: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that may link by their sketches, of poor(id, root, band, n, sketch) rows of equal band and other roots: all blocks against all, two at a time."""
    sizes = poor.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    x = poor.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    cells = x.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", F.least("block", "j").alias("low"), F.greatest("block", "j").alias("high"), "block", "id", "root", "n", "sketch")

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        size = min(map(len, cell["sketch"]))
        bits, n = np.stack([folded(s, size) for s in cell["sketch"]]), cell["n"].to_numpy()
        ids, roots, low = cell["id"].to_numpy(), cell["root"].to_numpy(), (cell["block"] == cell["low"]).to_numpy()
        alone, out = bool((cell["low"] == cell["high"]).all()), []
        for k in range(len(ids)):
            both = n + n[k]
            fits = (den * np.minimum(n, n[k]) >= num * np.maximum(n, n[k])) & (roots != roots[k]) & ((ids > ids[k]) if alone else (low[k] & ~low))
            at = np.flatnonzero(fits)
            close = np.bitwise_count(bits[at] ^ bits[k]).sum(1, dtype=np.int64) <= (both + 2 * (-num * both // (num + den)))[at]
            out.append(np.stack((np.minimum(ids[at[close]], ids[k]), np.maximum(ids[at[close]], ids[k]))))
        a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    return cells.groupBy("band", "low", "high").applyInPandas(run, "a long, b long")


def _unlike(rooted: DataFrame) -> DataFrame:
    """Rows of keys whose sets are of several components, with their number and the component of the key's first."""
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("sets"), F.min_by("root", "id").alias("first_root")).where("low < high")
    return rooted.join(keys.select("key", "sets", "first_root"), "key")


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PER_KEY, rows: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Words are lower-cased (A-Z) and split at blanks; a set holds the distinct shingles of so many words, or the whole
    sequence of fewer. Sets link when den * common >= num * all of both; component_id is the smallest doc_id reachable.
    Texts without a word, null and empty ones among them, have size 0 and only themselves. Equal sets are one row before
    keys are dealt. Repeated rows give a row each; an id with several texts stands for one document with all of them; a
    row without an id takes no part but has the component of the texts equal to its own (null if none has an id). Very
    long texts are rows like others; an empty table gives none; other columns are not read. Members are told apart by
    64-bit hashes. most: see MOST_PER_KEY; rows: for how many documents bands are chosen (all of them).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bands = Bands(num, den, rows or docs.count())
    info = written(set_rows(docs, bands, words))
    classes = written(info.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
    member = written(info.where("n > 0 and doc_id is not null").select("doc_id", "hi", "lo", "n").join(classes, ["hi", "lo"]).select("doc_id", "n", "rep").distinct())
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    links = [member.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a < b")]

    dealt = info.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"), F.lit(True).alias("own"))
    dealt = dealt.unionByName(info.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.explode("keys_back").alias("key"), F.lit(False).alias("own")))
    shared = _by_key(dealt.select("key", "id", "own"))
    copies = member.where("rep < doc_id").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    shared = shared.join(copies, F.col("id") == F.col("doc_id"), "left").select("key", F.coalesce("rep", "id").alias("id"), "own")
    groups = written(_by_key(shared))

    one = info.where("doc_id is not null and n > 0").dropDuplicates(["doc_id"])
    rooted = lambda x, r: x.select("key", "id", "own", "first").join(r, F.col("id") == F.col("node"), "left").select("key", "id", "own", "first", F.coalesce("root", "id").alias("root"))
    # first with one partner each, then, of keys with several components, with the first of the key
    tried = written(groups.where("id <> first").groupBy(F.col("id").alias("b")).agg(F.min("first").alias("a")).select("a", "b"))
    links.append(verified(tried, one, docs, words, num, den))
    roots = written(connected_components(links[0].unionByName(links[1])))
    left = written(_unlike(rooted(groups, roots)))
    stars = written(left.where("root <> first_root").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    links.append(verified(stars, one, docs, words, num, den))
    roots = written(connected_components(links[0].unionByName(links[1]).unionByName(links[2])))
    drop_written(groups)
    groups, left = left, written(_unlike(rooted(left, roots)))
    few = left.where(F.col("sets") <= most)
    cross = few.alias("x").join(few.alias("y"), "key").where("x.root < y.root").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    links.append(verified(cross.join(tried.unionByName(stars), ["a", "b"], "left_anti"), one, docs, words, num, den))

    gone = left.where(F.col("sets") > most).groupBy("id").agg(F.count_if("own").alias("gone"), F.count_if(~F.col("own")).alias("gone_back"))
    # a task that skipped a copy's keys counts nothing lost for it; what one of the copies has lost holds for all
    lost = info.where("doc_id is not null and n > 0").join(classes, ["hi", "lo"]).groupBy(F.col("rep").alias("id"), "band", "n").agg(F.max("lost").alias("lost"), F.max("lost_back").alias("lost_back"))
    state = lost.join(gone, "id", "left").fillna(0, ["gone", "gone_back"])
    at = lambda k: F.col("band") - k
    own = state.where(F.col("lost") + F.col("gone") * _by_band(bands.v, at(0)) > _by_band(bands.x, at(0))).select("id", "band")
    back = state.where("lost_back >= 0").where(F.col("lost_back") + F.col("gone_back") * _by_band(bands.v, at(1)) > _by_band(bands.x, at(1))).select("id", at(1).alias("band"))
    poor = own.unionByName(back).join(one.select(F.col("doc_id").alias("id"), "n", "sketch"), "id").join(roots, F.col("id") == F.col("node"), "left")
    poor = written(poor.select("id", F.coalesce("root", "id").alias("root"), "band", "n", "sketch"))
    links.append(verified(block_pairs(poor, num, den).distinct(), one, docs, words, num, den))

    roots = written(connected_components(reduce(DataFrame.unionByName, links)))
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("root", "rep").alias("component"))
    out = info.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    for used in (tried, stars, groups, left, poor):
        drop_written(used)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
