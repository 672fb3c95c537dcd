"""SimHash near-duplicates: pigeonhole blocks find every pair of close fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, frugal, mixed, parts, shingles_of, shuffle_partitions, word_hashes, written
from .graph import Forest, connected_components, contract, stars
from .jaccard import MOST_SENT, sets_of, sketch, verified

BITS = 64
#: Marks links that only tell which texts form a dense group; texts of a block, when a group's are compared with one another.
DENSE, BLOCK = -1, 512


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without a word."""
    found = (text or b"").lower().split()  # on bytes these are exactly A-Z and \x20, \x09-\x0D
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last, digest = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), xxhash.xxh64_intdigest
    total, ones = len(first), np.zeros(BITS, np.int64)
    for k in range(0, total, 32_768):
        hashes = np.array([digest(whole[s:e], seed) for s, e in zip(first[k : k + 32_768], last[k : k + 32_768], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of each row; the whole text counts. Null and blank texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = np.fromiter((fingerprint(t, words, seed) for t in x.column(1).cast(pa.binary()).to_pylist()), np.uint64, x.num_rows)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of which two fingerprints at most `distance` bits apart agree on one at least.

    `blocks` near-equal blocks; so many bits can spoil `distance` of them, so every choice of the rest is a mask.
    """
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(part, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _reach(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span what is linked among the fingerprints of one block.

    A search that compares each fingerprint reached with those not reached yet, so that a dense
    group costs little more than its size; memory is bounded by the step.
    """
    a, b, left = [], [], fps.copy()
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, min(len(front), 4_000_000 // len(left)))
            close = np.bitwise_count(front[:step, None] ^ left[None, :]) <= distance
            hit = close.any(0)
            a.append(front[:step][close[:, hit].argmax(0)])
            b.append(left[hit])
            front, left = np.concatenate((front[step:], left[hit])), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _stars(links):
    """What links() finds, as stars, within the same worker."""
    return lambda batches: contract(links(batches))


def _links(distance: int, small: int = 12):
    """Sorted (mask, key, fp) rows in, linked pairs out; groups never are held but one at a time."""

    def pairs(key: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1]))))
        size = np.diff(np.append(new, len(key)))
        group = np.repeat(np.arange(len(new)), size)
        few = np.repeat(size <= small, size)
        for lag in range(1, small):
            near = np.flatnonzero((group[lag:] == group[:-lag]) & few[lag:])
            if not len(near):
                break
            near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= distance]
            yield fp[near], fp[near + lag]
        for k in np.flatnonzero(size > small):
            yield _reach(fp[new[k] : new[k] + size[k]], distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(cols[0]):
                got = [(x, y) for x, y in pairs(*cols) if len(x)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in got]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for x in batches:
            if not x.num_rows:
                continue
            cols = [x.column(1).to_numpy(), x.column(0).to_numpy(), x.column(2).to_numpy().view(np.uint64)]
            changed = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            if held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][0], cols[1][0]):
                yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
            if len(changed):  # all but the last group is whole
                cut = changed[-1] + 1
                held.append([c[:cut] for c in cols])
                yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])
                held, cols = [], [c[cut:] for c in cols]
            held.append(cols)
        if held:
            yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def near_components(fps: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(fp, root) for the distinct fingerprints of fps(fp) that have a link; root stands for the component.

    Copies of one fingerprint are one row before anything is dealt out. Each distinct fingerprint goes to
    one place for each mask; a task sees its rows in order and compares only within equal keys.
    """
    masks = block_masks(distance, blocks)
    keys = F.array(*[F.struct(F.lit(k).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    dealt = fps.select("fp").where("fp is not null").distinct().select("fp", F.explode(keys).alias("x")).select("x.mask", "x.key", "fp")
    n = shuffle_partitions(fps.sparkSession)
    edges = dealt.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(frugal(_stars(_links(distance))), "a long, b long")
    return connected_components(edges, contracted=True).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, words: int = 4, distance: int = 4, blocks: int = 7, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 hex digits; component_id: the smallest doc_id reachable over links of at most
    `distance` differing bits, the row's own included. Null and blank texts have fingerprint zero and
    link like any other; repeated rows each give a row; a null id gives a row whose component is that
    of its fingerprint (null if no member has an id); an empty table gives none. Other columns are not read.
    """
    fps = written(fingerprints(docs, words, seed, id_col, text_col))
    roots = near_components(fps, distance, blocks)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = written(least)
    named = least.join(least.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def set_fingerprints(texts: pa.Array, words: int = 5, lanes: int = 8) -> np.ndarray:
    """A SimHash of 64 * lanes bits of the set of each text's word shingles, as rows of lanes numbers; zeros without a word.

    The share of bits in which two differ is about acos(c) / pi, where c is the cosine of the two sets; with the Jaccard
    index J and sets of like size c = 2 J / (1 + J).
    """
    hashed, starts = word_hashes(texts)
    h = shingles_of(hashed, starts, words)
    out = np.zeros((len(starts) - 1, lanes), np.uint64)
    for k, (a, b) in enumerate(zip(starts.tolist(), starts.tolist()[1:], strict=False)):
        if a == b:
            continue
        own = np.unique(h[a : b - words + 1] if b - a >= words else shingles_of(hashed[a:b], np.array([0, b - a]), b - a)[:1])
        ones = np.zeros(BITS * lanes, np.int64)
        for i in range(0, len(own), 8160):  # in blocks whose counts fit into a byte
            part = own[i : i + 8160]
            bits = np.unpackbits(np.stack([mixed(part, 100 + lane) for lane in range(lanes)], 1).view(np.uint8), axis=1, bitorder="little")
            for j in range(0, len(bits), 255):
                ones += bits[j : j + 255].sum(0, dtype=np.uint8)
        out[k] = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")
    return out


def cover_masks(lanes: int = 8, masks: int = 48, width: int = 18, seed: int = 3) -> np.ndarray:
    """Which bits each block holds: rows of `width` bit numbers. All bits are dealt into blocks again and again, in another order each time."""
    rng, bits = np.random.default_rng(seed), BITS * lanes
    deals = [rng.permutation(bits)[: bits // width * width].reshape(-1, width) for _ in range(-(-masks // (bits // width)))]
    return np.sort(np.concatenate(deals)[:masks], axis=1)


def _near(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """As _reach(), for rows of numbers: edges (row, row) that span what is linked in one block."""
    a, b, left = [], [], np.arange(len(fps))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, min(len(front), 500_000 // len(left)))
            close = np.bitwise_count(fps[front[:step], None] ^ fps[None, left]).sum(2, dtype=np.int32) <= distance
            hit = close.any(0)
            a.append(front[:step][close[:, hit].argmax(0)])
            b.append(left[hit])
            front, left = np.concatenate((front[step:], left[hit])), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _numbers(x: pa.Array, lanes: int) -> np.ndarray:
    """A column of binaries of 8 * lanes bytes each, none null, as rows of numbers."""
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8").reshape(-1, lanes)


def _across(fps: np.ndarray, label: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, bits) of the pairs of rows of unlike labels that differ in no more bits."""
    k = 0
    while k < len(fps) - 1:
        step = max(1, 500_000 // (len(fps) - k))
        bits = np.bitwise_count(fps[k : k + step, None] ^ fps[None, k:]).sum(2, dtype=np.int32)
        x, y = np.nonzero((bits <= distance) & (label[k : k + step, None] < label[None, k:]))
        yield x + k, y + k, bits[x, y]
        k += step


def _set_links(sure: int, loose: int, lanes: int, small: int = 12):
    """Sorted (key, node, fp) rows in, (a, b, bits) out: stars that span what is linked by `sure` bits or fewer (bits 0), and pairs of other bits up to `loose`.

    Pairs that sure links of their key connect are left out. A key with over twice as many pairs as rows gives stars instead (bits -1)
    that span what `loose` bits link there: what comes out never grows with the square of a group. What is whole in a batch is worked off at once, only its last group is held.
    """

    def linked(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(new, len(key)))
        few = np.repeat(size <= small, size)
        for lag in range(1, min(small, int(size.max()))):
            near = np.flatnonzero((key[lag:] == key[:-lag]) & few[lag:])
            bits = np.bitwise_count(fp[near] ^ fp[near + lag]).sum(1, dtype=np.int32)
            near, bits = near[bits <= loose], bits[bits <= loose]
            yield node[near], node[near + lag], bits
        for k in np.flatnonzero(size > small):
            own, fps = node[new[k] : new[k] + size[k]], fp[new[k] : new[k] + size[k]]
            x, y = _near(fps, sure)
            yield own[x], own[y], np.zeros(len(x), np.int32)
            label = np.arange(len(own))
            for i, j in zip(x.tolist(), y.tolist(), strict=True):  # i was reached before j
                label[j] = label[i]
            if label.any():
                order, found, total = np.argsort(label, kind="stable"), [], 0
                for i, j, bits in _across(fps[order], label[order], loose):
                    found.append((own[order[i]], own[order[j]], bits))
                    total += len(i)
                    if total > 2 * len(own):
                        x, y = _near(fps, loose)
                        found = [(own[x], own[y], np.full(len(x), DENSE, np.int32))]
                        break
                yield from found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        forest, dense = Forest(), Forest()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                for a, b, bits in linked(*cols):
                    for into, on in ((forest, (bits >= 0) & (bits <= sure)), (dense, bits == DENSE)):
                        for x, y in zip(a[on].tolist(), b[on].tolist(), strict=True):
                            into.join(x, y)
                    open_ = bits > sure
                    if open_.any():
                        yield pa.RecordBatch.from_arrays([pa.array(c[open_]) for c in (np.minimum(a, b), np.maximum(a, b), bits)], names=["a", "b", "bits"])

        for x in batches:
            if not x.num_rows:
                continue
            cols = (x.column(0).to_numpy(), x.column(1).to_numpy(), _numbers(x.column(2), lanes))
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # where the last group begins
            if last or (held and held[-1][0][-1] != cols[0][0]):
                held.append(tuple(c[:last] for c in cols))
                yield from flush()
            held.append(tuple(c[last:] for c in cols))
        yield from flush()
        for made, bits in ((forest, 0), (dense, DENSE)):
            for x in stars(made):
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(np.full(x.num_rows, bits, np.int32))], names=["a", "b", "bits"])

    return run


def _sketches(words: int):
    """(doc_id, text) rows in; the size and the sketch of each set of shingles out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches, rows=512, most=1 << 21):
            tokens, starts = sets_of(x.column(1), words)
            made = [sketch(tokens[a:b]) for a, b in zip(starts.tolist(), starts.tolist()[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.diff(starts)), pa.array(made, pa.binary())], names=["doc_id", "n", "sketch"])

    return run


def dense_links(members: DataFrame, words: int, num: int, den: int, loose: int, lanes: int) -> DataFrame:
    """(a, b): stars that span what is linked within each group of members(grp, node, root, fp, text), by all members of both sets.

    All blocks of a group are compared with all, two at a time; sets, not pairs, are dealt out, and a pair is looked at no more once links connect it.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches, rows=512, most=1 << 21, column=4):
            tokens, starts = sets_of(x.column(4), words)
            own = [tokens[a:b].tobytes() for a, b in zip(starts.tolist(), starts.tolist()[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array(own, pa.binary())], names=["grp", "node", "root", "fp", "members"])

    def compared(x: pa.Table) -> pa.Table:
        forest, linked = Forest(), Forest()
        node, root, block = (x.column(c).to_numpy() for c in ("node", "root", "block"))
        fps = np.stack([np.frombuffer(f, "<u8") for f in x.column("fp").to_pylist()])
        sets = [np.frombuffer(m, "<u8") for m in x.column("members").to_pylist()]
        n, low, high = np.array([len(v) for v in sets]), x.column("low")[0].as_py(), x.column("high")[0].as_py()
        for v, r in zip(node.tolist(), root.tolist(), strict=True):
            forest.join(("r", r), ("v", v))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for i in left.tolist():
            js = right[right > i] if low == high else right
            close = np.bitwise_count(fps[js] ^ fps[i]).sum(1, dtype=np.int32) <= loose
            fits = close & (den * np.minimum(n[js], n[i]) >= num * np.maximum(n[js], n[i])) & (root[js] != root[i])
            for j in js[fits].tolist():
                a, b = ("v", int(node[i])), ("v", int(node[j]))
                if n[i] and forest.find(a) != forest.find(b):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if den * both >= num * (n[i] + n[j] - both):
                        forest.join(a, b)
                        linked.join(a[1], b[1])
        out = list(stars(linked))
        return pa.table({c: pa.chunked_array([x.column(k) for x in out], pa.int64()) for k, c in enumerate("ab")})

    blocks = members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = members.select("grp", "node", "root", "fp", "text").mapInArrow(frugal(made), "grp long, node long, root long, fp binary, members binary")
    placed = sets.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("grp", F.least("block", "j").alias("low"), F.greatest("block", "j").alias("high"), "block", "node", "root", "fp", "members")
    n = shuffle_partitions(members.sparkSession)
    return cells.repartition(n, "grp", "low", "high").groupBy("grp", "low", "high").applyInArrow(compared, "a long, b long")


def set_components(docs: DataFrame, words: int = 5, alike: float = 0.8, lanes: int = 8, masks: int = 48, width: int = 18) -> DataFrame:
    """(doc_id, component_id) for every row of docs: groups of texts whose sets of word shingles are alike to `alike` (Jaccard index) or more.

    Wide SimHash fingerprints give the candidates: pairs that agree on one of `masks` blocks of `width` bits (of pairs at the bound 92 in
    100 do, of closer ones nearly all). What differs in so few bits that a pair below the bound has a chance under one in a million links at once; what differs in no
    more than two standard errors above what the bound lets expect links if the sets themselves, compared by all members, are alike enough. Where a block
    gives more candidates than twice its texts, these are not written down: the groups of texts that such candidates connect are compared within (dense_links). component_id is the smallest doc_id reachable. Null and blank texts are alike; repeated rows each give a row; a null id
    gives a row whose component is that of its fingerprint (where no row with an id has that fingerprint only the links of few bits count). An empty table gives none.
    """
    share = math.acos(2 * alike / (1 + alike)) / math.pi
    error = math.sqrt(BITS * lanes * share * (1 - share))
    sure, loose = int(BITS * lanes * share - 4.9 * error), int(BITS * lanes * share + 2 * error)
    bound = Fraction(alike).limit_denominator(1000)
    blocks = cover_masks(lanes, masks, width)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches, most=1 << 21):
            fp = set_fingerprints(x.column(1), words, lanes)
            node = np.array([xxhash.xxh64_intdigest(r.tobytes()) >> 1 for r in fp], np.int64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(node), pa.array([r.tobytes() for r in fp], pa.binary())], names=["doc_id", "node", "fp"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for part in (x.slice(k, 1024) for k in range(0, x.num_rows, 1024)):
                fp = _numbers(part.column(1), lanes)
                bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, blocks].astype(np.int64)  # row, mask, bit
                key = (bits << np.arange(width)).sum(2) + (np.arange(len(blocks)) << width)
                row = np.repeat(np.arange(len(fp)), len(blocks))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["key", "node", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = written(rows.mapInArrow(frugal(made), "doc_id long, node long, fp binary"))
    distinct = fps.groupBy("node").agg(F.min("fp").alias("fp"))
    n = shuffle_partitions(docs.sparkSession)
    dealt_out = distinct.mapInArrow(frugal(dealt), "key long, node long, fp binary").repartition(n, "key").sortWithinPartitions("key", "node")
    linked = written(dealt_out.mapInArrow(frugal(_set_links(sure, loose, lanes)), "a long, b long, bits int"))
    low = written(fps.groupBy("node").agg(F.min("doc_id").alias("low")))
    rooted = lambda e: written(low.join(connected_components(e, contracted=True), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    links = linked.where("bits = 0").select("a", "b")
    least = rooted(links)
    crowd = written(linked.where(F.col("bits") == DENSE).select("a", "b").distinct())
    if not crowd.isEmpty():
        grouped = connected_components(crowd, contracted=True).select("node", F.col("root").alias("grp"))
        members = written(grouped.join(least, "node").join(distinct, "node").where("low is not null").select("grp", "node", "root", "fp", F.col("low").alias("doc_id")))
        own = members.join(rows.select("doc_id", "text").distinct(), "doc_id").select("grp", "node", "root", "fp", "text")
        links = written(links.unionAll(dense_links(own, words, bound.numerator, bound.denominator, loose, lanes)))
        least = rooted(links)
    end = lambda x: least.select(F.col("node").alias(x), F.col("low").alias(f"doc_{x}"), F.col("root").alias(f"root_{x}"))
    apart = lambda p: p.join(end("a"), "a").join(end("b"), "b").where("root_a <> root_b")
    unsure = apart(linked.where("bits > 0").distinct()).where("doc_a <> doc_b")
    unsure = written(unsure.select("a", "b", "bits", F.least("doc_a", "doc_b").alias("x"), F.greatest("doc_a", "doc_b").alias("y")))
    ids = written(unsure.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    texts = written(rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "doc_id", "left_semi"))
    info = written(texts.mapInArrow(frugal(_sketches(words)), "doc_id long, n long, sketch binary"))
    alike_ones = verified(unsure.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), info, texts, words, bound.numerator, bound.denominator).toDF("x", "y")
    least = rooted(links.unionAll(unsure.join(alike_ones, ["x", "y"], "left_semi").select("a", "b")))
    used = [linked, unsure, ids, texts, info]
    for frame in used:
        drop_written(frame)
    named = least.join(least.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return fps.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """docs less all but one document of each near-duplicate group of simhash_components(): that with the smallest doc_id stays.

    Rows that share a doc_id are one document: they stay or go together, equal (doc_id, text) once. Rows
    without an id can't be named by a group and stay, equal texts once.
    """
    return _one_of_each(docs, simhash_components(docs, words, distance, blocks))


def drop_alike(docs: DataFrame, words: int = 5, alike: float = 0.8) -> DataFrame:
    """docs less all but one document of each group of set_components(), as drop_near_copies() has it."""
    return _one_of_each(docs, set_components(docs, words, alike))


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
