"""Language-model scores of whole documents.

Counts of all training tokens are gathered first. The most frequent words are the model's head; its output starts
from their counts. The network learns from all training documents: it starts from one trained on a few of them, shards
of a bounded number of tokens go on from there each by itself, and their weights are averaged (by tokens). It scores
every text whole; words outside the head have, within their class, their share of all counts, one for unknown words included.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import drawn, fit_in_one_task, frugal, parts, shuffle_partitions, written

END = b"\n"  # no word holds a line end


def token_counts(docs: DataFrame, learn: Column, text_col: str = "text", most: int = 400_000) -> DataFrame:
    """(word binary, n) over the tokens of the learn rows: words, lower-cased A-Z, and one END a text.

    Each task adds up before anything is dealt out; it holds at most about `most` words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = iter(n.items())
            while part := list(islice(items, 65_536)):
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["word", "n"])

        for x in batches:
            for t in x.column(0).cast(pa.binary()).to_pylist():
                n.update((t or b"").lower().split())
                n[END] += 1
                if len(n) > most:
                    yield from out()
                    n.clear()
        yield from out()

    return docs.where(learn).select(F.col(text_col).cast("string")).mapInArrow(frugal(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, `most` or fewer: those from the lowest count up at which no more are left.

    Words are counted by eighths of a power of two first (a few hundred numbers), so that no task sends more than
    its part of the words chosen.
    """
    eighth = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    left, low = most, None
    for r in counts.groupBy(eighth.alias("e")).count().orderBy(F.desc("e")).collect():
        left -= r["count"]
        if left < 0:
            break
        low = r["e"]
    return counts.where(eighth >= low) if low is not None else counts.limit(0)


class Coder:
    """What a task needs to split texts: head ids and counts of the frequent words. Words have ranks: the head's ids first, then the other frequent words."""

    def __init__(self, head: list[bytes], known: dict[bytes, int]) -> None:
        self.head = {w: k for k, w in enumerate(head)}
        self.kind = np.dtype("<u2" if len(head) < 1 << 16 else "<i4")
        self.rank = self.head | {w: k for k, w in enumerate((w for w in known if w not in self.head), len(head))}
        self.logs = np.log10([known.get(w, 0) + 1.0 for w in self.rank])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word (-1: none) and of the end."""
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))
        out[-1] = self.head[END]
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        return self.heads(self.ranks(words))

    def heads(self, ranks: np.ndarray) -> np.ndarray:
        tail = len(self.head)
        return np.where(ranks < 0, tail, np.minimum(ranks, tail)).astype(np.int32, copy=False)

    def row(self, text: bytes | None) -> tuple:
        """A text's head ids, tokens, known ones, their sum of log10(c + 1), that of tail words alone, tail tokens, and the words to look up with their numbers."""
        words, tail = (text or b"").lower().split(), len(self.head)
        ranks = self.ranks(words)
        ids, known = self.heads(ranks), ranks[ranks >= 0]
        rare = Counter([words[k] for k in np.flatnonzero(ranks < 0).tolist()])
        logs = self.logs[known]
        return ids.astype(self.kind).tobytes(), len(ranks), len(logs), float(logs.sum()), float(logs[known >= tail].sum()), int((ids == tail).sum()), list(rare), list(rare.values())

    def back(self, ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, self.kind).astype(np.int32)


def train_on_all(rows: DataFrame, tokens: int, coder: Coder, start: gru.Params, shard: int, pieces: int = 16) -> gru.Params:
    """The weights after every row of rows(doc_id, h, ids), `tokens` tokens in all: the mean over shards of about `shard` tokens, each trained from start in a task of its own.

    Head ids are dealt out, not texts. Shards go by h, a hash of the row, and are sorted, so that the weights are the same however
    rows arrive. Weights are averaged in pieces, each a task's, in which one shard's is held at a time.
    """
    names = sorted(k for k in start if k != "starts")
    shards, end, back = -(-tokens // shard), coder.head[END], coder.back

    def trained(x: pa.Table) -> pa.Table:
        texts = sorted(zip(x.column("doc_id").to_pylist(), x.column("ids").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ids, k = [back(r[1]) for r in texts], x.column("shard")[0].as_py()
        trainer, order = gru.Trainer(start), np.random.default_rng(k).permutation(len(ids))
        for at in range(0, len(order), 1024):
            trainer.rate = 0.018 * (1 - 0.9 * at / len(order))
            trainer.learn([ids[i] for i in order[at : at + 1024]], end)
        flat = np.array_split(np.concatenate([trainer.p[n].ravel() for n in names]).astype("<f4"), pieces)
        return pa.table({"piece": pa.array(range(pieces), pa.int32()), "shard": pa.array([k] * pieces, pa.int64()), "n": pa.array([trainer.tokens] * pieces, pa.int64()), "w": pa.array([v.tobytes() for v in flat], pa.binary())})

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for x in batches:
            for piece, n, w in zip(*[x.column(c).to_pylist() for c in ("piece", "n", "w")], strict=True):
                held = sums.setdefault(piece, [0, 0.0])
                held[0] += n
                held[1] = held[1] + n * np.frombuffer(w, "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(v / n).astype("<f4").tobytes() for n, v in sums.values()], pa.binary())], names=["piece", "w"])

    parted = rows.select(F.pmod("h", F.lit(shards)).cast("long").alias("shard"), "doc_id", "ids")
    own = parted.repartition(shuffle_partitions(rows.sparkSession), "shard").groupBy("shard").applyInArrow(trained, "piece int, shard long, n long, w binary")
    found = own.repartition(pieces, "piece").sortWithinPartitions("piece", "shard").mapInArrow(averaged, "piece int, w binary").collect()
    if not found:
        return start
    flat, at, out = np.concatenate([np.frombuffer(r["w"], "<f4") for r in sorted(found, key=lambda r: r["piece"])]), 0, {"starts": start["starts"]}
    for k in names:
        out[k] = flat[at : at + start[k].size].reshape(start[k].shape)
        at += start[k].size
    return out


def lm_scores(docs: DataFrame, learn: Column, text_col: str = "text", head: int = 2048, lookup: int = 150_000, sample: int = 3000, dim: int = 24, classes: int = 45, shard: int = 2_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    learn: the rows to learn from. base_score sums log10((c + 1) / (N + V + 1)) over all tokens; score is the
    network's log10 probability of the whole text. Null texts are empty (one token, the end). `lookup` bounds the most
    frequent words whose counts every task holds; counts of the others are joined by word. The network learns from all
    rows; about `sample` of them are where its shards of about `shard` tokens start from. Repeated rows each give a row. With nothing to learn from, N = V = 0 and
    score equals base_score; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = written(token_counts(rows, F.col("learn"), "text"))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not total:
        n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")) + 1
        return rows.select("doc_id", (~F.col("learn")).alias("held_out"), n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    known = dict(sorted(((bytes(r["word"]), r["n"]) for r in frequent(counts, lookup).collect()), key=lambda x: (-x[1], x[0])))
    n_end = counts.where(F.col("word") == F.lit(END)).first()["n"]
    names = [w for w in islice(known, head) if w != END]
    names.append(END)
    known[END] = n_end
    names.sort(key=lambda w: (-known[w], w))
    mass = np.array([known[w] for w in names], float)
    tail_tokens, tail_words = total - int(mass.sum()), distinct - len(names)
    start = gru.init(mass, tail_tokens, dim, classes)
    light = Coder(names, {})

    def fit(got: list[tuple]) -> gru.Params:
        trainer, texts = gru.Trainer(start), [light.ids((r[1] or "").encode().lower().split()) for r in got]
        rng = np.random.default_rng(1)
        for trainer.rate in (0.03, 0.018, 0.006):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), 1024):
                trainer.learn([texts[i] for i in order[k : k + 1024]], light.head[END])
        return trainer.p

    drawn_rows = rows.where(F.col("learn") & drawn(sample / n_end, "lm"))  # a text has one end
    first = fit_in_one_task(drawn_rows.select("doc_id", "text"), fit) or start
    shared = spark.sparkContext.broadcast(Coder(names, known))
    coded_schema = "task int, row long, doc_id long, learn boolean, h long, ids binary, n_tokens long, n_known long, logs double, tail double, n_tail long, words array<binary>, k array<long>"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text: its head ids, what its frequent words add up to, and the words whose counts must be looked up."""
        from pyspark import TaskContext

        coder, task, row = shared.value, TaskContext.get().partitionId(), 0
        types = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        fields = [f.split()[0] for f in coded_schema.split(", ")]
        for x in parts(batches, most=1 << 22, column=3):
            made = zip(*map(coder.row, x.column(3).cast(pa.binary()).to_pylist()), strict=True)  # words are held of some texts at a time
            at = [pa.array(np.full(x.num_rows, task, np.int32)), pa.array(np.arange(row, row + x.num_rows))]
            yield pa.RecordBatch.from_arrays([*at, *x.columns[:3], *(pa.array(c, t) for c, t in zip(made, types, strict=True))], names=fields)
            row += x.num_rows

    texts = rows.select("doc_id", "learn", F.xxhash64("doc_id", "text").alias("h"), "text")
    each = written(texts.mapInArrow(frugal(coded), coded_schema))  # texts are split once, for training and for scores
    params = train_on_all(each.where("learn").select("doc_id", "h", "ids"), total, light, first, shard)
    network, back, end = spark.sparkContext.broadcast(params), light.back, light.head[END]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in parts(batches, most=1 << 22, column=7):
            net = gru.score(network.value, [back(i) for i in x.column(7).to_pylist()], end) / math.log(10)
            yield pa.RecordBatch.from_arrays([*x.columns[:7], *x.columns[8:], pa.array(net)], names=[*plain, "net"])

    plain = ["task", "row", "doc_id", "learn", "n_tokens", "n_known", "logs", "tail", "n_tail"]
    nets = each.select(*plain[:7], "ids", *plain[7:]).mapInArrow(frugal(scored), each.select(*plain).schema.add("net", "double"))
    rare = each.select("task", "row", F.explode(F.arrays_zip("words", "k")).alias("x")).select("task", "row", F.col("x.words").alias("word"), F.col("x.k").alias("k"))
    found = rare.join(counts.where(~F.col("word").isin(END)), "word").groupBy("task", "row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("log_c"))
    log_c = F.coalesce("log_c", F.lit(0.0))
    each = nets.join(found, ["task", "row"], "left").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_tail", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), (F.col("logs") + log_c).alias("logs"), (F.col("tail") + log_c).alias("tail"), "net"
    )
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    net = F.col("net") + F.col("tail") - F.col("n_tail") * F.lit(math.log10(tail_tokens + tail_words + 1))
    return each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), net.alias("score"))
