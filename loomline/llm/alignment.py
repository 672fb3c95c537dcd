"""Two tokenizers over the same texts: common ends cut both into groups, overlapping byte ranges are links.

Two forms give the same links. token_ends, common_groups and token_links are relational: exploded tokens, windows over
cumulated lengths, a join on document and end, running counts of cuts, a join by group and range. They fit frames of
tokens that are tables already. Over whole texts that means six sorts of every token of both sides, so align_texts takes
the same steps (cumulated lengths, equal ends, running counts, ranges) on one text's arrays inside the task that has
encoded it, and only what spans the corpus, the counts of linked ids, is exploded, grouped and joined.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frugal, parts, written

#: A's ids times this plus B's is an id pair's code, under 2 ** 31.
STEP = 1 << 15
#: A table of so many counted pairs at most (16 bytes each before hashing) is broadcast; a larger one is joined by a shuffle.
MOST_SENT = 3_000_000
#: A text with a blank run of so many characters goes to the slower library, as the faster one's patterns overflow there.
LONG_BLANKS = re.compile(r"\s{20000}")

LINKS = ("n_a", "n_b", "n_groups", "n_links")


class Tokenizers:
    """A: byte-level BPE, of space + text; B: BPE pieces with byte fallback, of text. Ids and their bytes."""

    def __init__(self, ranks: bytes, pattern: str, model: bytes, library: bytes) -> None:
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.library = library
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a = [b""] * (max(table.values()) + 1)
        for k, v in table.items():
            self.a[v] = k
        n = self.pieces.get_piece_size()
        self.b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.pieces.id_to_piece, range(n)))]
        if n > STEP or len(self.a) > 1 << 16:
            raise ValueError("a vocabulary is too large for the pair codes")
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.a, self.b)]
        # a token's decimal id with what follows it: a comma, the mark between sides or the mark between groups
        self.shown = [f"{i}{end}" for end in (",", "|") for i in range(len(self.a))] + [f"{i}{end}" for end in (",", ";") for i in range(n)]

    @lru_cache(1)  # noqa: B019  one object a worker
    def slow(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.library.decode())
        t.encode_special_tokens = True
        return t

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both; None where a side's bytes are not those of space + text."""
        spaced = " " + text
        if len(text) > 20_000 and LONG_BLANKS.search(text):
            a = np.array(self.slow().encode(spaced, add_special_tokens=False).ids, np.int64)
        else:
            a = self.fast.encode_to_numpy(spaced, disallowed_special=()).astype(np.int64)
        b, whole = self.pieces.encode(text), spaced.encode()
        if b"".join(map(self.b.__getitem__, b)) != whole or b"".join(map(self.a.__getitem__, a.tolist())) != whole:
            return None
        return a, np.array(b, np.int64)


def aligned(tok: Tokenizers, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A and each B token (from 0), and for each A token the first B token that it overlaps and how many."""
    end_a, end_b = np.cumsum(tok.sizes[0][a]), np.cumsum(tok.sizes[1][b])
    at = np.searchsorted(end_b, end_a)  # the first B token that ends where A's does or later
    cut_a = end_b[at] == end_a
    cut_b = np.zeros(len(b), bool)
    cut_b[at[cut_a]] = True
    before = lambda cut: np.cumsum(cut) - cut
    first = np.searchsorted(end_b, end_a - tok.sizes[0][a], side="right")
    return before(cut_a), before(cut_b), first, at - first + 1


def listed(tok: Tokenizers, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group, A's and B's."""
    n, m, k = len(tok.a), len(tok.b), int(group_a[-1]) + 1
    ends = lambda g: np.append(g[1:] != g[:-1], True)
    starts_b, ends_a = np.searchsorted(group_b, np.arange(k)), np.searchsorted(group_a, np.arange(k), side="right")
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + starts_b[group_a]] = a + n * ends(group_a)
    out[np.arange(len(b)) + ends_a[group_b]] = 2 * n + b + m * ends(group_b)
    return "".join(map(tok.shown.__getitem__, out.tolist()))[:-1]


_made: dict = {}


def _tokenizers(spec) -> Tokenizers:
    """One pair of tokenizers for each worker process."""
    key, *files = spec.value
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizers(*files)
    return _made[key]


def load_tokenizers(spark: SparkSession, ranks: str, pattern: str, model: str, library: str):
    """The vocabulary files, read by the driver and broadcast (a few MB, whatever the data)."""
    read = [open(p, "rb").read() for p in (ranks, model, library)]  # noqa: SIM115
    return spark.sparkContext.broadcast(((ranks, model), read[0], pattern, read[1], read[2]))


def align_texts(docs: DataFrame, spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) for every row of docs, in its order.

    pairs array<long>: each linked id pair of the text once, its code in the upper 32 bits, its links in the lower.
    Texts that are null, empty or not kept by a tokenizer give zeros, an empty string and no pairs. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(spec)
        for x in parts(batches, rows=512):
            counts, digests, pairs = np.zeros((4, x.num_rows), np.int64), [""] * x.num_rows, []
            for row, text in enumerate(x.column(1).to_pylist()):
                ids = tok.encode(text) if text else None
                if not ids:
                    pairs.append(np.zeros(0, np.int64))
                    continue
                a, b = ids
                group_a, group_b, first, n = aligned(tok, a, b)
                total = int(n.sum())
                other = b[np.arange(total) - np.repeat(np.cumsum(n) - n - first, n)]
                code, links = np.unique(np.repeat(a, n) * STEP + other, return_counts=True)
                pairs.append((code << 32) | links)
                counts[:, row] = len(a), len(b), group_a[-1] + 1, total
                digests[row] = hashlib.sha256(listed(tok, a, b, group_a, group_b).encode()).hexdigest()
            ends = np.concatenate(([0], np.cumsum([len(p) for p in pairs]))).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pairs)))
            yield pa.RecordBatch.from_arrays([x.column(0), *map(pa.array, counts), pa.array(digests), made], names=["doc_id", *LINKS, "groups_sha256", "pairs"])

    kinds = "".join(f"{c} long, " for c in LINKS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), f"doc_id long, {kinds}groups_sha256 string, pairs array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many rows each pair's code occurs, and whether no pair of its A id occurs in more."""
    n = rows.select(F.explode("pairs").alias("x")).groupBy(F.shiftright("x", 32).alias("pair")).agg(F.count("*").alias("docs"))
    return n.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(F.floor(F.col("pair") / STEP))))


def alignment_report(docs: DataFrame, spec, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    A pair's count is the number of rows that hold it linked, repeated rows included. n_best: links whose count is the
    highest of their A id, ties included; count_sum: counts summed over links. Null ids give rows like others; an empty
    table gives none. See align_texts for texts. Rows are written once with their pairs, so a lost executor repeats
    no encoding; pairs meet their counts in a broadcast join up to most_sent counted pairs, beyond in a shuffled one.
    """
    rows = written(align_texts(docs, spec).withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(rows))
    met = F.broadcast(counts) if counts.count() <= most_sent else counts.hint("merge")
    links = rows.select("row", F.explode("pairs").alias("x")).select("row", F.shiftright("x", 32).alias("pair"), F.col("x").bitwiseAND(F.lit((1 << 32) - 1)).alias("links"))
    sums = links.join(met, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
    out = rows.join(sums, "row", "left")
    return out.select("doc_id", *LINKS, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def token_ends(tokens: DataFrame) -> DataFrame:
    """tokens(doc, pos, id, size) with start and end: where each token's bytes begin and end in its document."""
    end = F.sum("size").over(Window.partitionBy("doc").orderBy("pos"))
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


def common_groups(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (doc, pos, id, size, start, end) with group: how many common ends lie before the token."""
    cuts = a.select("doc", "end").join(b.select("doc", "end"), ["doc", "end"]).withColumn("cut", F.lit(1))
    w = Window.partitionBy("doc").orderBy("pos")
    grouped = lambda x: x.join(cuts, ["doc", "end"], "left").withColumn("group", F.sum(F.coalesce("cut", F.lit(0))).over(w) - F.coalesce("cut", F.lit(0))).drop("cut")
    return grouped(a), grouped(b)


def token_links(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, group, pos_a, a, pos_b, b): all pairs of tokens of a group whose byte ranges overlap. Tokens have a byte at least."""
    side = lambda x, s: x.select("doc", "group", F.col("pos").alias(f"pos_{s}"), F.col("id").alias(s), F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}"))
    return side(a, "a").join(side(b, "b"), ["doc", "group"]).where("start_a < end_b and start_b < end_a").select("doc", "group", "pos_a", "a", "pos_b", "b")
