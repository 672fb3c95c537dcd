"""BPE by dynamic programming over prefixes: exact ids in time linear in the text.

For every prefix of a word there is one last token that a merge-by-rank encoder would end it with. It is
the vocabulary entry that is a suffix of the prefix (an automaton over all entries finds these) and that
may stand behind the last token of what comes before it. Two tokens may stand side by side if undoing
their merges, latest first, never meets a merge across the border that would have come earlier.
Following the last tokens back from the end gives the encoding.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, without

WORD_END = 256  # added to the byte that ends a word


@cache
def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    out, spare = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + spare)] = b
            spare += 1
    return out


class WordBpe:
    """A lower-casing, word-end-marking byte-level BPE read from a tokenizers JSON file."""

    KEEP_WORDS, KEEP_PAIRS, LONG_WORD = 80_000, 200_000, 64

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab, byte_of = model["vocab"], _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_of_id = {i: t for t, i in (*vocab.items(), *self.special.items())}
        # symbols: 0-255 bytes, 256-511 bytes that end a word, then merges by rank
        self.left, self.right, self.ids, self.pair = list(range(512)), list(range(512)), [-1] * 512, {}
        symbol, spelled = {}, [chr(s) for s in range(512)]
        for char, b in byte_of.items():
            for name, s in ((char, b), (char + suffix, b + WORD_END)):
                if name in vocab:
                    self.ids[s], symbol[name] = vocab[name], s
        for x in model["merges"]:
            a, b = x.split(" ") if isinstance(x, str) else x
            s = len(self.left)
            self.left.append(symbol[a]), self.right.append(symbol[b])
            self.pair[symbol[a], symbol[b]] = s
            self.ids.append(vocab[a + b]), spelled.append(spelled[symbol[a]] + spelled[symbol[b]])
            symbol[a + b] = s
        # an entry that its own spelling doesn't encode to never ends a prefix
        usable = [i >= 0 for i in self.ids]
        for s in range(512, len(self.ids)):
            usable[s] = usable[self.left[s]] and usable[self.right[s]] and self._compatible(self.left[s], self.right[s], s)
        self._build([(spelled[s], s) for s in range(len(spelled)) if usable[s]])
        self.words: dict[str, bytes] = _Kept(self)
        self.pairs: dict[int, bool] = {}
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        self.specials = regex.compile("|".join(f"({regex.escape(t)})" for t in self.special)) if self.special else None

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge before `limit` joins the end of a with the start of b."""
        left, right, pair = self.left, self.right, self.pair
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b and a >= 512:  # a was merged last; a merge across the border must not have come before that
                a, limit = right[a], a
            elif b >= 512:  # of equal ranks the left one goes first
                b, limit = left[b], b + 1
            else:
                return True

    def _build(self, entries: list[tuple[str, int]]) -> None:
        """An automaton whose state is the longest suffix read that some entry starts with; found[state]: the entries that end here, longest first."""
        step, fail, found, deep = {}, [0], [None], [[0]]
        for word, s in entries:
            state = 0
            for depth, c in enumerate(map(ord, word), 1):
                if (to := step.get(state << 9 | c)) is None:
                    to = step[state << 9 | c] = len(found)
                    fail.append(0), found.append(None)
                    if len(deep) <= depth:
                        deep.append([])
                    deep[depth].append(state << 9 | c)
                state = to
            found[state] = (len(word), s)
        for level in deep[1:]:
            for key in level:
                state, c = step[key], key & 511
                at = fail[key >> 9]
                if key >> 9:
                    while at and at << 9 | c not in step:
                        at = fail[at]
                    fail[state] = step.get(at << 9 | c, 0)
                shorter = found[fail[state]] or ()
                found[state] = ((found[state],) if found[state] else ()) + shorter
        self.step, self.fail, self.found = step, fail, found

    def word(self, text: str) -> bytes:
        """The packed ids of one word."""
        raw = list(text.encode("utf-8"))
        raw[-1] += WORD_END
        step, fail, found, pairs = self.step.get, self.fail, self.found, self.pairs
        last, state = [0], 0
        for i, c in enumerate(raw, 1):
            while (to := step(state << 9 | c)) is None and state:
                state = fail[state]
            state = to or 0
            for size, s in found[state] or ():
                if size == i:
                    last.append(s)
                    break
                before = last[i - size]
                if before < 0:
                    continue
                if (good := pairs.get(before << 20 | s)) is None:
                    if len(pairs) > self.KEEP_PAIRS:
                        pairs.clear()
                    good = pairs[before << 20 | s] = self._compatible(before, s, 1 << 62)
                if good:
                    last.append(s)
                    break
            else:
                last.append(-1)
        out, at, sizes = [], len(raw), self._size
        while at:
            s = last[at]
            if s < 0:  # a byte the vocabulary lacks is left out, as the library does without an unknown token
                at -= 1
                continue
            out.append(self.ids[s])
            at -= sizes(s)
        return np.array(out[::-1], "<u4").tobytes()

    @cache  # noqa: B019  one vocabulary lives as long as its worker
    def _size(self, s: int) -> int:
        return 1 if s < 512 else self._size(self.left[s]) + self._size(self.right[s])

    def encode(self, text: str) -> bytes:
        """The packed little-endian 32-bit ids of a text, special tokens in it recognised."""
        if self.specials is None or not (at := list(self.specials.finditer(text))):
            return self._plain(text)
        out, start = [], 0
        for m in at:
            out += [self._plain(text[start : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            start = m.end()
        return b"".join([*out, self._plain(text[start:])])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without regard to what follows
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower())))

    def decode(self, ids) -> str:
        return " ".join(map(self.token_of_id.__getitem__, ids))


class _Kept(dict):
    """Words encoded before: two generations of bounded size, so that frequent words stay."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.older = bpe, {}

    def __missing__(self, word: str) -> bytes:
        if (out := self.older.get(word)) is None:
            out = self.bpe.word(word)
        if len(word) <= self.bpe.LONG_WORD:
            if len(self) >= self.bpe.KEEP_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


_loaded: dict[str, WordBpe] = {}


def _bpe(spec) -> WordBpe:
    """One vocabulary per worker process."""
    key, text = spec.value
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(text)
    return _loaded[key]


def load_spec(spark, path: str):
    """The vocabulary file, read by the driver and broadcast (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((path, f.read()))


Batches = Iterator[pa.RecordBatch]
ROWS = 1024  # rows worked on at once


def _parts(batches: Batches) -> Batches:
    for x in batches:
        for k in range(0, x.num_rows, ROWS):
            yield x.slice(k, ROWS)


def _with(x: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*x.columns, *new.values()], names=[*x.schema.names, *new])


def _rows(ids: pa.ListArray) -> Iterator[np.ndarray]:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        yield values[a:b] if ids[k].is_valid else values[:0]


def encode_batches(batches: Batches, spec, text: str, ids: str) -> Batches:
    bpe = _bpe(spec)
    for x in _parts(batches):
        made = [bpe.encode(t) if t else b"" for t in x.column(text).to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(m) // 4 for m in made]))).astype(np.int32)
        yield _with(x, **{ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))})


def decode_batches(batches: Batches, spec, ids: str, text: str) -> Batches:
    bpe = _bpe(spec)
    for x in _parts(batches):
        yield _with(x, **{text: pa.array([bpe.decode(r.tolist()) for r in _rows(x.column(ids))], pa.string())})


def _mapped(df: DataFrame, run, new: str, kind: str) -> DataFrame:
    rest = without(df, new)
    return rest.mapInArrow(frugal(run), rest.select("*", F.lit(None).cast(kind).alias(new)).schema)


def bpe_encode(docs: DataFrame, spec, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids array<int>: the ids of each whole text. Null and empty texts get an empty array.

    Every row gives a row; other columns pass through, but one named like ids_col (case aside) is replaced.
    """
    return _mapped(docs, lambda x: encode_batches(x, spec, text_col, ids_col), ids_col, "array<int>")


def bpe_decode(df: DataFrame, spec, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the library's text of each id array, special tokens included; the empty text for null.

    Every row gives a row; other columns pass through, but one named like text_col (case aside) is replaced.
    """
    return _mapped(df, lambda x: decode_batches(x, spec, ids_col, text_col), text_col, "string")


def bpe_digests(docs: DataFrame, spec) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, both digested.

    The two operators run one after the other within one Python worker, so that ids and decoded texts need not
    go through the JVM. ids_sha256 is over the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Batches) -> Batches:
        import hashlib

        for x in decode_batches(encode_batches(batches, spec, "text", "ids"), spec, "ids", "decoded"):
            ids = [hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in _rows(x.column("ids"))]
            back = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in x.column("decoded").to_pylist()]
            sizes = np.diff(x.column("ids").offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(sizes), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
