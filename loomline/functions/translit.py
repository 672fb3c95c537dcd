"""Romanising words of several scripts: the longest entry of a table at each place, Hangul by arithmetic, marks dropped.

The table (some hundred entries) goes to the workers with the function; readings of Chinese characters are a parameter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Rows of the kana table (vowels a i u e o by consonant), its glides, Cyrillic and single Latin letters, parts of Hangul syllables.
VOWELS = "aiueo"
HIRAGANA = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
IRREGULAR = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "o", "ん": "n", "ゔ": "vu", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゃ": "ya", "ゅ": "yu", "ょ": "yo"}
GLIDES = {"き": "ky", "し": "sh", "ち": "ch", "に": "ny", "ひ": "hy", "み": "my", "り": "ry", "ぎ": "gy", "じ": "j", "ぢ": "j", "び": "by", "ぴ": "py"}
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґўј", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya i yi ye g u j".replace("_", "").split(" "), strict=True))
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng"}
LEADS = "g kk n d tt r m b pp s ss _ j jj ch k t p h".replace("_", "").split(" ")
MIDDLES = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
TAILS = "_ k k k n n n t l k m l l l p l m p p t t ng t t k t p t".replace("_", "").split(" ")


@lru_cache(1)
def table() -> dict[str, str]:
    """Kana with glides and small tsu, both kinds, Cyrillic and single Latin letters, from the rows above."""
    kana = {k: c + v for c, row in HIRAGANA.items() for k, v in zip(row, VOWELS, strict=True)} | IRREGULAR
    for k, c in GLIDES.items():
        kana |= {k + small: c + v for small, v in zip("ゃゅょ", "auo", strict=True)}
    kana |= {"っ" + k: v[0].replace("c", "t") + v for k, v in kana.items() if v[0] not in VOWELS + "n" and k[0] not in "ゃゅょ"} | {"っ": ""}
    higher = lambda k: "".join(chr(ord(c) + 0x60) for c in k)  # noqa: E731  katakana lie that far behind
    return kana | {higher(k): v for k, v in kana.items()} | {"ー": "", "・": " "} | CYRILLIC | LATIN


def hangul(c: str) -> str:
    n = ord(c) - 0xAC00
    return LEADS[n // 588] + MIDDLES[n % 588 // 28] + TAILS[n % 28]


def romanise(text: str, entries: Mapping[str, str], longest: re.Pattern) -> str:
    """Lower case; letters that marks make up are taken apart once no entry holds them."""
    whole = unicodedata.normalize("NFKC", text).lower()
    out = longest.sub(lambda m: entries[m[0]] if m[0] in entries else hangul(m[0]), whole)
    return "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c)).lower()


class Romaniser:
    """The letters of words by a table of entries; a bounded number of words met before is kept."""

    def __init__(self, han: Mapping[str, str] | None = None) -> None:
        self.entries, self.known = table() | dict(han or {}), {}
        self.longest = re.compile("|".join(map(re.escape, sorted(self.entries, key=len, reverse=True))) + "|[가-힣]")

    def __call__(self, word: str) -> str:
        if (found := self.known.get(word)) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[word] = "".join(re.findall("[a-z']", romanise(word.replace("’", "'").replace("`", "'"), self.entries, self.longest)))
        return found


def romanised_rows(docs: DataFrame, key: str, text: str, han: Mapping[str, str] | None = None, most: int = 65_536) -> DataFrame:
    """(key, at, word, roman): a row for each of romanised_words(); null texts and those without words give none.

    Words leave a task in batches of `most` or fewer, so that its memory goes by the longest text, not by the rows of a batch.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roman = Romaniser(han)
        keys, at, words = [], [], []

        def out() -> pa.RecordBatch:
            cols = [pa.array(keys, to_arrow_type(kind)), pa.array(at, pa.int32()), pa.array(words, pa.string()), pa.array(list(map(roman, words)), pa.string())]
            for c in (keys, at, words):
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names=[key, "at", "word", "roman"])

        for x in batches:
            for k, t in zip(x.column(0), x.column(1), strict=True):
                found = (t.as_py() or "").split()
                for a in range(0, len(found), most):
                    part = found[a : a + most]
                    if len(words) + len(part) > most:
                        yield out()
                    keys += [k.as_py()] * len(part)
                    at += range(a, a + len(part))
                    words += part
        if words:
            yield out()

    schema = StructType([StructField(key, kind), StructField("at", IntegerType()), StructField("word", StringType()), StructField("roman", StringType())])
    return docs.select(key, text).mapInArrow(run, schema)


def romanised_words(text: Column, han: Mapping[str, str] | None = None) -> Column:
    """Array of (at, word, roman): the words of a text that blanks part, each with its letters a-z and apostrophes.

    at is the word's place among all words, so that words without letters leave a gap when they are left out. han maps
    Chinese characters (or runs of them, the longest first) to readings; without it they have no letters. Null gives null.
    The arrays of a whole batch are held at once: for tables of long texts romanised_rows() gives the same as rows.
    """

    @F.pandas_udf("array<struct<at:int,word:string,roman:string>>")
    def words(x: pd.Series) -> pd.Series:
        roman = Romaniser(han)
        return x.map(lambda t: None if t is None else [{"at": i, "word": w, "roman": roman(w)} for i, w in enumerate(t.split())])

    return words(text)
