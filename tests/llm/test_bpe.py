"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomline.llm.bpe import WordBpe, bpe_decode, bpe_encode, load_spec
from loomline.llm.queries import op1_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \n\t", "<|endoftext|>x<|startoftext|> a<|endoftext|>", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ﬁ ½ ¹²³ 𝟛 x́ é É", "日本語テキスト 你好！！！...", "\x1c\x1d a b　c\u0085d ​",
    "don't I'LL we'Ve '''s aaa aaaa aaaaa aaaaaaa", "😀👍🏽🇫🇷 #hash @me", "z" * 3000, "-" * 1000, "\x00a\x01", "the " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_exact_on_random_texts(library):
    rng = random.Random(3)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x500), rng.randrange(0x3000, 0x9FFF), rng.randrange(0x1F300, 0x1F9FF)])) for _ in range(200)) for _ in range(150)]
    texts += ["".join(rng.choice("abethn ns'") for _ in range(200)) for _ in range(150)]
    with open(PATH) as f:
        bpe = WordBpe(f.read())
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = np.frombuffer(bpe.encode(text), "<u4").tolist()
        assert got == want.ids, text[:60]
        assert bpe.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_frames(spark, library):
    rows = [(k, t, "en", "s", 1, "clash") for k, t in enumerate([*ODD, None])] + [(0, "", "en", "s", 1, "clash"), (None, "A b", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, IDS string")
    spec = load_spec(spark, PATH)
    encoded = bpe_encode(df, spec)
    assert encoded.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    for r in bpe_decode(encoded, spec, text_col="back").collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.back == library.decode(want, skip_special_tokens=False)
    assert bpe_encode(df.limit(0), spec).collect() == []


def test_query(spark, library):
    from pathlib import Path

    sf = str(Path("/root/testdata/sf0.001"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
