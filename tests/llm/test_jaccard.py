"""The Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm.jaccard import Bands, jaccard_components, may_link, sets_of, sketch

SCHEMA = "doc_id long, text string, key long, id long, n long, rep string, component string"


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}


def brute(rows):
    sets, up = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                same = sets[a] and sets[a] == sets[b]
            else:
                common = len(sets[a] & sets[b])
                same = (sets[a] and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common) and sets[b]) or rows[a][0] == rows[b][0] and sets[a] and sets[b]
            if same and (rows[a][0] is not None and rows[b][0] is not None):
                up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        if i is None:
            twins = [low[find(j)] for j, (o, _) in enumerate(rows) if o is not None and sets[j] == sets[k] and sets[k]]
            out.append((i, len(sets[k]), min(twins, default=None)))
        else:
            out.append((i, len(sets[k]), low[find(k)] if sets[k] else i))
    return sorted(out, key=str)


def corpus(seed, base_sizes=(1, 400)):
    rng = random.Random(seed)
    vocab = [rng.choice("bcdfgh") + rng.choice("aeiouéß") + rng.choice("klmnp") + rng.choice("aeiou") for _ in range(600)]
    rows = [(k, " ".join(rng.choices(vocab, k=rng.randint(*base_sizes)))) for k in range(120)]
    for k in range(120, 360):  # edited copies around the bound
        words = rows[rng.randrange(k)][1].split()
        for _ in range(rng.randint(0, 1 + len(words) // 45)):
            at, what = rng.randrange(len(words)), rng.random()
            words[at : at + (what < 0.7)] = [rng.choice(vocab)] * (what > 0.3)
            words = words or ["x"]
        rows.append((k, " ".join(words)))
    line = " ".join(rng.choices(vocab, k=24))
    for k in range(360, 460):  # a common passage in unlike documents, much of each
        rows.append((k, line + " " + " ".join(rng.choices(vocab, k=rng.choice([3, 6, 12, 30])))))
    base = rng.choices(vocab, k=300)
    for k in range(460, 560):  # a group of near copies
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(300)] = rng.choice(vocab)
        rows.append((k, " ".join(words)))
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "A\x0bB\x0cC"), (604, "a b c"), (605, "a b c d"), (606, "a b c d"), (606, "a b c d"), (None, "a b c d"), (None, "nobody else"), (None, None), (607, "a b"), (608, "a"), (609, "A")]
    rows += [(610, " ".join(f"w{k}" for k in range(30_000))), (611, " ".join(f"w{k}" for k in range(2500, 30_000))), (-5, rows[3][1])]
    rng.shuffle(rows)
    return rows


def run(spark, table, **more):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "x", "y") for i, t in table], SCHEMA).repartition(5)
    return sorted(map(tuple, jaccard_components(docs, **more).collect()), key=str)


@pytest.mark.parametrize(("seed", "most"), [(1, 64), (2, 2), (3, 0)])
def test_components_by_brute_force(spark, seed, most):
    rows = corpus(seed)
    assert run(spark, rows, most=most) == brute(rows)


def test_small_sets_and_large_corpora(spark):
    rows = corpus(4, (4, 60))
    assert run(spark, rows, rows=10**9) == brute(rows)


def test_one_id_with_two_texts_and_empty(spark):
    rows = [(1, "one two three four five"), (1, "six seven eight nine"), (2, "six seven eight nine"), (3, "one two three four five"), (4, "else")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []


def test_bounds():
    bands = Bands(85, 100, 10**6)
    for a in range(1, 260):
        apart = [a + b - 2 * i for b in range(a, 2 * a) for i in range(a + 1) if 100 * i >= 85 * (a + b - i)]
        assert bands.apart(np.array([a]))[0] == max(apart)
        n = np.array([a])
        assert bands.m[bands.band(n)[0]] >= bands.needed(n)[0] and (not max(apart) or bands.needed(n)[0] * bands.v[bands.band(n)[0]] > max(apart) + bands.x[bands.band(n)[0]])


def test_sketches_never_drop_a_link():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 300)
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        b = np.concatenate((a[rng.randint(0, n // 8) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, n // 8))], np.uint64)))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert may_link(len(a), sketch(a), len(b), sketch(b), 85, 100)
    far = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64), np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    assert not may_link(500, sketch(far[0]), 500, sketch(far[1]), 85, 100)


def test_sets():
    tokens, starts = sets_of(pa.array(["a b c d a b c d", None, "x y", "y x", "X\ty"]), 4)
    assert np.diff(starts).tolist() == [4, 0, 1, 1, 1]
    assert tokens[4] != tokens[5] and tokens[4] == tokens[6]
