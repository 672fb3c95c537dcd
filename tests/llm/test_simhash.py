"""SimHash against a brute-force version of its rule."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from loomline.llm.simhash import _set_links, block_masks, cover_masks, drop_alike, drop_near_copies, fingerprint, set_components, set_fingerprints, simhash_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> bit & 1 for s in shingles) * 2 > len(shingles):
            out |= 1 << bit
    return out


def brute(rows):
    prints = [(i, plain(t)) for i, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", low.get(find(k))) for k, (i, f) in enumerate(prints)), key=str)


def corpus():
    rng = random.Random(5)
    vocab = [rng.choice("bcdfgh") + rng.choice("aeiouéß") + rng.choice("klmnp") for _ in range(90)]
    rows = [(k, " ".join(rng.choices(vocab, k=rng.randint(1, 400)))) for k in range(150)]
    for k in range(150, 300):
        words = rows[rng.randrange(40)][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((k, " ".join(words)))
    base = " ".join(rng.choices(vocab, k=900)).split()
    for k in range(300, 380):  # a dense group
        words = list(base)
        words[rng.randrange(900)] = rng.choice(vocab)
        rows.append((k, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "A\x0bB\x0cC D"), (404, "a b c d"), (405, "É b"), (406, "é b"), (404, "a b c d"), (None, "a b c d"), (None, "alone here it stands now"), (407, "x " * 40_000)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 1, 9, "clash") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, simhash_components(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_masks_catch_every_close_pair():
    rng = random.Random(1)
    masks = block_masks(4, 7)
    assert len(masks) == 35
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 4):
            y ^= 1 << bit
        assert any(x & m == y & m for m in masks)


def test_drop_keeps_one_of_each_group(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 1, 9, "clash") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.text) for r in drop_near_copies(df).collect() if r.doc_id is not None)
    want = {i for i, _, c in brute(rows) if i == c and i is not None}
    assert {i for i, _ in got} == want and len(got) == len(want)


def test_equals_spark_hash(spark):
    text = "one Two three four five"
    row = spark.sql("select xxhash64('one two three four') a, xxhash64('two three four five') b").first()
    assert fingerprint(text.encode()) == (row.a & row.b) & (2**64 - 1)


def test_alike_sets_against_brute_force(spark):
    rng, rows = random.Random(9), []
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    for k in range(400):  # pairs from equal to far apart
        a = words(rng.choice((40, 120, 300)))
        b = list(a)
        for _ in range(rng.randint(0, max(2, len(a) // 25))):
            b[rng.randrange(len(b))] = "new"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    base = words(400)
    for k in range(1000, 1060):  # a dense group
        b = list(base)
        b[rng.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(b)))
    far = words(200)
    for k in range(1100, 1180):  # copies of one text, each edited on its own: some of them link, most not with most
        b = list(far)
        for _ in range(rng.randint(2, 6)):
            b[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(b)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows}
    odd = [(1400, None), (1401, ""), (1402, " \n"), (1403, "one Two"), (1404, "ONE two"), (1405, "alone"), (1406, "x y " * 30_000), (1406, "x y " * 30_000), (None, "one two"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 9, "clash") for i, t in [*rows, *odd]], SCHEMA)
    found = set_components(df).collect()
    assert len(found) == len(rows) + len(odd)
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    index = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = [(2 * k, 2 * k + 1, index(2 * k, 2 * k + 1)) for k in range(400)]
    assert all(j >= 0.8 for a, b, j in near if got[a] == got[b])
    edge, close = ([got[a] == got[b] for a, b, j in near if low <= j < high] for low, high in ((0.8, 0.85), (0.85, 2)))
    assert len(edge) > 40 and sum(edge) >= 0.9 * len(edge) and len(close) > 100 and sum(close) >= 0.98 * len(close)
    assert {got[k] for k in range(1000, 1060)} == {1000}
    own = range(1100, 1180)
    for k in own:  # its own component's members link with others of it, never with one outside alone
        assert got[k] == k or any(got[j] == got[k] and index(j, k) >= 0.8 for j in own if j != k)
    linked = [got[j] == got[k] for j in own for k in own if j < k and index(j, k) >= 0.8]
    assert len(linked) > 40 and sum(linked) >= 0.95 * len(linked)
    assert got[1400] == got[1401] == got[1402] == 1400 and got[1403] == got[1404] == 1403 and got[1405] == 1405 and got[1406] == 1406
    assert {r.component_id for r in found if r.doc_id is None} == {1400, 1403}
    kept = [r.doc_id for r in drop_alike(df).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(got.values())) and kept.count(None) == 2
    assert set_components(df.limit(0)).collect() == [] and drop_alike(df.limit(0)).collect() == []


def test_blocks_hold_each_bit_alike_often():
    blocks = cover_masks()
    assert blocks.shape == (48, 18) and all(len(set(b)) == 18 for b in blocks.tolist())


def test_a_large_group_gives_no_pairs(spark):
    """Texts just below the bound, each with many: stars and blocks instead of a row for each pair, and no link is lost that pairs would find."""
    rng, base, rows = random.Random(11), [f"w{k}" for k in range(120)], []
    for k in range(700):
        b = list(base)
        for at in rng.sample(range(0, 120, 6), 3 if k % 50 else 1):
            b[at] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(b)))
    fps = set_fingerprints(pa.array([t for _, t in rows]))
    blocks = cover_masks()
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, blocks].astype(np.int64)
    key = ((bits << np.arange(18)).sum(2) + (np.arange(48) << 18)).ravel()
    node, order = np.repeat(np.arange(700), 48), np.lexsort((np.repeat(np.arange(700), 48), key))
    batch = pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(node[order]), pa.array([fps[k].tobytes() for k in node[order]], pa.binary())], names=["key", "node", "fp"])
    out = sum(x.num_rows for x in _set_links(37, 93, 8)(iter([batch])))
    assert 600 < out < 40_000  # of 244,650 pairs
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in rows}
    got = {r.doc_id: r.component_id for r in set_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(linked) > 50 and sum(got[a] == got[b] for a, b in linked) >= 0.98 * len(linked)
    up = {k: k for k in sets}
    for a, b in linked:  # no component joins what exact links keep apart
        x, y = a, b
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        up[max(x, y)] = min(x, y)
    root = lambda x: x if up[x] == x else root(up[x])
    assert all(root(k) == root(got[k]) for k in sets)
