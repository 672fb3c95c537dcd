"""Compact windows and shared passages against brute force."""

import gc
import random

import numpy as np
import pyarrow as pa
import xxhash

from loomline.llm import passages
from loomline.llm.common import frugal, word_hashes
from loomline.llm.passages import compact_windows, cut, drop_shared_passages, keys, passage_classes, shared_passages, shared_spans, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, root string"


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 9, 40, 133):
        for least in (1, 2, 5, 9):
            h = rng.integers(1, 60, n).astype(np.uint64)
            want = []

            def split(a, b, h=h, least=least, want=want):
                if b - a + 1 >= least:
                    c = a + int(np.argmin(h[a : b + 1]))
                    want.append((a, c, b))
                    split(a, c - 1), split(c + 1, b)

            split(0, n - 1)
            assert sorted(zip(*map(np.ndarray.tolist, compact_windows(h, least)))) == sorted(want)


def corpus():
    rng = random.Random(7)
    vocab = [a + b + c for a in "bdfg" for b in "aeiou" for c in "klmnprst"]
    words = lambda n: rng.choices(vocab, k=n)
    rows = {k: words(rng.randint(5, 260)) for k in range(120)}
    planted, near = set(), set()
    hot = words(70)
    for k in range(10, 50):  # one passage in many documents
        rows[k] = words(60) + hot + words(60)
        planted.add(k)
    for k in range(60, 70):  # passages that two share
        p = words(56)
        rows[k], rows[k + 10] = words(40) + p + words(30), words(20) + p
        planted |= {k, k + 10}
    for k in range(80, 90):  # near: two words edited
        p = words(160)
        q = list(p)
        q[40], q[110] = "changed", "edited"
        rows[k], rows[k + 10] = words(30) + p + words(30), words(10) + q + words(20)
        near |= {k, k + 10}
    line = words(24)
    for k in range(100, 120):  # a common line is no passage
        rows[k] = words(50) + line + words(50)
    return {k: " ".join(w) for k, w in rows.items()}, planted, near


def brute(texts, passage=46):
    """Documents that share an exact run of 50 words with one of smaller id."""
    seen, out = {}, set()
    for k in sorted(texts):
        w = texts[k].split()
        runs = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        if any(r in seen for r in runs):
            out.add(k)
        for r in runs:
            seen.setdefault(r, k)
    return out


def test_shared_passages(spark):
    texts, planted, near = corpus()
    odd = [(500, None), (501, ""), (None, texts[10]), (502, texts[10].upper().replace(" ", "\n\t")), (503, "x y z w v " * 9000), (504, "x y z w v " * 9000), (504, "x y z w v " * 9000)]
    df = spark.createDataFrame([(k, t, "en", "s", 1, "clash", "clash") for k, t in [*texts.items(), *odd]], SCHEMA)
    got = passage_classes(df).collect()
    assert len(got) == len(texts) + len(odd)
    repeated = {r.doc_id for r in got if r.n_repeated}
    assert brute(texts) <= repeated
    assert repeated - {502, 504} <= planted | near
    assert len(repeated & near) >= 9
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by[k].component_id for k in range(10, 50)} == {10} and by[502].component_id == 10 and by[504].component_id == 503
    assert all(by[k].component_id == k and by[k].n_links == 0 for k in range(100, 120))
    kept = {r.doc_id: r.text for r in drop_shared_passages(df).collect() if r.doc_id is not None and r.doc_id != 504}
    assert all(kept[k] == t for k, t in texts.items() if k not in repeated) and kept[500] is None
    hot = set(zip(*[texts[10].split()[60:130][i:] for i in range(5)]))
    for k in range(11, 50):
        w = kept[k].split()
        assert not hot & set(zip(*[w[i:] for i in range(5)])) and 110 <= len(w) <= 130
    assert not brute({k: t for k, t in kept.items() if t})


def test_rows_of_one_id_with_other_texts_stay(spark):
    rng = random.Random(3)
    line = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    shared = line(80)
    first, second, other = (" ".join(w) for w in (line(20) + shared, ["a"] + line(20) + shared, ["z"] + line(150)))
    df = spark.createDataFrame([(1, first, None), (2, second, 7), (2, other, 8), (2, second, 9), (2, None, 10)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, drop_shared_passages(df).collect()), key=str)
    short = " ".join(second.split()[:21]) + " "
    assert got == sorted([(1, first, None), (2, short, len(short)), (2, other, 8), (2, short, len(short)), (2, None, 10)], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert shared_passages(df).collect() == [] and passage_classes(df).collect() == [] and drop_shared_passages(df).collect() == []


def test_cut():
    assert cut("a b  c\nd é f", [(1, 2), (2, 3)]) == "a  é f"
    assert cut("a b", [(0, 1)]) == "" and cut("a b", [(0, 5)]) == "a b"


def test_true_partner_behind_an_unlike_first_document(spark):
    texts, firsts = {}, []
    for k, seed in enumerate((2, 79, 110, 143, 146)):  # by these seeds every key that C and B share is A's too
        rng = random.Random(seed)
        words = lambda n, rng=rng: [f"w{rng.randrange(5000)}" for _ in range(n)]
        a = words(60)
        c = list(a)
        c[20], c[40] = "xa", "xb"
        b = list(c)
        b[10], b[50] = "xc", "xd"
        ids = [10 * k + 1, 10 * k + 2, 10 * k + 3]
        texts |= {i: " ".join(words(40) + p + words(40)) for i, p in zip(ids, (a, c, b))}
        firsts.append(ids)
        h = [shingles(texts[i].encode()) for i in ids]
        own = [set(keys(x, 46)[0].tolist()) for x in h]
        assert own[1] & own[2] and own[1] & own[2] <= own[0] and not shared_spans(h[2], h[0], 46)
    hot = " ".join(f"h{k}" for k in range(45))  # a line too short for a passage: all that share it fail, round by round
    rng = random.Random(3)
    texts |= {k: " ".join(f"v{rng.randrange(9000)}" for _ in range(60)) + " " + hot + " " + " ".join(f"v{rng.randrange(9000)}" for _ in range(60)) for k in range(100, 140)}
    df = spark.createDataFrame([(k, t, "en", "s", 1, "clash", "clash") for k, t in texts.items()], SCHEMA)
    got = {(r.doc_id, r.of) for r in shared_passages(df).collect()}
    assert all((b, c) in got for _, c, b in firsts) and all(d < 100 for d, _ in got)


def test_edited_short_passages(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, want, number = {}, set(), 0
    for size in (51, 55, 62, 70):
        for kind in ("replace", "insert", "delete", "first", "last"):
            for _ in range(4):
                p = words(size)
                q, at = list(p), {"first": rng.randrange(1, 4), "last": size - rng.randrange(2, 5)}.get(kind, rng.randrange(1, size - 1))
                if kind == "insert":
                    q.insert(at, "new")
                elif kind == "delete":
                    del q[at]
                else:
                    q[at] = "new"
                texts |= {number: " ".join(words(60) + p + words(50)), number + 1: " ".join(words(30) + q + words(70))}
                want.add((number + 1, number))
                number += 2
    for k in range(45, 50):  # runs just too short
        p = words(k)
        texts |= {1000 + 2 * k: " ".join(words(60) + p + words(50)), 1001 + 2 * k: " ".join(words(30) + p + words(70))}
    df = spark.createDataFrame([(k, t, "en", "s", 1, "clash", "clash") for k, t in texts.items()], SCHEMA)
    got = {(r.doc_id, r.of) for r in shared_passages(df).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_words_are_hashed_by_columns(monkeypatch):
    words = ["a", "é", "Ab", "x" * 7, "y" * 8, "z" * 13, "long" * 8, "w" * 31, "v" * 90]
    want = [xxhash.xxh64_intdigest(w.lower().encode()) for w in words]
    calls, digest = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a, **k: calls.append(a) or digest(*a, **k))
    got, starts = word_hashes(pa.array(["skipped", " " + " \n".join(words) + " ", None, "", "a"])[1:])
    assert got.tolist() == [*want, want[0]] and starts.tolist() == [0, 9, 9, 9, 10] and len(calls) == 2  # the two of 32 bytes or more


def test_a_first_text_is_put_in_order_once(monkeypatch):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = words(60)
    first, others = " ".join(words(30) + shared), [" ".join(words(k) + shared + words(9)) for k in range(50)]
    calls, ordered = [], passages.ordered
    monkeypatch.setattr(passages, "ordered", lambda h: calls.append(len(h)) or ordered(h))
    rows = pa.record_batch([pa.array(range(1, 51)), pa.array([0] * 50), pa.array([[k + 20] for k in range(50)], pa.list_(pa.int32())), pa.array(others), pa.array([first] * 50)], names=["doc_id", "of", "at", "text_b", "text_a"])
    got = [r for x in passages._verified(46)(iter([rows])) for r in x.to_pylist() if r["key"] is None]
    assert [(r["doc_id"], r["first"], r["last"]) for r in got] == [(k + 1, k, k + 59) for k in range(50)] and len(calls) == 1


def test_later_steps_leave_the_texts_where_they_are(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    hot, shared = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("h", 45), ("s", 70)))  # the first is too short for a passage: all that share it fail, step by step
    bits = lambda k: " ".join(f"b{i}{k >> i & 1}" for i in range(4))
    texts = {k: f"{words(60)} {hot} {bits(k)} {words(60)}" for k in range(30)} | {30 + k: f"{words(30)} {hot} {shared if k % 2 else words(60)}" for k in range(10)}
    df = spark.createDataFrame([(k, t, "en", "s", 1, "clash", "clash") for k, t in texts.items()], SCHEMA)
    made, written = [], passages.written
    monkeypatch.setattr(passages, "written", lambda x: made.append(x.columns) or written(x))
    got, writes = sorted(map(tuple, shared_passages(df).collect())), list(made)
    assert {r[0] for r in got} == {33, 35, 37, 39} and len([x for x in writes if "key" in x]) > 2
    assert len([x for x in writes if x == ["doc_id", "text"]]) <= 2  # of all pairs, and once of the few that are left
    made.clear()
    monkeypatch.setattr(passages, "FEW", 0)
    assert sorted(map(tuple, shared_passages(df).collect())) == got and len(made) > len(writes)


def test_workers_do_not_go_through_what_they_loaded_after_each_task(spark):
    def run(batches):
        for _ in batches:
            pass
        yield pa.record_batch([pa.array([gc.get_freeze_count()])], names=["n"])

    assert spark.range(8, numPartitions=4).mapInArrow(frugal(run), "n long").where("n = 0").count() == 0
