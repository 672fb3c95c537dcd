"""The filter audit against all orders run one by one."""

import re
from itertools import permutations

import duckdb

from loomline.llm.filter_audit import ORACLE_SQL, audit_documents, filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, id string"
WORDS = " ".join(f"w{k}" for k in range(220))
ROWS = [
    (5, WORDS, "s"), (3, WORDS, "t"), (9, WORDS, "s"), (9, WORDS, "s"), (3, WORDS, "t"), (1, "short text", "s"), (2, None, None), (4, "", "t"), (None, WORDS, "s"), (None, None, "s"),
    (10, "same " * 300, "s"), (11, "Ab " * 50 + "#", "t"), (12, "AB\x0bCD\x0c|", "u"), (13, WORDS.upper(), "t"), (14, " \t\n", "s"), (15, "é " * 99 + "É", "t"),
    (16, " ".join(f"x{k}" for k in range(40_000)), "u"), (17, "a " * 100 + "b " * 100, "u"), (18, " ".join(f"n{k}" for k in range(200)), "v"),
]
LABELS = [(3, 1, 0), (9, 0, 1), (9, 1, None), (10, 1, 1), (13, None, None), (None, 1, 1), (99, 1, 1)]


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((source or "", set(fails), i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shares = [r[1:] for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = own
            for k, f in enumerate(p):
                here, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                shares[f] += len(here)
                out[part, "".join(p), k + 1] = [len(left), len(here), sum(f in r[0] for r in own) - len(here), sum(r[0] == {f} for r in own), sum(r[1] for r in here), sum(r[2] for r in here), f]
        for (q, *_), v in out.items():
            if q == part:
                v[-1] = shares[v[-1]] if isinstance(v[-1], str) else v[-1]
    return sorted((*k, *v) for k, v in out.items())


def frames(spark, docs):
    return spark.createDataFrame([(i, t, "x", s, None, 7, "clash", "clash") for i, t, s in docs], DOCS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_all_orders_by_brute_force(spark):
    found = audit_documents(*frames(spark, ROWS))
    assert found.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int"), *[(c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]
    assert sorted(map(tuple, found.collect())) == brute(ROWS, LABELS)


def test_hot_text(spark):
    docs = [(k, "copied words", f"s{k % 3}") for k in range(3000)] + [(k, f"own {k}", "s0") for k in range(3000, 3100)]
    assert sorted(map(tuple, audit_documents(*frames(spark, docs)).where("step > 3").collect())) == [r for r in brute_counts(docs) if r[2] > 3]


def brute_counts(docs):
    """brute() for documents that fail A, and E but for the smallest id of a text."""
    first = {}
    for i, t, _ in docs:
        first[t] = min(i, first.get(t, i))
    few = [(i, t, s) for i, t, s in docs]
    out, good = [], {i: (q == 1, t == 1) for i, q, t in [(3, 1, 0), (9, 1, 1), (10, 1, 1), (99, 1, 1)]}
    for part in sorted({s for *_, s in few}):
        own = [({"A", "E"} if first[t] < i else {"A"}, *good.get(i, (False, False))) for i, t, s in few if s == part]
        shares = {"A": sum(60 if len(f) == 2 else 120 for f, *_ in own), "E": sum(60 for f, *_ in own if len(f) == 2)}
        for p in permutations("ABCDE"):
            left = own
            for k, f in enumerate(p):
                here, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                out.append((part, "".join(p), k + 1, len(left), len(here), sum(f in r[0] for r in own) - len(here), sum(r[0] == {f} for r in own), sum(r[1] for r in here), sum(r[2] for r in here), shares.get(f, 0)))
    return sorted(out)


def test_sql(spark):
    from loomline.llm.queries import op11_filter_audit

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = op11_filter_audit(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL})").fetchall())


def test_empty_and_other_numbers_of_filters(spark):
    docs, labels = frames(spark, ROWS)
    assert audit_documents(docs.limit(0), labels).count() == 0
    assert audit_documents(docs, labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 4, 0, 1), ("p", 1, 2, 0, 0)], "part string, mask int, n long, good long, toxic long")
    assert sorted(map(tuple, filter_audit(counts, "XY").collect())) == [("p", "XY", 1, 5, 6, 0, 2, 0, 1, 8), ("p", "XY", 2, 5, 0, 4, 0, 0, 0, 4), ("p", "YX", 1, 7, 4, 0, 0, 0, 1, 4), ("p", "YX", 2, 5, 2, 4, 2, 0, 0, 8)]
