"""Filter audit, integer clusters and personal data against brute force, and their edge cases."""
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seasonlens.llm import audit as A, centroids as C, personal as P

SF = "/root/testdata/sf0.001"


# ---- audit ------------------------------------------------------------------------------------
def brute_audit(rows, labels):
    docs = [(k, t or "", s or "") for k, t, s in rows]
    good, toxic = ({r[0] for r in labels if r[i] == 1 and r[0] is not None} for i in (1, 2))
    def fails(k, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                bool(re.search("[#$%&*|]", t)), k is not None and any(k2 is not None and k2 < k and t2 == t for k2, t2, _ in docs))) if bad}
    known = [(s, fails(k, t), k) for k, t, s in docs]
    out, removed = {}, {}
    for part in {s for s, _, _ in known}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(f, k) for s, f, k in known if s == part]
            for i, f in enumerate(order):
                gone = [k for x, k in left if f in x]
                before = [x for s, x, _ in known if s == part and f in x and x & set(order[:i])]
                alone = sum(s == part and x == {f} for s, x, _ in known)
                left = [(x, k) for x, k in left if f not in x]
                out[part, order, i + 1] = [len(left), len(gone), len(before), alone, sum(k in good for k in gone), sum(k in toxic for k in gone)]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
    return {(p, o, i): (*v, removed[p, o[i - 1]]) for (p, o, i), v in out.items()}


def audit_rows(seed=4, n=80):
    rng = random.Random(seed)
    texts = [None, "", "A B", "plain words " * 120, "x # y", " ".join(f"w{i}" for i in range(260)), "HELLO " * 210, "one|two " + " ".join(f"v{i}" for i in range(205))]
    rows = [(rng.randrange(50), rng.choice(texts), rng.choice(("a", "b", None, ""))) for _ in range(n)] + [(None, "", "a"), (None, "x # y", "b")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 50, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("salt_rows", [1000, 3])
def test_audit_equals_brute_force(spark, monkeypatch, salt_rows):
    rows, labels = audit_rows()
    copies = A._copies
    monkeypatch.setattr(A, "_copies", lambda t, r: copies(t, r, salt_rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"h": F.lit(1), "bits": F.lit(2), "n": F.lit(3)})
    got = A.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(rows, labels) and len(got) == 3 * 600


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit_filters(docs, labels).count() == 0


# ---- clusters ---------------------------------------------------------------------------------
def brute_clusters(rows, k, rounds, dims):
    kept = [(key, [math.floor(256 * x) for x in v]) for key, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)
    c = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        c = [[sum(v[j] for (_, v), o in zip(kept, of) if o == i) // of.count(i) for j in range(dims)] if i in of else x for i, x in enumerate(c)]
    return sorted((key if key is not None else -1, near(v)[1], near(v)[0]) for key, v in kept), c


@pytest.mark.parametrize("dims,k,spread", [(6, 7, 1.0), (6, 40, 0.02), (64, 9, 0.5)])
def test_clusters_equal_brute_force(spark, dims, k, spread):
    rng = np.random.default_rng(dims + k)
    centre = rng.normal(size=(5, dims))
    rows = [(i, (centre[i % 5] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(160)]
    rows += [(i, rows[i % 3][1]) for i in range(160, 190)] + [(3, rows[9][1]), (None, rows[8][1])]  # ties, repeated and NULL keys
    bad = [list(rows[0][1]) for _ in range(3)]
    bad[0][1], bad[1][2], bad[2] = float("nan"), float("inf"), bad[2] + [0.0]
    rows += [(500 + i, v) for i, v in enumerate(bad)] + [(600, None), (601, [None] * dims), (602, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit(1), "v": F.lit(2)})
    found = C.cluster(df, k=k, rounds=3, dims=dims, variance=.6)
    want, c = brute_clusters(rows, k, 3, dims)
    assert found.centroids == c
    assert sorted((r.key if r.key is not None else -1, r.cluster, r.distance) for r in found.members.collect()) == want


def test_bounds_lose_nothing_and_filter():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 64)) * 256
    x = np.floor(centre[rng.integers(0, 40, 5000)] + 40 * rng.normal(size=(5000, 64))).astype(np.int64)
    c = np.floor(centre).astype(np.int64)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    k, d, pairs = C.nearest(x, *C._rotated(x, axes, 16), c, axes)
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (k == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all() and pairs.mean() < 2
    big = np.full((3, 64), 1 << 27, np.int64)
    big[1] *= -1
    k, d, _ = C.nearest(big, *C._rotated(big, axes, 16), big[1:2], axes)
    assert d.tolist() == [64 << 56, 0, 64 << 56]


def test_clusters_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.0] * 64), (2, [1e30] * 64)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in C.cluster(df).members.select("key", "cluster", "distance").collect()] == [(1, 0, 0)]
    assert C.cluster(df.limit(0)).members.count() == 0


# ---- personal data ----------------------------------------------------------------------------
def naive_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pieces = ["@", ".", "-", "+", " ", "a", "b1", "é", "12", "7", "256", "0001", "(", ")", "4111111111111111", "+1 (415) 555-0100", "x@y.z", "\n", "１２", "1.2.3.4"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert P.base_spans(t) == naive_base(t), t
    assert P.base_spans("a" * 300_000 + "@" + "b" * 300_000 + "0" * 300_000 + "+1" + " " * 300_000) == []


def segmentations(n, scored):
    by = {}
    for s in scored:
        by.setdefault(s[0], []).append(s)
    def go(i):
        if i == n:
            yield (), 0.0
            return
        for rest, s in go(i + 1):
            yield rest, s
        for x in by.get(i, ()):
            for rest, s in go(x[1]):
                yield (x, *rest), s + x[3]
    return list(go(0))


def test_field_equals_all_segmentations():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        scored = sorted({(i, j, k): (i, j, k, rng.uniform(-3, 3)) for i, j, k in ((rng.randrange(n), 0, rng.randrange(4)) for _ in range(8))
                         for j in [rng.randint(i + 1, n)]}.values(), key=lambda s: (s[1], s[0], s[2]))
        every = segmentations(n, scored)
        z = sum(math.exp(s) for _, s in every)
        best = max(every, key=lambda e: e[1])[0]
        got = P.decode(n, scored)
        assert [g[:3] for g in got] == [b[:3] for b in best]
        for g in got:
            assert g[3] == pytest.approx(sum(math.exp(s) for e, s in every if any(x[:3] == g[:3] for x in e)) / z)


def test_training_gradient_is_that_of_the_likelihood():
    texts = ["call 051-555-0588 now or a1@b.com", "at 4111.1111.1111.1111 or 10[.]0[.]0[.]1"]
    x = P.lattices([(texts[0], [(3, 5, 17), (0, 25, 33)]), (texts[1], [(2, 3, 22), (1, 26, 40)])])
    rng = np.random.default_rng(3)
    w = rng.normal(size=(len(P.FEATURES), 4)) * 0.3
    g = P._gradient(x, w)[1]
    for f, k in ((0, 3), (P.FEATURES.index("tail34"), 3), (P.FEATURES.index("luhn"), 2), (P.FEATURES.index("ending"), 0)):
        step = np.zeros(w.shape)
        step[f, k] = 1e-5
        assert g[f, k] == pytest.approx((P._gradient(x, w + step)[0] - P._gradient(x, w - step)[0]) / 2e-5, abs=1e-4)


@pytest.fixture(scope="module")
def weights(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_held_out_rewritten_data_are_found(spark, weights):
    """Data of other documents than those given to training, rewritten with another seed."""
    rng, found, missed, wrong = random.Random(12), 0, 0, 0
    for i in range(300):
        d = "".join(rng.choice("0123456789") for _ in range(16))
        card = next(c for c in (d[:15] + x for x in "0123456789") if P.luhn(c))
        data = {P.CARD: card, P.PHONE: f"+{rng.randint(1, 99)} ({d[:3]}) {d[3:6]}-{d[6:10]}", P.EMAIL: f"n{d[:3]}.x@site{d[4]}.org",
                P.IP: ".".join(str(rng.randint(1, 255)) for _ in range(4))}
        kind = rng.randrange(4)
        u = P._rewritten(kind, data[kind], rng)
        t = f"Some words before it {u} and then some more, 12 of them."
        got = [s[:3] for s in P.scan_text(t, weights)]
        hit = (kind, 21, 21 + len(u)) in got
        found, missed, wrong = found + hit, missed + (not hit), wrong + len(got) - hit
    assert missed <= 9 and wrong <= 6, (found, missed, wrong)


def test_lookalikes_stay(weights):
    for t in ("2024-03-01 10:30:00", "version 1.2.3 and 10.4", "4111 1111 1111 1112", "meet me at noon", "300.1.1.1", "ISBN 978-3-16-148410-0", "look at example.com for more",
              "12 345 6789 1011 12 1314", "f(at) x", "1,234,567,890 people", "@ home", "5d41402abc4b2a76b9719d911017c592"):
        assert P.scan_text(t, weights) == [], t


def test_boundaries_and_kinds_are_chosen_together(weights):
    t = "tel (415) 555-0100 or ann.b7 (at) mail (dot) example (dot) com, host 10[.]1[.]2[.]3; +1 (415) 555-0100"
    assert [(P.KINDS[k], t[a:b], x) for k, a, b, x in P.scan_text(t, weights)] == [
        ("email", "ann.b7 (at) mail (dot) example (dot) com", False), ("ip", "10[.]1[.]2[.]3", False),
        ("phone", "(415) 555-0100", False), ("phone", "+1 (415) 555-0100", True)]


def test_personal_data_of_any_rows(spark, weights):
    rows = [(1, None), (2, ""), (None, "a@b.com"), (2, "a@b.com"), (3, "é" * 5 + "+1 (415) 555-0100" + "9 " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("personal", F.lit(7))
    got = {(r.doc_id, (r.text or "")[:3]): [tuple(s) for s in r.personal] for r in P.find_personal(df, weights).collect()}
    assert got[1, ""] == got[2, ""] == [] and got[None, "a@b"] == got[2, "a@b"] == [("email", 0, 7, True)]
    assert all(r.personal_in == 7 for r in P.find_personal(df, weights).collect())
    assert P.find_personal(df.limit(0), weights).count() == 0
    assert [r.text for r in P.masked(df.filter("doc_id is null"), weights).collect()] == ["<email>"]
    none = P.fit(df.limit(0))
    assert P.scan_text("(415) 555-0100 and a@b.com", none) == [(0, 19, 26, True)]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_centroid_clusters"])
def test_queries_equal_sql(spark, name):
    import check
    df = entry.queries()[name](spark, SF)
    cols, got = check.rows_of(df.columns, df.collect())
    cur = check.database(SF).execute(entry.oracle_sql()[name])
    ocols, want = check.rows_of([c[0] for c in cur.description], cur.fetchall())
    assert cols == ocols and got == want


def test_personal_query_equals_the_patterns(spark):
    got = {r.doc_id: r for r in entry.queries()["op13_personal_data"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        base = sorted(naive_base(r.text or ""))
        told = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in P.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert set(told.split(",")) - {""} <= set(got[r.doc_id].spans.split(","))
