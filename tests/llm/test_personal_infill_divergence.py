"""Personal data (op11), fill-in-middle (op12) and source divergence (op13) against plain restatements."""

import hashlib
import random
import re
from collections import Counter

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from pagegrain.llm import divergence, infill, personal
from pagegrain.llm import queries as llm

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_source_divergence"])
def test_same_as_sql(spark, name):
    assert difference(llm.queries()[name](spark, SF), connect(SF), llm.oracle_sql()[name]) is None


# op11


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m.group().split("."))) <= 255]
    for k, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if 13 <= len(d) <= 19 and luhn(d) if k == 2 else 9 <= len(d) <= 15:
                out.append((k, *m.span()))
    return ",".join(f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


NONE = personal.Model(0.0, [], {})


def test_base_spans_of_made_up_texts(spark):
    rng = random.Random(3)
    bits = ["a", "b@c", "@", "x.y", "1", "22", "255", "0256", ".", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "é", "\U0001d11e", "\n", "\x01", "_", "%", "/"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 60)))) for i in range(800)] + [(900, None), (None, "a@b.c"), (7, "a@b.c"), (7, "a@b.c")]
    got = personal.digest(personal.find(spark.createDataFrame(rows, DOCS), NONE)).collect()
    want = Counter((i, hashlib.sha256(base(t or "").encode()).hexdigest(), base(t or "")) for i, t in rows)
    assert Counter((x.doc_id, x.base_sha256, x.spans) for x in got) == want


def test_base_spans_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for x in llm.queries()["op11_personal_data"](spark, SF).collect():
        assert x.base_sha256 == hashlib.sha256(base(text[x.doc_id]).encode()).hexdigest()
        assert set(filter(None, base(text[x.doc_id]).split(","))) <= set(x.spans.split(","))


def test_many_matches_and_long_runs_in_one_text(spark):
    rows = [(1, "x@y.zz 10.0.0.1 " * 1500), (2, "a" * 200_000), (3, "1 " * 100_000), (4, "a@b" + ".c" * 50_000)]
    for x in personal.digest(personal.find(spark.createDataFrame(rows, DOCS), NONE)).collect():
        assert x.base_sha256 == hashlib.sha256(base(dict(rows)[x.doc_id]).encode()).hexdigest()


def test_lookalikes_are_added_and_other_numbers_are_not(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        k = i % 3
        said = (f"please mail p{rng.randint(1, 99)}@host{i}.example.com today", f"write to q{i} at once or leave the handle @x{i} here", f"order {rng.randint(10**12, 10**13)} shipped")[k]
        rows.append((i, said))
    docs = spark.createDataFrame(rows, DOCS)
    model = personal.train(docs)
    asked = [(1, "please mail jo [at] host9.example.com today"), (2, "order 1234567890123 shipped"), (3, "nothing here"), (4, None), (5, "please mail al@host9.example.com today")]
    got = {x.doc_id: x for x in personal.digest(personal.find(spark.createDataFrame(asked, DOCS), model)).collect()}
    assert got[1].spans == "email:12:37" and got[1].n_added == 1 and got[1].n_email == 0
    assert [got[k].spans for k in (3, 4, 5)] == ["", "", "email:12:32"] and got[5].n_added == 0
    assert got[2].n_added == 0
    clean = {x.doc_id: x.text for x in personal.redact(spark.createDataFrame(asked, DOCS), model).collect()}
    assert clean[1] == clean[5] == "please mail [EMAIL] today" and clean[3] == "nothing here" and clean[4] == ""


def test_calibration_pools_until_the_share_rises(spark):
    scored = [(0.1, 0, 50), (0.2, 30, 30), (0.3, 10, 30), (0.9, 99, 1)]
    assert personal.calibrate(scored) == 0.9
    assert personal.calibrate([(0.9, 5, 0)]) is None and personal.calibrate([]) is None


def test_all_feature_vectors_count_whatever_their_number(spark):
    """Over the number that the driver holds, the same trees and cuts come from sums; none is left out."""
    rng = random.Random(7)
    said = lambda i: (f"please mail p{'q' * (i % 17)}@host{i}.example.com today", f"write to q{i} or leave {'w' * (i % 11)} handle @x{i} here", f"order {rng.randint(10**12, 10**13 + 10**14)} shipped")[i % 3]
    docs = spark.createDataFrame([(i, said(i)) for i in range(900)], DOCS)
    near, far = personal.train(docs), personal.train(docs, patterns=2)
    assert far.cuts.keys() == near.cuts.keys() and near.cuts and len(far.trees) == len(near.trees)
    assert abs(far.prior - near.prior) < 1e-9 and all(abs(far.cuts[k] - near.cuts[k]) < 1e-3 for k in near.cuts)


def test_pools_of_pools_are_those_of_all():
    rng = random.Random(2)
    scored = sorted((round(rng.random(), 2), rng.randint(0, 9), rng.randint(0, 4)) for _ in range(300))
    parts = [p for k in range(11) for p in personal._pools([s for s in scored if int(s[0] * 10) == k])]
    assert personal._pools([(s, a, n - a) for s, a, n in parts]) == personal._pools(scored)


def test_scores_in_sql_are_those_of_the_trees(spark):
    rng = random.Random(1)
    width = len(personal.FEATURES)
    rows = [(tuple(rng.randint(0, 3) for _ in range(width)), rng.randint(0, 5), rng.randint(0, 5)) for _ in range(60)]
    prior, trees = personal.boost(rows, 5)
    model = personal.Model(prior, trees, {k: 0.0 for k in range(4)})
    fields = ", ".join(f"{n} int" for n in personal.FEATURES)
    df = spark.createDataFrame([(i, [(*x, False)]) for i, (x, _, _) in enumerate(rows)], f"i int, c array<struct<{fields}, y boolean>>")
    kept = {r.i for r in df.select("i", personal.chosen(model, "c").alias("c")).where(F.size("c") > 0).collect()}
    assert kept == {i for i, (x, _, _) in enumerate(rows) if personal.score(model, x) >= -1e-9}


# op12


def moved(i, t):
    t = t or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    hx = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hx[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return i, len(u), "plain", None, None, t
    spm = h[3] % 100 < 20
    return i, len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("most", [1 << 20, 64, 7])
def test_infill_and_back(spark, most):
    """Also texts over a slice, marks, nulls, repeated rows and columns that clash with results."""
    rng = random.Random(1)
    some = ["", None, "a", "äb<c", "x<P>y", "Hello, wörld\n\n<S ok", "日本語\x00\x01 tab\t", "z" * 100]
    rows = [(i, t) for i in range(12) for t in some] + [(None, "null id é"), (3, "a"), (3, "a")]
    rows += [(100 + i, "".join(rng.choices("ab Z\nß€\U0001d11e<PS>", k=rng.randint(0, 300)))) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("mine")).withColumn("form", F.lit(1)).withColumn("h0", F.lit(2))
    d = infill.transform(docs, most)
    assert Counter(map(tuple, d.collect())) == Counter(moved(*r) for r in rows)
    back = d.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in rows)


# op13


def test_run_lengths_against_plain_sums():
    import numpy as np

    rng = np.random.default_rng(2)
    cells, weight = rng.integers(0, 4, (200, 5)), rng.integers(1, 9, 200)
    a, b, got = divergence.compared(cells, weight)
    assert got.tolist() == [int((abs(cells[:, i] - cells[:, j]) * weight).sum()) for i, j in zip(a, b)]


def test_terms_and_portions_are_exact(spark):
    found = divergence.terms_of("Ab-ÀB ab'ab\x00Ä1é_".encode())
    assert {t.decode(): n for t, n in found.items() if t} == {"ab": 3, "Àb": 1, "Ä": 1, "é": 1}
    long = b"ab " * 500_000
    assert divergence.terms_of(long)[b"ab"] == 500_000
    rows = [(c, n, v) for c in (0, 1, 10**9, 9 * 10**14) for n in (0, 10**15) for v in (1, 7, 10**6) if c <= n]
    df = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.portion(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in df.collect())


def test_audit_of_edges(spark):
    """Nulls, a group without terms, a language without kept terms, repeated rows, one source alone, and clashing columns."""
    rows = [("Apple pear", "en", "a")] * 30 + [("apple", "en", "b")] * 3 + [(None, "en", "c")] + [("rare", None, None), ("rare", None, "x")] + [("solo " * 3, "fr", "s")] * 31
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit(1)).withColumn("vec", F.lit(1))
    got = [tuple(r) for r in divergence.audit(docs).orderBy("lang", "source", "part", "rank").collect()]
    v = 2
    p = {s: {t: 1 + 10**9 * (c + 5) // (n + 5 * v) for t, c in x.items()} for s, n, x in (("a", 60, {"apple": 30, "pear": 30}), ("b", 3, {"apple": 3, "pear": 0}), ("c", 0, {"apple": 0, "pear": 0}))}
    q = {t: 1 + 10**9 * (c + 5) // (63 + 5 * v) for t, c in (("apple", 33), ("pear", 30))}
    want = [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]
    for s in "abc":
        far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in q), o) for o in "abc" if o != s))
        want += [("en", s, "pair", o, -f, k) for k, (f, o) in enumerate(far, 1)]
        has = {"a": ("apple", "pear"), "b": ("apple",), "c": ()}[s]
        top = sorted((-(p[s][t] - q[t]), t) for t in has if p[s][t] > q[t])
        want += [("en", s, "term", t, -f, k) for k, (f, t) in enumerate(top, 1)]
    assert sorted(got) == sorted(want)
    assert divergence.audit(docs.limit(0)).count() == 0
