"""Substring dedup, vector codes and fill-in-middle against plain Python, on odd rows too."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import fim, substrings, vectorcodes

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(params=["odd", "none", "real"])
def docs(request, odd_docs, no_docs, real_docs):
    return {"odd": odd_docs, "none": no_docs, "real": real_docs}[request.param]


# substring dedup


def repeated(texts, window):
    """texts: (id, text) in any order, each pair once -> {(id, text): removed places}, null ids first."""
    seen, gone = {}, {}
    for i, t in sorted({*texts}, key=lambda x: (x[0] is not None, x[0] or 0)):
        words = WORD.findall(t or "")
        gone[i, t] = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[i, t].update(range(k, k + window))
            seen.setdefault(key, (i, k))
    return gone


def check_removed(df, window, gram):
    found = substrings.remove(df, window=window, gram=gram).select("doc_id", "text", "n_words", "n_removed", "kept", "factors").collect()
    given = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=repr) == sorted(given, key=repr)
    gone = repeated(given, window)
    words_of = {}
    for i, t in given:
        words_of.setdefault(i, []).append(WORD.findall(t or ""))
    for r in found:
        words, out = WORD.findall(r["text"] or ""), gone[r["doc_id"], r["text"]]
        assert (r["n_words"], r["n_removed"]) == (len(words), len(out))
        assert r["kept"] == " ".join(w for k, w in enumerate(words) if k not in out)
        assert {k for f in r["factors"] for k in range(f["start"], f["start"] + f["length"])} == out
        for f in r["factors"]:  # each factor stands at its source
            want = words[f["start"] : f["start"] + f["length"]]
            assert any(w[f["source_start"] : f["source_start"] + f["length"]] == want for w in words_of[f["source_id"]])


@pytest.mark.parametrize(("window", "gram"), [(3, 1), (4, 3), (6, 2), (5, 5)])
def test_few_words_repeat_in_all_ways(spark, window, gram):
    rng = np.random.default_rng(window)
    texts = [(int(i), " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(40)]
    texts += [(100 + k, texts[k % 7][1] + " x y " + texts[k % 5][1]) for k in range(12)] + [(200, "a " * 300), (201, "a " * 299 + "b")]
    check_removed(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), window, gram)


def test_removal_on_odd_rows(docs):
    rows = docs
    if docs.where("doc_id = 1").count() == 2:  # of rows that repeat an id alone, no order can be told here
        rows = docs.where("NOT (doc_id = 2 AND text IS NULL)")
    check_removed(rows, 20, 8)


def test_passages_within_copies_and_long_texts(spark):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage, line = words(60), words(21)
    texts = [(k, f"{words(30)} {passage} {words(k)}\n\n{line}") for k in range(50)]
    texts += [(100 + k, texts[0][1]) for k in range(30)] + [(None, passage), (None, line + " z"), (500, words(30_000) + " " + passage)]
    check_removed(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), 20, 8)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = spark.createDataFrame([(1, text)] * 20 + [(2, text)], "doc_id long, text string")
    found = substrings.remove(rows)
    assert {(r["doc_id"], r["n_removed"]) for r in found.collect()} == {(1, 0), (2, 100)}
    assert found.where("doc_id = 2").first()["factors"] == [(0, 100, 1, 0)]


def test_removal_keeps_other_columns(spark):
    rows = spark.createDataFrame([("b", None, 7, "x"), ("a", " q ", 8, "y")], "doc_id string, text string, n_words int, `id` string")
    found = substrings.remove(rows)
    assert found.columns == ["doc_id", "text", "id", "n_words", "n_removed", "kept", "factors"]
    assert sorted(found.select("doc_id", "id", "n_words", "kept").collect()) == [("a", "y", 1, "q"), ("b", "x", 0, "")]


# vector codes


def test_annuli_find_the_nearest_entry_and_ties():
    rng = np.random.default_rng(1)
    for spread in (2, 50, 4000):
        entries = rng.integers(-spread, spread, (16, 3))
        entries[5] = entries[2]
        x = rng.integers(-spread, spread, (500, 3))
        number, away = vectorcodes.Annuli(entries).nearest(x)
        all_away = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (number == all_away.argmin(axis=1)).all()
        assert (away == all_away.min(axis=1)).all()


def test_annuli_leave_entries_of_other_norms_out(monkeypatch):
    entries = np.array([[k * 1000, 0] for k in range(16)])
    index, x = vectorcodes.Annuli(entries), np.array([[3001, 1], [14_000, 0]])
    low, high = index._annulus(np.sqrt((x.astype(float) ** 2).sum(axis=1)), np.array([2, 0]))
    assert (high - low).tolist() == [1, 1]


def brute_codes(rows, parts, entries, rounds):
    """rows: (id, vector) kept, of one length."""
    w = len(rows[0][1]) // parts
    cut = lambda v: [v[j * w : (j + 1) * w] for j in range(parts)]
    x = [(i, cut([int(np.floor(4096 * float(c))) for c in v])) for i, v in rows]
    books = [[list(p[j]) for _, p in sorted(x, key=lambda r: r[0])[:entries]] for j in range(parts)]
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda part, book: min(range(len(book)), key=lambda k: (away(part, book[k]), k))
    for _ in range(rounds):
        for j in range(parts):
            mine = [nearest(p[j], books[j]) for _, p in x]
            for k in range(len(books[j])):
                if members := [p[j] for (_, p), m in zip(x, mine, strict=True) if m == k]:
                    books[j] = [*books[j][:k], [sum(c) // len(members) for c in zip(*members, strict=True)], *books[j][k + 1 :]]
    codes = {i: ("".join(f"{nearest(p[j], books[j]):02x}" for j in range(parts)), sum(min(away(p[j], e) for e in books[j]) for j in range(parts))) for i, p in x}
    return codes, books


def test_codes_and_codebooks_equal_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.normal(0, 0.2, 16)]) for i in rng.permutation(120)]
    rows += [(500 + k, rows[k][1]) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found, books = vectorcodes.encode(df, parts=4, entries=8, rounds=3)
    want, want_books = brute_codes(rows, 4, 8, 3)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found.collect()} == want
    assert [b.tolist() for b in books] == want_books


def test_codes_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, -0.25]), (3, [0.5, -0.25]), (None, [0.5, 0.0]), (4, None), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 0.0]), (8, [0.1]), (9, [1e300, -1e300]), (10, [])]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id int, embedding array<double>, code string, v double")
    found, books = vectorcodes.encode(df, parts=2, entries=3, rounds=0)
    assert found.columns == ["vec_id", "embedding", "code", "error"]
    got = {(r["vec_id"], r["code"], r["error"]) for r in found.collect()}
    # Both rows of id 3 start an entry, and the lower one is taken; the third smallest id has another length and starts none.
    assert [b.tolist() for b in books] == [[[2048]] * 2, [[-1024]] * 2]
    far = (2**27 - 2048) ** 2 + (2**27 - 1024) ** 2
    assert got == {(3, "0000", 0), (None, "0000", 1024**2), (9, "0000", far), (8, None, None), (10, None, None)}
    assert found.count() == 6
    for some in (df.where("vec_id IS NULL"), df.where("false")):
        coded, books = vectorcodes.encode(some, parts=2, entries=3, rounds=2)
        assert books == [] and all(r["code"] is None and r["error"] is None for r in coded.collect())
    with pytest.raises(ValueError, match="256"):
        vectorcodes.encode(df, entries=300)


# fill-in-middle


def plain_form(doc_id, text, rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(u) for u in (units[:a], units[a:b], units[b:])]
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 0), (0, 50)])
def test_forms_and_round_trip(docs, rate, spm_rate):
    found = fim.transform(docs, rate=rate, spm_rate=spm_rate).withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_form(r["doc_id"], r["text"], rate, spm_rate)
        assert r["again"] == (r["text"] or "")


def test_units_of_odd_lines(spark):
    texts = ["\n", "\n\n\n", "a\r\nb\rc\n", " x\u0085y\n\x0bz", "été\n日本\n🙂🙂\n🙂", "a<P>b\nc", "<M>", "x\n" * 5000, "q" * 3_000_000 + "\nr\n", "line of text\n" * 200_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string")
    for r in fim.transform(rows).withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_form(r["doc_id"], r["text"], 100, 50)
        assert r["again"] == r["text"]


def test_stretches_end_at_line_ends():
    text = "".join(f"{'y' * (k % 9)}\n" for k in range(400)) + "end"
    parts = [*fim.stretches(text, 50)]
    assert "".join(p for _, p in parts) == text and all(p.endswith("\n") for _, p in parts[:-1]) and len(parts) > 20
    assert all(text[at : at + len(p)] == p for at, p in parts)


def test_marks_are_parameters_and_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd\n", 9, "z"), (2, "(.*) [P]", 9, "z")], "doc_id long, text string, n int, w string")
    marks = ("(.*", "[S]", "|M|")
    found = fim.transform(rows, marks=marks).withColumn("again", fim.restore(F.col("output"), F.col("form"), marks))
    assert found.columns == ["doc_id", "text", "w", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    assert {r["doc_id"]: r["form"] == "plain" for r in found.collect()} == {1: False, 2: True}
    assert found.where("again != text").count() == 0
    with pytest.raises(ValueError, match="marks"):
        fim.transform(rows, marks=("<a>", "<a>b", "c"))
