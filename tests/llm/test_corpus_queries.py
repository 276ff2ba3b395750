"""Registered corpus queries and the pipeline, all columns, against their SQL or plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import LEAST, PATTERNS, brute, contamination, fingerprint, least_cover, long_probability, longest, pair_ratio, places, poisson_count

import __spark_entry__ as entry
import corpus_pipeline
from caseloom.llm import common, licenses, queries, secrets

TABLES = ("documents", "benchmark", "pages", "embeddings")


@pytest.fixture(scope="module")
def folder(spark, tiny, tmp_path_factory):
    """The smallest tables, with odd rows and a few documents that contain others' words."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 20000")
    key = "aB3xK9mQ7zR2pL5vN8wT4yU6hJ1sDf"
    taken = spark.read.parquet(f"{tiny}/benchmark.parquet").first()["text"]
    odd = [
        (9001, None, "en", "web", None),
        (9002, "", None, None, 0),
        (9003, "12 !! 34", "de", "web", 8),
        (9004, f"the key is {key} and password = 'hunter2hunter2' so keep é it", "en", "books", 60),
        (9005, "Released under the MIT License by the authors of it", "en", "books", 51),
        (9005, "Released under the MIT License by the authors of it", "en", "books", 51),
        (9006, "Released  under the mit license by the authors OF it", "en", "web", 52),
        (9007, f"see {taken} there", "en", None, 1),
        (9008, "le chat noir dort sur le tapis de la maison 550e8400-e29b-41d4-a716-446655440000", "fr", "news", 1),
    ]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).coalesce(1).write.parquet(f"{path}/documents.parquet")
    for name in TABLES[1:]:
        spark.read.parquet(f"{tiny}/{name}.parquet").coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def data(spark, folder):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def plain(value):
    if value is None or (isinstance(value, float) and np.isnan(value)) or value is pd.NA:
        return "null"
    return f"{float(value) + 0:.6f}" if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


def listed(found, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in found)


@pytest.mark.parametrize("name", sorted(queries.queries().keys() & entry.oracle_sql().keys()))
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = entry.queries()[name](spark, folder)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert len(want) > 0 and listed([r.asDict() for r in found.collect()], columns) == listed(want, columns)


def test_languages(spark, folder, data):
    found = {r["doc_id"]: r for r in queries.op1_language_id(spark, folder).collect()}
    assert len(data) - 1 == len(found)
    known = {r["lang"] for r in data if r["lang"]}
    for r in data:
        got = found[r["doc_id"]]
        assert got["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2)
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (got["lang_pred"] in known and 0 < got["score"] <= 1) if letters else (got["lang_pred"], got["score"]) == ("und", 0)
    held = [r for r in data if r["lang"] and crc32(str(r["doc_id"]).encode()) % 4 == 2 and any(map(str.isalpha, r["text"] or ""))]
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9


def test_labels_of_held_out_rows_change_no_prediction(spark, folder, monkeypatch):
    def swapped(spark, sf_dir, *columns):
        docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text", *columns)
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
        return docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))) if "lang" in columns else docs

    before = sorted(map(tuple, queries.op1_language_id(spark, folder).collect()))
    monkeypatch.setattr(queries, "documents", swapped)
    after = sorted(map(tuple, queries.op1_language_id(spark, folder).collect()))
    assert [r[:3] for r in before] == [r[:3] for r in after]
    assert [r[3] for r in before] == pytest.approx([r[3] for r in after])


def test_token_counts(spark, folder, data):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    want = [{"doc_id": r["doc_id"], "n_bytes": len((r["text"] or "").encode()), "n_tokens": (n := len(p.encode(r["text"] or ""))), "over_limit": n > 4096} for r in data]
    found = [r.asDict() for r in queries.op2_token_counts(spark, folder).collect()]
    assert listed(found, list(want[0])) == listed(want, list(want[0]))


def test_licenses(spark, folder, data):
    found = {r["doc_id"]: r for r in queries.op4_license_scan(spark, folder).collect()}
    for r in data:
        n, at, labels = places(r["text"])
        got = found[r["doc_id"]]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (n, len(at), min(at, default=None), max(at, default=None), labels)
        if n < 1000:
            cover = {p: longest(r["text"], p) for p in licenses.TEMPLATES}
            assert got["labels"] == ",".join(sorted({licenses.TEMPLATES[p] for p, c in cover.items() if c >= least_cover(p)} | {*labels.split(",")} - {""}))
            assert got["score"] == pytest.approx(max([*cover.values(), *(longest(r["text"], p) for p in licenses.BASE)]))


def test_near_duplicates_query(spark, folder, data):
    found = queries.op6_simhash_near_dedup(spark, folder).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=repr) == brute([(r["doc_id"], r["text"]) for r in data])


def test_language_model_scores(spark, folder, data, monkeypatch):
    short = [r for r in data if len(r["text"] or "") < 300]
    monkeypatch.setattr(queries, "documents", lambda spark, sf_dir: queries.table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NULL OR length(text) < 300"))
    found = sorted((tuple(r) for r in queries.op9_lm_scoring(spark, folder).collect()), key=repr)
    held = lambda i: crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), None]
    training = [r["text"] for r in short if not held(r["doc_id"])]
    seen = Counter(w for t in training for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = []
    for r in short:
        w = tokens(r["text"])
        want.append((r["doc_id"], held(r["doc_id"]), len(w), sum(x in seen for x in w), n, sum(np.log10((seen[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), long_probability(training, r["text"], queries.LM_ORDER)))
    assert len(short) > 20
    for g, e in zip(found, sorted(want, key=repr), strict=True):
        assert g[:5] == e[:5] and g[5:] == pytest.approx(e[5:], rel=1e-4)


def all_spans(text, table):
    """(start, kind, end) as plain Python finds them: base spans, then runs judged outside of them."""
    text, base = text or "", []
    for kind, pattern in enumerate(PATTERNS.values()):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == 0 else m[0]) >= [*LEAST.values()][kind]:
                base.append((m.start(), kind, m.end()))
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", text):
        crossed = sorted(b for b in base if b[0] < m.end() and m.start() < b[2])
        if any(b[0] <= m.start() and m.end() <= b[2] for b in crossed):
            continue
        free, at = [], m.start()
        for a, b in [*((b[0], b[2]) for b in crossed), (m.end(), m.end())]:
            if a - at > 1:
                free.append((at, a))
            at = max(at, b)
        ratios = [pair_ratio(text[a:b], table) for a, b in free]
        groups = [len(re.findall("[0-9]+", text[a:b])) for a, b in free]
        asked = lambda n: secrets.MARGINS[min(n, 3)]
        if sum(ratios) >= asked(sum(groups)):
            more.append((m.start(), 3, m.end()))
        else:
            more += [(a, 3, b) for (a, b), r, n in zip(free, ratios, groups, strict=True) if r >= asked(n) and b - a >= secrets.LEAST_PART]
    return sorted(base), sorted(base + more)


def written(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_secrets(spark, folder, data):
    table = [float(f"{x:.4f}") for x in secrets.log_ratios(queries.documents(spark, folder))]
    found = [r.asDict() for r in queries.op10_secret_scan(spark, folder).collect()]
    want = []
    for r in data:
        base, every = all_spans(r["text"], table)
        n = Counter(k for _, k, _ in base)
        want.append({"doc_id": r["doc_id"], "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans": written(every)})
    assert any("random" in r["spans"] for r in want)
    assert listed(found, list(want[0])) == listed(want, list(want[0]))


def masked(text, spans):
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                at = end
            out.append(text[at:a])
        end = max(end, b)
    return "[SECRET]".join([*out, text[end:]]) if spans else text


def test_pipeline_stage_by_stage(spark, folder, data):
    """Each stage against plain Python on its own input, written and reread, and run() against the last."""
    docs, columns = data, list(data[0])
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def step(name):
        nonlocal frame
        stage = dict(corpus_pipeline.STAGES)[name]
        frame = common.materialize(stage(spark, frame, folder), name)
        return [r.asDict() for r in frame.collect()]

    docs = [r for r in docs if any(map(str.isalpha, r["text"] or ""))]
    assert listed(step("language_id"), columns) == listed(docs, columns) and len(docs) < len(data)

    least, kept = {}, []
    of = {(r["doc_id"], r["text"]): None for r in docs}
    for i, fp, component in brute([(r["doc_id"], r["text"]) for r in docs]):
        least[i, fp] = component
    for r in docs:
        key = (r["doc_id"], f"{fingerprint(r['text']):016x}")
        if least[key] == r["doc_id"] and (r["doc_id"], r["text"]) in of:
            kept.append(r)
            del of[r["doc_id"], r["text"]]
    docs = kept
    assert listed(step("near_dedup"), columns) == listed(docs, columns) and 9006 not in {r["doc_id"] for r in docs}

    docs = [r for r in docs if not contamination(r["text"], items)[-1]]
    assert listed(step("decontamination"), columns) == listed(docs, columns) and 9007 not in {r["doc_id"] for r in docs}

    table = [float(f"{x:.4f}") for x in secrets.log_ratios(frame)]
    docs = [r | {"text": (t := masked(r["text"], all_spans(r["text"], table)[1])), "n_chars": len(t)} for r in docs]
    assert listed(step("secret_scan"), columns) == listed(docs, columns)
    text = {r["doc_id"]: r["text"] for r in docs}
    assert text[9004] == "the key is [SECRET] and [SECRET]' so keep é it" and "550e8400-e29b" in text[9008]

    sizes = Counter(r["source"] for r in docs)
    want = []
    for r in docs:
        u = int(hashlib.md5(f"17:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        n = poisson_count(len(docs) / len(sizes) / sizes[r["source"]], u)
        want += [r | {"copy_no": k, "shuffle_key": hashlib.md5(f"17:order:{r['doc_id']}:{k}".encode()).hexdigest()} for k in range(1, n + 1)]
    assert listed(step("source_mixing"), list(want[0])) == listed(want, list(want[0]))
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == list(want[0])
    assert listed([r.asDict() for r in found.collect()], list(want[0])) == listed(want, list(want[0]))


def test_pipeline_of_an_empty_table_is_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_stand_odd_documents(spark, odd_docs, folder):
    """Nulls in any column, repeated rows and clashing names go through every stage."""
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, folder), "odd")
    assert docs.columns == [*odd_docs.columns, "copy_no", "shuffle_key"]


def test_intermediates_are_deleted(spark, folder):
    common.discard_all(spark)
    corpus_pipeline.run(spark, folder).count()
    assert len(common._written) <= 2, "what the last stage reads, and its rates"
    common.discard_all(spark)
    assert not common._written
