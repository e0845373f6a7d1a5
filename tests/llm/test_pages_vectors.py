"""Archives, searches, components and the pipeline."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repurchase.llm import ann, warc
from repurchase.llm.graphs import connected_components
from tests.llm.data import bag, documents


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1))


PAGES = [
    (3, "http://a/x y\r\nInjected: 1", "<p>" + "same " * 40), (1, "http://b", "<p>" + "same " * 40), (7, None, "<p>" + "same " * 40),
    (4, "http://c", "short"), (5, "http://d", "short"), (6, "http://e", None), (8, "http://f", ""), (9, "http://g", "é😀\r\n\r\n" * 50),
    (10, "http://h", "z" * 400_000), (None, "http://i", "q" * 300), (None, "http://j", "q" * 300), (1, "http://b", "<p>" + "same " * 40),
]


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, PAGES))
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        twins = [p for p, _, h in PAGES if (h or "").encode() == body and p is not None]
        first = min(twins) if twins and len(body) >= 100 else None
        revisit = first is not None and page != first
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert bag(map(tuple, rows)) == bag(want)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_payloads_and_dictionary(spark, tmp_path):
    folder = f"file://{tmp_path}"
    records = warc.plan_records(pages(spark, PAGES))
    assert warc.write_archives(records, folder, archive_bytes=100_000) == len(PAGES)
    back = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, folder).where("record_type = 'response'").collect()}
    assert back[9] == ("é😀\r\n\r\n" * 50).encode() and back[1] == ("<p>" + "same " * 40).encode()
    files = list(tmp_path.glob("*.warc.zst"))
    assert files and all(f.read_bytes()[:4] == b"\x5d\x2a\x4d\x18" for f in files)


def test_reader_refuses_damage():
    record = warc._record(1, "http://a", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), "response", None)
    assert warc.parse(record)[3] == 200
    data = warc.archive([record] * 3, warc.train([record]))
    assert len(list(warc.records_of(data))) == 3
    for bad in (data[:-5], data[8:], b"", data[:-1] + b"\x00" * 20):
        with pytest.raises(Exception):
            list(map(warc.parse, warc.records_of(bad)))
    for damaged in (record.replace(b"Content-Length: 2", b"Content-Length: 3", 1), record.replace(b"xxxx", b"yyyy", 1), record[:-1], record.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse(damaged)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1)).withColumn("label", F.lit(2))


def test_clustered_vectors_are_found_in_few_partitions(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(40, size=4000)] + 0.4 * rng.normal(size=(4000, 16))).astype(np.float32)
    table = vectors(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)])
    rows = ann.usable(table)
    weights, mass = ann.fit(rows)
    assert weights.shape[1] == round(ann.PER_ROOT * 4000**0.5)
    homes = {r.part: r["count"] for r in ann.route(rows, weights, None).groupBy("part").count().collect()}
    asked = ann.route(rows.where("vec_id % 20 = 0"), weights, mass).groupBy("part").count().collect()
    compared = sum(r["count"] * homes.get(r.part, 0) for r in asked) / (200 * 4000)
    assert compared < 0.2
    found = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        near = x.astype(np.float64) @ x[q].astype(np.float64)
        near[q] = -np.inf
        hits += len(found[q] & set(np.lexsort((np.arange(4000), -near))[:20].tolist()))
    assert hits / 4000 >= 0.9


def test_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2080, [1.0] * 3), (None, [1.0] * 16)]
    got = ann.search(vectors(spark, rows + odd), F.col("vec_id") % 20 == 0, parts=8, block_rows=200).collect()
    assert {r.query_id for r in got} == set(range(0, 1500, 20))
    y, hits, total = x.astype(np.float64), 0, 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, found in by.items():
        found.sort()
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == pytest.approx(float(y[f[1]] @ y[q]), abs=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.9


def test_search_small_and_empty(spark):
    assert ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0])]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 1.0), (3, 0.0), (3, 0.0)]


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k not in alone}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Stage by stage against what the operators say on their own input."""
    import corpus_pipeline
    from repurchase.llm import bpe, mixing, quality
    from tests.llm.test_documents import base_spans, near_components

    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in at.select("doc_id", "text", "lang", "source").collect()]
        got = stage(spark, at, str(tmp_path)).cache()
        rows = got.collect()
        if i < 4:
            assert got.columns == docs.columns
        if i == 0:
            verdicts = quality.quality_verdicts(at, labels)
            assert got.count() == verdicts.where("kept").count()
        if i == 1:
            kept = {d for d, _, _, k in near_components(before) if k}
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(kept)
        if i == 2:
            assert len(rows) == len(before)
            assert not any(base_spans(r.text) for r in rows)
        if i == 3:
            copies = {r.doc_id for r in rows}
            taken = mixing.taken(mixing.mix(at)).where("copies > 0")
            assert copies == {r.doc_id for r in taken.collect()}
            assert len(rows) == sum(r.copies for r in taken.collect())
        if i == 4:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(bpe.default_path())
            want = [(d, whole.encode(t or "", add_special_tokens=False).ids) for d, t, _, _ in before]
            assert bag((r.doc_id, list(r.ids)) for r in rows) == bag(want)
        at = got


def test_pipeline_runs_from_files(spark, tmp_path):
    """The whole run, written and read between stages, with a cutoff that is proven and rejects."""
    import corpus_pipeline
    from repurchase.llm import bpe, quality
    from tokenizers import Tokenizer

    good = [(i, f"plain words of text number {i} " + " ".join(f"w{i * 60 + j}" for j in range(60)), "en", f"s{i % 3}") for i in range(2400)]
    bad = [(9000 + i, " ".join(f"w{i * 60 + j}%%%" for j in range(90)), "en", "s0") for i in range(200)]
    # A copy under a larger id, a different text under an id that is taken, rows without id, personal data, and junk.
    more = [(7000, good[5][1], "en", "s1"), (5, good[5][1].replace("w3", "v3"), "en", "s1"), (None, good[6][1], "en", "s1")]
    more += [(7001, None, "en", "s0"), (7002, "", None, None), (7003, good[7][1].replace("w4", "x4") + " write to jo@mail.example.com", "en", "s2")]
    rows = good + bad + more
    folder = str(tmp_path / "some")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    marks = [(r[0], 1) for r in good] + [(r[0], 0) for r in bad]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    verdicts = quality.quality_verdicts(documents(spark, rows), labels).where("not base_failed").collect()
    refused = {r.doc_id for r in verdicts if not r.kept}
    assert refused == {r[0] for r in bad}
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"]
    found = {}
    for r in out.collect():
        found.setdefault(r.doc_id, []).append(list(r.ids))
        assert r.n_tokens == len(r.ids)
    assert not refused & set(found) and not {7000, 7001, 7002, None} & set(found)
    whole = Tokenizer.from_file(bpe.default_path())
    texts_of = {}
    for d, t, _, _ in rows:
        texts_of.setdefault(d, []).append(t)
    for d, lists in found.items():
        assert len(lists) <= 3 * len(texts_of[d])
        if d != 7003:
            assert all(ids in [whole.encode(t, add_special_tokens=False).ids for t in texts_of[d]] for ids in lists)
    # Sources of equal size and weights 5, 2, 1: the first is repeated, the last is thinned out.
    shares = [sum(len(found.get(i, ())) for i in range(s, 2400, 3)) / 800 for s in range(3)]
    assert shares[0] > 1.6 and 0.6 < shares[1] < 0.9 and 0.3 < shares[2] < 0.45
    none = str(tmp_path / "none")
    documents(spark, []).write.parquet(f"{none}/documents.parquet")
    labels.limit(0).write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
