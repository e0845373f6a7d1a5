"""Block rotation, weighted fingerprints and mined negatives against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from repurchase.llm import fim, negatives, weighted
from tests.llm.data import bag, documents, texts

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def rearranged(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    written = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(written[at : at + 8], 16) for at in (0, 8, 16, 24)]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rotation_of_awkward_texts():
    rng = random.Random(1)
    letters = ["a", "é", "漢", "😀", " ", "\n", "\t", "<", "P", ">", "S", "M", "\x85", "\xa0", "\x00"]
    for i in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        buffer = bytearray(text.encode())
        got = fim.transform_bytes(buffer, i, 42, 100, 50)
        assert (*got, buffer.decode()) == rearranged(i, text, 100, 50)
        fim.restore_bytes(buffer, got[1])
        assert buffer.decode() == text


def test_rotation_swaps_chunks_of_long_blocks():
    text = "wörd and " * 100_000
    for i in range(8):
        buffer = bytearray(text.encode())
        got = fim.transform_bytes(buffer, i, 42, 100, 50)
        assert (*got, buffer.decode()) == rearranged(i, text, 100, 50)
        fim.restore_bytes(buffer, got[1])
        assert buffer.decode() == text


def test_fill_in_middle(spark, docs, none):
    rows = texts() + [(50 + i, t, "en", "s") for i, t in enumerate(["a <P> b", "<S>", "x <M", " \n ", "< P >"] * 3)]
    done = fim.restore(fim.transform(documents(spark, rows), "lang", rate=90))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in done.collect()]
    assert bag(got) == bag((d, *rearranged(d, t, 90), t or "") for d, t, _, _ in rows)
    assert {g[2] for g in got} == {"plain", "spm", "psm"}
    assert fim.restore(fim.transform(none)).count() == 0
    with pytest.raises(ValueError, match="rename"):
        fim.transform(docs, "n")


# --- weighted fingerprints ---------------------------------------------------------------------


def drawn(term: int, weight: int, j: int) -> tuple[float, int]:
    """ln a and the name of the sample, from the definition."""
    mask = (1 << 64) - 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long = lambda v, seed: xxhash.xxh64_intdigest((v & mask).to_bytes(8, "little"), seed)
    first = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), long(term, 42))
    second = long(first, 42)
    part = lambda h, bits, at: (((h >> at) & ((1 << bits) - 1)) + 0.5) / (1 << bits)
    r = -math.log(part(first, 32, 0) * part(first, 32, 32))
    c = -math.log(part(second, 20, 0) * part(second, 20, 20))
    b = part(second, 24, 40)
    t = math.floor(math.log(weight) / r + b)
    return math.log(c) - r * (t - b + 1), signed(long(t, long(first, 42))) & 0xFFFF


def fingerprint(text, samples):
    words = Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w)
    terms = {xxhash.xxh64_intdigest(w.encode(), 42): n for w, n in words.items()}
    if not terms:
        return ""
    return "".join(f"{min((drawn(t, n, j) for t, n in terms.items()))[1]:04X}" for j in range(samples))


def generalised_jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_follow_the_definition(spark, docs, none):
    rows = texts()
    got = weighted.compare_with_next(docs, samples=8).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert sum(map(len, by.values())) == len(rows) and set(by) == {r[0] for r in rows}
    for at, (doc_id, text, _, _) in enumerate(order):
        text = text or ""
        found = by[doc_id]
        if len(found) > 1:
            # Rows that share an id: equal ones follow each other, the last of them is followed by the next id.
            assert {(r.n_chars, r.fingerprint) for r in found} == {(len(x or ""), fingerprint(x, 8)) for d, x, _, _ in rows if d == doc_id}
            continue
        r, other = found[0], order[(at + 1) % len(order)]
        assert (r.n_chars, r.fingerprint) == (len(text), fingerprint(text, 8))
        if other[0] is None:
            continue
        half = len(text) // 2
        changed = text[: len(text) - half] + (other[1] or "")[:half]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.edited_fingerprint == fingerprint(changed, 8)
        if other[0] != 5:
            assert r.near_next == alike(r.fingerprint, fingerprint(other[1], 8))
        assert r.near_edited == alike(r.fingerprint, r.edited_fingerprint)
    twins = sorted((r.near_edited, r.near_next) for r in by[5] if r.fingerprint == fingerprint(rows[5][1], 8))
    # Three equal rows: two of them are followed by one like themselves.
    assert [t[1] for t in twins][1:] == [1.0, 1.0]
    assert weighted.compare_with_next(none, samples=8).count() == 0


def alike(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def test_a_single_row_is_its_own_next(spark):
    (row,) = weighted.compare_with_next(documents(spark, [(1, "one two two three four", "en", "s")]), samples=8).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"one two twoone two two").hexdigest()


def test_beginnings_of_next_texts_are_shuffled_once(spark, docs, monkeypatch):
    seen, save = {}, weighted.stored
    monkeypatch.setattr(weighted, "stored", lambda df, name: save(seen.setdefault(name, df), name))
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, ("false", "-1")):
            spark.conf.set(name, value)
        weighted.compare_with_next(docs, samples=1)
        text = seen["fingerprints"]._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    # Texts, their rows, whom they follow, and beginnings; digests and fingerprints read the same ones.
    assert len(re.findall(r"(?<!, )Exchange hashpartitioning", text)) == 4


def test_collisions_follow_the_generalised_jaccard_similarity(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words[: 40 + 5 * i]) for i in range(60) for _ in range(4)]
    rows = []
    for i in range(24):
        kept = base[: len(base) * (i + 1) // 24]
        rows.append((i, " ".join(kept + [rng.choice(words) for _ in range(len(base) - len(kept))])))
    table = spark.createDataFrame(rows, "id long, text string")
    found = {r.id: r.fingerprint for r in weighted.fingerprints(table, ["id"], samples=384).collect()}
    off = []
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        true = generalised_jaccard(a, b)
        share = alike(found[i], found[j])
        off.append(share - true)
        assert abs(share - true) < 5 * math.sqrt(true * (1 - true) / 384 + 1e-4)
    assert abs(sum(off) / len(off)) < 0.01


# --- mined negatives ---------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit("clash")).withColumn("size", F.lit(1))


def mined(rows):
    """(anchor, positive, rank, negative, scores) by comparing all pairs."""
    taken = []
    for vec_id, label, e in rows:
        if None in (vec_id, label, e) or any(x is None or not math.isfinite(x) for x in e):
            continue
        taken.append((vec_id, label, [max(-negatives.LIMIT, min(negatives.LIMIT, math.floor(256 * float(np.float32(x))))) for x in e]))
    out = []
    for a, (anchor, label, v) in enumerate(taken):
        if anchor % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, kind) for b, (i, kind, w) in enumerate(taken) if b != a and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scores if s[2] == label)[:5]:
            found = sorted(s for s in scores if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p)[:10]
            out += [(anchor, positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(found)]
    return out


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(1400):
        v = centres[i % 6] + rng.normal(size=16) * (0.05 if i % 100 == 0 else 0.6)
        rows.append((i, int(rng.integers(3)), [float(x) for x in np.round(v, 2 if i % 5 else 0)]))
    hot = rows[100][2]
    # A third of all rows repeat one vector, ids repeat, vectors of other lengths, broken ones, huge ones.
    rows += [(i, i % 4, hot) for i in range(1400, 2000)]
    rows += [(100, 1, hot), (100, 2, rows[3][2]), (300, 0, rows[7][2]), (5000, 1, [1.0, 2.0]), (5001, 1, [1.0, 1.0]), (5002, 2, [0.5, 1.0]), (5100, 7, [3.0]), (5200, 1, [])]
    rows += [(5300, None, hot), (5400, 1, None), (None, 1, hot), (5500, 1, [float("nan")] + hot[1:]), (5600, 1, [None] + hot[1:]), (5700, 1, [float("inf")] + hot[1:])]
    rows += [(6000, 1, [1e9] * 16), (6001, 1, [5e8] * 16), (6002, 2, [1e5] * 16), (6003, 2, [7e4, -3.3] * 8)]
    anchor = F.col("vec_id") % 100 == 0
    got = negatives.mine(vectors(spark, rows), anchor, tree=6, block=300)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert bag(map(tuple, got.collect())) == bag(mined(rows))
    assert bag(map(tuple, negatives.mine(vectors(spark, rows).repartition(3), anchor).collect())) == bag(mined(rows))
    assert negatives.mine(vectors(spark, []), anchor).count() == 0
    # One row alone, and anchors without positives.
    assert negatives.mine(vectors(spark, rows[:1]), anchor).count() == 0


def test_bounds_spare_most_scores_of_close_anchors():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(4000, 16)))
    anchors = np.floor(256 * (rng.normal(size=16) + 0.02 * rng.normal(size=(60, 16))))
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(60)) and (parent[1:] < np.arange(1, 60)).all()
    # The tree is minimal: as long as the one found by sorting all edges.
    every = sorted((np.sqrt(((anchors[i] - anchors[j]) ** 2).sum()), i, j) for i in range(60) for j in range(i))
    group, length = list(range(60)), 0.0
    for d, i, j in every:
        if group[i] != group[j]:
            length += d
            group = [group[i] if g == group[j] else g for g in group]
    assert edge.sum() == pytest.approx(length)
    walk = negatives.Walk(anchors[order], parent, edge, x)
    for at, own in enumerate(order):
        low, high = walk.enter(at)
        exact = (x @ anchors[own]).astype(np.int64)
        assert (low <= exact).all() and (exact <= high).all()
        found = negatives.best(walk, at, low, high, np.arange(len(x)), 5)
        assert set(np.argsort(-exact, kind="stable")[:5]) <= set(found)
        top = int(exact.max())
        found = negatives.best_inside(walk, at, low, high, np.arange(len(x)), 3 * top // 10, 9 * top // 10, 10)
        inside = np.flatnonzero((exact >= 3 * top // 10) & (exact <= 9 * top // 10))
        assert set(inside[np.argsort(-exact[inside], kind="stable")[:10]]) <= set(found)
    assert walk.scored < 0.25 * len(x) * 60
