"""Operators on documents against plain Python, on a table of awkward rows and on an empty one."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repurchase.llm import bpe, mixing, neardup, pii, quality, sharding, substrings, toxicity
from tests.llm.data import bag, documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, shards=4, buckets=8).collect()
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in texts()]
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in got) == bag(want)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(4))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_documents(none, shards=4).count() == 0


def test_sharding_keeps_groups_and_balance(spark):
    """Many small groups and one with a third of all bytes: shards level, few groups cut."""
    rows = [(i, f"text {i // 3} " + "x" * 200, "en", "s") for i in range(300)]
    rows += [(1000 + i, "hot " + "y" * 200, "en", "s") for i in range(300)]
    rows += [(2000 + i, f"alone {i} " + "z" * 200, "en", "s") for i in range(300)]
    got = sharding.shard_documents(documents(spark, rows), shards=10, buckets=16).collect()
    bytes_, groups = Counter(), defaultdict(set)
    for r in got:
        bytes_[r.shard] += r["size"]
        groups[r.text_crc32].add(r.shard)
    mean = sum(bytes_.values()) / 10
    assert max(bytes_.values()) <= 1.03 * mean and min(bytes_.values()) >= 0.97 * mean
    hot = zlib.crc32(("hot " + "y" * 200).encode())
    assert 4 <= len(groups[hot]) <= 8
    assert sum(len(s) > 1 for g, s in groups.items() if g != hot) <= 20


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_verdicts(docs, labels).collect()
    want = [(d, *base_measures(t)) for d, t, _, _ in texts()]
    assert bag(tuple(r)[:-1] for r in got) == bag(want)
    # Without enough labels only the base rule rejects.
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality.quality_verdicts(none, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_quality_bounds_false_rejections(spark):
    good = [(i, "plain words of a text " * 5 + f"number {i} and {i * 7} " + " ".join(f"w{i * 60 + j}" for j in range(60)), "en", "s") for i in range(2400)]
    bad = [(9000 + i, " ".join(f"w{i * 60 + j}%%%" for j in range(90)), "en", "s") for i in range(200)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(r[0], 1 if r[0] < 9000 else 0) for r in good + bad], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labels).collect()}
    assert sum(not got[r[0]] for r in good) <= 0.01 * len(good)
    assert not any(got[r[0]] for r in bad)


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10, 0.1), (3, 50, 0.1), (1, 400, 0.01), (5, 1000, 0.01), (9, 20, 0.1)]
    for k, n, p in cases:
        exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k <= n * p else 1.0
        row = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()
        assert row[0] == pytest.approx(exact, rel=1e-9)


def test_mixing(docs, none):
    got = mixing.taken(mixing.mix(docs, block_words=16), 16).collect()
    sizes = defaultdict(int)
    for _, t, _, s in texts():
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(names, (5, 2, 1, 5)))
    target, free, total = {}, set(names), sum(sizes.values())
    while True:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    of = {sizes[s]: target[s] for s in names}
    assert bag((r.doc_id, r["size"]) for r in got) == bag((d, len(WORD.findall(t or ""))) for d, t, _, _ in texts())
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(of[r.source_size])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size] += r.taken
    assert all(abs(taken[n] - of[n]) <= 1 for n in of)
    again = mixing.taken(mixing.mix(docs.repartition(3), block_words=16), 16)
    assert bag(map(tuple, again.collect())) == bag(map(tuple, got))
    assert mixing.taken(mixing.mix(none)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_schedule_spreads_sources(docs):
    """Every source comes about as often as its share says in each stretch of the schedule."""
    mixed = mixing.mix(docs, block_words=16)
    goal = {r.source_id: r.n_slots for r in mixed.sources.collect()}
    total = sum(goal.values())
    slots = [r.source_id for r in mixed.schedule.where(F.col("slot") < total).orderBy("slot").collect()]
    for upto in (total // 4, total // 2):
        seen = Counter(slots[:upto])
        assert all(abs(seen[s] - upto * n / total) <= 6 for s, n in goal.items())


def removed_windows(rows, length):
    raw = [(d, (t or "").encode()) for d, t, _, _ in rows]
    count = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    for d, b in raw:
        runs = []
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        kept, at = b"", 0
        for a, z in runs:
            kept, at = kept + b[at:a], z
        yield d, len(b), sum(z - a for a, z in runs), len(runs), hashlib.sha256(kept + b[at:]).hexdigest()


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeated_strings(docs, none, hot):
    got = substrings.repeated_strings(docs, length=400, hot=hot)
    assert bag(map(tuple, got.collect())) == bag(removed_windows(texts(), 400))
    assert substrings.repeated_strings(none).count() == 0


def test_repeated_strings_of_other_lengths(docs):
    got = substrings.repeated_strings(docs, length=100, gram=16)
    assert bag(map(tuple, got.collect())) == bag(removed_windows(texts(), 100))


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeated_strings_in_pieces(spark, hot):
    """Passages that repeat across the pieces of one long text, within one piece, and in other texts."""
    import random

    from tests.llm.data import prose

    rng = random.Random(11)
    inner, outer, near, both = (prose(rng, n) for n in (40, 45, 35, 50))
    long = " ".join(
        [prose(rng, 150), inner, both, prose(rng, 500), inner, prose(rng, 300), outer, near, prose(rng, 30), near, prose(rng, 700), both, prose(rng, 200)]
    )
    rows = [
        (1, long, "en", "s"), (2, prose(rng, 30) + " " + outer + " " + prose(rng, 30), "en", "s"),
        (3, prose(rng, 400) + " " + both + " " + prose(rng, 400), "en", "s"), (4, "x" * 3000, "en", "s"),
    ]
    # Other texts hold the bytes around every piece border of the long one.
    rows += [(10 + i, prose(rng, 5) + " " + long[at - 200 : at + 200], "en", "s") for i, at in enumerate(range(924, len(long), 924))]
    # A text of three pieces in two rows, with a passage that the long text has as well.
    rows += [(i, prose(random.Random(12), 400) + " " + inner, "en", "s") for i in (50, 51)]
    docs = documents(spark, rows)
    assert len(long) > 8 * 1024
    got = substrings.repeated_strings(docs, length=100, gram=16, hot=hot, piece=1024)
    assert bag(map(tuple, got.collect())) == bag(removed_windows(rows, 100))


def test_repeated_strings_hold_few_stretches(spark, monkeypatch):
    """A passage in many texts, each with its own bytes around it: no task is given more than ``hot`` of them at once."""
    from tests.llm.data import prose

    import random

    rng, hot, held = random.Random(13), 20, []
    shared = prose(rng, 90)
    rows = [(i, prose(rng, 20) + f" {i} " + shared + f" {i} " + prose(rng, 20), "en", "s") for i in range(120)]
    # Some share a little more of the text before or after the passage.
    rows += [(200 + i, prose(rng, 9) + f" {i} before " + shared + f" after {i} " + prose(rng, 9), "en", "s") for i in range(40)]
    real = substrings.matches

    def matches(found, length):
        each = found.where("bytes is not null").groupBy("group").agg(F.countDistinct("stretch").alias("n"))
        held.append(each.agg(F.max("n")).first()[0])
        return real(found, length)

    monkeypatch.setattr(substrings, "matches", matches)
    got = substrings.repeated_strings(documents(spark, rows), hot=hot)
    assert bag(map(tuple, got.collect())) == bag(removed_windows(rows, 400))
    assert held and max(n or 0 for n in held) <= hot


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_near_duplicates_are_missed_as_rarely_as_stated():
    from math import comb

    least = min(n for n in range(65) if n / 64 >= neardup.THRESHOLD / 100 - neardup.MARGIN)
    least = max(least, neardup.SURE_OVERLAP)
    assert sum(comb(64, n) * 0.75**n * 0.25 ** (64 - n) for n in range(least)) < 1e-10


@pytest.mark.parametrize("n", range(8))
def test_shingles_of_few_words(n):
    """All the words that one call sees, in one text and in two."""
    import numpy as np

    words = "one two three four five six seven".split()[:n]
    with np.errstate(over="ignore"):
        for cut in range(n + 1):
            parts = [" ".join(words[:cut]), " ".join(words[cut:])]
            data, sizes = np.frombuffer("".join(parts).encode(), dtype=np.uint8), [len(p) for p in parts]
            sets = neardup.shingle_sets(data, np.cumsum([0, *sizes]))
            assert [len(s) for s in sets] == [len(shingles(p)) for p in parts]


def test_near_duplicates_of_few_words(spark):
    """Every row is a slice of its own."""
    words = "one two three four five six".split()
    rows = [(i, " ".join(words[:i]), "en", "s") for i in range(1, 7)] + [(10, "One TWO  three", "en", "s")]
    docs = documents(spark, rows).repartitionByRange(7, "doc_id")
    assert bag(map(tuple, neardup.near_duplicates(docs).collect())) == bag(near_components(rows))


def near_components(rows):
    sets = [(d, shingles(t)) for d, t, _, _ in rows]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    for i, (d, s) in enumerate(sets):
        ids = [x for g, (x, _) in zip(group, sets) if g == group[i] and x is not None]
        component = (min(ids) if ids else None) if s else d
        yield d, len(s), component, d is not None and d == component


@pytest.mark.parametrize("block", [200, 2_000_000])
def test_near_duplicates(docs, none, block):
    got = neardup.near_duplicates(docs, block_shingles=block)
    assert bag(map(tuple, got.collect())) == bag(near_components(texts()))
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """Edited copies of one text, linked in chains and not all with each other."""
    import random

    from tests.llm.data import prose

    rng = random.Random(9)
    text = prose(rng, 150).split()
    rows = []
    for i in range(150):
        own = list(text)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(1000)}"
        rows.append((i, " ".join(own), "en", "s"))
    got = neardup.near_duplicates(documents(spark, rows))
    assert bag(map(tuple, got.collect())) == bag(near_components(rows))
    kept = neardup.keep_one(documents(spark, rows))
    assert kept.count() == sum(k for *_, k in near_components(rows))


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    few = toxicity.score(docs, labels, F.lit(True), "doc_id").collect()
    assert bag((r.doc_id,) for r in few) == bag((d,) for d, *_ in texts())
    assert {r.score for r in few} == {0.0}
    assert toxicity.score(none, labels, F.lit(True), "doc_id").count() == 0


def test_toxicity_is_learned(spark):
    from tests.llm.data import prose

    import random

    rng = random.Random(3)
    bad = ["vile", "rotten", "filthstain", "filthworm"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 40).split()
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels[:450], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), known, F.lit(True), "doc_id", rounds=5).collect()}
    right = [(got[i] >= 0.7) == bool(t) for i, t in labels[450:]]
    assert sum(right) / len(right) >= 0.95
    assert all(0 <= s <= 1 for s in got.values())


@pytest.mark.parametrize("leaf, spread", [(4096, 65_536), (64, 500)])
def test_bpe(docs, none, leaf, spread):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_path())
    want = []
    for d, t, _, _ in texts():
        e = whole.encode(t or "", add_special_tokens=False)
        ids, back = " ".join(map(str, e.ids)), whole.decode(e.ids, skip_special_tokens=False)
        want.append((d, len(e.ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.encode_documents(docs, "doc_id", outputs="digests", leaf=leaf, spread=spread)
    assert bag(map(tuple, got.collect())) == bag(want)
    ids = {r.doc_id: (r.n_tokens, len(r.ids)) for r in bpe.encode_documents(docs, "doc_id", leaf=leaf, spread=spread).collect()}
    assert all(a == b for a, b in ids.values())
    assert bpe.encode_documents(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_bpe_joins_like_the_whole(seed):
    """Random strings of awkward pieces, cut at every few characters."""
    import random

    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(bpe.default_path()), random.Random(seed)
    own = bpe.Encoder(bpe.default_path(), leaf=4)
    pieces = ["the", "ing", "'s", "'re", "'", "!", "...", "<|endoftext|>", " ", "\n", "́", "é", "ß", "1", "漢字", "😀", "x" * 30, "ab" * 20, "\x1c", "\x85", "　", "각"]
    for _ in range(150):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([2, 10, 60])))
        own.leaf = rng.choice([2, 7, 40])
        e = whole.encode(text, add_special_tokens=False)
        found = own.encode(text)
        assert bpe.ids_of(found) == " ".join(map(str, e.ids)), text
        assert bpe.decoded(found) == whole.decode(e.ids, skip_special_tokens=False)


def base_spans(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0

    checks = {
        "email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 10 <= len(d) <= 15,
    }
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for k, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text or ""):
            if checks[kind](m[0], re.sub("[^0-9]", "", m[0])):
                found.append((m.start(), k, m.end(), kind))
    return [(a, z, kind) for a, _, z, kind in sorted(found)]


def test_personal_data(spark, none):
    import random

    rng = random.Random(8)
    pieces = ["a.b@c.de", "x@y", "@", "f@g.h.", "_i@j.k", "1.2.3.4", "256.1.1.1", "001.02.3.255", ".", "4111111111111111", "4111-1111 1111", " ", "1", "79927398713", "+1 (212) 555-0100", "+49 30 1234567", "+", "(", "é", "😀", "-", "5500000000000004", "12 34", "\n"]
    rows = texts() + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.choice([3, 12, 40]))), "en", "s") for i in range(200)]
    rows.append((900, "1" * 20_000 + " " + "a" * 20_000 + "@b.c " + "1.1.1.1 " * 700, "en", "s"))
    docs = documents(spark, rows)
    found = pii.find_spans(docs, "doc_id").collect()
    want = bag((d, [(a, pii.KINDS.index(k), z) for a, z, k in base_spans(t)]) for d, t, _, _ in rows)
    assert bag((r.doc_id, [tuple(s) for s in r.base]) for r in found) == want
    assert all(set(r.base) <= set(r.spans) for r in found)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    left = {r.doc_id: r.text for r in clean.collect()}
    assert left[33].startswith("mail me at [EMAIL] or [PHONE], ip [IP] and 300.1.1.1") and left[20] is None
    assert pii.find_spans(none, "doc_id").count() == 0


def test_keep_one_tells_rows_apart_that_share_an_id(spark):
    words = " ".join(f"w{i}" for i in range(60))
    near = words.replace("w7 ", "changed ")
    rows = [
        (1, words, "en", "s"), (1, "another text of its own " * 3, "en", "s"), (2, near, "en", "s"), (None, words, "en", "s"),
        (None, "no id but text of its own", "en", "s"), (None, "no id but text of its own", "en", "s"), (7, None, "en", "s"), (7, None, "en", "s"),
    ]
    kept = neardup.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    # One of each group of near-duplicates, the smallest id first; texts without words are linked with nothing.
    got = bag((r.doc_id, r.text) for r in kept.collect())
    assert got == bag([rows[0][:2], rows[1][:2], rows[4][:2], (7, None), (7, None)])


def test_sharding_keeps_small_groups_whole(spark):
    """Groups of two to nine members of different sizes: hardly any is cut, and the bytes stay level."""
    rows = [(20 * i + j, f"group {i} " + "x" * (100 + 37 * i % 900), "en", "s") for i in range(200) for j in range(2 + i % 8)]
    rows += [(100_000 + i, f"alone {i} " + "z" * (i % 700), "en", "s") for i in range(600)]
    got = sharding.shard_documents(documents(spark, rows), shards=6, buckets=16).collect()
    bytes_, groups = Counter(), defaultdict(set)
    for r in got:
        bytes_[r.shard] += r["size"]
        groups[r.text_crc32].add(r.shard)
    mean = sum(bytes_.values()) / 6
    assert all(abs(b - mean) <= 0.02 * mean for b in bytes_.values())
    assert sum(len(s) > 1 for s in groups.values()) <= 2
