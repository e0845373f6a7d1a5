"""A small table with everything that operators must stand: nulls, empties, repeats, ties, clashing columns."""

from __future__ import annotations

import random

CLASHING = ("size", "shard", "start", "bucket", "value", "n", "key", "kept", "body", "spans", "row", "copies", "n_words", "score")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text, lang, source)"""
    rng = random.Random(4)
    base = [prose(rng, 160) for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(base)]
    near = base[0].split()
    near[10] = "changed"
    shared = prose(rng, 90)
    rows += [
        (20, None, "en", "s0"), (21, "", "en", None), (22, " \n\t ", None, "s1"), (23, "one two", "en", "s1"),
        (24, base[0], "en", "s2"), (25, " ".join(near), "de", "s0"), (26, base[1].upper(), "en", "s0"),
        (27, prose(rng, 60) + " " + shared + " " + prose(rng, 50), "en", "s1"),
        (28, shared + " " + prose(rng, 60), "en", "s2"), (29, "ab " * 3000, "en", "s0"),
        (30, prose(rng, 5000), "de", "s1"), (31, "x" * 3000, "en", "s1"), (32, "one two", "en", "s1"),
        (33, "mail me at jo.doe@mail.example.com or +1 (212) 555-0100, ip 10.1.2.3 and 300.1.1.1", "en", "s0"),
        (34, "card 4111 1111 1111 1111 or 4111111111111112; a@b.c_d@e.f " * 3, "en", "s0"),
        (35, "é ß 漢字 😀 " * 60, "en", "s2"), (5, base[5], "de", "s2"), (5, base[5], "de", "s2"), (None, base[2], "en", "s0"),
        (None, "no id here at all", "en", None),
    ]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    filled = [(*r, None if r[1] is None else len(r[1]), *["clash"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(filled, schema).select(*names)


def bag(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
