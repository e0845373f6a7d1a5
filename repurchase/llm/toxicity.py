"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows are dealt into three parts by a hash of their id, half and two quarters. The first gives the lexicon: words, and beginnings of
words, that are much more frequent in toxic documents. The second fits the trees on dense features of whole texts:
lexicon densities, closeness of second-person words to lexicon words, capitals, punctuation and obfuscation. The third
fits the isotonic curve that turns the trees' output into a probability. Their number is bounded by a
parameter; more rows are thinned by the hash. Everything else reads all documents.

Defined results: a null or empty text has all features 0 and is scored like any other; without labels of both kinds
in a part, every score is the share of toxic rows among the labelled ones (0 without any); of a doc_id with several
labels the largest counts; null labels are not used; repeated rows are scored row by row; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repurchase.llm.storage import stored

MAX_LABELLED = 40_000
LEXICON_SIZE = 400
MIN_SUPPORT = 4
MIN_LOG_ODDS = 2.0
STEM_LENGTHS = (4, 5)
ROUNDS = 20
DEPTH = 3
NEAR = 4
# Fixed words of address in the languages of the documents.
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch sie tu te toi vous votre ton ta usted ti tú tus".split())
FEATURES = (
    "words", "word_hits", "stem_hits", "word_density", "stem_density", "weight", "strongest", "distinct",
    "second_person", "near_second_person", "capitals", "shouting", "marks", "masked",
)
WORDS = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+[*@$#0-9]+[^\W\d_]+")
MARKS = re.compile(r"[!?]")
CAPITAL = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")


def labelled(documents: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """text, label, part (0, 1, 2) of the rows that may be learned from, about MAX_LABELLED at most."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    known = known.where(train)
    n = known.count()
    share = min(1.0, MAX_LABELLED / max(n, 1))
    kept = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
    part = F.greatest(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) - 1, F.lit(0)).cast("int")
    # The thinned labels are bounded by MAX_LABELLED, so they go to every task and no text is moved.
    rows = documents.select("doc_id", "text").join(F.broadcast(kept), "doc_id")
    return stored(rows.select("text", "label", part.alias("part")), "labelled")


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Terms with their log odds: ``size`` at most. A term is a word, or a beginning of one followed by a star."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    stems = [F.transform(F.filter("w", lambda x: F.length(x) > n), _stem(n)) for n in STEM_LENGTHS]
    terms = rows.select("label", words.alias("w")).select("label", F.explode(F.array_distinct(F.concat("w", *stems))).alias("term"))
    n = rows.agg(F.sum("label").alias("yes"), F.count("*").alias("all")).first()
    if not n["all"] or not n["yes"] or n["yes"] == n["all"]:
        return {}
    yes, no = n["yes"], n["all"] - n["yes"]
    odds = F.log((F.col("a") + 0.5) / (yes + 1)) - F.log((F.col("b") + 0.5) / (no + 1))
    found = (
        terms.groupBy("term")
        .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        .where(F.col("a") >= MIN_SUPPORT)
        .withColumn("odds", odds)
        .where(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy((F.col("odds") * F.sqrt("a")).desc(), "term")
        .limit(size)
    )
    return {r["term"]: float(r["odds"]) for r in found.collect()}


def _stem(n: int):
    return lambda x: F.concat(F.substring(x, 1, n), F.lit("*"))


def dense(text: str, words: dict[str, float], stems: dict[str, float]) -> tuple[float, ...]:
    """The features of one text."""
    own = WORDS.findall(text)
    if not own:
        return (0.0,) * len(FEATURES)
    n = len(own)
    low = WORDS.findall(text.lower())
    hits = [i for i, w in enumerate(low) if w in words or w[:4] in stems or w[:5] in stems]
    second = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near, weight, top, plain, terms = 0, 0.0, 0.0, 0, set()
    if hits:
        close = set()
        for i in second:
            close.update(range(i - NEAR, i + NEAR + 1))
        near = sum(i in close for i in hits)
        for i in hits:
            w = low[i]
            odds = max(words.get(w, 0.0), stems.get(w[:4], 0.0), stems.get(w[:5], 0.0))
            plain += w in words
            terms.add(w)
            weight += odds
            top = max(top, odds)
    return (
        math.log1p(n), float(plain), float(len(hits)), plain / n, len(hits) / n, weight / n, top, float(len(terms)),
        len(second) / n, near / n, sum(map(len, CAPITAL.findall(text))) / len(text), len(CAPITAL.findall(text)) / n,
        len(MARKS.findall(text)) / n, len(MASKED.findall(text)) / n,
    )


def featured(rows: DataFrame, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """The kept columns and FEATURES, from whole texts."""
    words = {k: v for k, v in lexicon.items() if not k.endswith("*")}
    stems = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
    source = rows.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    kept = [f for f in source.schema.fields if f.name != "_text"]
    out = T.StructType(kept + [T.StructField(f, T.DoubleType()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [dense(t, words, stems) for t in batch.column("_text").to_pylist()]
                columns = [batch.column(f.name) for f in kept] + [pa.array(c, pa.float64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return source.mapInArrow(run, out)


def score(documents: DataFrame, labels: DataFrame, train: Column, *keep: str, rounds: int = ROUNDS, depth: int = DEPTH) -> DataFrame:
    """The kept columns and ``score``. ``train`` is a condition on doc_id: rows that may be learned from."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = labelled(documents, labels, train)
    counts = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    if any(not counts.get((part, label)) for part in (0, 1, 2) for label in (0.0, 1.0)):
        yes, all_ = sum(n for (_, label), n in counts.items() if label), sum(counts.values())
        return documents.select(*keep, F.lit(yes / all_ if all_ else 0.0).alias("score"))
    lexicon = learn_lexicon(rows.where("part = 0"))
    vector = array_to_vector(F.array(*FEATURES)).alias("features")
    fitted = stored(featured(rows.where("part > 0"), lexicon, "label", "part"), "features")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32, cacheNodeIds=True).fit(
        fitted.where("part = 1").select("label", vector).repartition(1 + counts[1, 0.0] // 5000)
    )
    raw = vector_to_array(F.col("probability"))[1].alias("raw")
    held = trees.transform(fitted.where("part = 2").select("label", vector)).select("label", raw)
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held)
    scored = trees.transform(featured(documents, lexicon, *keep).select(*keep, vector)).select(*keep, raw)
    return curve.transform(scored).select(*keep, F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("score"))
