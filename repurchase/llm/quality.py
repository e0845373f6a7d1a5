"""Quality rules whose cutoffs are chosen under a risk bound (DataFrame operations only).

Measures of a text are compared with cutoffs per stratum (language). A cutoff is acceptable if the documents labelled
good in a holdout are wrongly rejected by it at a rate of at most ``risk``, with certainty ``1 - delta`` over all
cutoffs tried:

1. Labelled documents are split by a hash of their id. On the tuning half, each measure and side gets a cutoff per
   level: a quantile of its good documents. A cutoff beyond which more good than bad documents lie is left out.
2. A level is the set of its cutoffs; it rejects a document beyond any of them. Of n good holdout documents it
   rejects k, and its p-value is the exact binomial tail P(X <= k), X ~ Bin(n, risk).
3. Holm's step-down correction over all strata and levels keeps the levels that hold together. Each stratum uses
   the one that separates bad from good best.

Defined results: a null text has no words and fails the base rule; a stratum without labels, or with too few for
any bound, rejects by the base rule alone; a null language is a stratum of its own; null labels are not used; of a
doc_id with several labels the smallest counts; rows that repeat a doc_id are judged row by row; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repurchase.llm.storage import WORD, stored

MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
RISK = 0.01
DELTA = 0.05
# Levels: shares of good tuning documents beyond each cutoff.
SHARES = (0.0, 0.0005, 0.001, 0.002, 0.005)
#: measure and whether high or low values are suspicious
RULES = (
    ("symbol_rate", "high"), ("upper_rate", "high"), ("mark_rate", "high"), ("dup_line_rate", "high"),
    ("repeat_rate", "high"), ("word_length", "high"), ("word_length", "low"),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def measure(documents: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks.

    A window of three words is known by its 64-bit hash within one text. Windows are sorted with their positions,
    so that equal ones are neighbours; the words they cover follow from the sorted positions of the repeated ones.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*keep, body.alias("_text")).withColumn("_words", _words(F.col("_text")))
    without = lambda chars: F.length(F.translate("_text", chars, ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        without(SPACES).cast("long").alias("word_chars"),
        (F.length("_text") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("_text") - without("!?;:")).cast("long").alias("n_marks"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.when(F.col("_text").contains("\n"), lines).alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    n = F.col("n_words").cast("int")
    shifted = lambda k: F.slice("_h", k + 1, F.greatest(n - 2, F.lit(0)))
    pairs = F.zip_with(shifted(0), shifted(1), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("_g", F.zip_with(pairs, shifted(2), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn(
        "_z", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    )
    following = F.slice("_z", 2, F.size("_z"))
    same = F.zip_with("_z", following, lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    rows = rows.withColumn(
        "_at", F.when(F.col("_z").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    )
    steps = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols",
        F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper", "n_marks",
    )


def rates(measured: DataFrame) -> DataFrame:
    """Add the base rule and the measures that cutoffs are learned for."""
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    words = F.greatest(F.col("n_words"), F.lit(1))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    return measured.withColumns(
        {
            "base_failed": base,
            "symbol_rate": F.col("n_symbols") / chars,
            "upper_rate": F.col("n_upper") / chars,
            "mark_rate": F.col("n_marks") / chars,
            "dup_line_rate": F.col("n_dup_lines") / words,
            "repeat_rate": F.col("n_repeat_words") / words,
            "word_length": F.col("word_chars") / words,
        }
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p): the terms are added relative to the largest, which is at k as long as k <= n p.

    Larger k give 1, an upper bound that never passes a test.
    """
    odds = F.lit(p / (1 - p))
    zero = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j * odds)
        return F.struct(term.alias("term"), (term + F.log1p(F.exp(a["sum"] - term))).alias("sum"))

    counts = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k <= n * p, F.exp(F.aggregate(counts, zero, step)["sum"])).otherwise(F.lit(1.0))


def value(rule: tuple[str, str]) -> Column:
    """The measure of a rule, turned so that large values are suspicious."""
    return F.col(rule[0]) if rule[1] == "high" else -F.col(rule[0])


def beyond(cutoffs: Column) -> Column:
    """Whether any measure lies beyond its entry of an array in the order of RULES (null: no cutoff)."""
    return F.coalesce(
        F.greatest(*[F.coalesce((value(r) > cutoffs[i]).cast("int"), F.lit(0)) for i, r in enumerate(RULES)]), F.lit(0)
    ) == 1


def choose_cutoffs(rated: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, seed: int = 5) -> DataFrame:
    """stratum, cutoffs (array in the order of RULES), p_value, level: one row for each stratum with a level that holds.

    ``rated`` has doc_id, lang, base_failed and the measures; ``labels`` doc_id and quality.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stored(
        rated.where("not base_failed")
        .join(known, "doc_id")
        .select(
            F.coalesce("lang", F.lit("")).alias("stratum"),
            (F.col("quality") == 1).alias("good"),
            (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)) == 0).alias("tuning"),
            *sorted({m for m, _ in RULES}),
        ),
        "labelled",
    )
    tuning = labelled.where("tuning")
    shares = F.array(*[F.lit(1.0 - s) for s in SHARES])
    # Quantiles and levels are stored, so that Spark knows their size before it chooses how to join them: a row per
    # stratum and level need not move the labelled rows, of which one language may hold most.
    quantiles = stored(
        tuning.where("good")
        .groupBy("stratum")
        .agg(F.array(*[F.percentile_approx(value(r), shares, 10_000) for r in RULES]).alias("at"))
        .select("stratum", "at", F.explode(F.array(*[F.lit(i) for i in range(len(SHARES))])).alias("level"))
        .select("stratum", "level", F.transform("at", lambda x: F.element_at(x, F.col("level") + 1)).alias("at")),
        "quantiles",
    )
    balance = [
        F.sum(F.when(value(r) > F.col("at")[i], F.when(F.col("good"), -1).otherwise(1)).otherwise(0)) for i, r in enumerate(RULES)
    ]
    useful = tuning.join(quantiles, "stratum").groupBy("stratum", "level", "at").agg(F.array(*balance).alias("gain"))
    levels = stored(
        useful.select("stratum", "level", F.zip_with("at", "gain", lambda c, g: F.when(g > 0, c)).alias("cutoffs")).where(
            F.exists("cutoffs", lambda c: c.isNotNull())
        ),
        "levels",
    )
    out = beyond(F.col("cutoffs"))
    tested = (
        labelled.where("not tuning")
        .join(levels, "stratum")
        .groupBy("stratum", "level", "cutoffs")
        .agg(
            F.count(F.when(F.col("good"), 1)).alias("n"),
            F.count(F.when(F.col("good") & out, 1)).alias("k"),
            F.avg(F.when(~F.col("good"), out.cast("double"))).alias("caught"),
        )
        .withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), risk))
    )
    # Holm: the i-th smallest of m p-values must be at most delta / (m - i + 1), and so must all smaller ones.
    order = Window.orderBy("p_value", "stratum", "level")
    bound = F.lit(delta) / (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1)
    held = F.min((F.col("p_value") <= F.col("bound")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    best = Window.partitionBy("stratum").orderBy((F.coalesce("caught", F.lit(0.0)) - F.col("k") / F.col("n")).desc(), "level")
    return (
        tested.withColumn("bound", bound)
        .withColumn("held", held)
        .where("held = 1")
        .withColumn("i", F.row_number().over(best))
        .where("i = 1")
        .select("stratum", "cutoffs", "p_value", "level")
    )


def judge(rated: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add kept: false if the base rule or a chosen cutoff of the document's stratum rejects."""
    # Stored, so that Spark knows the size before it chooses the join: a row per language need not move documents.
    chosen = stored(cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs")), "cutoffs")
    joined = rated.withColumn("_stratum", F.coalesce("lang", F.lit(""))).join(chosen, "_stratum", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond(F.col("_cutoffs"))).drop("_stratum", "_cutoffs")


def quality_verdicts(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, row by row."""
    rated = stored(rates(measure(documents, "doc_id", "lang")), "measures")
    return judge(rated, choose_cutoffs(rated, labels, risk, delta)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that pass, with all their columns."""
    packed = documents.select(F.struct(*documents.columns).alias("_document"), "doc_id", "lang", "text")
    rated = stored(rates(measure(packed, "_document", "doc_id", "lang")), "measures")
    return judge(rated, choose_cutoffs(rated, labels, risk, delta)).where("kept").select("_document.*")
