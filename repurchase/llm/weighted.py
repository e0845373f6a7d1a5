"""Document fingerprints by consistent weighted sampling.

A text is a set of terms (its words, split at blanks only) with their counts as weights S. For every position j of the
fingerprint a term draws, from hashes of the term and j alone, two gamma variables r, c of shape 2 and a uniform b, and

    t = floor(ln S / r + b),   ln a = ln c - r (t - b + 1);

the term with the smallest a is the sample, known by (term, t). Two texts agree at a position with a probability equal
to their generalised Jaccard similarity, sum of min(S) over sum of max(S) of all terms, whatever the two texts are.

Everything is built of column functions. ln a and a hash of (term, t) are packed into one long, so that a sample is a
plain ``min`` and all positions of a text are one hash aggregate. Texts are shuffled once by their key; the samples need
no further exchange, as they are grouped by that key and more.

The fingerprint is written as four hexadecimal digits per position, so unequal samples look equal with a probability of
1/65536, by which likenesses are too high at most. ln a is kept to 2**-23; closer ones are settled by the hash, in the
same way for all texts.

Defined results: a null text is an empty one; a text without words has an empty fingerprint, which is like another
empty one (1) and unlike any other (0); very long texts are counted whole; rows that repeat an id and a text are
neighbours, each the next of the one before; rows that share an id are ordered by a hash of their text, rows without id
come last; the next of the last row is the first, of a single row itself; an empty table gives no rows. Columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repurchase.llm.storage import stored

SAMPLES = 48
DIGITS = 4
# A position may miss its sample with a probability of exp(-14), below 1e-6; another one, or none, then stands for it.
SURE = 14.0
# ln a lies within +-128 for any count below 2**63: kept in 31 bits, above 32 bits that name the sample.
_RANGE, _STEPS = 128.0, float(1 << 23)
KEY = ["_id", "_hash"]


def _uniform(h: Column, bits: int, shift: int) -> Column:
    """The given bits of a hash as a number inside (0, 1)."""
    taken = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (taken + 0.5) * F.lit(1.0 / (1 << bits))


def sample(term: Column, weight: Column, log_weight: Column, total: Column, j: int) -> Column:
    """ln a and the name of (term, t) as one long, null if a is certainly not the least of its text at position j.

    With r = -ln u and c = -ln v, a is at least (1 - v) u / S, which takes no logarithm. The least a of a text is
    exponentially distributed with the sum of its weights as rate, so it exceeds ``SURE`` over that sum with a
    probability of exp(-SURE); terms whose bound does are not looked at any further.
    """
    first = F.xxhash64(term, F.lit(j))
    second = F.xxhash64(first)
    u = _uniform(first, 32, 0) * _uniform(first, 32, 32)
    v = _uniform(second, 20, 0) * _uniform(second, 20, 20)
    r, b = -F.ln(u), _uniform(second, 24, 40)
    t = F.floor(log_weight / r + b)
    log_a = F.ln(-F.ln(v)) - r * (t - b + 1.0)
    name = F.xxhash64(first, t).bitwiseAND(F.lit(0xFFFFFFFF))
    packed = F.shiftleft(F.floor((log_a + _RANGE) * _STEPS), 32) + name
    return F.when(term.isNotNull() & ((1.0 - v) * u * total <= SURE * weight), packed)


def words(text: Column) -> Column:
    """The words of a text; empty strings stand before and behind blanks at its ends, and for a text without words."""
    return F.split(text, "[\\x20\\x09-\\x0D]+")


def written(samples: list[Column]) -> Column:
    digits = [F.right(F.lpad(F.hex(s), 16, "0"), F.lit(DIGITS)) for s in samples]
    return F.when(F.coalesce(*samples).isNull(), F.lit("")).otherwise(F.concat(*[F.coalesce(d, F.lit("0" * DIGITS)) for d in digits]))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint: one row per text. ``keys`` name a text; it must not occur twice.

    Where ``texts`` is already partitioned by some of the keys, nothing is shuffled.
    """
    # Within one text 64 bits stand for a word. Equal ones are counted where they are, as runs of the sorted list.
    lists = texts.select(*keys, F.sort_array(F.transform(words(F.col(text)), lambda w: F.xxhash64(w))).alias("_terms"))
    size, terms = F.size("_terms"), F.col("_terms")
    changes = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.get(terms, i) != F.get(terms, i - 1)))
    lists = lists.select(*keys, "_terms", changes.alias("_ends"))
    run = F.transform(
        "_ends", lambda end, i: F.struct(F.get(terms, end - 1).alias("_term"), (end - F.when(i > 0, F.get(F.col("_ends"), i - 1)).otherwise(0)).alias("_count"))
    )
    weighed = lists.select(*keys, size.cast("double").alias("_total"), F.inline(run))
    # The empty string is no term, but keeps a row of a text without words.
    weighed = weighed.withColumn("_term", F.when(F.col("_term") != F.xxhash64(F.lit("")), F.col("_term")))
    weight = F.col("_count").cast("double")
    weighed = weighed.select(*keys, "_total", "_term", weight.alias("_weight"), F.ln(weight).alias("_log"))
    columns = [F.col(c) for c in ("_term", "_weight", "_log", "_total")]
    least = [F.min(sample(*columns, j)).alias(f"_s{j}") for j in range(samples)]
    found = weighed.groupBy(*keys).agg(*least)
    return found.select(*keys, written([F.col(f"_s{j}") for j in range(samples)]).alias("fingerprint"))


def likeness(a: str | Column, b: str | Column, samples: int = SAMPLES) -> Column:
    """Share of positions at which two fingerprints agree."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    same = [F.when(F.substring(a, DIGITS * j + 1, DIGITS) == F.substring(b, DIGITS * j + 1, DIGITS), 1).otherwise(0) for j in range(samples)]
    share = sum(same[1:], same[0]) / F.lit(float(samples))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(share)


def keyed(documents: DataFrame) -> DataFrame:
    """_id and _hash name an id and a text; a missing id goes into the hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_id"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("_hash"), "doc_id", text.alias("text"),
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """One stored row per id and text: KEY, doc_id, n_chars, copies, next_id, next_hash.

    The order is by falling id. Rows without texts are dealt into ranges; the first row of each range is the next of
    the last row of the range before, which takes one row per range to find.
    """
    thin = rows.groupBy(*KEY, "doc_id", F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("copies"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_hash")]
    ranged = stored(thin.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "order")
    inside = Window.partitionBy("_range").orderBy(*order)
    own = F.struct(*KEY)
    first = ranged.withColumn("_at", F.row_number().over(inside)).where("_at = 1").select("_range", own.alias("_own"))
    along = Window.orderBy("_range")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select("_range", F.coalesce(F.lead("_own").over(along), F.first("_own").over(whole)).alias("_after"))
    linked = ranged.withColumn("_next", F.lead(own).over(inside)).join(after, "_range")
    following = F.coalesce("_next", "_after")
    placed = linked.select(
        *KEY, "doc_id", "n_chars", "copies", following.getField("_id").alias("next_id"), following.getField("_hash").alias("next_hash")
    )
    return stored(placed, "neighbours")


def edited(text: Column, n_chars: Column, other: Column) -> Column:
    """The last half of the text replaced by the first as many characters of the other."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars.cast("int") - half), F.substring(other, F.lit(1), half))


def compare_with_next(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last half replaced by the beginning of the next document, by falling id.
    """
    rows = keyed(documents)
    thin = neighbours(rows)
    # An aggregate keeps its name in every copy of the plan, so that the heads are shuffled once; dropDuplicates does not.
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"))
    asked = thin.select(F.col("next_id").alias("_id"), F.col("next_hash").alias("_hash"), F.struct(*KEY).alias("_for"), "n_chars")
    heads = asked.join(texts, KEY).select("_for._id", "_for._hash", F.substring("text", F.lit(1), F.floor(F.col("n_chars") / 2).cast("int")).alias("_head"))
    full = texts.join(thin.select(*KEY, "n_chars", "copies"), KEY).join(heads, KEY)
    # All but the last of several equal rows are followed by themselves.
    text, n = F.col("text"), F.col("n_chars")
    forms = full.select(
        *KEY, text.alias("_own"), edited(text, n, F.col("_head")).alias("_edited"),
        F.when(F.col("copies") > 1, edited(text, n, text)).alias("_doubled"),
    )
    names = ("_own", "_edited", "_doubled")
    digests = forms.select(*KEY, *[F.sha2(c, 256).alias(f"{c}_sha256") for c in names[1:]])
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("form"), F.col(c).alias("text")) for i, c in enumerate(names)]), lambda x: x["text"].isNotNull())
    prints = fingerprints(forms.select(*KEY, F.inline(each)), [*KEY, "form"], samples=samples)
    prints = prints.groupBy(*KEY).agg(*[F.max(F.when(F.col("form") == i, F.col("fingerprint"))).alias(c) for i, c in enumerate(names)])
    done = stored(prints.join(digests, KEY), "fingerprints")
    both = thin.join(done, KEY).join(
        done.select(F.col("_id").alias("next_id"), F.col("_hash").alias("next_hash"), F.col("_own").alias("_following")), ["next_id", "next_hash"]
    )
    copies = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    last = F.col("_copy") == F.col("copies")
    changed = F.when(last, F.col("_edited")).otherwise(F.col("_doubled"))
    return copies.select(
        "doc_id", "n_chars", F.when(last, F.col("_edited_sha256")).otherwise(F.col("_doubled_sha256")).alias("edited_sha256"),
        F.col("_own").alias("fingerprint"), changed.alias("edited_fingerprint"), likeness(F.col("_own"), changed, samples).alias("near_edited"),
        F.when(last, likeness("_own", "_following", samples)).otherwise(F.lit(1.0)).alias("near_next"),
    )
