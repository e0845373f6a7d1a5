"""Personal data: base patterns, and weakly supervised spans on top of them (DataFrame operations only).

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches that pass their check. The method looks
at wider candidates too: the same kinds written more loosely, and matches that failed their check. Labelers vote on each candidate: shape (a regular expression), gazetteer (known endings, providers and
ranges) and context (words before it). Expectation-maximisation over the vote patterns estimates how reliable each
labeler is and how many candidates are personal; its posteriors train a logistic span classifier over shape features,
which decides. Loosely written candidates that it accepts and that overlap no base span are added; matches that
failed their check stay dropped and serve as examples only.

Positions count code points, ends are exclusive. Defined results: a null or empty text has no spans; repeated rows
and null ids are handled row by row; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repurchase.llm.storage import stored

KINDS = ("email", "ip", "card", "phone")
# Possessive loops and anchors keep the meaning of the base patterns but never backtrack over a long run:
# a match can only begin where a run of its first class begins, or where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these cannot match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
CONTEXT = 40
# Labeler words and gazetteers; matched in lower case within the text before the candidate.
CONTEXT_WORDS = {
    "email": r"e-?mail|mail|contact|write|reach|address|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|login|from",
    "card": r"card|visa|master|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel\b|call|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp",
}
#: loose shapes of further candidates
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?| dot )[A-Za-z]{2,12}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.+-])[0-9]{4}(?:[\x20.-]{1,2}[0-9]{4}){3}(?![A-Za-z0-9])",
}
LOOSE_NEEDS = {"email": r"[ \[(]dot[ \])]", "phone": r"[0-9]{3}[.-][0-9]{4}", "card": r"[0-9]{4}[\x20.-]{1,2}[0-9]{4}"}
PROVIDERS = r"\b(?:gmail|yahoo|hotmail|outlook|mail|example|com|org|net|edu)\b"
LABELERS = ("shape", "gazetteer", "context", "form")
EM_ROUNDS = 12
THRESHOLD = 0.9


SPAN = "struct<start:int,end:int,match:string>"
# Positions are summed up within blocks of so many matches and then over blocks, which keeps the copying small.
BLOCK = 256


def find(text: Column, pattern: str, needs: str) -> Column:
    """Matches as an array of (start, end, match), positions in code points.

    The pieces between the matches and the matches themselves alternate, so their lengths give the positions.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).alias("g"), F.length(h).alias("n"), h.alias("h")))
    both = F.filter(both, lambda x: x["h"].isNotNull())
    none = F.array().cast(f"array<{SPAN}>")

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + x["g"]
        span = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["h"].alias("match"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(a["list"], F.array(span)).alias("list"))

    def within(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("list")), add)

    def blocks(list_: Column) -> Column:
        upto = F.floor((F.size(list_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), upto), lambda b: within(F.slice(list_, b * BLOCK + 1, BLOCK)))

    def joined(parts: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), none.alias("list"))
        shift = lambda s, o: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["match"].alias("match"))
        return F.aggregate(
            parts, first,
            lambda a, d: F.struct(
                (a["at"] + d["at"]).alias("at"), F.concat(a["list"], F.transform(d["list"], lambda s: shift(s, a["at"]))).alias("list")
            ),
        )["list"]

    # One-element arrays bind a value to a name, so that it is computed once.
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    return F.when(text.rlike(needs), once(both, lambda m: F.when(F.size(m) > 0, joined(blocks(m))).otherwise(none))).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits fits."""
    n = F.length(digits)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(places, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    digits = digits_of(match)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        number = lambda p: F.when(small(p), F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")).otherwise(F.lit(256))
        return F.forall(F.split(match, r"\."), lambda p: number(p) <= 255)
    return F.lit(True)


def _at_least(length: int):
    return lambda s: F.length(s["match"]) >= length


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


def scan(documents: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, ``row``, ``text`` and ``spans``: all base matches and loose candidates.

    A span is (kind, start, end, match, strict: found by the base pattern, passes: its check, before: context).
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*[c for c in keep if c != "text"], body.alias("_body"), *[c for c in keep if c == "text"])
    for kind in KINDS:
        found = find(F.col("_body"), PATTERNS[kind], NEEDS[kind])
        # Numbers too short for any check to pass are no examples of a card or a phone either.
        shortest = {"card": 14, "phone": 9}.get(kind, 0)
        rows = rows.withColumn(f"_{kind}", F.filter(found, _at_least(shortest)))
    for kind in LOOSE:
        rows = rows.withColumn(f"_loose_{kind}", find(F.col("_body"), LOOSE[kind], LOOSE_NEEDS[kind]))

    def described(kind: str, column: str, strict: bool) -> Column:
        return F.transform(column, lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
            F.lit(strict).alias("strict"), (valid(kind, s["match"]) if strict else F.lit(False)).alias("passes"),
            F.lower(F.substring(F.col("_body"), F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))).alias("before"),
        ))

    lists = [described(k, f"_{k}", True) for k in KINDS] + [described(k, f"_loose_{k}", False) for k in LOOSE]
    return rows.select(*keep, F.concat(*lists).alias("spans"))


def votes(spans: DataFrame) -> DataFrame:
    """kind, match, before, strict, passes -> the votes of the labelers (1, -1, or 0 for none) and shape features."""
    kind, match = F.col("kind"), F.lower("match")
    digits = digits_of(match)
    by_kind = lambda values, other: F.coalesce(*[F.when(kind == KINDS.index(k), v) for k, v in values.items()], other)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    nothing = F.lit(0)
    shape = by_kind({
        "email": vote(F.col("strict"), match.rlike("^[^ ]* at [^ ]* dot ")),
        "ip": vote(F.col("passes"), ~F.col("passes")),
        "card": vote(luhn(F.when(F.length(digits) == 0, F.lit("1")).otherwise(digits)) & F.length(digits).between(14, 19), F.length(digits) < 14),
        "phone": vote(F.length(digits).between(10, 15), F.length(digits) < 10),
    }, nothing)
    gazetteer = by_kind({
        "email": vote(match.rlike(PROVIDERS), ~match.rlike(r"\.[a-z]{2,}$|dot [a-z]{2,}$")),
        "ip": vote(F.lit(False), match.rlike(r"^(?:0+|127|255)\.")),
        "card": vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^(?:0|1|7|8|9)")),
        "phone": vote(F.col("match").startswith("+") | F.col("match").startswith("("), digits.rlike("^0+$|^(?:19|20)[0-9]{2}")),
    }, nothing)
    context = F.coalesce(*[F.when((kind == i) & F.col("before").rlike(CONTEXT_WORDS[k]), 1) for i, k in enumerate(KINDS)], nothing)
    form = by_kind({
        "email": vote(match.contains("@"), F.lit(False)),
        "ip": vote(F.size(F.split("match", r"\.")) == 4, F.lit(False)),
        "card": vote(F.length(digits) == 16, ~F.length(digits).between(13, 19)),
        "phone": vote(F.col("strict"), F.length(digits) > 15),
    }, nothing)
    return spans.withColumns({"shape": shape, "gazetteer": gazetteer, "context": context, "form": form})


def patterns_of(voted: DataFrame) -> DataFrame:
    """How often each vote pattern occurs: at most kinds x 2 x 3^labelers rows, whatever the input."""
    return voted.groupBy("kind", "strict", "passes", *LABELERS).agg(F.count("*").cast("double").alias("n"))


def posterior(prior: float, table: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """P(personal | votes) of labelers that err independently."""
    logit = F.lit(math.log(prior / (1 - prior)))
    for name in LABELERS:
        for value, (yes, no) in table[name].items():
            logit = logit + F.when(F.col(name) == value, F.lit(math.log(yes / no))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def reliabilities(patterns: DataFrame, rounds: int = EM_ROUNDS) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """Expectation-maximisation: each round is one aggregate over the vote patterns.

    Labelers start as more often right than wrong; counts are smoothed by one, so nothing becomes certain.
    """
    prior = 0.5
    table = {name: {1: (0.6, 0.2), 0: (0.3, 0.3), -1: (0.1, 0.5)} for name in LABELERS}
    for _ in range(rounds):
        scored = patterns.withColumn("p", posterior(prior, table))
        sums = [F.sum(F.col("n")).alias("all"), F.sum(F.col("n") * F.col("p")).alias("yes")]
        for name in LABELERS:
            for value in (1, 0, -1):
                weight = F.when(F.col(name) == value, F.col("n")).otherwise(0.0)
                sums.append(F.sum(weight * F.col("p")).alias(f"{name}_{value}_yes"))
                sums.append(F.sum(weight * (1 - F.col("p"))).alias(f"{name}_{value}_no"))
        row = scored.agg(*sums).first()
        if not row["all"]:
            break
        yes, no = row["yes"], row["all"] - row["yes"]
        prior = (yes + 1) / (row["all"] + 2)
        table = {
            name: {
                v: ((row[f"{name}_{v}_yes"] + 1) / (yes + 3), (row[f"{name}_{v}_no"] + 1) / (no + 3)) for v in (1, 0, -1)
            }
            for name in LABELERS
        }
    return prior, table


def features() -> list[Column]:
    """Inputs of the span classifier: votes and form per kind."""
    out = [F.when(F.col(n) == v, 1.0).otherwise(0.0) for n in LABELERS for v in (1, -1)]
    out += [F.when(F.col("kind") == i, 1.0).otherwise(0.0) for i in range(len(KINDS))]
    return out + [F.col("strict").cast("double"), F.col("passes").cast("double")]


def train_classifier(patterns: DataFrame, prior: float, table: dict) -> list[float]:
    """Weights of a logistic regression on the posteriors: every pattern counts once as yes and once as no.

    The last number is the intercept. Without candidates nothing is accepted.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    scored = patterns.withColumn("p", posterior(prior, table)).withColumn("features", array_to_vector(F.array(*features())))
    yes = scored.select("features", F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("w"))
    no = scored.select("features", F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("w"))
    if scored.isEmpty():
        return [0.0] * len(features()) + [-100.0]
    model = LogisticRegression(weightCol="w", regParam=1e-3, maxIter=50, standardization=False).fit(yes.unionByName(no).where("w > 0"))
    return [float(x) for x in model.coefficients] + [float(model.intercept)]


def find_spans(documents: DataFrame, *keep: str, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, ``base`` and ``spans``: arrays of (start, kind, end), sorted; kinds as indexes of KINDS."""
    columns = list(dict.fromkeys(keep))
    found = stored(scan(documents, *columns).withColumn("_row", F.monotonically_increasing_id()), "spans")
    each = found.select("_row", F.posexplode("spans").alias("i", "s")).select("_row", "i", "s.*")
    voted = stored(votes(each).drop("match", "before"), "votes")
    patterns = stored(patterns_of(voted), "patterns")
    prior, table = reliabilities(patterns)
    weights = train_classifier(patterns, prior, table)
    logit = F.lit(weights[-1])
    for weight, feature in zip(weights, features()):
        logit = logit + F.lit(weight) * feature
    accepted = (
        voted.where(~F.col("strict"))
        .where(1 / (1 + F.exp(-logit)) >= threshold)
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    )
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["passes"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    joined = found.withColumn("base", base).join(accepted, "_row", "left")
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")), clear)
    return joined.select(*columns, "base", F.array_sort(F.array_distinct(F.concat("base", more))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span of their text replaced by its kind in brackets; other columns as they are.

    Overlapping spans of several kinds are replaced as one, by the kind that begins first.
    """
    packed = documents.select(F.struct(*documents.columns).alias("_document"), "text")
    found = find_spans(packed, "_document")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.coalesce(F.col("_document.text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(piece))).otherwise(a["parts"]).alias("parts"),
        )

    def whole(a: Column) -> Column:
        return F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text)))

    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, whole)).otherwise(F.col("_document.text"))
    return found.select(*[clean.alias(c) if c == "text" else F.col("_document")[c].alias(c) for c in documents.columns])
