"""Personal data spans by weak supervision, in DataFrame functions only.

Broad patterns propose candidate spans. Labelers vote on each (yes, no, or nothing): the strict format, gazetteers
of prefixes and ranges, a checksum or character mix, and the words before the span. Expectation-maximisation over
the counts of the vote patterns (at most 3^labelers rows for each kind) estimates how reliable each labeler is and
how likely each pattern; a logistic span classifier is then trained with those probabilities as soft labels. It doesn't
see the votes but the span and its context (``FEATURES``: format, length, kinds of characters, separators, variety, the
character and the hashed word before it), so that it also decides where labelers abstain. It is fitted to counts of the
distinct feature rows, at most ``CODES`` for each kind at any table size. What it accepts is added to the base spans,
which always stay: emails, IP addresses, card numbers and phone numbers by their fixed patterns.

Places are in code points, end exclusive. Patterns are written so that each text is scanned in linear time.

Defined results: a null text is an empty one and has no spans; texts are examined by content, so repeated rows and
rows with a null id get the spans of their text; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._common import attach, attach_shuffled, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Candidate patterns. The first four are the base patterns; possessive forms and the guards in front match the same text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
}
#: A cheap test that every text with a candidate passes.
NEEDS = {"email": "@", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Gazetteers: fixed values, public knowledge.
MAIL_WORDS = "mail|contact|write|reach|kontakt|correo|courriel"
NUMBER_WORDS = "card|visa|credit|account|payment|karte|tarjeta|carte"
PHONE_WORDS = "phone|call|tel|mobile|fax|telefon"
NET_WORDS = "ip|host|server|address|addr"
SECRET_WORDS = "token|secret|key|password|passwd|pwd|api|auth"
CONTEXT = {"email": MAIL_WORDS, "ip": NET_WORDS, "card": NUMBER_WORDS, "phone": PHONE_WORDS, "secret": SECRET_WORDS}
CARD_PREFIXES = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5))"
PRIVATE_RANGES = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
DOMAIN_ENDINGS = r"\.(?:com|org|net|edu|gov|de|fr|es|uk|eu|io|info)$"
CALLING_CODES = r"^\+(?:1|33|34|44|49|39|7|81|86|91)"
LABELERS = ("format", "gazetteer", "mix", "context", "assigned")
BEFORE = 24
ACCEPT = 0.5
#: What the classifier sees of a span and its context, with the number of values of each.
FEATURES = {"valid": 2, "size": 6, "shape": 8, "parts": 4, "variety": 3, "edge": 5, "word": 17}
CODES = math.prod(FEATURES.values())


def proposals(docs: DataFrame) -> DataFrame:
    """(text_key, kind, start, stop, value, before, after) of every candidate in the distinct texts of docs (text)."""
    text = F.col("text")
    cut = lambda gap: F.struct(F.length(gap).alias("n"), F.right(gap, F.lit(BEFORE)).alias("r"), F.left(gap, F.lit(1)).alias("l"))
    each = []
    for kind in KINDS:
        has = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        gaps = F.transform(F.split(text, PATTERNS[kind], -1), cut)
        each.append(F.when(has, F.struct(F.lit(kind).alias("kind"), found.alias("found"), gaps.alias("gaps"))))
    kinds = docs.filter("text IS NOT NULL").select(F.md5("text").alias("text_key"), F.explode(F.array_compact(F.array(*each))).alias("k"))
    kinds = kinds.select("text_key", "k.*").filter(F.size("found") > 0)
    rows = kinds.select("text_key", "kind", F.posexplode(F.arrays_zip("found", "gaps", F.slice("gaps", 2, F.size("gaps")).alias("next"))))
    rows = rows.select("text_key", "kind", "pos", F.col("col.found").alias("value"), F.col("col.gaps").alias("gap"), F.col("col.next.l").alias("after"))
    rows = rows.filter("value IS NOT NULL").dropDuplicates(["text_key", "kind", "pos"])
    here = Window.partitionBy("text_key", "kind").orderBy("pos")
    stop = F.sum(F.col("gap.n") + F.length("value")).over(here)
    return rows.select("text_key", "kind", (stop - F.length("value")).alias("start"), stop.alias("stop"), "value", F.col("gap.r").alias("before"), "after")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    back = F.reverse(digits)
    each = F.transform(
        F.split(back, ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def judged(candidates: DataFrame) -> DataFrame:
    """candidates with ``base`` (a base span) and one vote of each labeler: 1, 0, or null for none."""
    kind, value, before = F.col("kind"), F.col("value"), F.lower("before")
    out = candidates.withColumn("digits", F.regexp_replace("value", "[^0-9]", "")).withColumn("n", F.length("digits"))
    size = F.col("n")
    strict = (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == "card", size.between(14, 19) & F.when(size.between(14, 19), luhn(F.col("digits"))).otherwise(False))
        .when(kind == "phone", size.between(10, 15))
        .otherwise(value.rlike("[0-9]") & value.rlike("[A-Za-z]"))
    )
    vote = lambda yes, no: F.when(yes, 1).when(no, 0)
    listed = (
        F.when(kind == "email", vote(value.rlike(DOMAIN_ENDINGS), F.lit(False)))
        .when(kind == "ip", vote(F.lit(False), value.rlike(PRIVATE_RANGES)))
        .when(kind == "card", vote(F.lit(False), ~F.col("digits").rlike(CARD_PREFIXES)))
        .when(kind == "phone", vote(value.rlike(CALLING_CODES), F.lit(False)))
        .otherwise(vote(value.rlike("^[0-9a-f]{32,}$"), value.rlike("^[A-Za-z-]+$|^[0-9-]+$")))
    )
    variety = F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), "")))
    mix = (
        F.when(kind == "secret", vote(variety >= 9, variety < 6))
        .when(kind == "card", vote(size.between(15, 16), ~size.between(13, 19)))
        .when(kind == "phone", vote(value.rlike("[ ().-]"), size < 8))
        .when(kind == "ip", vote(F.lit(False), F.col("after").rlike(r"^[.0-9]")))
        .otherwise(vote(F.length("value") >= 8, F.length("value") < 6))
    )
    told = F.lit(None).cast("int")
    for k, words in CONTEXT.items():
        told = F.when((kind == k) & before.rlike(rf"\b(?:{words})s?\b"), 1).otherwise(told)
    assigned = F.when(kind == "secret", vote(before.rlike("[=:]\\s*[\"']?$"), ~before.rlike("[=:\"']$"))).otherwise(vote(before.rlike("[=:]\\s*$"), F.lit(False)))
    return out.select(
        "text_key", "kind", "start", "stop", (strict & (kind != "secret")).alias("base"),
        vote(strict, ~strict).alias("format"), listed.alias("gazetteer"), mix.alias("mix"), told.alias("context"), assigned.alias("assigned"),
        code(strict, variety).alias("code"),
    )


def code(valid: Column, variety: Column) -> Column:
    """The FEATURES of a candidate (value, before) as one number: digits of mixed base, the first feature highest."""
    value, before = F.col("value"), F.lower("before")
    has = lambda pattern, weight: F.when(value.rlike(pattern), weight).otherwise(0)
    word = F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1)
    seen = {
        "valid": F.coalesce(valid, F.lit(False)).cast("int"),
        "size": F.least(F.floor(F.log2(F.length("value"))), F.lit(FEATURES["size"] - 1)),
        "shape": has("[0-9]", 1) + has("[A-Z]", 2) + has("[a-z]", 4),
        "parts": F.least(F.length(F.regexp_replace(F.left(value, F.lit(256)), "[A-Za-z0-9]+", "")), F.lit(FEATURES["parts"] - 1)),
        "variety": F.when(variety < 6, 0).when(variety < 9, 1).otherwise(2),
        "edge": F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike("[=:\"']$"), 2).when(before.rlike(r"[\p{L}\p{N}]$"), 3).otherwise(4),
        "word": F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(FEATURES["word"] - 1))),
    }
    out = F.lit(0).cast("long")
    for name, values in FEATURES.items():
        out = out * values + seen[name]
    return out.cast("int")


def reliabilities(patterns: list[tuple[tuple, int]], rounds: int = 50):
    """(prior, sensitivity, specificity, probability of each pattern) by expectation-maximisation over vote patterns.

    A labeler that doesn't vote says nothing. Starts from labelers that are right in four of five votes.
    """
    n = len(LABELERS)
    prior, sens, spec, p = 0.5, [0.8] * n, [0.8] * n, []
    for _ in range(rounds):
        p = []
        for votes, _ in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(votes):
                if v is not None:
                    yes += math.log(sens[j] if v else 1 - sens[j])
                    no += math.log(1 - spec[j] if v else spec[j])
            p.append(1 / (1 + math.exp(min(max(no - yes, -60), 60))))
        total = sum(c for _, c in patterns)
        prior = min(max(sum(q * c for q, (_, c) in zip(p, patterns)) / total, 0.01), 0.99)
        for j in range(n):
            cast = [(q, c, v[j]) for q, (v, c) in zip(p, patterns) if v[j] is not None]
            sens[j] = (2 + sum(q * c for q, c, v in cast if v)) / (2.5 + sum(q * c for q, c, _ in cast))
            spec[j] = (2 + sum((1 - q) * c for q, c, v in cast if not v)) / (2.5 + sum((1 - q) * c for q, c, _ in cast))
    return prior, sens, spec, p


def indicators(codes: np.ndarray) -> np.ndarray:
    """A constant and an indicator of each value of each feature, for the codes of code()."""
    columns, rest = [], codes.copy()
    for values in reversed(FEATURES.values()):
        columns.append(np.eye(values)[rest % values])
        rest = rest // values
    return np.hstack([np.ones((len(codes), 1)), *reversed(columns)])


def classifier(codes: np.ndarray, counts: np.ndarray, p: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression on the codes' indicators with soft labels p and an L2 penalty, by Newton steps.

    The penalty weighs as much as a few candidates, so that rare values of a feature decide little.
    """
    x, penalty = indicators(codes), np.full(1 + sum(FEATURES.values()), 1.0)
    penalty[0] = 1e-3
    w = np.zeros(x.shape[1])
    loss = lambda w: float(counts @ (np.logaddexp(0, x @ w) - p * (x @ w)) + 0.5 * penalty @ w**2)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve(x.T @ (x * (counts * q * (1 - q))[:, None]) + np.diag(penalty), x.T @ (counts * (q - p)) + penalty * w)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return w


def _pattern() -> Column:
    """The number of a candidate's votes: a digit of base 3 for each labeler (0: none)."""
    out = F.lit(0)
    for name in LABELERS:
        out = out * 3 + F.coalesce(F.col(name) + 1, F.lit(0))
    return out


def fit(votes: DataFrame) -> dict[str, np.ndarray]:
    """Classifier weights of each kind: the label model from the counts of all vote patterns, the classifier from the
    counts and mean probabilities of all feature rows."""
    counted = votes.groupBy("kind", *LABELERS).count().collect()  # at most 3^5 rows for each kind
    likely = [0.0] * (len(KINDS) * 3 ** len(LABELERS))
    for i, kind in enumerate(KINDS):
        patterns = sorted((((tuple(r[x] for x in LABELERS)), r["count"]) for r in counted if r.kind == kind), key=str)
        if patterns:
            for (v, _), p in zip(patterns, reliabilities(patterns)[3]):
                number = 0
                for x in v:
                    number = number * 3 + (0 if x is None else x + 1)
                likely[i * 3 ** len(LABELERS) + number] = p
    place = (rank(F.col("kind")) - 1) * 3 ** len(LABELERS) + _pattern() + 1
    rows = votes.groupBy("kind", "code").agg(F.count("*").alias("n"), F.avg(F.element_at(F.lit(likely), place.cast("int"))).alias("p")).collect()  # CODES a kind at most
    out = {}
    for kind in KINDS:
        if own := sorted((r.code, r.n, r.p) for r in rows if r.kind == kind):
            codes, n, p = zip(*own)
            out[kind] = classifier(np.array(codes, np.int64), np.array(n, float), np.array(p))
    return out


def probability(weights: dict[str, np.ndarray]) -> Column:
    """The classifier's probability of a candidate (kind, code); -1 for a kind without a classifier."""
    width, score = 1 + sum(FEATURES.values()), F.lit(-1.0)
    table = np.concatenate([weights.get(k, np.zeros(width)) for k in KINDS])
    weight = lambda at: F.element_at(F.lit(table.tolist()), ((rank(F.col("kind")) - 1) * width + at + 1).cast("int"))
    f, below, first = weight(F.lit(0)), CODES, 1
    for values in FEATURES.values():
        below //= values
        f = f + weight(first + F.floor(F.col("code") / below) % values)
        first += values
    return F.when(F.col("kind").isin(*weights), 1 / (1 + F.exp(-f))).otherwise(score) if weights else score


def spans(docs: DataFrame) -> DataFrame:
    """(text_key, kind, start, stop, base): base spans and those that the classifier adds; docs: (text)."""
    votes = written(judged(proposals(docs)))
    return votes.filter(F.col("base") | (probability(fit(votes)) >= ACCEPT)).select("text_key", "kind", "start", "stop", "base")


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def examine(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ``spans``: all spans in order as structs (start, rank, kind, stop, base)."""
    found = spans(docs.select("text")).select("text_key", F.struct("start", rank(F.col("kind")).alias("rank"), "kind", "stop", "base").alias("s"))
    found = written(found.groupBy("text_key").agg(F.array_sort(F.collect_list("s")).alias("spans")))
    kind = dict(found.dtypes)["spans"]
    keyed = written(docs.select("doc_id", F.md5("text").alias("text_key")))
    return attach_shuffled(keyed, found, "text_key", F.col("doc_id")).select("doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in ``text`` replaced by its kind in angle brackets; all columns are kept. Overlapping spans become one."""
    order = Window.partitionBy("text_key").orderBy("start", rank(F.col("kind")))
    past = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = spans(docs.select("text")).withColumn("past", past)
    cuts = written(cuts.groupBy("text_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("past"), F.struct("start", "past", "kind")))).alias("cuts"), F.max("stop").alias("last")
    ))
    text, last = F.col("row.text"), F.col("last").cast("int")
    piece = lambda c: F.concat(F.substring(text, c["past"].cast("int") + 1, (c["start"] - c["past"]).cast("int")), F.lit("<"), F.upper(c["kind"]), F.lit(">"))
    cut = F.concat(F.array_join(F.transform("cuts", piece), ""), F.substring(text, last + 1, F.length(text)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5("text").alias("text_key"))
    joined = attach(rows, cuts, "text_key", F.struct(F.lit(0), *[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]))
    return joined.select(*[F.when(F.col("cuts").isNull(), text).otherwise(cut).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
