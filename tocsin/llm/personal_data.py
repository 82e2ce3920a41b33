"""Personal data: fixed patterns, and secrets found by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone). Beside them, mixed strings of letters and digits are
candidates for secrets. Four labelers vote on each: a pattern of the string, a gazetteer of credential names before
it, the signs around it, and how its letters and digits change. Expectation-maximisation over the vote patterns of all
candidates estimates how reliable each labeler is; the posteriors then weigh every candidate in the training of a
naive Bayes span classifier on features of string and context, and spans above a probability are added.

All work on texts is in Spark's own functions. What comes to the driver is one number for each vote pattern (3^4 at
most) and for each feature value (under a hundred).
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import text_or_empty, written

#: Fixed values of the contract. Look-behinds and \G keep to leftmost matches without trying every place of a long run
#: again; possessive loops neither backtrack nor recurse, so a text of any length is read in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = "secret"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+"

#: Names that stand before credentials.
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "key")

LEAST_PROBABILITY = 0.9
ROUNDS = 40
_SPAN = "array<struct<start:int,stop:int,found:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Start, end and text of every match. The pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(seen: Column, x: Column) -> Column:
        start = seen["at"] + x["gap"]
        stop = start + F.length(x["found"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["found"].alias("found"))
        return F.struct(stop.alias("at"), F.concat(seen["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(
        F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))),
        found,
        lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("found")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(pairs, start, step, lambda seen: seen["out"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    values = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), worth)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _between(value: Column, low: int, high: int) -> Column:
    return (value >= low) & (value <= high)


_VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: ~F.exists(F.split(s["found"], "[.]"), lambda p: ~p.rlike("^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda s: F.when(_between(F.length(_digits(s["found"])), 12, 19), _luhn(_digits(s["found"]))).otherwise(False),
    "phone": lambda s: _between(F.length(_digits(s["found"])), 9, 15),
}
#: What a text must hold for a pattern to be tried.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def base_spans(text: Column, kind: str) -> Column:
    spans = F.filter(_matches(text, PATTERNS[kind]), _VALID[kind])
    hint = text.rlike("[0-9]") if kind != "email" else F.lit(True)
    if _HINT[kind]:
        hint = hint & text.contains(_HINT[kind])
    return F.when(hint, spans).otherwise(F.array().cast(_SPAN))


def _candidates(text: Column) -> Column:
    """Candidate strings with votes (1 for, 0 against, null none) and features."""

    def judged(s: Column) -> Column:
        found, size = s["found"], F.length(s["found"])
        before = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
        after = F.substring(text, s["stop"] + 1, F.lit(1))
        lead = F.lower(F.regexp_extract(before, r"([A-Za-z_-]+)[\x20\x09:=\"']*$", 1))
        sign = F.when(before.rlike(r"[=:][\x20]?[\"']?$"), "assigned").when(before.rlike(r"[\"'(]$"), "quoted").otherwise(
            F.when(before.rlike(r"(?:^|[\x20\x09-\x0D])$"), "prose").otherwise("joined")
        )
        changes = size - F.length(F.regexp_replace(found, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "")) + F.size(
            F.split(found, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", -1)
        ) - 1
        named = lead.isin(*NAMES)
        hexed = found.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
        shaped = found.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{16,}|[A-Za-z0-9+/_-]{20,})$")
        votes = F.struct(
            F.when(shaped, 1).when(size < 16, 0).alias("shape"),
            F.when(named, 1).alias("name"),
            F.when(sign.isin("assigned", "quoted"), 1).when(sign == "prose", 0).alias("sign"),
            F.when(changes >= 4, 1).when(changes <= 1, 0).alias("changes"),
        )
        features = F.array(
            F.concat(F.lit("size:"), F.least(F.floor(size / 4), F.lit(12)).cast("string")),
            F.concat(F.lit("kind:"), F.when(hexed, "hex").when(found.rlike("^[A-Z0-9]+$"), "upper").otherwise("other")),
            F.concat(F.lit("named:"), named.cast("string")),
            F.concat(F.lit("sign:"), sign),
            F.concat(F.lit("changes:"), F.least(changes, F.lit(10)).cast("string")),
            F.concat(F.lit("after:"), F.when(after == "", "end").when(after.rlike(r"[\x20\x09-\x0D]"), "white").when(after.rlike("[\"']"), "quote").otherwise("other")),
        )
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), votes.alias("votes"), features.alias("features"))

    return F.transform(_matches(text, CANDIDATE), judged)


def _apart(candidates: Column, spans: Column) -> Column:
    """Candidates that overlap no base span."""
    return F.filter(
        candidates, lambda c: ~F.exists(spans, lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))
    )


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Posterior probability of each vote pattern by expectation-maximisation.

    patterns: votes and number of candidates. Each labeler has a rate of voting for, against and not at all in either
    class; all start from the majority and a light count keeps the rates off 0 and 1.
    """
    if not patterns:
        return {}
    labelers = range(len(patterns[0][0]))
    posterior = {}
    for votes, _ in patterns:
        cast = [v for v in votes if v is not None]
        posterior[votes] = (1 + 2 * sum(cast)) / (2 + 2 * len(cast))
    for _ in range(rounds):
        sums = {c: 1.0 + sum(k * (p if c else 1 - p) for votes, k in patterns for p in [posterior[votes]]) for c in (0, 1)}
        rates = {
            (c, i, v): (1 / 3 + sum(k * (posterior[w] if c else 1 - posterior[w]) for w, k in patterns if w[i] == v)) / sums[c]
            for c in (0, 1)
            for i in labelers
            for v in (None, 0, 1)
        }
        total = sums[0] + sums[1]
        for votes, _ in patterns:
            score = {c: log(sums[c] / total) + sum(log(rates[c, i, v]) for i, v in enumerate(votes)) for c in (0, 1)}
            posterior[votes] = 1 / (1 + exp(min(700.0, score[0] - score[1])))
    return posterior


def train(rows: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the features and the bias of the span classifier, from all candidates."""
    names = ("shape", "name", "sign", "changes")
    each = rows.select(F.explode("candidates").alias("c")).select(*(F.col(f"c.votes.{n}").alias(n) for n in names), "c.features")
    counted = each.groupBy(*names).count().collect()
    patterns = [(tuple(row[n] for n in names), row["count"]) for row in counted]
    patterns.sort(key=lambda p: tuple(-1 if v is None else v for v in p[0]))
    posterior = estimate(patterns)
    if not posterior:
        return {}, 0.0
    chance = F.lit(None).cast("double")
    for votes, p in posterior.items():
        same = F.lit(True)
        for name, vote in zip(names, votes):
            same = same & F.col(name).eqNullSafe(F.lit(vote).cast("int"))
        chance = F.when(same, F.lit(p)).otherwise(chance)
    weighed = each.withColumn("p", chance).select("p", F.explode("features").alias("feature"))
    sums = weighed.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes = sum(k * posterior[votes] for votes, k in patterns)
    no = sum(k * (1 - posterior[votes]) for votes, k in patterns)
    weights = {row["feature"]: log((row["yes"] + 1) / (yes + 2)) - log((row["no"] + 1) / (no + 2)) for row in sums}
    return weights, log((yes + 1) / (no + 1))


def _joined(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(parts, ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_spans (all of them), base_sha256, spans of every row.

    Null counts as empty: no spans, and the digest of nothing. Texts are read whole. Spans of different kinds may
    overlap; at equal starts they come in the order of the kinds. Repeated rows get equal results. Other columns are
    not read. An empty table gives no rows, and without candidates nothing is added.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", *(base_spans(text, kind).alias(kind) for kind in KINDS))

    def named(kind: str) -> Column:
        order = KINDS.index(kind)
        return F.transform(
            kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), F.lit(kind).alias("kind"))
        )

    base = F.array_sort(F.concat(*(named(kind) for kind in KINDS)))
    candidates = F.when(text.rlike("[0-9]"), _candidates(text))
    rows = rows.select("doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS), base.alias("base"), candidates.alias("found"))
    rows = rows.withColumn("candidates", F.coalesce(_apart(F.col("found"), F.col("base")), F.expr("filter(found, x -> false)"))).drop("found")
    rows = written(rows, "spans")
    weights, bias = train(rows)
    if weights:
        table = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair))
        worth = lambda c: F.aggregate(c["features"], F.lit(bias), lambda a, f: a + F.coalesce(table[f], F.lit(0.0)))
        limit = log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY))
        added = F.filter("candidates", lambda c: worth(c) >= limit)
    else:
        added = F.filter("candidates", lambda c: F.lit(False))
    added = F.transform(
        F.coalesce(added, F.expr("filter(candidates, x -> false)")),
        lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("order"), c["stop"].alias("stop"), F.lit(SECRET).alias("kind")),
    )
    empty = F.expr("filter(base, x -> false)")
    added = F.coalesce(added, empty)
    return rows.select(
        "doc_id",
        *(f"n_{kind}" for kind in KINDS),
        F.size(added).cast("long").alias("n_secret"),
        (F.size("base") + F.size(added)).cast("long").alias("n_spans"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", added))).alias("spans"),
    )
