"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stand. Beside them, wide
patterns propose candidates that the base misses, and much that only looks alike: emails
whose at sign or dots are written out, numbers in groups without a plus sign, dotted numbers, long numbers that fail
the card check, and key-like strings (kind ``secret``). So both classes are seen. Labelers vote on every span, base spans included: regex
labelers on its form and its parts, gazetteer labelers on known names, prefixes and codes inside it, context labelers on the words
and signs before it. Expectation-maximisation over the counts of vote patterns, a few
hundred of each kind at most however large the corpus, estimates how reliable each labeler is. Its
posteriors, as soft labels over all spans, train a naive Bayes span classifier on span features.
Candidates that the classifier accepts are added where they don't overlap a base span; one whose form is
denied (a number that fails the card check) also needs a word that announces it.

Each text is scanned once, into its matches and the gaps between them; running sums over matches place them, so the
work is linear in a text however many matches it holds, and only matches are shuffled.

Defined results: null texts count as empty and have no spans. Offsets are code points, end
exclusive. Very long texts are scanned whole. Repeated rows are judged one by one. Equal starts follow the order of kinds. A candidate that begins
inside an earlier accepted one is dropped. With no
spans in the corpus nothing is added. An empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
# Possessive forms of the contract's patterns. A run that fails from its first character fails from
# all others, so matches start where a run does, or where the match before ended. Runs of digits too
# short or too long for a card would fail the check on their number of digits and are not matched.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Wide candidates: what they may be, and how they look.
LOOSE_PHONE = r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\)[\x20]?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,3}+(?![0-9A-Za-z/-])"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:[\[(]at[\])]|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}){1,4}"
LOOSE_IP = r"(?<![0-9A-Za-z.])[0-9]{1,9}(?:\.[0-9]{1,9}){2,5}+(?![0-9])"
LOOSE_CARD = r"(?<![0-9A-Za-z.,])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![0-9A-Za-z]|[\x20-][0-9])"
LOOSE_SECRET = r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{20,128}+(?![0-9A-Za-z_-])"
#: Kind, whether base, pattern, and what a text must hold to be worth a scan.
STREAMS = (
    ("email", True, EMAIL, "@"),
    ("ip", True, IP, r"[0-9]\.[0-9]"),
    ("card", True, CARD, "[0-9]"),
    ("phone", True, PHONE, r"\+[0-9]"),
    ("email", False, LOOSE_EMAIL, r"[\[( ]at[\]) ]"),
    ("ip", False, LOOSE_IP, r"[0-9]\.[0-9]"),
    ("card", False, LOOSE_CARD, "[0-9]"),
    ("phone", False, LOOSE_PHONE, "[0-9]"),
    ("secret", False, LOOSE_SECRET, "[0-9]"),
)
#: Characters before a span that the context labelers read.
CONTEXT = 40
# fixed values: words that announce each kind, and words that deny it
ANNOUNCE = {
    "email": "mail|e-mail|email|contact|write|address|correo|courriel|kontakt",
    "ip": "ip|address|host|server|client|login|addr",
    "card": "card|visa|mastercard|amex|credit|debit|account|karte|tarjeta|carte",
    "phone": "phone|mobile|cell|call|tel|telephone|fax|contact|telefon|handy|anruf|teléfono|téléphone|portable|whatsapp",
    "secret": "token|key|secret|password|passwd|pwd|api|auth|bearer|credential|credentials",
}
DENY = {
    "email": "look|looking|stay|meet|arrived",
    "ip": "version|v|release|section|rev|build|chapter|figure|firmware|update",
    "card": "isbn|order|serial|tracking|item|invoice|number of|id|part|reference",
    "phone": "version|isbn|issn|chapter|section|figure|table|page|rev|build|part|order|item|serial|date|price|total|id|since|between|from|until",
    "secret": "sha|sha1|sha256|md5|commit|checksum|digest|hash|uuid|file|path|url|version",
}
# fixed values: top-level names; prefixes of card issuers; area codes never given out; country codes; prefixes of service keys
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|name|io|ai|app|dev|me|tv|at|au|be|br|ca|ch|cn|cz|de|dk|es|eu|fi|fr|gr|hu|ie|il|in|it|jp|kr|mx|nl|no|nz|pl|pt|ro|ru|se|tr|ua|uk|us|za"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|64[4-9]|65|62"
NEVER_GIVEN = "000|666|911"
COUNTRIES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[013]"
KEY_PREFIXES = "sk_|pk_|ghp_|gho_|xoxb-|xoxp-|AKIA|AIza|glpat-"
EM_ROUNDS = 50
ACCEPT = 0.5
#: Pseudo-spans of each class of the classifier.
SMOOTHING = 8.0
#: Spans of a kind at which its classifier and the bare vote count alike.
UNTRUSTED = 200


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)
    value = lambda i: F.substring(number, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def is_card(match: Column) -> Column:
    number = digits(match)
    return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)


def is_phone(match: Column) -> Column:
    return F.length(digits(match)).between(10, 15)


def is_ip(match: Column) -> Column:
    return F.rlike(match, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))


PIECE = "array<struct<stream:int,skip:int,tail:string,match:string>>"


def pieces(text: Column, stream: int, pattern: str, worth: str) -> Column:
    """All matches of a pattern, each with the length and the end of the gap before it."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("skip"), F.right(g, F.lit(CONTEXT)).alias("tail")))
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    made = F.transform(
        F.filter(found, lambda p: p["match"].isNotNull()),
        lambda p: F.struct(F.lit(stream).alias("stream"), p["gap"]["skip"].alias("skip"), p["gap"]["tail"].alias("tail"), p["match"].alias("match")),
    )
    there = F.contains(text, F.lit(worth)) if worth == "@" else F.rlike(text, F.lit(worth))
    return F.when(there, made).otherwise(F.array()).cast(PIECE)


def found_in(docs: DataFrame) -> DataFrame:
    """rid, doc_id and found (the matches of all patterns) of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    every = F.concat(*[pieces(text, i, pattern, worth) for i, (_, _, pattern, worth) in enumerate(STREAMS)])
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", every.alias("found"))


def spans_of(found: DataFrame) -> DataFrame:
    """rid, start, end, kind (its number), base, match and tail of all base spans and of the candidates that overlap none."""
    matches = found.select("rid", F.posexplode("found").alias("pos", "m")).select("rid", "pos", "m.*")
    upto = F.sum(F.col("skip") + F.length("match")).over(Window.partitionBy("rid", "stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kind = F.element_at(F.array(*[F.lit(KINDS.index(k)) for k, _, _, _ in STREAMS]), F.col("stream") + 1)
    of_base = F.col("stream") < len(BASE)
    valid = (
        F.when(F.col("stream") == KINDS.index("ip"), is_ip(F.col("match")))
        .when(F.col("stream") == KINDS.index("card"), is_card(F.col("match")))
        .when(F.col("stream") == KINDS.index("phone"), is_phone(F.col("match")))
        .otherwise(True)
    )
    placed = matches.select(
        "rid", (upto - F.length("match")).cast("int").alias("start"), upto.cast("int").alias("end"), kind.alias("kind"), of_base.alias("base"), "match", "tail", valid.alias("valid")
    ).where(F.col("valid") | ~F.col("base"))
    order = ["start", F.col("base").desc(), "kind", "end"]
    before = Window.partitionBy("rid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("base"), F.col("kind").desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("base")
    near = placed.withColumn("ended", F.max(F.when(known, F.col("end"))).over(before)).withColumn("next", F.min(F.when(known, F.col("start"))).over(behind))
    free = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return near.where(known | free).drop("ended", "next", "valid")


def _vote(yes: Column, no: Column) -> Column:
    """1 for, -1 against, 0 without an opinion."""
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _by_kind(of: dict[str, Column]) -> Column:
    out = F.when(F.col("kind") == KINDS.index(KINDS[0]), of[KINDS[0]])
    for k in KINDS[1:]:
        out = out.when(F.col("kind") == KINDS.index(k), of[k])
    return out


def _said(words: str) -> Column:
    """Whether one of the words is the last but signs and one further word before the span."""
    return F.rlike(F.lower("tail"), F.lit(rf"(?<![\p{{L}}])(?:{words})[\p{{L}}]{{0,2}}[^\p{{L}}]*(?:[\p{{L}}]{{1,8}}[^\p{{L}}]*)?$"))


def with_votes(spans: DataFrame) -> DataFrame:
    """Adds votes (one of each labeler) and features."""
    match, low = F.col("match"), F.lower("match")
    number = digits(match)
    n = F.length(number)
    like = lambda text, pattern: F.rlike(text, F.lit(pattern))
    luhn_ok = F.when(n.between(12, 19), luhn(number)).otherwise(False)
    year = like(match, r"^(?:19|20)[0-9]{2}[ ./-]|[ ./-](?:19|20)[0-9]{2}$")
    form = _by_kind({
        "email": _vote(like(low, r"@|[\[(]at[\])]"), like(low, r" at .*[^a-z0-9.-]")),
        "ip": _vote(is_ip(match), ~is_ip(match)),
        "card": _vote(luhn_ok, ~luhn_ok),
        "phone": _vote(n.between(9, 15) & ~year, (n < 8) | year),
        "secret": _vote(like(match, r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9]).*)$"), like(match, r"^(?:[a-z]+|[A-Z]+|[0-9]+)(?:[-_](?:[a-z]+|[A-Z]+|[0-9]+))+$")),
    })
    parts = _by_kind({
        "email": _vote(like(match, r"^[A-Za-z0-9][A-Za-z0-9._%+-]*[A-Za-z0-9]?[ @\[(]"), like(match, r"^[^A-Za-z0-9]|\.\.")),
        "ip": _vote(like(match, r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), ~like(match, r"^(?:[0-9]+\.){3}[0-9]+$")),
        "card": _vote(like(match, r"^(?:[0-9]{14,16}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), like(match, r"^[0-9]{1,3}[ -]|[ -][0-9]{1,2}[ -]")),
        "phone": _vote(like(match, r"^[+(]|[0-9]{3}[ .-][0-9]{4}$"), like(match, r"^[0-9]{1,2}[./][0-9]{1,2}[./]|/")),
        "secret": _vote(F.length(match).isin(32, 36, 40, 64) | (F.length(match) >= 24) & ~like(match, "[-_]"), like(match, "[-_].*[-_].*[-_]")),
    })
    known = _by_kind({
        "email": _vote(like(low, rf"(?:\.|dot[\])]? ?)(?:{TOP_LEVEL})$"), ~like(low, rf"(?:\.|dot[\])]? ?)(?:{TOP_LEVEL})$")),
        "ip": _vote(~like(match, r"^(?:0|1?[0-9])\.[0-9]{1,2}\.[0-9]{1,2}(?:\.[0-9]{1,2})?$"), like(match, r"^(?:0|1?[0-9])\.[0-9]{1,2}\.[0-9]{1,2}(?:\.[0-9]{1,2})?$")),
        "card": _vote(like(number, f"^(?:{ISSUERS})"), ~like(number, f"^(?:{ISSUERS})")),
        "phone": _vote(~like(match, rf"(?:^|[^0-9])(?:{NEVER_GIVEN})[ .)-]") & (~like(match, r"^\+") | like(number, f"^(?:{COUNTRIES})")), like(match, rf"(?:^|[^0-9])(?:{NEVER_GIVEN})[ .)-]|^\+0")),
        "secret": _vote(like(match, f"^(?:{KEY_PREFIXES})"), F.lit(False)),
    })
    told = _by_kind({k: _vote(_said(ANNOUNCE[k]), _said(DENY[k])) for k in KINDS})
    around = _vote(like(F.col("tail"), r"[\p{L},.:;]\s$|^$|\n$|[:=]\s?[\"']$"), like(F.col("tail"), r"[0-9=$€£#%/]\s?$|[-_/.]$"))
    votes = F.array(form, parts, known, told, around)
    feature = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"))
    features = F.array(
        feature("digits", F.least(n, F.lit(20))),
        feature("long", F.least(F.floor(F.length(match) / 4), F.lit(12))),
        feature("parts", F.least(F.size(F.split(match, "[^0-9A-Za-z]+")), F.lit(8))),
        feature("plus", like(match, r"^\+")),
        feature("round", F.contains(match, F.lit("("))),
        feature("ends4", like(match, "[^0-9][0-9]{4}$")),
        feature("year", year),
        feature("slash", F.contains(match, F.lit("/"))),
        feature("check", luhn_ok),
        feature("octets", is_ip(match)),
        feature("sign", F.contains(match, F.lit("@"))),
        feature("told", told),
        feature("ending", F.when(F.col("kind") == KINDS.index("email"), like(low, rf"(?:{TOP_LEVEL})$")).otherwise(False)),
    )
    return spans.withColumn("votes", votes).withColumn("features", features)


#: Labelers, and the place of the one that reads announcing words.
VOTERS, TOLD = 5, 3


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """The posterior of each vote pattern, from counts, by EM over independent voters.

    A voter that has no opinion says nothing. Reliability starts at 0.8 and counts are smoothed, so no
    voter becomes infallible.
    """
    voters = range(VOTERS)
    total = sum(patterns.values())
    hit = {(v, y, x): (0.8 if x == y else 0.2) for v, y, x in product(voters, (1, -1), (1, -1))}
    prior, posterior = 0.5, {}
    for _ in range(rounds if total else 0):
        for pattern in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for v in voters:
                if pattern[v]:
                    yes += math.log(hit[v, 1, pattern[v]])
                    no += math.log(hit[v, -1, pattern[v]])
            posterior[pattern] = 1 / (1 + math.exp(min(700, no - yes)))
        prior = (1 + sum(n * posterior[p] for p, n in patterns.items())) / (2 + total)
        for v, y in product(voters, (1, -1)):
            weight = {x: sum(n * (posterior[p] if y == 1 else 1 - posterior[p]) for p, n in patterns.items() if p[v] == x) for x in (1, -1)}
            agree, against = weight[y] + 8, weight[-y] + 2
            hit[v, y, y], hit[v, y, -y] = agree / (agree + against), against / (agree + against)
    return posterior


#: By kind: how far the classifier is trusted against the bare vote, its prior log-odds, and the weight of each feature value.
Classifier = dict[int, tuple[float, float, dict[str, float]]]


def train(spans: DataFrame) -> Classifier:
    """spans: kind, base, votes and features, one row a span.

    The prior comes from candidates alone, so base spans of a kind don't vote its candidates in. The driver gets the counts of vote
    patterns (3 ** VOTERS of a kind at most) and of feature values by pattern.
    """
    counted = spans.groupBy("kind", "base", "votes").count().collect()
    seen = spans.select("kind", "votes", F.explode("features").alias("feature")).groupBy("kind", "votes", "feature").count().collect()
    out: Classifier = {}
    for kind in sorted({r["kind"] for r in counted}):
        patterns: dict[tuple[int, ...], int] = {}
        for r in counted:
            if r["kind"] == kind:
                patterns[tuple(r["votes"])] = patterns.get(tuple(r["votes"]), 0) + r["count"]
        posterior = reliabilities(patterns)
        total = sum(patterns.values())
        yes = sum(n * posterior[p] for p, n in patterns.items())
        no = total - yes
        proposed = {y: sum(r["count"] * (posterior[tuple(r["votes"])] if y else 1 - posterior[tuple(r["votes"])]) for r in counted if r["kind"] == kind and not r["base"]) for y in (True, False)}
        sums: dict[str, list[float]] = {}
        for r in sorted((r for r in seen if r["kind"] == kind), key=lambda r: (r["feature"], tuple(r["votes"]))):
            p = posterior[tuple(r["votes"])]
            pair = sums.setdefault(r["feature"], [0.0, 0.0])
            pair[0] += r["count"] * p
            pair[1] += r["count"] * (1 - p)
        # each class is smoothed towards the feature's share in all spans, so a class with few spans says little
        weights = {}
        for f, (a, b) in sums.items():
            share = SMOOTHING * (a + b) / (yes + no)
            weights[f] = math.log((a + share) / (yes + SMOOTHING)) - math.log((b + share) / (no + SMOOTHING))
        trust = total / (total + UNTRUSTED)
        out[kind] = trust, math.log((proposed[True] + 1) / (proposed[False] + 1)), weights
    return out


def _logit(prior: float, weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return F.aggregate("features", F.lit(float(prior)), lambda acc, f: acc + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))


def accepted(classifier: Classifier) -> Column:
    """Whether a span is taken, from its columns kind, votes and features.

    A span whose form is denied, such as a number that fails the card check, is taken only where a word announces it. Otherwise the classifier
    decides, and the bare vote at its starting reliability as far as a kind has few spans to learn from.
    """
    voted = math.log(0.8 / 0.2) * F.aggregate("votes", F.lit(0), lambda acc, v: acc + v)
    logit = F.lit(None).cast("double")
    for kind, (trust, prior, weights) in sorted(classifier.items()):
        logit = F.when(F.col("kind") == kind, trust * _logit(prior, weights) + (1 - trust) * voted).otherwise(logit)
    possible = (F.col("votes")[0] >= 0) | (F.col("votes")[TOLD] > 0)
    return possible & F.coalesce(logit > math.log(ACCEPT / (1 - ACCEPT)), F.lit(False))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(said, ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    found = staged(found_in(docs), "pii-found")
    spans = staged(with_votes(spans_of(found)).drop("match", "tail"), "pii-spans")
    taken = spans.where(F.col("base") | accepted(train(spans.select("kind", "base", "votes", "features"))))
    earlier = Window.partitionBy("rid").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.when(~F.col("base"), F.col("end"))).over(earlier) > F.col("start"), F.lit(False))
    taken = taken.withColumn("inside", inside).where(F.col("base") | ~F.col("inside"))
    lists = taken.groupBy(F.col("rid").alias("s_rid")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("every"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")
    rows = found.select("rid", "doc_id").join(lists, F.col("rid") == F.col("s_rid"), "left").withColumn("every", F.coalesce("every", none))
    base = F.filter("every", lambda s: s["base"])
    count = lambda k: F.size(F.filter("every", lambda s: s["base"] & (s["kind"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("every")).alias("spans"))


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))
