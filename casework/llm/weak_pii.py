"""Personal data by weak supervision.

Base spans come from fixed patterns and always stay. Further candidates
(secrets, national ids, account numbers, local telephone numbers) get votes from four
labelers: a strict shape (digits and letters in a secret, check digits of an account),
lists (placeholder words, void numbers, account lengths by country, area codes), cue words in
the 40 characters before the span (context) and its edges. Votes are counted by kind and
pattern of votes, a table whose size the labelers bound. For each kind,
expectation-maximisation over those counts estimates how reliable each labeler
is for either class, starting from and weighed against ``PRIOR`` spans on which a labeler that
speaks is right three times in four, so that a kind with few candidates goes by its votes. A
logistic regression, trained on the estimated probabilities of all patterns, is the final
classifier, a column expression that decides about the further candidates. Base spans,
which are certain, take no part in the training.

Everything over documents is column expressions: a match's place is the
running length of the pieces that split() leaves plus the matches before.

A null text is empty; texts without spans give empty strings and the digest of
the empty string. Rows that repeat are searched each, and an empty table gives an empty
result. Further candidates that touch a base span are dropped. Only the id and the
text are read, so names cannot clash; a null id is carried along.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import id_and_text, written

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "national_id", "account", "local_phone")
KINDS = BASE + EXTRA
LABELERS = ("shape", "listed", "context", "edges")

# The base patterns, written so that each start is tried once: a run of word
# characters is entered at its beginning (or where the last match ended), and
# nothing is given back that could not match anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}+",
    # The longest run of digits with single separators, of 13 to 19 digits.
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}

# A secret has no greatest length: the possessive run ends where its characters
# do, with the padding of Base64. The key may be quoted, as in JSON.
_SECRET = (r"(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?+[\x20\t]{0,3}+[=:][\x20\t]{0,3}+"
           r"[\"']?+[A-Za-z0-9_/+.-]{6,}+={0,2}+[\"']?+")
_KEY = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
SUB = {
    "secret": rf"(?i:(?<![A-Za-z0-9]){_SECRET})|(?<![A-Za-z0-9])(?:{_KEY})",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
PATTERNS["extra"] = "|".join(SUB[k] for k in EXTRA)

# Lists (fixed values).
DOMAINS = "com org net edu gov info io co de fr es uk eu ch at nl it".split()
CUES = {
    "email": "mail email contact write reach".split(), "ip": "ip host server address login".split(),
    "card": "card visa credit pay payment".split(), "phone": "phone tel call mobile fax".split(),
    "secret": "password key secret token credentials login".split(), "national_id": "ssn social security id".split(),
    "account": "iban account bank transfer".split(), "local_phone": "phone tel call mobile fax".split(),
}
AGAINST = ("version release section figure isbn order page chapter build table total sum amount "
           "ref reference invoice serial sku part model").split()
#: Words that stand where a secret would.
PLACEHOLDERS = ("required please something identifier optional example placeholder changeme changeit none null true false string "
                "text value secret password passwd token username hidden redacted unknown default undefined missing invalid incorrect expired "
                "forgotten protected reset authentication authorization generator manager parameter argument").split()
#: Numbers that were never issued or are void.
VOID_IDS = ("078-05-1120 219-09-9999 457-55-5462 123-45-6789 987-65-4321 111-11-1111 222-22-2222 333-33-3333 444-44-4444 "
            "555-55-5555 777-77-7777 888-88-8888").split()
#: Area codes: three digits without 9 in the middle; service, reserved and business codes excepted.
AREA = "^(?!.11|37|96|555|800|822|833|844|855|866|877|888|900)[2-9][0-8][0-9]"
#: Lengths of account numbers by country.
ACCOUNT_LENGTHS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 "
    "FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 "
    "LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 "
    "SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())

SPAN = "struct<kind: int, start: int, end: int, shape: int, listed: int, context: int, edges: int>"
#: Matches whose places are summed in one go; see :func:`_located`.
RUN = 512


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(turned, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _checked(account: Column) -> Column:
    """The check digits of an account number (modulo 97) are right."""
    letters = F.filter(F.split(F.concat(F.substring(account, F.lit(5), F.length(account)), F.left(account, F.lit(4))), ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        return F.when(c <= "9", rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(letters, F.lit(0), step) == 1


def _value(secret: Column) -> Column:
    """What follows the key of a secret, or all of it where there is no key."""
    return F.regexp_replace(secret, "^[^=:]*[=:][\\x20\\t]*[\"']*", "")


def _holds(kind: str, match: Column) -> Column:
    """What a base match must meet besides its pattern."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(part(p).cast("int") <= 255))
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _located(pieces: Column, matches: Column) -> Column:
    """start, end, match, before, after of each match.

    Places are summed over runs of ``RUN`` matches, then within each run, so a
    text with very many matches does not take quadratic time.
    """
    n = F.size(matches)
    left = F.zip_with(F.slice(pieces, F.lit(1), n), matches, lambda p, m: F.struct(
        F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("match"), F.right(p, F.lit(40)).alias("before")))
    items = F.zip_with(left, F.slice(pieces, F.lit(2), n), lambda x, p: F.struct(
        x["gap"].alias("gap"), x["len"].alias("len"), x["match"].alias("match"), x["before"].alias("before"), F.left(p, F.lit(1)).alias("after")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda b: F.slice(items, b * RUN + 1, F.lit(RUN)))
    # Each run carries its items, its length, and below the place where it starts.
    runs = F.transform(runs, lambda r: F.struct(r.alias("items"), F.aggregate(r, F.lit(0), lambda a, x: a + x["gap"] + x["len"]).alias("sum")))
    empty = "cast(array() as array<struct<at: int, items: array<struct<gap: int, len: int, match: string, before: string, after: string>>>>)"
    placed = F.aggregate(
        runs, F.struct(F.lit(0).alias("at"), F.expr(empty).alias("out")),
        lambda a, r: F.struct((a["at"] + r["sum"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), r["items"].alias("items")))).alias("out")),
        lambda a: a["out"])
    out = "cast(array() as array<struct<start: int, end: int, match: string, before: string, after: string>>)"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((start + x["len"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return F.flatten(F.transform(placed, lambda r: F.aggregate(r["items"], F.struct(r["at"].alias("at"), F.expr(out).alias("out")), step, lambda a: a["out"])))


def _shape(kind: str, m: Column) -> Column:
    digits = F.length(_digits(m))
    if kind == "email":
        return _vote(m.rlike(r"^[A-Za-z0-9][^@]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}$"), m.rlike(r"\.\.|^[.%+-]"))
    if kind == "ip":
        return _vote(~m.rlike(r"(^|\.)0[0-9]"), m.rlike("^0"))
    if kind == "card":
        return _vote(digits.isin(15, 16), F.length(m) > digits + 4)
    if kind in ("phone", "local_phone"):
        good = digits.between(10, 13) if kind == "phone" else _digits(m).rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
        return _vote(good, ~good)
    if kind == "secret":
        return _vote(_value(m).rlike("[0-9]") & _value(m).rlike("[A-Za-z]"), ~_value(m).rlike("[0-9]"))
    if kind == "national_id":
        return _vote(~m.rlike("^(000|666|9)|-00-|-0000$"), m.rlike("^(000|666|9)|-00-|-0000$"))
    good = _checked(F.regexp_replace(m, " ", ""))
    return _vote(good, ~good)


def _listed(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.element_at(F.split(m, r"\."), -1)).isin(DOMAINS))
    if kind == "ip":
        return _vote(~m.rlike(r"^(0|127|255)\."), m.rlike(r"^(0|255)\."))
    if kind == "card":
        return _vote(m.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65)"), m.rlike("^0"))
    if kind == "secret":
        return _vote(_value(m).rlike("^(AKIA|ASIA|ghp_)"), F.lower(F.regexp_extract(_value(m), "^[A-Za-z]*", 0)).isin(PLACEHOLDERS))
    if kind == "national_id":
        return _vote(F.lit(False), m.isin(VOID_IDS))
    if kind == "account":
        lengths = F.create_map(*[F.lit(x) for item in ACCOUNT_LENGTHS.items() for x in item])
        good = F.coalesce(lengths[F.left(m, F.lit(2))].cast("int") == F.length(F.regexp_replace(m, " ", "")), F.lit(False))
        return _vote(F.lit(False), ~good)  # a right length says little
    if kind == "local_phone":
        return _vote(_digits(m).rlike(AREA), ~_digits(m).rlike(AREA))
    return _vote(m.rlike(r"^\+?\(?[1-9]"), m.rlike(r"^\+?\(?0"))


def _span(kind: str, x: Column) -> Column:
    before = F.lower(x["before"])
    cue = before.rlike(rf"\b({'|'.join(CUES[kind])})\b")
    edges = (x["before"].rlike(r"(^|[\x20\t\n\r(\"'<:;,=])$")) & x["after"].rlike(r"^($|[\x20\t\n\r)\"'>:;,.!?])")
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _shape(kind, x["match"]).alias("shape"),
                    _listed(kind, x["match"]).alias("listed"), _vote(cue, before.rlike(rf"\b({'|'.join(AGAINST)})\b")).alias("context"),
                    _vote(edges, ~edges).alias("edges"))


def candidates(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, base and extra: arrays of spans with votes (and the text)."""
    names = [*BASE, "extra"]
    found = lambda k: F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    tried = lambda k: F.when(F.contains(F.col("text"), F.lit(NEEDED[k])), found(k)).otherwise(none) if k in NEEDED else found(k)
    others = [c for c in docs.columns if c != "text"]
    step = docs.select(*others, "text", *[tried(k).alias(f"__{k}") for k in names])
    step = step.select("*", *[F.when(F.size(f"__{k}") > 0, F.split("text", PATTERNS[k], -1)).alias(f"__{k}_pieces") for k in names])
    spans = lambda k: F.when(F.size(f"__{k}") > 0, _located(F.col(f"__{k}_pieces"), F.col(f"__{k}")))
    step = step.select(*others, "text", *[spans(k).alias(f"__{k}") for k in names])
    empty = F.expr(f"cast(array() as array<{SPAN}>)")

    def rated(k: str) -> Column:
        valid = F.filter(F.col(f"__{k}"), lambda x: _holds(k, x["match"]))
        return F.when(F.col(f"__{k}").isNotNull(), F.transform(valid, lambda x: _span(k, x))).otherwise(empty)

    base = [rated(k) for k in BASE]

    def extra(x: Column) -> Column:
        out = _span(EXTRA[-1], x)
        for k in reversed(EXTRA[:-1]):
            out = F.when(x["match"].rlike(f"^(?:{SUB[k]})$"), _span(k, x)).otherwise(out)
        return out

    step = step.select(*others, "text", F.concat(*base).alias("base"),
                       F.when(F.col("__extra").isNotNull(), F.transform("__extra", extra)).otherwise(empty).alias("extra"))
    apart = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    apart = F.when(F.size("base") == 0, F.col("extra")).when(F.size("extra") == 0, F.col("extra")).otherwise(apart)
    return step.select(*others, *["text"] * keep_text, "base", F.array_sort(apart).alias("extra"))


@dataclass(frozen=True)
class Reliability:
    """P(vote | class) of each labeler, and the share of true spans."""

    share: float
    chances: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]  # [labeler][class][vote + 1]

    def probability(self, votes: tuple[int, ...]) -> float:
        yes, no = math.log(self.share), math.log(1 - self.share)
        for chance, vote in zip(self.chances, votes):
            yes, no = yes + math.log(chance[1][vote + 1]), no + math.log(chance[0][vote + 1])
        return 1 / (1 + math.exp(min(700, no - yes)))


#: Before any data: a labeler that speaks is right three times in four, and votes that balance are not enough.
START = Reliability(0.4, (((0.6, 0.2, 0.2), (0.2, 0.2, 0.6)),) * len(LABELERS))
#: How many spans that assumption counts for.
PRIOR = 20


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 40) -> Reliability:
    """Reliabilities from how often each pattern of votes occurs.

    ``patterns`` has at most 3 ** labelers entries, whatever the corpus.
    """
    model = START
    if not patterns:
        return model
    for _ in range(rounds):
        sums = [[[START.chances[j][c][v] * PRIOR for v in range(3)] for c in range(2)] for j in range(len(LABELERS))]
        yes, total = PRIOR * START.share, PRIOR
        for votes, n in patterns.items():
            p = model.probability(votes)
            yes, total = yes + n * p, total + n
            for j, v in enumerate(votes):
                sums[j][1][v + 1] += n * p
                sums[j][0][v + 1] += n * (1 - p)
        model = Reliability(min(0.99, max(0.01, yes / total)), tuple(
            tuple(tuple(x / sum(of) for x in of) for of in labeler) for labeler in sums))
    return model


def _features(span: Column) -> list[Column]:
    """For each kind of candidate: whether it is that kind, and each labeler's vote against and for."""
    of = [span["kind"] == KINDS.index(k) for k in EXTRA]
    return [F.when(is_kind & test, 1.0).otherwise(0.0) for is_kind in of
            for test in (F.lit(True), *[span[j] == v for j in LABELERS for v in (-1, 1)])]


@dataclass(frozen=True)
class SpanClassifier:
    """Weights in the order of the features."""

    weights: tuple[float, ...]
    intercept: float

    def accepts(self, span: Column) -> Column:
        """A candidate's probability is at least one half."""
        weights = F.array(*[F.lit(w) for w in self.weights])
        first = (span["kind"] - len(BASE)) * (1 + 2 * len(LABELERS)) + 1
        total = F.element_at(weights, first) + self.intercept
        for i, j in enumerate(LABELERS):
            against, speaks_for = (F.element_at(weights, first + 2 * i + k) for k in (1, 2))
            total = total + F.when(span[j] == -1, against).when(span[j] == 1, speaks_for).otherwise(0.0)
        return total >= 0


def vote_patterns(found: DataFrame) -> DataFrame:
    """How often each kind and pattern of votes of candidates occurs: a table of bounded size."""
    spans = found.select(F.explode("extra").alias("span"))
    keys = ["kind", *LABELERS]
    return spans.select(*[F.col(f"span.{k}") for k in keys]).groupBy(*keys).count()


def trained(spark: SparkSession, found: DataFrame) -> SpanClassifier:
    """The span classifier of a corpus; without candidates, that of the assumptions alone."""
    seen: dict[int, dict[tuple[int, ...], int]] = {KINDS.index(k): {} for k in EXTRA}
    for r in vote_patterns(found).collect():  # at most 4 kinds x 81 patterns
        seen[r["kind"]][tuple(r[j] for j in LABELERS)] = r["count"]
    values = []
    for kind, patterns in seen.items():
        model = expectation_maximisation(patterns)
        for votes in product((-1, 0, 1), repeat=len(LABELERS)):
            # Each pattern has a part, so that each weight is defined; many spans weigh more.
            p, weight = model.probability(votes), 1 + math.log1p(patterns.get(votes, 0))
            head = ", ".join(map(str, (kind, *votes)))
            values += [f"({head}, {y}D, {w!r}D)" for y, w in ((1, weight * p), (0, weight * (1 - p)))]
    names = ", ".join(("kind", *LABELERS, "label", "weight"))
    data = spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t({names})").withColumn("span", F.struct("kind", *LABELERS))
    features = [f.alias(f"f{i}") for i, f in enumerate(_features(F.col("span")))]
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(data.select("label", "weight", *features))
    # The probabilities are never 0 or 1, so the weights are finite without a penalty to speak of.
    fit = LogisticRegression(weightCol="weight", regParam=1e-7, maxIter=100, standardization=False).fit(vectors.coalesce(1))
    return SpanClassifier(tuple(float(w) for w in fit.coefficients), float(fit.intercept))


def accepted(classifier: SpanClassifier) -> Column:
    """The extra spans that the classifier accepts."""
    return F.filter("extra", classifier.accepts)


def _written_out(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra of every row."""
    found = written(candidates(id_and_text(docs, id_col, text_col)), "pii-candidates")
    classifier = trained(docs.sparkSession, found)
    rows = found.select("doc_id", "base", accepted(classifier).alias("extra"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
                       F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"),
                       _written_out(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_extra"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a tag such as ``<EMAIL>`` in place of each span.

    Spans that overlap give one tag, that of the first. A null text stays null.
    """
    text = F.col(f"`{text_col}`")
    # Other columns by place, so that no name clashes or needs quoting.
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(text.isNull().alias("absent"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    marked = docs.select(row.alias("__row"), F.coalesce(text, F.lit("")).alias("text"))
    # Searched once: the texts are written with their spans, and read again to be tagged.
    found = written(candidates(marked, keep_text=True), "pii-candidates")
    rows = found.select("__row", "text", F.concat("base", accepted(trained(docs.sparkSession, found))).alias("spans"))
    inner = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def put(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        tagged = F.concat(a["out"], F.array(gap, F.element_at(tags, s["kind"] + 1)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], tagged).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(F.array_sort(inner), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), put,
                        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    clean = F.when(F.col("__row.absent"), None).when(F.size("spans") == 0, F.col("text")).otherwise(clean)
    return rows.select(*[(clean if c == text_col else F.col(f"__row.c{others.index(c)}")).alias(c) for c in docs.columns])
