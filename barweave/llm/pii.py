"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Regexes of the base kinds give spans that always stay.  Wider patterns give
further candidates, written forms that the base patterns miss.  On every
candidate some labelers vote for or against, or abstain: base and wide regexes,
checks of digits, gazetteers of context words, and the shape of what stands
around.  Expectation-maximisation over the table of vote patterns estimates how
reliable each labeler is.  The posteriors are the soft labels of a final
classifier over span features, which needs no votes.  Everything that touches a
document is a Spark SQL expression or aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import id_text, settled

# Base kinds in their order.  Where a run of signs could be tried from each of its places, the pattern
# starts at the run's first sign or where the last match ended, which finds the same matches in one pass; possessive
# loops match what greedy ones would, as nothing behind them needs a sign back.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider written forms.
WIDE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\x20at\x20|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.+])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])|(?<![0-9A-Za-z.+])[0-9]{15}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
KINDS = ("email", "ip", "card", "phone")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
#: Context words by kind; a word within ``CONTEXT`` signs before a span votes for it.
GAZETTEER = {
    "email": "e-mail|email|mail|mailto|contact|correo|courriel|adresse",
    "ip": "ip|ipv6|host|server|addr|address|from",
    "card": "card|visa|amex|mastercard|credit|debit|payment|karte|carte|tarjeta|konto",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|contact|telefon|telefono|rufen",
}
AGAINST = "isbn|issn|version|doi|order|invoice|serial|sku|id|no|ref|token|sha|md5|key|hash"
CONTEXT = 24


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    rev = F.reverse(digits)

    def add(acc, i):
        d = F.substring(rev, i, F.lit(1)).cast("int")
        twice = 2 * d
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    """The base kind's check of a match."""
    digits = _digits(text)
    n = F.length(digits)
    if kind == "ip":
        byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return text.rlike(rf"^{byte}(?:\.{byte}){{3}}$")
    if kind == "card":
        # the digits are only added up where their number is right
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


SPAN = "struct<kind:string,start:int,end:int,valid:boolean,wide:boolean,text:string,before:string,after:string>"
NONE = f"array<{SPAN}>"
#: Matches that one inner step of ``_places`` appends to a list.
CHUNK = 256


def _none() -> Column:
    return F.array().cast(NONE)


def _places(text: Column, pattern: str, kind: str, wide: bool, worth: Callable[[Column], Column]) -> Column:
    """Spans of all matches that are ``worth`` keeping.

    A match starts after the parts and matches before it, whose lengths are
    summed in chunks, so that a text with very many matches stays cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)

    def inside(items, first):
        def step(acc, x):
            start = acc["at"] + x["gap"]
            end = start + F.length(x["m"])
            span = F.struct(
                F.lit(kind).alias("kind"),
                start.alias("start"),
                end.alias("end"),
                F.when(F.lit(wide), F.lit(False)).otherwise(_valid(kind, x["m"])).alias("valid"),
                F.lit(wide).alias("wide"),
                x["m"].alias("text"),
                F.substr(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))).alias("before"),
                F.substr(text, end + 1, F.lit(1)).alias("after"),
            )
            out = F.when(worth(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(end.alias("at"), out.cast(NONE).alias("out"))

        return F.aggregate(items, F.struct(first.alias("at"), _none().alias("out")), step)["out"]

    def chunks(items):
        numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
        part = lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK))
        length = lambda k: F.aggregate(part(k), F.lit(0), lambda acc, x: acc + x["gap"] + F.length(x["m"]))
        starts = F.aggregate(
            numbers,
            F.array(F.lit(0)),
            lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + length(k))),
        )
        bound = lambda s: F.flatten(F.transform(numbers, lambda k: inside(part(k), F.get(s, k))))
        return F.get(F.transform(F.array(starts), bound), F.lit(0))

    items = F.zip_with(found, F.slice(parts, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap")))
    return F.when(F.size(found) > 0, F.get(F.transform(F.array(items), chunks), F.lit(0))).otherwise(_none())


def candidates(text: Column) -> Column:
    """All spans to judge: base matches, valid or nearly so, and wide ones that touch no valid base span.

    A pattern runs where the text has what every match of it that is worth keeping needs.
    """
    has = {
        "email": text.contains("@"),
        "ip": text.rlike("[0-9]\\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": text.contains("+"),
    }
    wide_has = {
        "email": text.rlike(r"(?i)@|[\[(]at[\])]|\x20at\x20"),
        "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"),
        "card": text.rlike("[0-9]{5}"),
        "phone": text.rlike("[0-9]{3}[\\x20.-][0-9]{4}"),
    }
    n_digits = lambda m: F.length(_digits(m))
    worth = {"email": lambda m: F.lit(True), "ip": lambda m: F.lit(True), "card": lambda m: n_digits(m) >= 13, "phone": lambda m: n_digits(m) >= 6}
    base = F.concat(*[F.when(has[k], _places(text, PATTERNS[k], k, False, worth[k])).otherwise(_none()) for k in KINDS])
    wide = F.concat(*[F.when(wide_has[k], _places(text, WIDE[k], k, True, lambda m: F.lit(True))).otherwise(_none()) for k in KINDS])

    def both(b):
        held = F.filter(b, lambda x: x["valid"])
        apart = lambda w: ~F.exists(held, lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"]))
        return F.concat(b, F.filter(wide, apart))

    return F.get(F.transform(F.array(base), both), F.lit(0))


def _spoken(text: Column) -> Column:
    """How a wide e-mail says ``at`` as a word: not, before a full stop with a space behind it as prose has, or joined."""
    at = text.rlike(r"(?i)\x20at\x20")
    return F.when(~at, "no").when(text.rlike(r"\.\x20"), "prose").otherwise("joined")


def votes(c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, -1, or 0 where it abstains."""
    kind, text, digits = c["kind"], c["text"], _digits(c["text"])
    n = F.length(digits)
    words = F.lower(c["before"])
    near = F.lit(False)
    for k in KINDS:
        near = F.when(kind == k, words.rlike(rf"(?:^|[^a-z])(?:{GAZETTEER[k]})[^a-z]")).otherwise(near)
    prose = (kind == "email") & (_spoken(text) == "prose")
    shape = (
        F.when(kind == "email", text.rlike(r"(?i)[a-z]{2,24}$") & ~prose)
        .when(kind == "ip", ~text.rlike(r"^0|^255|\.0{2,}"))
        .when(kind == "card", digits.rlike("^[3-6]") & n.between(15, 19))
        .otherwise(n.between(10, 15))
    )
    check = F.when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False))).when(
        kind == "ip", c["valid"] | c["wide"]
    )
    vote = lambda yes: F.when(yes, 1).otherwise(-1)
    return {
        "base": F.when(c["wide"], 0).otherwise(vote(c["valid"])),
        "check": F.when(check.isNull(), 0).otherwise(vote(check)),
        "shape": vote(shape),
        "near": F.when(near, 1).otherwise(0),
        "against": F.when(words.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]+$") | prose, -1).otherwise(0),
        "apart": F.when(c["before"].rlike("[A-Za-z0-9]$") | c["after"].rlike("[A-Za-z0-9]"), -1).otherwise(0),
        "same": F.when(digits.rlike(r"^([0-9])\1{6,}$"), -1).otherwise(0),
    }


def features(c: Column) -> list[Column]:
    """Discrete features of a candidate as ``name=value``; at most a few hundred values in all."""
    kind, digits = c["kind"], _digits(c["text"])
    sign = lambda x: F.when(x == "", "none").when(x.rlike("[A-Za-z]"), "letter").when(x.rlike("[0-9]"), "digit").when(x.rlike(r"\s"), "space").otherwise("sign")
    word = F.regexp_extract(F.lower(c["before"]), "([a-z]+)[^a-z]*$", 1)
    named = {
        "form": F.concat(kind, F.when(c["wide"], ":wide").when(c["valid"], ":valid").otherwise(":other")),
        "digits": F.concat(kind, F.lit(":"), F.least(F.length(digits), F.lit(24)).cast("string")),
        "length": F.concat(kind, F.lit(":"), F.least(F.floor(F.length(c["text"]) / 4), F.lit(12)).cast("string")),
        "before": sign(F.right(c["before"], F.lit(1))),
        "after": sign(c["after"]),
        "spoken": _spoken(c["text"]),
        "word": F.pmod(F.xxhash64(word), F.lit(64)).cast("string"),
        "signs": F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(c["text"], "[^@.:()\\x20+-]", ""), ""))), ""),
    }
    return [F.concat(F.lit(f"{name}="), value) for name, value in named.items()]


@dataclass(frozen=True)
class SpanModel:
    """What was learnt: each labeler's reliability by kind, and the classifier's log-odds by feature."""

    reliability: dict[tuple[str, str], dict[int, tuple[float, float]]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0


def _em(rows: list[tuple[tuple[int, ...], float]], names: list[str], rounds: int) -> tuple[dict, dict]:
    """Two classes, votes independent given the class; from majority votes, a fixed number of rounds."""
    post = {v: 0.5 + 0.45 * max(-1.0, min(1.0, sum(v) / 2)) for v, _ in rows}
    table: dict = {}
    for _ in range(rounds):
        yes = sum(n * post[v] for v, n in rows)
        total = sum(n for _, n in rows)
        prior = min(0.99, max(0.01, (yes + 1) / (total + 2)))
        table = {}
        for j, name in enumerate(names):
            seen = {s: [0.5, 0.5] for s in (1, 0, -1)}
            # a labeler is taken to be better than chance: a vote carries that much weight before any data
            seen[1][0] += 2.0
            seen[-1][1] += 2.0
            for v, n in rows:
                seen[v[j]][0] += n * post[v]
                seen[v[j]][1] += n * (1 - post[v])
            sums = [sum(x[k] for x in seen.values()) for k in (0, 1)]
            table[name] = {s: (x[0] / sums[0], x[1] / sums[1]) for s, x in seen.items()}
        for v, _ in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[m][s][0] / table[m][s][1]) for m, s in zip(names, v) if s)
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, table


def fit(found: DataFrame, rounds: int = 20) -> SpanModel:
    """Learn from ``found.cands`` of all documents.

    Only two grouped tables reach the driver: vote patterns with their counts
    (at most 3 to the power of the labelers, by kind) and soft counts by feature.
    Without candidates the model is empty and accepts nothing beyond the base.
    """
    each = found.select(F.explode("cands").alias("c"))
    ballot = each.select("c", *[v.alias(f"v_{n}") for n, v in votes(F.col("c")).items()])
    names = [c[2:] for c in ballot.columns if c.startswith("v_")]
    cols = [f"v_{n}" for n in names]
    patterns = ballot.groupBy(F.col("c.kind").alias("kind"), *cols).count().collect()
    posterior, reliability = [], {}
    for kind in KINDS:
        rows = sorted((tuple(r[c] for c in cols), float(r["count"])) for r in patterns if r["kind"] == kind)
        if rows:
            post, table = _em(rows, names, rounds)
            reliability |= {(kind, n): t for n, t in table.items()}
            posterior += [(kind, *v, p) for v, p in post.items()]
    if not posterior:
        return SpanModel()
    spark = found.sparkSession
    known = spark.createDataFrame(posterior, ", ".join(["kind string", *[f"{c} int" for c in cols], "p double"]))
    soft = ballot.withColumn("kind", F.col("c.kind")).join(F.broadcast(known), ["kind", *cols])
    counts = (
        soft.select("p", F.explode(F.array(*features(F.col("c")))).alias("feature"))
        .groupBy("feature")
        .agg(F.round(F.sum("p"), 6).alias("yes"), F.round(F.sum(1 - F.col("p")), 6).alias("no"))
        .collect()
    )
    # naive Bayes on soft labels: every candidate has one value of each feature
    n_features = len(features(F.col("c")))
    yes, no = sum(r["yes"] for r in counts) / n_features, sum(r["no"] for r in counts) / n_features
    # a value seen once or twice leans to neither class
    share = (yes + 1) / (yes + no + 2)
    odds = lambda r: math.log((r["yes"] + share) / (yes + 1)) - math.log((r["no"] + 1 - share) / (no + 1))
    weights = {r["feature"]: odds(r) for r in counts}
    return SpanModel(reliability, {k: round(w, 9) for k, w in sorted(weights.items())}, round(math.log((yes + 1) / (no + 1)), 9))


def decide(cands: Column, model: SpanModel) -> Column:
    """Spans that stay: valid base ones, and those wide ones that the classifier accepts; by kind, then start."""
    held = F.filter(cands, lambda c: c["valid"])
    if model.weights:
        table = F.create_map(*[F.lit(x) for pair in model.weights.items() for x in pair])

        def accepted(c):
            odds = F.lit(model.bias)
            for f in features(c):
                odds = odds + F.coalesce(F.try_element_at(table, f), F.lit(0.0))
            return ~c["valid"] & c["wide"] & (odds > 0)

        held = F.concat(held, F.filter(cands, accepted))
    rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
    keyed = F.transform(held, lambda c: F.struct(rank(c).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["valid"].alias("base")))
    return F.array_sort(keyed)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SpanModel]:
    """``doc_id, spans`` of every document, and the model learnt from them.

    Null and empty texts have no spans; repeated rows stay.  Texts are read
    once: their candidates, without the texts, are written to the shared folder
    and serve both the fit and the decision.  No shuffle but of the two counts.
    """
    found = settled(id_text(df, id_col, text_col).select("doc_id", candidates(F.col("text")).alias("cands")), "pii")
    model = fit(found)
    return found.select("doc_id", decide(F.col("cands"), model).alias("spans")), model


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones joined, replaced by its kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"),
        ),
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    tail = lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1, F.length(text)))
    whole = F.get(F.transform(F.array(done), tail), F.lit(0))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans listed."""
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
