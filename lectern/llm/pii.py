"""Personal data: regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation weighs them.

Candidates are all matches of the four base patterns, whether or not they pass their checks, and of two further patterns
(addresses written out with "at" and "dot", telephone numbers without a country code). Four labelers vote for, against or not at all on each:
its own check, a gazetteer (top-level domains, network ranges, card issuers, country codes), words in its context, and
the characters around it. Votes of all candidates of the corpus are counted by pattern; from these counts
expectation-maximisation estimates, for each kind, how reliable each labeler is and how likely each pattern is personal
data, and a logistic classifier of the votes is trained on that. Spans are the base matches that pass their checks, which
always stay, and the other candidates that the classifier accepts and that no base span overlaps.

Everything that touches rows is DataFrame expressions in a narrow plan: one pass finds the candidates, a small
aggregate counts vote patterns, and no text is shuffled. Only those counts (at most 6 x 3**4 rows) come to the driver.

Defined results: a null text is empty; no spans give counts of 0, the hash of the empty string and an empty list; a span's
positions are code points, end exclusive; rows that repeat an id are handled each; a null id passes through; an empty table
gives an empty result; other columns are ignored, and passed through by redacted().
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import stored

KINDS = ("email", "ip", "card", "phone")

# Where a run of one class of characters begins, or the last match ended: elsewhere within the run no match can start that
# would not also start there. It spares the engine to try every character of a long run, and possessive repeats spare it
# to go back; neither changes what is found.
_RUN = r"(?:\G|(?<![{0}]))"
PATTERNS = {
    "email": _RUN.format(r"A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _RUN.format("0-9") + r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: kind, pattern, and a plain text without which the pattern is not tried.
WRITTEN_MAIL = r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+)++"
LOCAL_PHONE = r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"

#: Well-known top-level domains, country codes of telephone numbers, and issuers' first digits of cards.
TOP_DOMAINS = "com org net edu gov mil int info biz io dev app ai co uk de fr es it nl be ch at pt pl cz se no fi dk ie gr ru ua tr us ca mx br ar cl au nz jp cn kr in sg hk tw za eu".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 358 359 370 371 372 380 385 386 420 421 852 886 961 962 965 966 971 972".split()
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|6011|65|35)"
#: Network ranges that are not hosts of the public network.
SPECIAL_RANGES = r"^0*(?:0|10|127|2(?:2[4-9]|[345][0-9]))\."
FOR_WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client|addr)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|telefon|telefono|anruf)\b",
}
AGAINST_WORDS = r"(?i)(?:\b(?:version|isbn|issn|sku|order|invoice|part|serial|id|no|figure|table|section|chapter)\b[\s.:#=-]*|[#=/\\\"'])$"
CONTEXT = 32
#: A candidate beside the base is a span if the classifier holds it for personal data with this probability.
ACCEPT = 0.9
LABELERS = ("check", "gazetteer", "context", "border")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often it is used and in whichever loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix(values: Column, zero: Column, add: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """Running totals of an array, in two levels, so that the work of an array of n values stays near block * n."""
    fold = lambda part: F.aggregate(part, zero, add)
    count = lambda n: F.sequence(F.lit(0), n - 1)

    def within(x: Column, before: Column) -> Column:
        at = lambda i: add(F.get(before, F.floor(i / block).cast("int")), fold(F.slice(x, (i - i % block + 1).cast("int"), (i % block + 1).cast("int"))))
        return F.transform(count(F.size(x)), at)

    def whole(x: Column) -> Column:
        blocks = F.transform(count(F.ceil(F.size(x) / block).cast("int")), lambda b: fold(F.slice(x, b * block + 1, F.lit(block))))
        before = let(blocks, lambda y: F.transform(count(F.size(y)), lambda b: fold(F.slice(y, F.lit(1), b))))
        return let(before, lambda y: within(x, y))

    return let(values, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(x))


def _sum(values: Column) -> Column:
    return prefix(values, F.lit(0), lambda a, b: a + b)


def _max(values: Column) -> Column:
    return prefix(values, F.lit(0), lambda a, b: F.greatest(a, b))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    """Whether a match of a kind's pattern passes the kind's check."""
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(s)).between(14, 19) & _luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _gazetteer(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS), 1).otherwise(-1)
    if kind == "ip":
        return F.when(s.rlike(SPECIAL_RANGES), -1).otherwise(1)
    if kind == "card":
        return F.when(F.length(_digits(s)).between(14, 19) & _digits(s).rlike(CARD_ISSUERS), 1).otherwise(-1)
    code = _digits(s)
    known = [F.substr(code, F.lit(1), F.lit(n)).isin([c for c in COUNTRY_CODES if len(c) == n]) for n in (1, 2, 3)]
    return F.when(s.startswith("+"), F.when(reduce(lambda a, b: a | b, known), 1).otherwise(-1)).otherwise(0)


def _candidates(kind: str, base: bool, gaps: Column, found: Column) -> Column:
    """Structs (start, kind, end, base, votes) of the matches `found` that stand between the texts `gaps`."""
    n = F.size(found)
    lengths = F.transform(F.slice(gaps, F.lit(1), n), lambda g, i: F.length(g) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
    starts = _sum(lengths)

    def span(p: Column, i: Column) -> Column:
        s, start = p["s"], p["start"]
        left, right = F.right(F.get(gaps, i), F.lit(CONTEXT)), F.left(F.get(gaps, i + 1), F.lit(1))
        check = passes(kind, s) if base else F.lit(False)
        context = F.when(left.rlike(AGAINST_WORDS), -1).when(left.rlike(FOR_WORDS[kind]), 1).otherwise(0)
        border = F.when(left.rlike(r"[\p{L}\p{N}_@#$%&*=/\\.-]$") | right.rlike(r"^[\p{L}\p{N}_@#$%&*=/\\-]"), -1).otherwise(1)
        own = F.when(check, 1).otherwise(-1) if base else F.lit(0)
        votes = F.concat_ws(",", *[v.cast("string") for v in (own, _gazetteer(kind, s), context, border)])
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(s)).alias("end"), check.alias("base"), F.concat(F.lit(f"{kind}{'' if base else '+'},"), votes).alias("votes"))

    return F.transform(F.zip_with(found, starts, lambda s, start: F.struct(s.alias("s"), start.alias("start"))), span)


def with_candidates(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Columns `keep` of docs and __spans: all candidates of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    looks = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    todo = [(k, True, PATTERNS[k], looks[k]) for k in KINDS]
    todo += [("email", False, WRITTEN_MAIL, text.rlike(r"[(\[{]\x20?at\x20?[)\]}]")), ("phone", False, LOCAL_PHONE, text.rlike(r"[0-9]{3}[.-][0-9]{4}"))]
    # each regular expression runs once: a column that is used more than once is not computed again
    rows = docs.select(*keep, text.alias("__text"), *[F.when(look, F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"__found{k}") for k, (_, _, p, look) in enumerate(todo)])
    some = [F.size(F.coalesce(F.col(f"__found{k}"), F.array().cast("array<string>"))) > 0 for k in range(len(todo))]
    rows = rows.select("*", *[F.when(some[k], F.split("__text", p, -1)).alias(f"__gaps{k}") for k, (_, _, p, _) in enumerate(todo)])
    spans = [F.when(some[k], _candidates(kind, base, F.col(f"__gaps{k}"), F.col(f"__found{k}"))).alias(f"__spans{k}") for k, (kind, base, _, _) in enumerate(todo)]
    kept = [c for c in rows.columns if not c.startswith(("__found", "__gaps"))]
    rows = rows.select(*[f"`{c}`" for c in kept], *spans)
    empty = "array<struct<start:int,kind:int,end:int,base:boolean,votes:string>>"
    every = F.flatten(F.array(*[F.coalesce(F.col(f"__spans{k}"), F.array().cast(empty)).cast(empty) for k in range(len(todo))]))
    return rows.select(*[f"`{c}`" for c in kept], every.alias("__spans"))


def estimate(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """The probability that a candidate is personal data, by its kind and votes: reliabilities by expectation-maximisation, then a classifier.

    counts: candidates by "kind,vote,vote,..."; votes are 1, 0 (none) and -1.
    """
    out: dict[str, float] = {}
    for kind in sorted({k.split(",")[0] for k in counts}):
        rows = [(tuple(int(v) for v in k.split(",")[1:]), n, k) for k, n in sorted(counts.items()) if k.split(",")[0] == kind]
        n_labelers = len(rows[0][0])
        prior = 0.5
        right = [{y: {v: (0.7 if v == y else 0.15 if v == 0 else 0.15) for v in (-1, 0, 1)} for y in (-1, 1)} for _ in range(n_labelers)]
        post: dict[str, float] = {}
        for _ in range(rounds):
            for votes, _, key in rows:
                like = [math.log(p) + sum(math.log(right[j][y][v]) for j, v in enumerate(votes)) for y, p in ((1, prior), (-1, 1 - prior))]
                post[key] = 1 / (1 + math.exp(min(50, max(-50, like[1] - like[0]))))
            total = sum(n for _, n, _ in rows)
            prior = min(0.99, max(0.01, (sum(n * post[k] for _, n, k in rows) + 1) / (total + 2)))
            for j in range(n_labelers):
                for y in (-1, 1):
                    weight = {v: 0.5 + (1.5 if v == y else 0.0) for v in (-1, 0, 1)}  # a labeler is taken to be better than chance
                    for votes, n, key in rows:
                        weight[votes[j]] += n * (post[key] if y == 1 else 1 - post[key])
                    right[j][y] = {v: w / sum(weight.values()) for v, w in weight.items()}
        # the classifier: one weight for each labeler's votes for and against
        coef = [0.0] * (1 + 2 * n_labelers)
        x = {key: [1.0] + [float(v == 1) for v in votes] + [float(v == -1) for v in votes] for votes, _, key in rows}
        scale = sum(n for _, n, _ in rows)
        for _ in range(500):
            grad = [0.001 * c for c in coef]
            for _, n, key in rows:
                p = 1 / (1 + math.exp(-min(50, max(-50, sum(a * b for a, b in zip(coef, x[key], strict=True))))))
                for i, a in enumerate(x[key]):
                    grad[i] += n / scale * (p - post[key]) * a
            coef = [c - 1.0 * g for c, g in zip(coef, grad, strict=True)]
        for _, _, key in rows:
            out[key] = 1 / (1 + math.exp(-min(50, max(-50, sum(a * b for a, b in zip(coef, x[key], strict=True))))))
    return out


def accepted_votes(found: DataFrame) -> list[str]:
    """The vote patterns of candidates beside the base that the classifier accepts, from all rows with __spans."""
    votes = found.select(F.explode("__spans.votes").alias("votes")).groupBy("votes").count().collect()
    return sorted(k for k, p in estimate({r["votes"]: r["count"] for r in votes}).items() if p >= ACCEPT)


def _final(accepted: list[str]) -> Column:
    """Base spans, and accepted candidates that no base span overlaps, in the order of start, kind and end."""
    spans = F.col("__spans")
    more = F.filter(spans, lambda s: ~s["base"] & s["votes"].isin(accepted)) if accepted else F.filter(spans, lambda s: F.lit(False))
    slim = lambda part: F.transform(part, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def joined(base: Column) -> Column:
        free = F.filter(more, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.array_sort(F.array_distinct(F.concat(slim(base), slim(free))))

    return let(F.filter(spans, lambda s: s["base"]), joined)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of base spans, and spans."""
    found = stored(with_candidates(docs, [F.col("doc_id")]).drop("__text"), "pii")
    rows = found.select("doc_id", F.array_sort(F.filter("__spans", lambda s: s["base"])).alias("__base"), _final(accepted_votes(found)).alias("__all"))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(_written(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("__all")).alias("spans"))


def redacted(docs: DataFrame, length_column: str = "n_chars") -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, as in [EMAIL]; length_column, if there, holds the new length."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    votes = accepted_votes(stored(with_candidates(docs, []).select("__spans"), "pii-votes"))
    rows = with_candidates(docs.select(F.struct(*own).alias("__row"), "text"), [F.col("__row")])
    rows = rows.select("__row", "__text", _final(votes).alias("__all"))
    ends = F.concat(F.array(F.lit(0)), _max(F.transform("__all", lambda s: s["end"])))
    rows = rows.select("*", F.when(F.size("__all") > 0, ends).alias("__ends"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        done = F.get("__ends", i)  # up to where the text is covered already
        gap = F.when(s["start"] > done, F.substr(F.col("__text"), done + 1, s["start"] - done)).otherwise("")
        return F.concat(gap, F.when((s["start"] >= done), F.get(marks, s["kind"])).otherwise(""))

    tail = F.substr(F.col("__text"), F.element_at("__ends", -1) + 1)
    clean = F.when(F.size("__all") > 0, F.concat(F.array_join(F.transform("__all", piece), ""), tail)).otherwise(F.col("__row.text"))
    rows = rows.select("__row", "__all", clean.alias("__clean"))
    changed = F.size("__all") > 0

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__clean").alias(c)
        if c == length_column:
            return F.when(changed, F.length("__clean").cast(docs.schema[c].dataType)).otherwise(F.col(f"__row.`{c}`")).alias(c)
        return F.col(f"__row.`{c}`").alias(c)

    return rows.select(*[column(c) for c in docs.columns])
