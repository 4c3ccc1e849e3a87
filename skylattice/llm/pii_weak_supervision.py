"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Four of them (email, ip, card, phone) are certain once a check passes; looser ones (secret,
number) are candidates. On every proposal, certain or not, labelers vote for, against or abstain: a pattern check, a
gazetteer, the words before it, and its shape together with what follows. Expectation-maximisation estimates how
reliable each labeler is from their agreement alone, and with the posteriors as soft labels a naive Bayes classifier
over span features is trained; it decides which candidates become spans.

Votes and features take few values, so all proposals of all documents are first counted by their combination; the
iterations run over that small table. Documents are then scored in a second scan. Nothing but counts is shuffled.

Patterns are written so that Java's matcher needs neither deep recursion nor repeated starts on long runs; they match
what their plain forms match. Texts are looked at in blocks that end where no pattern can reach across, so the work on
a text grows with its length and not with the square of its matches. Only a stretch without any such place, as digits
and dots throughout, is one block however long it is.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Kinds in the order that breaks ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = 4
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
    "number": r"(?<![A-Za-z0-9+.,-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
#: Labelers' word lists.
TOP_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|it|eu"
SECRET_PREFIXES = "akia|ghp_|gho_|sk-|xox|aiza|eyj|sk_live|glpat"
COUNTRY_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|55|61|81|82|86|91"
PERSONAL_WORDS = "token|secret|passw|pwd|api|auth|key|phone|tel|call|mobile|fax|ssn|social|card|visa|account|iban|mail|contact|addr|ip"
OTHER_WORDS = "version|page|order|isbn|figure|line|total|price|chapter|vol"
LEFT, RIGHT = 24, 8
#: Characters of a block at least. It ends after a character that is in no pattern and before which no pattern looks, or
#: after a space that follows a character which the patterns with spaces do not have.
BLOCK_SIZE = 1024
BLOCK = rf"(?s).{{{BLOCK_SIZE}}}.*?(?:(?<=[^A-Za-z0-9._%+@/=(),\x20-])|(?<=[^0-9().\x20+-]\x20)|\z)|.+\z"
#: A character that separates matches from what lies between; in texts it is replaced by its neighbour.
MARK, INSTEAD = "\uffff", "\ufffe"
VOTES = ("by_pattern", "by_gazetteer", "by_context", "by_shape")
FEATURES = ("kind", "size", "digits", "lead", "context")
ROUNDS = 12
THRESHOLD = 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(body))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(body))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True) if kind == "secret" else n <= 15


def _parts(text: Column, kind: str) -> Column:
    """The text cut at the matches of one kind, which are every second part; null where it cannot have any."""
    possible = F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]")
    return F.when(possible, F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once: the optimizer does not copy it to each place that uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


NO_SPANS = "array<struct<kind:int,start:int,end:int,body:string,left:string,right:string,valid:boolean>>"


def _spans(block: Column, kind: str, before: Column, after: Column) -> Column:
    """Proposed spans of one kind in a block; places count from the block's begin."""

    def placed(parts: Column, starts: Column) -> Column:
        def one(i: Column) -> Column:
            body = F.get(parts, i)
            left = F.concat(F.when(i == 1, before).otherwise(""), F.get(parts, i - 1))
            right = F.concat(F.get(parts, i + 1), F.when(i == F.size(parts) - 2, after).otherwise(""))
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                F.get(starts, i).alias("start"),
                F.get(starts, i + 1).alias("end"),
                body.alias("body"),
                F.lower(F.right(left, F.lit(LEFT))).alias("left"),
                F.lower(F.left(right, F.lit(RIGHT))).alias("right"),
                _valid(kind, body).alias("valid"),
            )

        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), one)

    def found(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, _let(_ends(parts), lambda starts: placed(parts, starts))).otherwise(F.array().cast(NO_SPANS))

    return _let(_parts(block, kind), found)


def _ends(parts: Column) -> Column:
    """Where each of ``parts`` begins, and where the last ends."""
    return F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))


def _by_block(text: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
    """``then(block, number, proposed spans)`` for each block of a text; null and empty texts have none."""

    def one(blocks: Column) -> Column:
        def at(block: Column, i: Column) -> Column:
            before = F.right(F.coalesce(F.get(blocks, i - 1), F.lit("")), F.lit(LEFT))
            after = F.left(F.coalesce(F.get(blocks, i + 1), F.lit("")), F.lit(RIGHT))
            clean = F.translate(block, MARK, INSTEAD)
            every = _let(clean, lambda c: F.concat(*(_spans(c, k, before, after) for k in KINDS)))
            return _let(every, lambda e: then(block, i, e))

        return F.transform(blocks, at)

    return _let(_blocks(text), one)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLOCK), F.lit(0))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _is(p: Column, *kinds: str) -> Column:
    return p["kind"].isin(*(KINDS.index(k) for k in kinds))


def described(p: Column) -> dict[str, Column]:
    """Votes and features of one proposed span."""
    body, left, right = F.lower(p["body"]), p["left"], p["right"]
    base, secret, number = p["kind"] < BASE, _is(p, "secret"), _is(p, "number")
    digits = F.length(_digits(body))
    personal, other = left.rlike(rf"({PERSONAL_WORDS})[^a-z0-9]{{0,8}}$"), left.rlike(rf"({OTHER_WORDS})[^a-z0-9]{{0,8}}$")
    return {
        "by_pattern": _vote(
            (base & p["valid"]) | (secret & body.rlike("^[0-9a-f]{32,}$")) | (number & body.rlike(r"^(\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$")),
            ~p["valid"],
        ),
        "by_gazetteer": _vote(
            (_is(p, "email") & body.rlike(rf"\.({TOP_DOMAINS})$")) | (_is(p, "card") & body.rlike("^(4|5[1-5]|3[47]|6)")) | (_is(p, "phone") & body.rlike(rf"^\+({COUNTRY_CODES})")) | (secret & body.rlike(f"^({SECRET_PREFIXES})")),
            _is(p, "ip") & body.rlike(r"^(0|127|255)\."),
        ),
        "by_context": _vote(personal, other),
        "by_shape": _vote(
            (secret & (digits >= 6) & (F.length(body) - digits >= 6)) | (~secret & (digits >= 9)) | _is(p, "email"),
            right.rlike(r"^ ?(%|px|kg|km|eur|usd|[$€£])") | (secret & (digits < 3)) | left.rlike(r"[=/?&#]\w*$"),
        ),
        "kind": p["kind"],
        "size": F.least(F.floor(F.length(body) / 4), F.lit(16)).cast("int"),
        "digits": F.floor(digits * 4 / F.length(body)).cast("int"),
        "lead": F.when(left.rlike("[\"'=:]\\s?$"), 2).when(left.rlike(r"(^|\s)$"), 1).otherwise(0),
        "context": F.when(personal, 2).when(other, 0).otherwise(1),
    }


@dataclass(frozen=True)
class SpanModel:
    """Labelers' reliabilities by vote, and the classifier's log odds by feature value."""

    prior: float
    votes: dict[tuple[str, int], tuple[float, float]]
    bias: float
    weights: dict[str, dict[int, float]]

    def probability(self, features: dict[str, Column]) -> Column:
        odds = F.lit(self.bias)
        for name, by_value in self.weights.items():
            if by_value:
                known = F.create_map(*(F.lit(x) for pair in sorted(by_value.items()) for x in pair))
                odds = odds + F.coalesce(F.try_element_at(known, features[name].cast("int")), F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def _train_votes(counts: dict[tuple[int, ...], int], rounds: int) -> tuple[float, dict[tuple[str, int], tuple[float, float]]]:
    """Expectation-maximisation over the combinations of votes (81 at most): the prior, and each vote's share among both."""
    # at first a vote is right three times in four
    prior, table = 0.5, {(name, v): {1: (0.6, 0.2), 0: (0.2, 0.2), -1: (0.2, 0.6)}[v] for name in VOTES for v in (-1, 0, 1)}
    for _ in range(rounds):
        yes = {votes: n * _posterior(prior, table, votes) for votes, n in counts.items()}
        total = sum(counts.values())
        if not sum(yes.values()):
            break
        sums = (sum(yes.values()), total - sum(yes.values()))
        prior = min(0.999, max(0.001, sums[0] / total))
        seen = {(name, v): sum(yes[c] for c in counts if c[k] == v) for k, name in enumerate(VOTES) for v in (-1, 0, 1)}
        every = {(name, v): sum(n for c, n in counts.items() if c[k] == v) for k, name in enumerate(VOTES) for v in (-1, 0, 1)}
        table = {key: ((seen[key] + 1) / (sums[0] + 3), (every[key] - seen[key] + 1) / (sums[1] + 3)) for key in table}
    return prior, table


def _posterior(prior: float, table: dict[tuple[str, int], tuple[float, float]], votes: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(table[name, v][0] / table[name, v][1]) for name, v in zip(VOTES, votes, strict=True))
    return 1 / (1 + math.exp(-odds))


def train(docs: DataFrame, *, text: str = "text", rounds: int = ROUNDS) -> SpanModel:
    """Estimates the labelers and trains the classifier on the proposals of all rows of ``docs``.

    Null and empty texts have no proposals; a table without any gives a model that finds nothing but base spans.
    """
    spark = docs.sparkSession
    each = docs.select(F.explode(F.flatten(_by_block(F.col(text), lambda block, i, every: every))).alias("p"))
    columns = described(F.col("p"))
    path = f"{shared_dir(spark)}/spans-{uuid.uuid4().hex}"
    named = {n: ("v_" if n in VOTES else "f_") + n for n in columns}
    each.select(*(c.alias(named[n]) for n, c in columns.items())).groupBy(*named.values()).agg(F.count("*").alias("n")).write.parquet(path)
    counted = spark.read.schema(", ".join(f"{x} int" for x in named.values()) + ", n long").parquet(path)

    votes = [F.col(f"v_{name}") for name in VOTES]
    counts = {tuple(r[:-1]): r[-1] for r in counted.groupBy(*votes).agg(F.sum("n")).collect()}
    prior, table = _train_votes(counts, rounds)
    posterior = {c: _posterior(prior, table, c) for c in counts}
    known = F.create_map(*(F.lit(x) for c, p in sorted(posterior.items()) for x in (",".join(map(str, c)), p))) if posterior else None
    yes = F.try_element_at(known, F.concat_ws(",", *votes)) * F.col("n") if posterior else F.lit(0.0)
    stacked = counted.select(yes.alias("yes"), (F.col("n") - yes).alias("no"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"f_{n}").alias("value")) for n in FEATURES))).alias("f"))
    learned = stacked.groupBy("f.name", "f.value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    size = {k: sum(r[k] for r in learned) / len(FEATURES) for k in ("yes", "no")}
    bias = math.log((size["yes"] + 1) / (size["no"] + 1))
    weights: dict[str, dict[int, float]] = {n: {} for n in FEATURES}
    for r in learned:
        weights[r["name"]][r["value"]] = math.log((r["yes"] + 0.5) / (size["yes"] + 1)) - math.log((r["no"] + 0.5) / (size["no"] + 1))
    return SpanModel(prior, table, bias, weights)


def _decided(every: Column, model: SpanModel) -> Column:
    """The spans ``start, k, end`` of a block that are kept, in order."""

    def chosen(kind: str, *taken: Column) -> Column:
        def good(p: Column) -> Column:
            fine = (p["kind"] == KINDS.index(kind)) & p["valid"] & (model.probability(described(p)) >= THRESHOLD)
            for other in taken:
                fine = fine & ~F.exists(other, lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"]) & ((b["start"] <= p["start"]) | (b["end"] >= p["end"])))
            return fine

        return F.filter(every, good)

    def named(*groups: Column) -> Column:
        return F.array_sort(F.transform(F.concat(*groups), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("k"), p["end"].alias("end"))))

    base = F.filter(every, lambda p: (p["kind"] < BASE) & p["valid"])
    return _let(base, lambda b: _let(chosen("secret", b), lambda s: named(b, s, chosen("number", b, s))))


def detect(docs: DataFrame, model: SpanModel, *, text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with an array ``out`` of spans ``kind, start, end``, by start and then kind; a column ``out`` is replaced.

    Base kinds are kept if their check passes; a candidate if the classifier finds it likelier than not and all base
    spans that it meets lie inside it (for a number the kept secrets too). Null and empty texts have none. Places count
    code points from 0, ends are exclusive. Repeated rows are treated each; an empty table stays empty.
    """

    def moved(found: Column, starts: Column) -> Column:
        def one(spans: Column, i: Column) -> Column:
            return F.transform(spans, lambda p: F.struct(F.get(F.array(*map(F.lit, KINDS)), p["k"]).alias("kind"), (p["start"] + F.get(starts, i)).alias("start"), (p["end"] + F.get(starts, i)).alias("end")))

        return F.flatten(F.transform(found, one))

    found = _by_block(F.col(text), lambda block, i, every: _decided(every, model))
    return docs.withColumn(out, _let(found, lambda f: _let(_ends(_blocks(F.col(text))), lambda starts: moved(f, starts))))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: SpanModel, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``length`` (if there) set to the new code points.

    Spans that overlap are replaced together, under the kind of the first. Null texts stay null, and so does their
    ``length``; other columns are as they were. Repeated rows are treated each; an empty table stays empty.
    """

    def replaced(block: Column, spans: Column) -> Column:
        def one(acc: Column, s: Column) -> Column:
            start = F.greatest(s["start"], acc["at"])
            mark = F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, KINDS)), s["k"])), F.lit("]"))
            put = F.concat(acc["out"], F.substring(block, acc["at"] + 1, start - acc["at"]), F.when(s["start"] >= acc["at"], mark).otherwise(""))
            return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), put.alias("out"))

        folded = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), one, lambda acc: F.concat(acc["out"], F.substring(block, acc["at"] + 1, F.length(block))))
        return F.when(F.size(spans) > 0, folded).otherwise(block)

    blocks = _by_block(F.col(text), lambda block, i, every: _let(_decided(every, model), lambda spans: replaced(block, spans)))
    out = docs.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(blocks, "")))
    if length and length in docs.columns:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
