"""Operator 10: personal data by weak supervision.  Built-in functions only.

Candidate spans come from base rules (email, ip, card, phone) and from looser patterns
(national numbers, account numbers, phones without a plus, spelled-out addresses, titled
names).  Three labelers vote on each candidate: a regular expression on its
form, a gazetteer on its parts, and the context before it; a vote is 1, -1, or 0 for
abstention.  Expectation-maximisation over the counts of vote patterns estimates, without labels, how
reliable each labeler is and how often a candidate of each kind is personal data.  A logistic span
classifier over kind, votes and measures of the span (length, share of digits, a colon before it) is trained
on the resulting posteriors, and decides on what is no base span.  The number of distinct patterns is bounded by
kinds, votes and classes of measures (under 10,000), whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm._native import bound, count_of, in_runs, located, overlaps, said, span_runs
from strandtally.llm._shared import table, written

KINDS = ["email", "ip", "card", "phone", "national", "account", "local_phone", "spelled", "name"]
LABELERS = ("form", "gazetteer", "context")
# The base rules.  The anchors in front only spare the scan starts that can't match; possessive repetitions don't recurse, so texts may be long.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: One pattern for all looser candidates, each with the pattern that tells its kind.
LOOSE = {
    4: r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    5: r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    6: r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    7: r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{2,30}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{2,30}\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z]{2,10}",
    8: r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
}
# What the gazetteers know.
GIVEN_NAMES = (
    "Adam Alice Amy Ana Andrea Andreas Andrew Anna Anne Anthony Antoine Antonio Barbara Ben Brian Camille Carlos Carmen Caroline Catherine Charles Charlotte "
    "Chris Christian Claire Claudia Daniel David Diego Dominique Edward Elena Elizabeth Emily Emma Eric Eva Fernando Francisco Frank François George Hannah "
    "Hans Heinrich Helen Henry Isabel Jack Jacques Jake James Jan Javier Jean Jennifer Jessica John Jonathan Jorge Jose José Joseph Juan Julia Julie Jürgen "
    "Karen Karin Karl Katharina Kevin Klaus Laura Lena Linda Lisa Louis Lucia Luis Luise Manuel Marc Maria María Marie Mark Martin Mary Matthew Max Michael "
    "Michel Miguel Monika Nancy Nicolas Nicole Oliver Olivia Pablo Patricia Paul Pedro Peter Philippe Pierre Rachel Richard Robert Rosa Ruth Sabine Sandra "
    "Sara Sarah Simon Sofia Sophie Stefan Stephen Steven Susan Thomas Ursula Walter Wilhelm William Wolfgang"
)
TOP_DOMAINS = "com org net edu gov mil info biz io dev app co me tv ai uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg se no dk fi is ee lv lt ru ua tr il in cn jp kr br mx ar cl pe za eu"
ACCOUNT_LANDS = "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM TL TN TR UA VA VG XK"
DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 64 65 81 82 86 90 91 351 352 353 354 358 359 370 371 372 380 385 386 420 421 972"


def any_of(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


#: By kind: what its form must (1) or must not (-1) match, what the gazetteers know, and the words expected before it.
FORM = {0: r"\.[A-Za-z]{2,}$", 1: r"^(?!0\.)", 2: r"^[3-6]", 3: r"^\+[1-9]", 4: r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", 5: r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,}$", 6: r"^\(?[2-9]", 7: r"[A-Za-z]{2,}$", 8: r"\x20\p{Lu}\p{Ll}{2,}"}
GAZETTEER = {0: rf"(?i)\.{any_of(TOP_DOMAINS)}$", 1: r"", 2: r"^(?:4|5[1-5]|2[2-7]|34|37|6011|65|35)", 3: rf"^\+{any_of(DIAL_CODES)}", 4: r"", 5: rf"^{any_of(ACCOUNT_LANDS)}", 6: r"", 7: rf"(?i)\b{any_of(TOP_DOMAINS)}$", 8: rf"\x20{any_of(GIVEN_NAMES)}(?:\x20|$)"}
CALLED = r"(?i)phone|tel|call|mobile|cell|fax|contact|handy|anruf|appel|portable|móvil|llam"
WRITTEN = r"(?i)mail|contact|write|reach|schreib|kontakt|écri|correo|escrib"
CONTEXT = {0: WRITTEN, 1: r"(?i)\bip\b|address|adresse|dirección|host|server|login|from", 2: r"(?i)card|visa|pay|credit|karte|carte|tarjeta", 3: CALLED, 4: r"(?i)ssn|social|security|sozial|sécurité|seguridad", 5: r"(?i)iban|account|konto|compte|cuenta", 6: CALLED, 7: WRITTEN, 8: r"(?i)name|dear|contact|signed|from|by|with|regards|sincerely|geehrte|cher|chère|estimad"}
#: Upper bounds of the classes of a span's length and of its share of digits.
LENGTHS, SHARES = (12, 17, 24), (0.05, 0.5, 0.9)
MEASURES = {"length": len(LENGTHS) + 1, "share": len(SHARES) + 1, "colon": 2}
CONTEXT_WIDTH = 30


def digits(x: Column) -> Column:
    return F.translate(x, " -().+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.split(F.reverse(number), "")

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(back, weigh), F.lit(0), lambda s, d: s + d) % 10 == 0


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, found array<struct<kind,start,end,votes...,measures...>>), base kinds valid by their rules."""
    rows = df.select(F.col(id_col), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))

    none = F.array().cast("array<struct<kind:int,start:int,end:int,match:string>>")
    email = F.when(F.contains(text, F.lit("@")), tagged(located(text, EMAIL), 0)).otherwise(none)
    ip = tagged(F.filter(located(text, IP), lambda s: F.forall(F.split(s["match"], r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, -1).when(F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).try_cast("int") <= 255, 3).otherwise(-1))), 1)
    # the scan looks for 13 digits in a row first; the rule itself then finds every match
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), tagged(F.filter(located(text, CARD), lambda s: F.length(digits(s["match"])).between(13, 19) & luhn(digits(s["match"]))), 2)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), tagged(F.filter(located(text, PHONE), lambda s: F.length(digits(s["match"])).between(9, 15)), 3)).otherwise(none)
    rows = rows.withColumn("_base", F.array_sort(F.concat(email, ip, card, phone)))
    loose = located(text, "|".join(LOOSE.values()))

    def kind_of(c: Column) -> Column:
        out = F.lit(None).cast("int")
        for kind in reversed(LOOSE):
            whole = LOOSE[kind]
            out = F.when(c.rlike("^(?:" + whole + ")$"), F.lit(kind)).otherwise(out)
        return out

    extra = F.transform(loose, lambda s: F.struct(kind_of(s["match"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))
    by_start = F.array_sort(F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    free = bound(span_runs(by_start), lambda runs: F.filter(extra, lambda s: s["kind"].isNotNull() & ~overlaps(runs, s)))
    ordered = F.transform(F.concat("_base", free), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))
    rows = rows.withColumn("_all", F.array_sort(ordered))

    def by_kind(kind: Column, rules: dict[int, str], x: Column) -> Column:
        out = F.lit(0)
        for k, rule in rules.items():
            if rule:
                out = F.when(kind == k, F.when(x.rlike(rule), 1).otherwise(-1)).otherwise(out)
        return out

    def bin_of(x: Column, bounds: tuple[float, ...]) -> Column:
        return sum(((x >= b).cast("int") for b in bounds), F.lit(0))

    def vote(s: Column, ahead: Column) -> Column:
        known = by_kind(s["kind"], GAZETTEER, s["match"])
        near = by_kind(s["kind"], CONTEXT, ahead)
        size = F.length(s["match"])
        share = F.length(F.regexp_replace(s["match"], "[^0-9]", "")) / size
        return F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            by_kind(s["kind"], FORM, s["match"]).alias("form"),
            known.alias("gazetteer"),
            F.greatest(near, F.lit(0)).alias("context"),  # missing words say nothing
            bin_of(size, LENGTHS).alias("length"),
            bin_of(share, SHARES).alias("share"),
            ahead.rlike(r"[:=]\x20*$").cast("int").alias("colon"),
        )

    def votes(own: Column) -> Column:
        """Of a run of candidates, whose stretch of the text is cut out once."""
        lo, hi = F.greatest(F.get(own, F.lit(0))["start"] - CONTEXT_WIDTH, F.lit(0)), F.element_at(own, -1)["start"]
        width = lambda s: F.least(s["start"], F.lit(CONTEXT_WIDTH))
        return bound(F.substring(text, lo + 1, hi - lo), lambda part: F.transform(own, lambda s: bound(F.substring(part, s["start"] - width(s) - lo + 1, width(s)), lambda ahead: vote(s, ahead))))

    return rows.withColumn("found", F.flatten(F.transform(in_runs(F.col("_all")), votes))).drop("_text", "_base", "_all")


@dataclass
class SpanModel:
    """The prior by kind, reliabilities by labeler (how often it is right on personal data, and on what is none), and the classifier's weights."""

    prior: dict[int, float] = field(default_factory=dict)
    right: dict[str, tuple[float, float]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def features(rows: np.ndarray) -> np.ndarray:
    """One row of features for each (kind, votes..., measures...): a constant, the kind, the votes, and each measure's class."""
    n = len(LABELERS)
    hot = [rows[:, :1] == np.arange(len(KINDS))]
    hot += [rows[:, 1 + n + i : 2 + n + i] == np.arange(size) for i, size in enumerate(MEASURES.values())]
    return np.hstack([np.ones((len(rows), 1)), rows[:, 1 : 1 + n], *hot]).astype(float)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 100, steps: int = 50) -> SpanModel:
    """EM over distinct (kind, votes..., measures...) and their counts, then logistic regression (Newton steps) on its posteriors."""
    model = SpanModel(prior={k: 0.5 for k in range(len(KINDS))}, right={name: (0.8, 0.8) for name in LABELERS})
    if not len(rows):
        model.weights = np.zeros(features(np.zeros((1, 1 + len(LABELERS) + len(MEASURES)), int)).shape[1])
        return model
    counts = counts.astype(float)
    kind, votes = rows[:, 0], rows[:, 1 : 1 + len(LABELERS)]
    posterior = np.full(len(rows), 0.5)
    for _ in range(rounds):
        before = posterior
        prior = np.array([model.prior[int(k)] for k in kind])
        yes, no = np.log(prior), np.log(1 - prior)
        for i, name in enumerate(LABELERS):
            hit, reject = model.right[name]
            v = votes[:, i]
            yes = yes + np.where(v > 0, np.log(hit), np.where(v < 0, np.log(1 - hit), 0))
            no = no + np.where(v > 0, np.log(1 - reject), np.where(v < 0, np.log(reject), 0))
        posterior = 1 / (1 + np.exp(np.clip(no - yes, -700, 700)))
        for k in range(len(KINDS)):  # a weak belief in one half
            own = kind == k
            model.prior[k] = float(np.clip((posterior[own] @ counts[own] + 1) / (counts[own].sum() + 2), 0.01, 0.99))
        for i, name in enumerate(LABELERS):  # and in 0.8
            v = votes[:, i]
            on, off = posterior * counts * (v != 0), (1 - posterior) * counts * (v != 0)
            hit, reject = (on[v > 0].sum() + 1.6) / (on.sum() + 2), (off[v < 0].sum() + 1.6) / (off.sum() + 2)
            # a labeler is taken to be right more often than not
            model.right[name] = float(np.clip(hit, 0.5, 0.99)), float(np.clip(reject, 0.5, 0.99))
        if np.abs(posterior - before).max() < 1e-9:
            break
    x, share = features(rows), counts / counts.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - posterior)) + 1e-4 * w
        move = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), slope)
        w = w - move * min(1.0, 5 / max(np.abs(move).max(), 1e-300))
        if np.abs(move).max() < 1e-10:
            break
    model.weights = w
    return model


def find_private(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, base, spans): arrays of struct<kind,start,end>, sorted so; kind is the number in KINDS.

    base holds what the base rules find, spans also the candidates whose
    probability by the classifier is at least `least`.  Positions are code points, end exclusive.  A null or
    empty text has no spans.  Spans of different kinds may overlap, but for added ones, which never overlap a base span.
    Repeated rows, and rows with a null id, are rows like any other (and each counts in training).  Other columns are ignored.
    """
    found = written(candidates(df, id_col, text_col), "candidates")
    names = ["kind", *LABELERS, *MEASURES]
    seen = found.select(F.explode("found").alias("s")).groupBy(*[F.col(f"s.{v}").alias(v) for v in names]).agg(F.count("*").alias("n"))
    patterns = sorted(tuple(r) for r in seen.collect())
    table_ = np.array([p[:-1] for p in patterns], dtype=int).reshape(len(patterns), len(names))
    bias, *rest = fit(table_, np.array([p[-1] for p in patterns])).weights.tolist()
    by_vote, rest = rest[: len(LABELERS)], rest[len(LABELERS) :]
    by_class = {"kind": rest[: len(KINDS)]}
    at = len(KINDS)
    for name, size in MEASURES.items():
        by_class[name], at = rest[at : at + size], at + size

    def sure(s: Column) -> Column:
        z = F.lit(bias)
        for name, own in by_class.items():
            z = z + F.get(F.array(*map(F.lit, own)), s[name])
        for name, w in zip(LABELERS, by_vote, strict=True):
            z = z + F.lit(w) * s[name]
        return (s["kind"] < 4) | (1 / (1 + F.exp(-z)) >= least)

    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    spans = F.array_sort(F.transform(F.filter("found", sure), plain))
    base = F.array_sort(F.transform(F.filter("found", lambda s: s["kind"] < 4), plain))
    return found.select(F.col(id_col), base.alias("base"), spans.alias("spans"))


def op10_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base"), KINDS), 256).alias("base_sha256"), said(F.col("spans"), KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
