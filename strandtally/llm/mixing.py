"""Operator 7: mixing sources to target weights.  Built-in functions only.

Labelled documents train a classifier of soft domain membership: Gaussian class densities over a few
measures of the text, among them hits of a lexicon of telling words.  The means and
variances come from one aggregation over all labelled rows; the lexicon is fitted on a
bounded sample of labelled rows (`lexicon_rows`).  Then a nonnegative rate is fitted
for each document so that the expected token totals of the domains,
sum over documents of rate * tokens * posterior, match the targets in least squares.

The minimum over all nonnegative rates has the form max(0, 1 - sum of price * posterior), with one price a
domain.  So gradients are followed in the prices (Newton steps with the matrix of the documents between the
bounds): a step needs one aggregation over a narrow table, and nothing is rewritten between
steps.  Steps end when the targets are met; a miss that remains is reported by a warning.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandtally.llm._shared import table, written

DOMAINS = ("high_clean", "high_toxic", "low_clean", "low_toxic")
TARGETS = {"high_clean": 0.80, "high_toxic": 0.02, "low_clean": 0.17, "low_toxic": 0.01}
MARKS = ("!", "*", "|", "$")
LEAST_VARIANCE = 0.02


def domain_of() -> Column:
    """The domain of a labels row, null if either label is unknown."""
    quality = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    toxic = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return F.when(quality.isNotNull() & toxic.isNotNull(), F.concat_ws("_", quality, toxic))


def labelled(labels: DataFrame) -> DataFrame:
    """(id, domain): one row for each labelled id; of contradicting rows the first domain by name counts."""
    rows = labels.select(F.col("doc_id").alias("id"), domain_of().alias("domain")).where("id is not null and domain is not null")
    return rows.groupBy("id").agg(F.min("domain").alias("domain"))


def tokens_of(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def bare(word: Column) -> Column:
    """A word as the lexicon knows it."""
    return F.lower(F.rtrim(word, F.lit(".,;:!?")))


def lexicon(docs: DataFrame, labels: DataFrame, rows: int, words: int) -> dict[str, list[str]]:
    """For each domain the words with the greatest log odds over the other domains, weighted by the root of their frequency.

    Fitted on the `rows` labelled ids with the least hash; what reaches the driver is bounded by domains * words.
    """
    sample = labels.orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.join(F.broadcast(sample), "id")  # at most `rows` ids
    seen = own.select("domain", F.explode(F.array_distinct(F.transform(tokens_of(F.col("text")), bare))).alias("word")).where("word <> ''")
    counts = seen.groupBy("domain", "word").agg(F.count("*").alias("n"))
    sizes = own.groupBy("domain").agg(F.count("*").alias("size"))
    everything = counts.groupBy("word").agg(F.sum("n").alias("all")).where("all >= 5")
    size, total = F.col("size"), F.sum("size").over(W.partitionBy(F.lit(0)))
    rated = counts.join(everything, "word").join(F.broadcast(sizes.withColumn("total", total)), "domain")
    rest = (F.col("all") - F.col("n") + 0.5) / (F.col("total") - size + 1)
    odds = (F.log((F.col("n") + 0.5) / (size + 1)) - F.log(rest)) * F.sqrt("n")
    top = rated.withColumn("odds", odds).where("odds > 0").withColumn("r", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("odds"), "word"))).where(F.col("r") <= words)
    out: dict[str, list[str]] = {}
    for r in top.select("domain", "word").orderBy("domain", "r").collect():
        out.setdefault(r["domain"], []).append(r["word"])
    return out


def within(own: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(own)


def measured(docs: DataFrame, telling: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """docs with n_tokens and the measures; the measures' names."""
    text = F.col("text")
    every = sorted({w for words in telling.values() for w in words})
    rows = docs.withColumn("_words", F.filter(tokens_of(text), lambda w: w != ""))
    rows = rows.withColumn("n_tokens", F.size("_words").cast("long"))
    n = F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")
    rows = rows.withColumn("_hits", F.filter(F.transform("_words", bare), lambda w: w.isin(every)) if every else F.array().cast("array<string>"))
    out = {
        "m_size": F.log1p("n_tokens"),
        "m_width": F.length(text) / n,
        "m_repeat": F.size(F.array_distinct("_words")) / n * 4,
    }
    for i, mark in enumerate(MARKS):
        out[f"m_mark{i}"] = F.sqrt((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / n)
    for i, domain in enumerate(sorted(telling)):
        found = F.size(F.filter("_hits", within(telling[domain])))
        out[f"m_word{i}"] = F.sqrt(found / n) * 4
    return rows.select(*docs.columns, "n_tokens", *[v.alias(k) for k, v in out.items()]), list(out)


def posteriors(docs: DataFrame, labels: DataFrame, lexicon_rows: int = 4000, lexicon_words: int = 24, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(id, n_tokens, p_<domain>...) for each row of docs, written to the shared folder; and the domains that have labels.

    Without any label there is one domain, `all`, with posterior 1.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = written(labelled(labels), "labelled")
    telling = lexicon(rows, known, lexicon_rows, lexicon_words)
    full, names = measured(rows, telling)
    table_ = written(full.drop("text"), "measures")
    stats = table_.join(known, "id").groupBy("domain").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("avg", F.avg), ("var", F.var_pop))])
    found = {r["domain"]: r for r in stats.collect()}
    if not found:
        return table_.select("id", "n_tokens", F.lit(1.0).alias("p_all")), ["all"]
    domains, total = sorted(found), sum(r["n"] for r in found.values())
    logs = []
    for d in domains:
        r = found[d]
        log = F.lit(math.log(r["n"] / total))
        for c in names:
            var = r[f"var_{c}"] + LEAST_VARIANCE
            log = log - (F.col(c) - r[f"avg_{c}"]) * (F.col(c) - r[f"avg_{c}"]) / (2 * var) - 0.5 * math.log(var)
        logs.append(log)
    out = table_.select("id", "n_tokens", F.array(*logs).alias("l"))
    out = out.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    out = out.withColumn("t", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    return written(out.select("id", "n_tokens", *[(F.get("e", F.lit(i)) / F.col("t")).alias(f"p_{d}") for i, d in enumerate(domains)]), "posteriors"), domains


def fit_rates(member: DataFrame, domains: list[str], targets: dict[str, float], steps: int = 40, pull: float = 0.02, tolerance: float = 1e-3, most: float | None = None, anchor: bool = False) -> DataFrame:
    """member with a column rate.

    targets are the domains' shares of the token total (normalised over the domains present).  The total
    stays that of the input; with anchor, it is what keeps the domain with the greatest target whole.  The
    loss adds a weak pull of all rates towards 1, which also makes the solution unique; while the pull itself keeps a
    domain off its target by more than `tolerance` (of the target, or of 0.01 if that is more), it is made ten times
    weaker, until that no longer lowers the miss by a twentieth.  `most` bounds the rates from above, `steps` the steps for each pull.
    """
    p = [F.col(f"p_{d}") for d in domains]
    k = len(domains)
    tokens = F.col("n_tokens").cast("double")
    sums = member.agg(F.sum(tokens).alias("n"), *[F.sum(tokens * x).alias(f"s{i}") for i, x in enumerate(p)]).first()
    total = sums["n"] or 0.0
    wanted = [targets.get(d, 0.0) for d in domains]
    if not total or not sum(wanted):
        return member.withColumn("rate", F.lit(1.0))
    goal = [max(w / sum(wanted), 1e-6) for w in wanted]
    if anchor:
        lead = max(range(k), key=lambda i: goal[i])
        goal = [g * (sums[f"s{lead}"] / total) / goal[lead] for g in goal]
        goal = [max(g, 1e-6) for g in goal]
    # shares instead of totals; each miss is weighed by 1 / goal
    goal = np.array(goal)
    weight = 1 / np.maximum(goal, 0.01)

    def rate_of(price: np.ndarray) -> tuple[Column, Column]:
        """The rate, and the sum of price * posterior."""
        cost = F.lit(0.0)
        for x, y in zip(p, price, strict=True):
            cost = cost + x * F.lit(float(y))
        rate = F.greatest(F.lit(0.0), F.lit(1.0) - cost)
        return (rate if most is None else F.least(F.lit(float(most)), rate)), cost

    def totals(price: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Sum of the documents' losses at these prices, the domains' shares, and the matrix of the documents between the bounds."""
        rate, cost = rate_of(price)
        rows = member.select(*p, tokens.alias("_t"), rate.alias("_r"), cost.alias("_c"))
        r, t = F.col("_r"), F.col("_t")
        free = F.when((r > 0) & (F.lit(True) if most is None else r < float(most)), t).otherwise(F.lit(0.0))
        cells = [F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]
        now = rows.agg(F.sum(t * ((r - 1) * (r - 1) / 2 + r * F.col("_c"))).alias("loss"), *[F.sum(t * r * x).alias(f"s{i}") for i, x in enumerate(p)], *cells).first()
        matrix = np.array([[now[f"m{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) / total
        return now["loss"] / total, np.array([now[f"s{i}"] for i in range(k)]) / total, matrix

    price, miss = np.zeros(k), math.inf
    loss, share, matrix = totals(price)
    while True:
        start, old = price, miss
        for _ in range(steps):
            # the dual of the loss is concave in the prices; slope is its gradient
            slope = share - goal - pull * price / weight
            if np.max(np.abs(slope) * weight) <= tolerance / 10:
                break
            step = np.linalg.solve(matrix + np.diag(pull / weight), slope)
            height = loss - price @ goal - pull / 2 * np.sum(price**2 / weight)
            size = 1.0
            while True:
                new = price + size * step
                found = totals(new)
                rise = found[0] - new @ goal - pull / 2 * np.sum(new**2 / weight) - height
                if rise >= 1e-4 * size * (slope @ step) - 1e-12 or size < 1e-6:
                    break
                size /= 2
            price, (loss, share, matrix) = new, found
        miss = float(np.max(np.abs(share - goal) * weight))
        if miss <= tolerance:
            break
        if miss > 0.95 * old or pull < 1e-9:
            price = start if miss > old else price
            break
        pull /= 10
    miss = min(miss, old)
    if miss > tolerance:
        warnings.warn(f"targets are missed by up to {miss:.3g} of a target, which no nonnegative rates within the bound seem to mend", stacklevel=2)
    return member.withColumn("rate", rate_of(price)[0])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """(id, n_tokens, p_<domain>..., rate, copies) for each row of docs.

    copies is the rate rounded up or down by a hash of the id, so that its mean is the rate.  A null or empty text has
    no tokens; a null id can't be labelled.  Repeated rows are mixed alike.  Other columns are ignored.
    """
    member, domains = posteriors(docs, labels, id_col=id_col, text_col=text_col)
    rated = fit_rates(member, domains, targets, **options)
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col("id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return rated.withColumn("copies", copies).withColumnRenamed("id", id_col)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
