"""Mixing documents to target weights by soft membership, with DataFrame functions alone.

1. A labelled table gives each domain's most telling words. A multinomial logistic regression (MLlib) reads the share of a text's hits
   that each domain's words have, and the text's shape in steps: its length, shares of distinct words, capitals and marks, and words'
   mean length. Its log scores are divided by a temperature, the one of a grid with the least log loss on a held-out fifth of the
   labelled texts. That yields domain posteriors.
2. Document rates r >= least (0 or 1) minimise sum_d (E_d(r) - T_d)^2 / (2 E_d(1)), E_d(r) = sum_i r_i p_id n_i with posterior p and n words,
   by projected gradient from r = 1 in the metric of n: r <- max(least, r - sum_d p_d c_d), c_d = (E_d(r) - T_d) / E_d(1). In this
   metric the curvature is at most 1, so a step of 1 is safe. A rate depends on a text through p alone, so words are summed by distinct
   posterior once; an iteration is one aggregate of that table to as many sums as there are domains, and rates never need to be stored.
   A fit that still moves after ``iterations`` steps raises an error.

Targets are shares of the mixture. By default its size is the smallest at which no domain has to shrink and rates stay at 1 or
more, so texts are repeated, not dropped; with ``total`` as a factor of the corpus, rates below 1, down to 0, drop texts.

Defined cases: null text counts as empty: no words, posterior equal to the prior, rate by that. Domains without any words and
targets of 0 are allowed (rates go to 0 for the latter). Labels that differ in case only are different domains. Of equally likely
domains the first by name is ``domain``. Without labelled rows there is one domain, and all rates are equal.
Rows without id get rates as well. Repeated rows get equal rates. An empty table gives no rows. Clashing column names are harmless: only id
and text are read, and ``apply_rates`` returns the columns it was given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, materialize, sample_share


@dataclass
class Domains:
    names: list[str]
    words: list[list[str]]  # telling words of each domain
    bias: list[float]  # of each domain's log score
    by_share: list[list[float]]  # [domain][word group]
    by_shape: list[list[list[float]]] | None = None  # [domain][shape][step]
    temperature: float = 1.0
    log_loss: float | None = None  # of held-out labelled texts, at this temperature
    log_loss_plain: float | None = None  # and at temperature 1
    accuracy: float | None = None  # of held-out labelled texts


#: Where the steps of each shape begin: number of words, and shares or means of what ``_shape`` counts.
STEPS = {"words": [2, 10, 50, 200], "distinct": [0.2, 0.35, 0.5, 0.65, 0.8], "capitals": [0.01, 0.02, 0.05, 0.1, 0.3], "marks": [0.02, 0.04, 0.06, 0.1, 0.2], "letters": [3, 5, 6, 7, 9]}


def _one(name: str = "all") -> Domains:
    return Domains([name], [[]], [0.0], [[0.0]], [[[0.0] * (len(e) + 1) for e in STEPS.values()]])


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
                most: int = 6_000, words: int = 80, domains: int = 256, penalty: float = 1e-3) -> Domains:
    """Learn from at most ``most`` labelled texts. More labels than ``domains`` are an error: each is a column of the plan.

    labelled: id and label. The vocabulary counted is that of the bounded sample."""
    known = labelled.select(F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("y")).where("i is not null and y is not null")
    names = sorted(r.y for r in known.select("y").distinct().limit(domains + 1).collect())
    if len(names) > domains:
        raise ValueError(f"more than {domains} domains")
    if not names:
        return _one()
    taken = sample_share(known, "i", most / max(1, known.count()), most)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(taken), "i")  # bounded by most
    held = F.pmod(F.xxhash64("i", F.lit(13)), F.lit(5)) == 0
    every = materialize(_described(texts.select("y", held.alias("held"), "t"), "t").drop("t"), "mix-sample")
    texts = every.where("not held")
    sizes = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = [y for y in names if y in sizes]
    if len(names) < 2:
        return _one(*names)
    place = (F.array_position(F.lit(names), F.col("y")) - 1).cast("int").alias("k")
    seen = texts.where(F.col("y").isin(names)).select(place, F.explode("__w").alias("w")).where("w <> ''").groupBy("w").pivot("k", list(range(len(names)))).count().na.fill(0)
    score = []
    for k, y in enumerate(names):  # log odds of appearing, weighed by how often
        here = (F.col(f"`{k}`") + .5) / (sizes[y] + 1)
        rest = sum(sizes.values()) - sizes[y]
        there = (sum((F.col(f"`{z}`") for z in range(len(names)) if z != k), F.lit(0)) + .5) / (rest + 1)
        score.append(F.struct((F.log(here / there) * F.sqrt(here)).alias("s"), F.lit(k).alias("k")))
    ranked = seen.select("w", F.explode(F.array(*score)).alias("x")).select("w", "x.s", "x.k").where("s > 0")
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "w"))).where(F.col("r") <= words)
    groups: list[list[str]] = [[] for _ in names]
    for r in top.orderBy("k", "r").collect():
        groups[r.k].append(r.w)
    rows = _measured(every.where(F.col("y").isin(names)), groups)
    steps = [F.array(*((F.col(f"__s{s}") == x).cast("double") for x in range(len(e) + 1))) for s, e in enumerate(STEPS.values())]
    shares = F.array(*(F.col(f"__h{k}") for k in range(len(groups))))
    # Four parts at most: the regression sums so few without a shuffle in each of its steps.
    rows = materialize(rows.select("held", place.alias("label"), *(f"__h{k}" for k in range(len(groups))), *(f"__s{s}" for s in range(len(STEPS))), array_to_vector(F.concat(shares, *steps)).alias("v")).coalesce(4), "mix-rows")
    fitted = LogisticRegression(featuresCol="v", labelCol="label", family="multinomial", regParam=penalty, maxIter=100).fit(rows.where("not held").withColumn("label", F.col("label").cast("double")))
    weights, starts = fitted.coefficientMatrix.toArray(), np.cumsum([len(groups), *(len(e) + 1 for e in STEPS.values())])
    model = Domains(names, groups, fitted.interceptVector.toArray().tolist(), weights[:, :len(groups)].tolist(),
                    [[w[a:b].tolist() for a, b in zip(starts, starts[1:])] for w in weights])
    tested = rows.where("held").select("label", *(x.alias(f"__l{d}") for d, x in enumerate(_evidence(model)))).withColumn("t", F.explode(F.lit(TEMPERATURES)))
    scores = F.array(*(F.col(f"__l{d}") for d in range(len(names))))
    right = (F.array_position(scores, F.array_max(scores)) - 1 == F.col("label")).cast("int")
    losses = tested.groupBy("t").agg(F.avg(_log_loss(len(names))).alias("loss"), F.avg(right).alias("right")).orderBy("loss", "t").collect()
    if losses:
        model.temperature, model.log_loss, model.accuracy = losses[0].t, losses[0].loss, losses[0].right
        model.log_loss_plain = next(r.loss for r in losses if r.t == 1)
    discard(every)
    discard(rows)
    return model


#: Temperatures tried for the classifier's log scores.
TEMPERATURES = [2.0 ** (k / 2) for k in range(-2, 15)]


def _described(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with __n, the number of words, __w, the distinct words in lower case, and __s0, __s1, ...: the step of each shape."""
    text, kept = F.coalesce(F.col(text_col), F.lit("")), df.columns
    df = df.withColumn("__a", F.split(F.lower(text), SPACE))
    df = df.select(*kept, (F.size("__a") - F.size(F.filter("__a", lambda x: x == ""))).alias("__n"), F.array_distinct("__a").alias("__w"))
    long = F.greatest(F.length(text), F.lit(1))

    def share(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / long

    size = F.greatest(F.col("__n"), F.lit(1))
    values = [F.col("__n"), F.size("__w") / size, share("[A-Z]+"), share("[!-/:-@\\[-`{-~]+"), F.length(text) / size]
    return df.withColumns({f"__s{k}": _step(v, e) for k, (v, e) in enumerate(zip(values, STEPS.values()))})


def _step(value: Column, edges: list[float]) -> Column:
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _measured(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """``df`` with __h0, __h1, ...: the share of the hits on all groups' words that each group has, in sixteenths, so that many texts have
    one posterior."""
    kept = df.columns
    df = df.select("*", *(_hits(F.col("__w"), g).alias(f"__c{k}") for k, g in enumerate(groups)))
    total = F.greatest(sum((F.col(f"__c{k}") for k in range(len(groups))), F.lit(0)), F.lit(1))
    return df.select(*kept, *((F.round(16 * F.col(f"__c{k}") / total) / 16).alias(f"__h{k}") for k in range(len(groups))))


def _evidence(model: Domains) -> list[Column]:
    """Log scores of the domains from the columns __h and __s."""
    out = []
    for bias, by_share, by_shape in zip(model.bias, model.by_share, model.by_shape or [[]] * len(model.names)):
        score = F.lit(bias)
        for k in range(len(model.words)):
            score = score + F.col(f"__h{k}") * F.lit(by_share[k])
        for s, w in enumerate(by_shape):
            score = score + F.element_at(F.lit(w), F.col(f"__s{s}") + 1)
        out.append(score)
    return out


def _log_loss(n: int) -> Column:
    """Of label number ``label``, from the columns __l of log scores and the temperature t."""
    scores = F.array(*(F.col(f"__l{d}") / F.col("t") for d in range(n)))
    best = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - best))
    return best + F.log(total) - F.element_at(scores, F.col("label") + 1)


def _hits(distinct: Column, words: list[str]) -> Column:
    return F.size(F.array_intersect(distinct, F.lit(words) if words else F.array().cast("array<string>")))


def posteriors(docs: DataFrame, model: Domains, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns: __n, the number of words, and __p, the posterior of each domain."""
    kept = docs.columns
    df = _measured(_described(docs, text_col), model.words)
    names = [f"__l{d}" for d in range(len(model.names))]
    df = df.select(*kept, "__n", *((x / model.temperature).alias(n) for n, x in zip(names, _evidence(model))))
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    df = df.withColumn("__m", best)
    df = df.select(*kept, "__n", *(F.exp(F.col(x) - F.col("__m")).alias(x) for x in names))
    total = sum((F.col(x) for x in names[1:]), F.col(names[0]))
    return df.select(*kept, "__n", F.array(*(F.col(x) / total for x in names)).alias("__p"))


def rate(p: Column, steps: list[list[float]], least: float = 0.0, start: Column | None = None) -> Column:
    """The rate after the given gradient steps from ``start`` (1 by default), as one expression."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start

    def step(r: Column, c: Column) -> Column:
        down = F.aggregate(F.zip_with(p, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(least), r - down)

    return F.aggregate(F.array(*(F.lit(c) for c in steps)), start, step)


@dataclass
class Mixture:
    model: Domains
    steps: list[list[float]]
    targets: list[float]  # words
    reached: list[float]
    least: float
    at_bound: bool = False  # whether rates at their least keep a target from being met


def fit_rates(scored: DataFrame, model: Domains, targets: dict[str, float] | None = None, total: float | None = None,
              iterations: int = 300, tolerance: float = 2e-3) -> Mixture:
    """scored: __n and __p of every document. targets: shares by domain; domains not named share what the named ones leave.

    The fit ends when each domain is off by ``tolerance`` of its own target at most; or, ``at_bound``, when a step moves no domain by a
    tenth of that, as what is left of the gradient points out of the allowed rates: a domain that may not shrink, or whose texts are
    partly another domain's, cannot meet every target. ``targets`` and ``reached`` tell how far off each domain is then."""
    size = range(len(model.names))
    least = 1.0 if total is None else 0.0
    cells = materialize(scored.groupBy("__p").agg(F.sum("__n").alias("__n")).withColumn("__r", F.lit(1.0)), "mix-cells")

    def sums(steps: list[list[float]]) -> list[float]:
        # The rate is a column of its own: inside each domain's sum the plan would hold all steps that many times.
        rated = cells.withColumn("__r", rate(F.col("__p"), steps, least, F.col("__r")))
        row = rated.agg(*(F.sum(F.col("__r") * F.col("__n") * F.element_at("__p", d + 1)).alias(f"s{d}") for d in size)).first()
        return [float(x or 0) for x in row]

    have = sums([])
    shares = dict(targets or {})
    rest = [y for y in model.names if y not in shares]
    shares |= {y: max(0.0, 1 - sum(shares.values())) / len(rest) for y in rest}
    weight = [max(0.0, shares[y]) for y in model.names]
    weight = [w / (sum(weight) or 1) for w in weight]
    corpus = sum(have)
    if total is None:
        size_all = max((h / w for h, w in zip(have, weight) if w > 0), default=corpus)
    else:
        size_all = total * corpus
    goal = [size_all * w for w in weight]
    steps: list[list[float]] = []
    now, written, at_bound = have, 0, False
    for _ in range(iterations + 1):
        if all(abs(a - b) <= max(tolerance * b, 0.5) for a, b in zip(now, goal)):
            break
        steps.append([(a - b) / h if h else 0.0 for a, b, h in zip(now, goal, have)])
        before, now = now, sums(steps[written:])
        if all(abs(a - b) <= max(tolerance / 10 * g, 0.01) for a, b, g in zip(now, before, goal)):
            at_bound = True
            break
        if len(steps) - written == 16:  # rates so far are written, so that no step repeats all those before it
            further = materialize(cells.withColumn("__r", rate(F.col("__p"), steps[written:], least, F.col("__r"))), "mix-cells")
            discard(cells)
            cells, written = further, len(steps)
    else:
        raise RuntimeError(f"rates still move after {iterations} steps: {now} for {goal}")
    discard(cells)
    return Mixture(model, steps, goal, now, least, at_bound)


def copies(of_rate: Column, id_col: str, seed: int = 11) -> Column:
    """Whole copies, plus one more for the fraction of ids that hash below the rest."""
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.ceil(of_rate - chance).cast("int")


def mix(docs: DataFrame, model: Domains, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> tuple[DataFrame, Mixture]:
    """One row per document: id, n_words, domain (likeliest), posterior of each domain, rate, copies; and the fitted mixture."""
    rows = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t"))
    scored = materialize(posteriors(rows, model, "__t").drop("__t"), "mix-scored")
    fitted = fit_rates(scored, model, targets, **how)
    r = rate(F.col("__p"), fitted.steps, fitted.least)
    domain = F.element_at(F.lit(model.names), F.array_position("__p", F.array_max("__p")).cast("int"))
    lower = [y.lower() for y in model.names]  # columns may not differ in case only
    shares = [F.element_at("__p", d + 1).alias(f"p_{y}" if lower.count(y.lower()) == 1 else f"p{d}_{y}") for d, y in enumerate(model.names)]
    # The likeliest domain's expected words in the mixture: wanted, and reached.
    words = [F.element_at(F.lit([float(x) for x in v]), F.array_position("__p", F.array_max("__p")).cast("int")).alias(n) for n, v in (("target_words", fitted.targets), ("mixed_words", fitted.reached))]
    out = scored.select(F.col("__i").alias(id_col), F.col("__n").cast("long").alias("n_words"), domain.alias("domain"), *shares, r.alias("rate"), *words)
    return out.withColumn("copies", copies(F.col("rate"), id_col)), fitted


def apply_rates(docs: DataFrame, model: Domains, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` mixed to the targets: each row as many times as its rate says, with its own columns."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # no clash with the names used here
    own, i, t = docs.toDF(*names), names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    scored = materialize(posteriors(own.select(t), model, t).drop(t), "mix-scored")
    fitted = fit_rates(scored, model, targets, **how)
    discard(scored)
    again = posteriors(own, model, t)  # cheaper than moving whole texts to a join
    n = copies(rate(F.col("__p"), fitted.steps, fitted.least), i)
    return again.withColumn("__k", F.explode(F.array_repeat(F.lit(1), n))).select(*names).toDF(*docs.columns)
