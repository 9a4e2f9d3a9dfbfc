"""Mixing sources to target weights, with soft membership of documents in domains."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import log, pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.shared import SPACE, whole, written

#: Up to so many domains each is compiled on its own; more are looped over as arrays.
UNROLLED = 32
#: Chance that a document's source names its domain.
TRUST = 0.9
#: Steps of the fit at most, and the relative error of each total at which it ends.
STEPS, CLOSE = 12, 1e-3
FEATURES = ("log_words", "word_chars", "wide", "word_lines")


def tokens(text: Column) -> Column:
    """Words of a whole text."""
    return F.regexp_count(whole(text), F.lit(SPACE.replace("[", "[^"))).cast("long")


def features(text: Column, words: Column) -> dict[str, Column]:
    """What the classifier measures of a whole text."""
    body, some = whole(text), F.greatest(words, F.lit(1))
    size, chars = F.octet_length(body), F.length(body)
    lines = F.regexp_count(body, F.lit("\n"))
    return {"log_words": F.log1p(words), "word_chars": chars / some, "wide": (size - chars) / F.greatest(size, F.lit(1)), "word_lines": lines / some}


def _measured(docs: DataFrame, text: str, source: str) -> DataFrame:
    """``docs`` in a struct ``row``, with tokens and features."""
    cells = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(source), F.lit("")).alias("source"),
                        tokens(F.col(text)).alias("tokens"))
    return cells.select("row", "source", "tokens", *[c.alias(n) for n, c in features(F.col("row")[text], F.col("tokens")).items()])


@dataclass
class Mixer:
    """The classifier and the steps of the fit: numbers of domains, as literals."""

    names: list[str]
    prior: list[float]
    mean: list[list[float]]
    spread: list[list[float]]
    totals: list[float] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)
    least: float = 0.0

    def with_posterior(self, measured: DataFrame) -> DataFrame:
        """``measured`` and P(domain | source, features) as the array ``posterior``: normal densities for each domain.

        Up to UNROLLED, each domain is plain arithmetic, in stages that name a value
        once, so all of it is compiled. A source that the fit has not seen names no domain."""
        count = len(self.names)
        numbers = F.create_map(*[F.lit(x) for i, n in enumerate(self.names) for x in (n, i)])
        own = F.coalesce(F.try_element_at(numbers, F.col("source")), F.lit(-1))
        right, wrong = log(TRUST) if count > 1 else 0.0, log((1 - TRUST) / max(1, count - 1))
        if count > UNROLLED:
            return self._looped(measured.withColumn("_own", own), measured.columns, right, wrong)

        def score(k: int) -> Column:
            total = F.lit(log(self.prior[k]) - sum(log(2 * pi * d) / 2 for d in self.spread[k])) + F.when(F.col("_own") == k, right).otherwise(wrong)
            for name, mean, spread in zip(FEATURES, self.mean[k], self.spread[k], strict=True):
                off = F.col(name) - mean
                total = total - off * off / (2 * spread)
            return total.alias(f"_s{k}")

        names = measured.columns
        scored = measured.withColumn("_own", own).select(*names, *[score(k) for k in range(count)])
        top = F.greatest(*[F.col(f"_s{k}") for k in range(count)]) if count > 1 else F.col("_s0")
        odds = scored.withColumn("_top", top).select(*names, *[F.exp(F.col(f"_s{k}") - F.col("_top")).alias(f"_o{k}") for k in range(count)])
        whole_odds = odds.withColumn("_sum", sum((F.col(f"_o{k}") for k in range(1, count)), F.col("_o0")))
        shares = F.array(*[F.col(f"_o{k}") / F.col("_sum") for k in range(count)])
        # What an explode makes is a column of its own: a filter on it is not
        # rewritten into the arithmetic above, which would multiply with each stage.
        return whole_odds.select(*names, F.explode_outer(F.array(shares)).alias("posterior"))

    def _looped(self, owned: DataFrame, names: list[str], right: float, wrong: float) -> DataFrame:
        """The same over arrays, whose expression does not grow with the steps of the arithmetic."""
        domains = F.array(*[F.struct(F.lit(log(prior) - sum(log(2 * pi * d) / 2 for d in spread)).alias("base"),
                                     *[F.lit(m).alias(f"m_{f}") for f, m in zip(FEATURES, mean, strict=True)],
                                     *[F.lit(d).alias(f"d_{f}") for f, d in zip(FEATURES, spread, strict=True)])
                            for prior, mean, spread in zip(self.prior, self.mean, self.spread, strict=True)])

        def score(x: Column, k: Column) -> Column:
            total = x["base"] + F.when(F.col("_own") == k, right).otherwise(wrong)
            for f in FEATURES:
                total = total - (F.col(f) - x[f"m_{f}"]) * (F.col(f) - x[f"m_{f}"]) / (2 * x[f"d_{f}"])
            return total

        scored = owned.select(*names, F.explode_outer(F.array(F.transform(domains, score))).alias("_s")).withColumn("_top", F.array_max("_s"))
        odds = scored.select(*names, F.explode_outer(F.array(F.transform("_s", lambda x: F.exp(x - F.col("_top"))))).alias("_o"))
        summed = odds.withColumn("_sum", F.aggregate("_o", F.lit(0.0), lambda a, x: a + x))
        return summed.select(*names, F.explode_outer(F.array(F.transform("_o", lambda x: x / F.col("_sum")))).alias("posterior"))

    def with_rate(self, rows: DataFrame) -> DataFrame:
        """``rows`` and ``rate`` of their posteriors: from one, each step goes against its gradient and back to ``least`` or more."""
        first = F.lit(max(1.0, self.least))
        if not self.steps:
            return rows.withColumn("rate", first)
        history = F.array(*[F.array(*[F.lit(x) for x in g]) for g in self.steps])

        def fold(p: Column) -> Column:
            def step(rate: Column, gradient: Column) -> Column:
                along = F.aggregate(F.zip_with(p, gradient, lambda a, g: a * g), F.lit(0.0), lambda a, x: a + x)
                return F.greatest(F.lit(self.least), rate - along)

            return F.aggregate(history, first, step)

        # the posterior stands in an array of one, so it is computed once for all steps
        return rows.withColumn("rate", F.get(F.transform(F.array("posterior"), fold), F.lit(0)))


def classifier(measured: DataFrame, labels: DataFrame, doc_id: str) -> Mixer:
    """Learns a domain for each source: from its labelled documents, all of them, or
    from all its documents where none is labelled. Documents of the latter kind
    weigh as much as a labelled source's do on average. A domain's spread is
    smoothed with that of all."""
    named = labels.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    light = measured.select(F.col("row")[doc_id].cast("long").alias("_id"), "source", *FEATURES)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f) ** k).alias(f"{f}{k}") for f in FEATURES for k in (1, 2)]]
    docs = dict(measured.groupBy("source").count().collect())
    if not docs:
        return Mixer([], [], [], [])
    known = [r.asDict() | {"weight": 1.0} for r in light.join(named, "_id", "left_semi").groupBy("source").agg(*sums).collect()]
    rest = sorted(docs.keys() - {r["source"] for r in known})
    if rest:
        share = sum(r["n"] for r in known) / sum(docs[r["source"]] for r in known) if known else 1.0
        known += [r.asDict() | {"weight": share} for r in light.where(F.col("source").isin(rest)).groupBy("source").agg(*sums).collect()]
    top = sorted(known, key=lambda r: (-r["n"] * r["weight"], r["source"]))
    n = sum(r["n"] * r["weight"] for r in top)
    both = {f: sum(r[f"{f}1"] * r["weight"] for r in top) / n for f in FEATURES}
    spread = {f: max(1e-6, sum(r[f"{f}2"] * r["weight"] for r in top) / n - both[f] ** 2) for f in FEATURES}
    mean = [[(r[f"{f}1"] + both[f]) / (r["n"] + 1) for f in FEATURES] for r in top]
    own = [[max(1e-6, (r[f"{f}2"] - 2 * m * r[f"{f}1"] + r["n"] * m * m + 10 * spread[f]) / (r["n"] + 10)) for f, m in zip(FEATURES, ms, strict=True)]
           for r, ms in zip(top, mean, strict=True)]
    return Mixer([r["source"] for r in top], [r["n"] * r["weight"] / n for r in top], mean, own)


def tempered(totals: Sequence[float], power: float) -> list[float]:
    """Targets whose shares are the natural ones to a power, as large in all as it
    takes that no domain has to shrink."""
    shares = [t ** power if t > 0 else 0.0 for t in totals]
    scale = max((t / s for t, s in zip(totals, shares, strict=True) if s), default=0.0)
    return [s * scale for s in shares]


def fit(docs: DataFrame, labels: DataFrame, power: float, targets: dict[str, float] | None = None, least: float = 0.0, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> Mixer:
    """Fits rates r >= ``least`` so that the expected tokens of each domain,
    sum of tokens * posterior * r, come closest to its target in least squares.

    Each source is a domain. Targets are token totals by domain, zero for domains
    they leave out; a target of no domain is an error. Without them, natural totals
    are tempered by ``power``. Each step of the projected gradient is one aggregate over the
    table of tokens and posteriors. Errors are weighed by the inverse of the
    domains' overlap, the sum of tokens * posterior_i * posterior_j: in that metric
    the curvature is one, so a full step is safe, and a single one is enough
    until rates meet their bound. The driver holds numbers of domains alone."""
    measured = _measured(docs, text, source)
    mixer = classifier(measured, labels, doc_id)
    mixer.least = least
    if not mixer.names:
        return mixer
    if unknown := sorted((targets or {}).keys() - set(mixer.names)):
        raise ValueError(f"targets of no domain: {unknown}")
    state = written(mixer.with_posterior(measured.select("source", "tokens", *FEATURES)).select("tokens", "posterior"))
    count = len(mixer.names)

    def sums() -> list[float]:
        weighed = mixer.with_rate(state).select((F.col("tokens") * F.col("rate")).alias("w"), "posterior")
        if count > UNROLLED:
            by_domain = dict(weighed.select("w", F.posexplode("posterior")).groupBy("pos").agg(F.sum(F.col("w") * F.col("col"))).collect())
            return [by_domain.get(k) or 0.0 for k in range(count)]
        row = weighed.agg(*[F.sum(F.col("w") * F.get("posterior", F.lit(k))).alias(f"t{k}") for k in range(count)]).first()
        return [x or 0.0 for x in row]

    overlap = np.zeros((count, count))
    if count > UNROLLED:
        each = state.select("posterior", F.posexplode("posterior").alias("i", "a"), "tokens").select("i", (F.col("a") * F.col("tokens")).alias("w"), "posterior")
        cells = each.select("i", "w", F.posexplode("posterior").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("w") * F.col("b"))).collect()
        for i, j, x in cells:
            overlap[i, j] = x or 0.0
        overlap = (overlap + overlap.T) / 2
    else:
        pairs = [(i, j) for i in range(count) for j in range(i + 1)]
        row = state.agg(*[F.sum(F.col("tokens") * F.get("posterior", F.lit(i)) * F.get("posterior", F.lit(j))).alias(f"g{i}_{j}") for i, j in pairs]).first()
        for (i, j), x in zip(pairs, row, strict=True):
            overlap[i, j] = overlap[j, i] = x or 0.0
    mixer.totals = overlap.sum(axis=1).tolist()
    mixer.targets = [targets.get(n, 0.0) for n in mixer.names] if targets else tempered(mixer.totals, power)
    overlap += np.eye(count) * max(1e-9 * np.trace(overlap) / count, 1e-9)
    for _ in range(STEPS):
        error = np.array(sums()) - mixer.targets
        if (abs(error) <= CLOSE * np.maximum(mixer.targets, 1.0)).all():
            break
        mixer.steps.append(np.linalg.solve(overlap, error).tolist())
    return mixer


def rates(docs: DataFrame, mixer: Mixer, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` in a struct ``row`` with ``source, tokens, posterior, rate, copies``.

    The rate's whole part is certain, its fraction a chance by a seeded hash of the
    id. A null text has no tokens; a null source is the source of an empty name;
    rows that repeat an id have equal chances. Rates are an expression of the row
    and the fitted numbers, so nothing is joined or shuffled."""
    measured = _measured(docs, text, source)
    if not mixer.names:
        return measured.select("row", "source", "tokens", F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    chance = F.shiftrightunsigned(F.xxhash64(F.col("row")[doc_id], F.lit(seed)), 11) / float(1 << 53)
    rated = mixer.with_rate(mixer.with_posterior(measured).select("row", "source", "tokens", "posterior"))
    return rated.select("*", F.floor(F.col("rate") + chance).cast("int").alias("copies"))


def mixed(docs: DataFrame, mixer: Mixer, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    each = rates(docs, mixer, seed).where("copies > 0")
    return each.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
