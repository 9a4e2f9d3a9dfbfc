"""Trust checks: findings per cell and the verdict they add up to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import faults, text
from runlens.operators import ledger as L
from runlens.session import cut_lineage

JUDGED = ("green", "charged")
NOT_CHARGED = ("refunded", "interrupted")
NOT_CHARGED_WARN_AT = 3
# Fixed patterns: the names of archived runs, and of those before end states.
RUN_NAME = r"^(\d+)-a(\d+)-(.+)-(green|charged|refunded|interrupted)$"
LEGACY_NAME = r"^(\d+)-(.+)$"
FINDING = "cell, severity, rule, line_no, text"


def archived_runs(dirs: DataFrame) -> DataFrame:
    """Attempt, shape and end state out of a run folder's ``name``; folders
    from before end states have neither, and other names are left out."""
    part = lambda i: F.regexp_extract("name", RUN_NAME, i)
    new = F.col("name").rlike(RUN_NAME)
    return dirs.where(F.col("name").rlike(LEGACY_NAME)).select(
        "*", F.when(new, part(2).try_cast("long")).alias("attempt"),
        F.when(new, part(3)).otherwise(F.regexp_extract("name", LEGACY_NAME, 2)).alias("shape"),
        F.when(new, part(4)).alias("end_state"))


def judged() -> Column:
    return F.col("end_state").isNull() | F.col("end_state").isin(*JUDGED)


def end_state(ok: Column, charge: Column, verdict: Column) -> Column:
    """What became of a run: interrupted when no verdict came back."""
    return F.when(~verdict, "interrupted").when(ok, "green").when(charge, "charged").otherwise("refunded")


def refunds(runs: DataFrame) -> DataFrame:
    """A warning for cells whose runs keep being refunded: three in all, or
    any stage twice. Runs have cell, end_state, stage."""
    free = runs.where(F.col("end_state").isin(*NOT_CHARGED)).select("cell", F.coalesce("stage", "end_state").alias("stage"))
    by = free.groupBy("cell", "stage").agg(F.count(F.lit(1)).alias("n"))
    # one entry per stage name
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", "n"))),
                                      lambda x: F.concat(x["stage"], F.lit("x"), x["n"].cast("string"))), ", ")
    g = by.groupBy("cell").agg(F.sum("n").alias("all"), F.max("n").alias("most"), listed.alias("detail"))
    return g.where((F.col("all") >= NOT_CHARGED_WARN_AT) | (F.col("most") > 1)).select(
        "cell", F.concat(F.col("all").cast("string"), F.lit(" verify run(s) not charged ("), "detail", F.lit(")")).alias("text"))


def archive_mismatches(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Attempts whose archived end state and ledger verdict differ, from the
    first attempt the archive labels; attempts without an edit are left out."""
    labelled = runs.where(F.col("end_state").isNotNull() & (F.col("attempt") > 0))
    first = labelled.groupBy("cell").agg(F.min("attempt").alias("_first"))
    note = F.coalesce(F.try_element_at("fields", F.lit(2)), F.lit(""))
    iters = ledger.where(L.is_("ITER") & F.col("fields")[0].isin(*L.ITER_RESULTS) & ~F.contains(note, F.lit("stage=no-edit"))).select(
        "cell", "line_no", text.attempt_of(note).alias("attempt"),
        F.when(F.col("fields")[0] == "green", "green").otherwise("charged").alias("state"))
    led = (iters.where("attempt IS NOT NULL").groupBy("cell", "attempt").agg(F.max_by("state", "line_no").alias("ledger"))
           .join(first, "cell").where("attempt >= _first").drop("_first"))
    arc = labelled.groupBy("cell", "attempt").agg(
        F.when(F.bool_or(F.col("end_state") == "charged"), "charged").when(F.bool_or(F.col("end_state") == "green"), "green").alias("archive"))
    j = led.join(arc.where("archive IS NOT NULL"), ["cell", "attempt"], "full_outer")
    return j.where(~F.col("ledger").eqNullSafe(F.col("archive"))).select("cell", "attempt", F.concat(
        F.lit("archive/ledger mismatch at attempt "), F.col("attempt").cast("string"), F.lit(": ledger "),
        F.coalesce("ledger", F.lit("no verdict")), F.lit(", archive "), F.coalesce("archive", F.lit("no judged run"))).alias("text"))


def integrity_alerts(ledger: DataFrame) -> DataFrame:
    what = F.element_at("fields", -1)
    return ledger.where(L.is_("ALERT") & F.startswith(what, F.lit("INTEGRITY "))).select(
        "cell", "line_no", F.concat(F.lit("a verify changed the cell's record: "), F.left(F.substr(what, F.lit(11)), F.lit(100))).alias("text"))


def charged_walls(ledger: DataFrame, logs: DataFrame) -> DataFrame:
    """Attempts charged although their log says a provider wall ended them.
    ``logs`` are lines with cell, attempt, line_no, line. A plain log decides
    only for an untouched tree."""
    note = F.coalesce(F.try_element_at("fields", F.lit(2)), F.lit(""))
    it = ledger.where(L.is_("ITER") & F.col("fields")[0].isin("fail", "budget")).select(
        "cell", F.col("line_no").alias("at"), text.attempt_of(note).alias("attempt"), F.contains(note, F.lit("stage=no-edit")).cast("int").alias("rc"))
    j = it.join(faults.read_logs(logs, ("cell", "attempt")), ["cell", "attempt"])
    kind = faults.classify(F.col("rc"))
    return j.select("cell", F.col("at").alias("line_no"), kind.alias("kind"), "attempt", faults.reason().alias("why")).where("kind IS NOT NULL").select(
        "cell", "line_no", F.concat(F.lit("attempt "), F.col("attempt").cast("string"), F.lit(" charged on a provider "), "kind",
                                    F.lit(" wall: "), F.left("why", F.lit(80))).alias("text"))


def rule_findings(breaks: DataFrame) -> DataFrame:
    told = F.lit("")
    for n, says in L.RULES.items():
        told = F.when(F.col("rule") == n, says).otherwise(told)
    return breaks.select("cell", "line_no", F.concat(
        F.lit("ledger rule "), F.col("rule").cast("string"), F.lit(" broken at line "), F.col("line_no").cast("string"), F.lit(" ("), told,
        F.lit("): "), F.left(F.trim("line"), F.lit(100))).alias("text"))


def unreliable(footprints: DataFrame) -> DataFrame:
    f = footprints.where(~F.col("reliable"))
    extra = lambda c, tail: F.when(F.col(c) > 0, F.concat(F.lit(", "), F.lit("of " if tail == "" else ""), F.col(c).cast("string"), F.lit(tail))).otherwise("")
    return f.select("cell", F.concat(F.lit("footprint unreliable ("), F.col("unreliable_samples").cast("string"), F.lit(" sample(s) disagreed"),
                                     extra("unchecked_samples", " unchecked"), extra("samples", ""), F.lit(")")).alias("text"))


Rule = Callable[[dict[str, DataFrame]], DataFrame]


def findings(evidence: dict[str, DataFrame], budget: int | None = None, rules: Sequence[Rule] = ()) -> DataFrame:
    """Every finding as (cell, severity, rule, line_no, text). ``evidence`` has
    ledger, and where there are any logs, runs and footprints. ``rules`` map
    the evidence to more findings of that shape. The ledger and the runs, which
    one check after another reads, are put together once."""
    evidence = {name: cut_lineage(df) if name in ("ledger", "runs") else df for name, df in evidence.items()}
    led = evidence["ledger"]
    parts: list[tuple[str, str | None, DataFrame]] = [
        ("1-rules", "taint", rule_findings(L.rule_breaks(led, budget))),
        ("2-integrity", "taint", integrity_alerts(led)),
        ("3-rig-output", None, L.rig_output(led)),
        ("4-rig-abort", "warn", led.where(F.contains(F.concat_ws("\t", "fields"), F.lit("ERROR[rig]"))).groupBy("cell").agg(F.min("line_no").alias("line_no")).select(
            "cell", "line_no", F.lit("a reverify aborted on a rig fault (green intact, gate incomplete)").alias("text")))]
    if "logs" in evidence:
        parts.append(("5-wall", "taint", charged_walls(led, evidence["logs"])))
    if "footprints" in evidence:
        parts.append(("6-footprint", "warn", unreliable(evidence["footprints"])))
    if "runs" in evidence:
        parts.append(("7-refunds", "warn", refunds(evidence["runs"])))
        parts.append(("8-archive", "warn", archive_mismatches(evidence["runs"], led).withColumnRenamed("attempt", "line_no")))
    out = None
    for name, severity, df in parts:
        sev = F.col("severity") if severity is None else F.lit(severity)
        at = F.col("line_no") if "line_no" in df.columns else F.lit(0)
        shaped = df.select("cell", sev.alias("severity"), F.lit(name).alias("rule"), at.cast("long").alias("line_no"), "text")
        out = shaped if out is None else out.unionByName(shaped)
    for rule in rules:
        out = out.unionByName(rule(evidence).select("cell", "severity", "rule", F.col("line_no").cast("long").alias("line_no"), "text"))
    return out


def verdicts(cells: DataFrame, found: DataFrame) -> DataFrame:
    """TAINTED when a cell has any taint, with its first one."""
    taint = F.col("severity") == "taint"
    order = F.struct("rule", "line_no", "text")
    g = found.groupBy("cell").agg(
        F.count_if(taint).alias("taints"), F.count_if(~taint).alias("warns"),
        F.min_by(F.when(taint, F.col("text")), F.when(taint, order)).alias("first_taint"))
    return cells.select("cell").join(g, "cell", "left").select(
        "cell", F.when(F.col("taints") > 0, "TAINTED").otherwise("VALID").alias("verdict"), F.coalesce("taints", F.lit(0)).alias("taints"),
        F.coalesce("warns", F.lit(0)).alias("warns"), "first_taint")


def tally(validations: DataFrame) -> DataFrame:
    """Cells by outcome, with how many are valid, tainted, held, and valid
    with warnings. Rows have outcome, verdict (null while held), warns."""
    v = F.col("verdict")
    return validations.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(v == "VALID").alias("valid"), F.count_if(v == "TAINTED").alias("tainted"),
        F.count_if(v.isNull()).alias("held"), F.count_if((v == "VALID") & (F.col("warns") > 0)).alias("with_warnings"))


def warning_recap(found: DataFrame) -> DataFrame:
    """Each kind of warning with the number of cells it hits."""
    w = found.where("severity = 'warn'").select("cell", text.warning_kind(F.col("text")).alias("kind")).distinct()
    return w.groupBy("kind").agg(F.count(F.lit(1)).alias("cells"))


def missing_outputs(required: DataFrame, outputs: DataFrame, slack_s: float = 1.0) -> DataFrame:
    """Required outputs a run did not write: absent, or older than the run.
    ``required`` has run, name, started; ``outputs`` run, name, mtime."""
    j = required.join(outputs, ["run", "name"], "left")
    return j.where(~F.coalesce(F.col("mtime") >= F.col("started") - slack_s, F.lit(False))).select("run", "name")
