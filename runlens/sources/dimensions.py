"""Small declared tables: variants, models, calibration references, work."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANT_KEYS = {"label", "retired", "factors"}
MODEL_KEYS = {"tag", "agent", "model", "effort"}
REFERENCE_KEYS = {"variant", "arrangement", "values", "spreads", "spread", "n"}
SPREADS = ("measured", "estimated")


class DeclarationError(ValueError):
    """A declaration that must be mended before any job runs."""


def _known(where: str, table: dict, keys: set[str]) -> None:
    extra = sorted(set(table) - keys)
    if extra:
        raise DeclarationError(f"{where}: unknown key(s) {extra}")


def variants(spark: SparkSession, texts: Iterable[tuple[str, str]], keys: set[str] = VARIANT_KEYS) -> DataFrame:
    """(name, TOML text) of each variant file as a table; unknown keys are
    refused here, before any job."""
    rows = []
    for name, text in texts:
        t = tomllib.loads(text)
        _known(name, t, keys)
        rows.append((name, t.get("label", name), bool(t.get("retired", False)), {k: str(v) for k, v in t.get("factors", {}).items()}))
    return spark.createDataFrame(rows, "variant string, label string, retired boolean, factors map<string,string>")


def models(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(models, agents) of one TOML text; a model whose agent is not declared
    is refused."""
    t = tomllib.loads(text)
    agents = [(name, a.get("client", name)) for name, a in t.get("agents", {}).items()]
    rows = []
    for m in t.get("models", []):
        _known(f"model {m.get('tag')}", m, MODEL_KEYS)
        rows.append(tuple(m.get(k) for k in ("tag", "agent", "model", "effort")))
    a = spark.createDataFrame(agents, "agent string, client string")
    m = spark.createDataFrame(rows, "tag string, agent string, model string, effort string")
    lost = sorted({r[1] for r in rows} - {name for name, _ in agents})
    if lost:
        raise DeclarationError(f"models name undeclared agents {lost}")
    return m, a


def dangling(m: DataFrame, agents: DataFrame) -> DataFrame:
    """Models whose agent is not declared."""
    return m.join(agents.select("agent"), "agent", "left_anti").select(*m.columns)


def reference_breaks(refs: DataFrame) -> DataFrame:
    """What is wrong with calibration references (host, variant, arrangement,
    values, spreads, spread, n), one row per problem."""
    key = ["host", "variant", "arrangement"]
    twice = refs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key, F.lit("appears twice").alias("problem"))
    lost = F.array_except(F.map_keys("spreads"), F.map_keys("values"))
    problems = F.array_compact(F.array(
        F.when(~F.col("spread").isin(*SPREADS), F.lit("spread is not measured or estimated")),
        F.when((F.col("spread") == "measured") & (F.col("n") < 2), F.lit("measured needs n >= 2")),
        F.when(F.size(lost) > 0, F.concat(F.lit("spreads for no value: "), F.array_join(F.array_sort(lost), ",")))))
    own = refs.select(*key, F.explode(problems).alias("problem")).distinct()
    return twice.unionByName(own)


def reference(runs: DataFrame, refs: DataFrame) -> DataFrame:
    """The calibrated values of each run's (variant, arrangement), null where
    it was never calibrated."""
    return runs.join(refs, ["variant", "arrangement"], "left")


def work_specs(spark: SparkSession, root: str) -> DataFrame:
    """Queued work: state and lane from the folder, admission order from the
    number a file name starts with (none sorts last)."""
    schema = "task string, variant string, rep int, fresh boolean"
    s = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(root)
    path = F.col("_metadata.file_path")
    name = F.element_at(F.split(path, "/"), -1)
    number = F.regexp_extract(name, r"^(?:tmp-)?(\d+)\.", 1).try_cast("long")
    parts = F.split(path, "/")
    return s.select("task", "variant", "rep", "fresh", F.element_at(parts, -3).alias("state"), F.element_at(parts, -2).alias("lane"),
                    F.coalesce(number, F.lit((1 << 62))).alias("seq"), F.regexp_replace(F.regexp_replace(name, r"^(?:tmp-)?\d+\.", ""), r"\.json$", "").alias("cid"))


def regimes(spark: SparkSession, path: str) -> DataFrame:
    """Measurement conditions, one JSON object per line; fields beyond the
    time and the event stay in ``rest``."""
    m = F.from_json("value", "map<string,string>")
    return (spark.read.text(path).where("trim(value) <> ''").select(m.alias("m"))
            .select(F.to_timestamp(F.col("m")["ts"]).alias("ts"), F.col("m")["event"].alias("event"),
                    F.map_filter("m", lambda k, v: ~k.isin("ts", "event")).alias("rest")))
