"""What an experiment adds, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from runlens.operators import usage

Rule = Callable[[dict[str, DataFrame]], DataFrame]
Summary = Callable[[DataFrame, Callable], DataFrame]
Reader = Callable[[DataFrame], DataFrame]


class Experiment:
    """The rules, summaries, clients and calibration values of one
    experiment; each part is optional."""

    def __init__(self) -> None:
        self.rules: list[Rule] = []
        self.summaries: dict[str, Summary] = {}
        self.clients: dict[str, Reader] = dict(usage.READERS)
        self.values: dict[str, Callable[..., DataFrame]] = {}
        self.texts: dict[str, DataFrame] = {}

    def register_rule(self, rule: Rule) -> Rule:
        """More findings: (cell, severity, rule, line_no, text)."""
        self.rules.append(rule)
        return rule

    def register_summary(self, name: str, summary: Summary) -> None:
        """Extra report entries from (scores, group metrics)."""
        self.summaries[name] = summary

    def register_client(self, name: str, reader: Reader) -> None:
        """A transcript reader: lines to one row per attempt."""
        self.clients[name] = reader

    def register_values(self, name: str, values: Callable[..., DataFrame]) -> None:
        """Calibration values of archived runs: (run, name, value)."""
        self.values[name] = values

    def register_text(self, name: str, text: DataFrame) -> None:
        """A text per cell (cell, text) the rules find in their evidence."""
        self.texts[name] = text

    def evidence(self, **tables: DataFrame) -> dict[str, DataFrame]:
        """Evidence tables with the registered texts beside them."""
        return {**tables, **self.texts}

    def report(self, scores: DataFrame, metrics: Callable) -> dict[str, DataFrame]:
        return {name: s(scores, metrics) for name, s in self.summaries.items()}
