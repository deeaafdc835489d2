"""Whole conversion: source events to checked, written object-centric relations."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tracewright.config import VOCABULARY, LogSpec, SourceColumns, Vocabulary
from tracewright.operators import checks
from tracewright.operators.mapping import Relations, relations_of, transformation_stats
from tracewright.operators.match import match_messages
from tracewright.operators.skew import Skew
from tracewright.session import materialize, prepare, size_shuffles
from tracewright.sources.documents import document_violations, require_valid, write_documents
from tracewright.sources import xes
from tracewright.sources.relational import write_relational


def read_event_logs(spark: SparkSession, specs: Iterable[LogSpec],
                    names: SourceColumns = SourceColumns()
                    ) -> tuple[DataFrame | None, list[dict[str, str]]]:
    """Source events of all readable logs in one scan, and error rows for the others."""
    return xes.read_event_logs(spark, {spec.name: spec.events for spec in specs}, names)


def convert(src: DataFrame, folder: str | None = None, strict: bool = False, validate: bool = True,
            skew: Skew | None = None, vocabulary: Vocabulary = VOCABULARY,
            report: Callable[[str, DataFrame], None] | None = None) -> Relations:
    """Transform, check, write below `folder` and validate what was written.

    With `strict` a failed check stops before writing and a layout violation raises afterwards.
    `report` receives the statistics, the check report and the violations as DataFrames.
    """
    spark = prepare(src.sparkSession)
    tell = report or (lambda _name, _df: None)
    # Sources are parsed once; this also fixes positions that come from row ids.
    src = materialize(src, "source")
    skew = skew or Skew.of(src)
    size_shuffles(spark, skew.rows)
    # The four relations and five checks read the matched events many times.
    matched = materialize(match_messages(src, skew), "matched")
    relations = relations_of(matched, vocabulary)
    tell("stats", transformation_stats(relations, matched, vocabulary))
    verdict = checks.check_report(checks.check_measures(src, relations, vocabulary))
    tell("checks", verdict)
    if strict:
        checks.require_passed(verdict)
    if folder is None:
        return relations
    write_relational(relations, f"{folder}/relational", vocabulary)
    write_documents(relations, f"{folder}/documents", vocabulary, skew)
    if validate:
        violations = document_violations(spark, f"{folder}/documents")
        tell("violations", violations)
        if strict:
            require_valid(violations)
    return relations
