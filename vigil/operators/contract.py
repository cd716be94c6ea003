"""Do parsers make all event types that detectors need?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil import schemas as S


class ContractError(RuntimeError):
    """A detector needs an event type that nothing makes."""


def contract_gap(produced: DataFrame, needs: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """detector and event_type for every needed type that produced (event_type) lacks."""
    rows = [(d, t) for d, types in (S.DETECTOR_NEEDS if needs is None else needs).items() for t in types]
    required = produced.sparkSession.createDataFrame(rows, "detector string, event_type string")
    return required.join(produced.select("event_type").distinct(), "event_type", "left_anti").select("detector", "event_type")


def declared_types(spark: SparkSession, emits: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    rows = [(t,) for types in (S.PARSER_EMITS if emits is None else emits).values() for t in types]
    return spark.createDataFrame(rows, "event_type string").distinct()


def assert_contract(spark: SparkSession, emits: dict[str, tuple[str, ...]] | None = None, needs: dict[str, tuple[str, ...]] | None = None) -> None:
    missing = [f"{r.detector} needs {r.event_type}" for r in contract_gap(declared_types(spark, emits), needs).orderBy("detector").collect()]
    if missing:
        raise ContractError("; ".join(missing))
