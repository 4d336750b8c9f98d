"""Operators: every function takes DataFrames and returns DataFrames, lazily."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame


class Split(NamedTuple):
    """Rows that passed an operator and rows on its reject flow."""

    ok: DataFrame
    reject: DataFrame
