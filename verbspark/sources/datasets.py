"""Small example tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..frame import Frame
from .tables import from_rows


def band_members(spark: SparkSession) -> Frame:
    return from_rows(spark, [("Mick", "Stones"), ("John", "Beatles"), ("Paul", "Beatles")], "name string, band string")


def band_instruments(spark: SparkSession) -> Frame:
    return from_rows(spark, [("John", "guitar"), ("Paul", "bass"), ("Keith", "guitar")], "name string, plays string")


def band_instruments2(spark: SparkSession) -> Frame:
    return band_instruments(spark).rename(artist="name")
