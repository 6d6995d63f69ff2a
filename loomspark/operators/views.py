"""Logical views: projections that never fan out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ringing_towers(dove: DataFrame) -> DataFrame:
    """V1: the ringing register, a row for each ring, with two columns under clearer names."""
    return dove.select(
        "TowerID", "RingID", "DoveID", "Place", "County", "Region", "Country", "RingType", F.col("Bells").alias("bell_count"), F.col("Wt").alias("tenor_weight"), "Lat", "Long", "Practice", "WebPage",
    )


def towers_unique(towers: DataFrame) -> DataFrame:
    """V2: one row a TowerID. MAX is safe as the attributes are the same for all of a tower's rings."""
    attributes = ["Place", "Dedicn", "County", "Country", "Lat", "Long"]
    return towers.groupBy("TowerID").agg(*[F.max(c).alias(c) for c in attributes], F.count("*").alias("installations"))


def dove_towers(dove: DataFrame) -> DataFrame:
    """V3: one row a TowerID with its smallest ring as the primary one and the number of rings."""
    return dove.groupBy("TowerID").agg(F.min("RingID").alias("primary_ring_id"), F.count("*").alias("rings"), *[F.max(c).alias(c) for c in ("Place", "Dedicn", "County")])


def tower_performances(performances: DataFrame, unique: DataFrame) -> DataFrame:
    """V4: performances with their tower; those without a known one are left out."""
    kept = unique.select("TowerID", F.col("Place").alias("tower_place"), "Dedicn", "County", "Country")
    return performances.join(kept, performances["dove_tower_id"] == kept["TowerID"])


def first_tower_peals(methods: DataFrame, events: DataFrame, unique: DataFrame) -> DataFrame:
    """V5: every method with its first tower-bell peal, if any; the event is filtered before the outer join."""
    peals = events.where("event_type = 'firstTowerbellPeal'").select("method_id", "perf_date", "dove_tower_id", "society")
    return methods.join(peals, "method_id", "left").join(unique.select(F.col("TowerID").alias("dove_tower_id"), "Place", "County"), "dove_tower_id", "left")


def performance_methods_view(links: DataFrame, performances: DataFrame, methods: DataFrame) -> DataFrame:
    """V6: linked performances with their methods, low confidence left out."""
    m = methods.select("method_id", F.col("title").alias("method_title"), "stage", "classification")
    return links.where("confidence <> 'low'").join(performances, "perf_id").join(m, "method_id")


def composition_methods_view(compositions: DataFrame, parts: DataFrame, methods: DataFrame) -> DataFrame:
    """V7: the methods of each composition; inner on the composition, outer on the method library."""
    return compositions.join(parts, "composition_id").join(methods.select("method_id", F.col("title").alias("library_title")), "method_id", "left")
