"""Scans of CSV, XML and JSON files with stated schemas: empty is null, numbers that are none are null, and nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.dialect import filled


def safe_name(name: str) -> str:
    """A header as a column name: without a byte-order mark, signs as underscores, none at the ends."""
    return re.sub(r"[^0-9a-zA-Z_]", "_", name.lstrip("﻿")).strip("_")


def whole_number(text: Column) -> Column:
    """Digits as a number, all else null."""
    return F.when(F.trim(text).rlike(r"^-?\d+$"), F.trim(text).try_cast("bigint"))


def scan_csv(spark: SparkSession, paths: str | list[str], columns: dict[str, str], lines_in_cells: bool = True) -> DataFrame:
    """The named columns of headed CSV files, by their safe names; `columns` has a type for each.

    Files are read as text by their own header (one pass over the first line), then cast: a cell that is empty, 'nan' or
    not of the type is null, and a column that a file lacks is null. Paths may have wildcards, as for one file a year.
    A cell may hold line ends, for which a file is read by one task; where none does, `lines_in_cells` False lets large files be split.
    """
    raw = spark.read.option("header", True).option("multiLine", lines_in_cells).option("escape", '"').option("nullValue", "").csv(paths)
    raw = raw.toDF(*[safe_name(c) for c in raw.columns])

    def cell(name: str, kind: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast(kind).alias(name)
        text = F.when(filled(F.col(name)) & (F.lower(F.trim(name)) != "nan"), F.col(name))
        return (whole_number(text).cast(kind) if kind in ("int", "long", "bigint") else text if kind == "string" else text.try_cast(kind)).alias(name)

    return raw.select(*[cell(n, k) for n, k in columns.items()])


def latest_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by `order`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("mode", "PERMISSIVE").schema(schema).load(path)


def text(column: Column | str) -> Column:
    """The trimmed text of an element; empty is null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(filled(c), F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


_EVENT = "array<struct<date:string,society:string,location:struct<building:string,town:string,county:string,address:string,region:string,country:string,room:string>>>"
EVENT_TYPES = (
    "firstTowerbellPeal", "firstHandbellPeal", "firstPerformance", "firstInclusionInTowerbellPeal", "firstInclusionInHandbellPeal", "firstTowerbellExtent", "firstHandbellExtent",
    "firstKeyboardPeal", "firstDistanceExtent", "firstDistancePeal", "firstTowerbellQuarterPeal", "firstHandbellQuarterPeal", "firstKeyboardExtent", "firstInclusionInTowerbellQuarterPeal", "firstInclusionInHandbellQuarterPeal",
)
_METHOD_SET = (
    "properties struct<stage:string,lengthOfLead:string,numberOfHunts:string,huntbellPath:string,classification:struct<_VALUE:string,_plain:string,_little:string,_differential:string,_trebleDodging:string>>,"
    "method array<struct<_id:string,title:string,name:string,notation:string,symmetry:string,leadHead:string,leadHeadCode:string,extensionConstruction:string,notes:string,falseness:struct<fchGroups:string>,references:struct<rwRef:string>,performances:struct<"
    + ",".join(f"{e}:{_EVENT}" for e in EVENT_TYPES) + ">>>"
)


def scan_methods(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Methods and their first performances from a library of method sets, whose properties hold for all their methods."""
    sets = _xml(spark, path, "methodSet", _METHOD_SET).select("properties", F.explode("method").alias("m")).where(filled(F.col("m._id")))
    p, c = F.col("properties"), F.col("properties.classification")
    flag = lambda name: F.coalesce((c[f"_{name}"] == "true").cast("int"), F.lit(0))
    methods = sets.select(
        F.col("m._id").alias("method_id"), F.coalesce(text("m.title"), F.lit("")).alias("title"), text("m.name").alias("name"), whole_number(p["stage"]).cast("int").alias("stage"), text(c["_VALUE"]).alias("classification"),
        flag("plain").alias("cls_plain"), flag("little").alias("cls_little"), flag("differential").alias("cls_differential"), flag("trebleDodging").alias("cls_treble_dodging"),
        whole_number(p["lengthOfLead"]).cast("int").alias("length_of_lead"), whole_number(p["numberOfHunts"]).cast("int").alias("number_of_hunts"), text(p["huntbellPath"]).alias("huntbell_path"),
        text("m.notation").alias("notation"), text("m.symmetry").alias("symmetry"), text("m.leadHead").alias("lead_head"), text("m.leadHeadCode").alias("lead_head_code"),
        text("m.falseness.fchGroups").alias("fch_groups"), text("m.references.rwRef").alias("rw_ref"), text("m.extensionConstruction").alias("extension_construction"), text("m.notes").alias("notes"),
    )
    def of(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"m.performances.{kind}"), F.array().cast(_EVENT)), lambda x: F.struct(F.lit(kind).alias("event_type"), x.alias("e")))

    every = F.concat(*map(of, EVENT_TYPES))
    events = sets.select(F.col("m._id").alias("method_id"), F.posexplode(every).alias("position", "x")).select(
        "method_id", "position", "x.event_type", text("x.e.date").alias("perf_date"), text("x.e.society").alias("society"),
        *[text(f"x.e.location.{k}").alias(k) for k in ("building", "town", "county", "address", "region", "country", "room")], F.lit(None).cast("long").alias("dove_tower_id"),
    )
    return methods, events


_PERFORMANCE = (
    "_id string,association string,place struct<`_towerbase-id`:string,`_dove-tower-id`:string,`place-name`:array<struct<_VALUE:string,_type:string>>,ring:struct<_type:string,_tenor:string,`_dove-ring-id`:string>>,"
    "title struct<changes:string,method:string>,date string,duration string,details string,composer string,composition string,timestamp string,"
    "ringers struct<ringer:array<struct<_VALUE:string,_bell:string,_conductor:string>>>,footnote array<string>,flag array<struct<_VALUE:string,_type:string,_bell:string>>"
)


def scan_performances(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Performances, ringers, footnotes and flags of performance records; a record without a numeric id is left out."""
    rows = _xml(spark, path, "performance", _PERFORMANCE).withColumn("perf_id", whole_number(F.regexp_replace("_id", "^P+", ""))).where("perf_id IS NOT NULL")
    named = lambda kind: text(F.get(F.filter(F.col("place.place-name"), lambda x: x["_type"] == kind), F.lit(0))["_VALUE"])
    performances = rows.select(
        "perf_id", F.col("_id").alias("bb_id"), text("association").alias("association"), named("place").alias("place"), named("dedication").alias("dedication"), named("county").alias("county"),
        whole_number(F.col("place.`_towerbase-id`")).alias("towerbase_id"), whole_number(F.col("place.`_dove-tower-id`")).alias("dove_tower_id"), whole_number(F.col("place.ring.`_dove-ring-id`")).alias("dove_ring_id"),
        F.col("place.ring._type").alias("ring_type"), F.col("place.ring._tenor").alias("tenor"), text("date").alias("perf_date"), text("duration").alias("duration"), whole_number(F.col("title.changes")).cast("int").alias("changes"),
        text("title.method").alias("method"), text("details").alias("details"), text("composer").alias("composer"), text("composition").alias("composition"), text("timestamp").alias("bb_timestamp"),
    )
    ringers = rows.select("perf_id", F.posexplode("ringers.ringer").alias("position", "r")).select("perf_id", "position", F.col("r._bell").alias("bell"), text("r._VALUE").alias("name"), F.coalesce((F.col("r._conductor") == "true").cast("int"), F.lit(0)).alias("conductor"))
    footnotes = rows.select("perf_id", F.posexplode("footnote").alias("position", "f")).select("perf_id", "position", text("f").alias("footnote"))
    flags = rows.select("perf_id", F.posexplode("flag").alias("position", "f")).select("perf_id", "position", F.col("f._type").alias("flag_type"), F.col("f._bell").alias("bell"), text("f._VALUE").alias("flag_text"))
    return {"performances": performances, "ringers": ringers, "footnotes": footnotes, "flags": flags}


_COMPOSITION = (
    "id string,library string,derivedTitle string,title string,opus string,stage string,length string,dateComposed string,extents string,backstrokeStart boolean,callDefaultSpecifier string,calling string,"
    "methodCalling string,methodDetails string,partheads array<string>,courseheadMasks array<string>,notes string,"
    "methodDefinitions array<struct<name:string,title:string,mnemonic:string,placeNotation:string,methodPlaceNotation:string,rowStage:string,methodStage:string>>"
)


def scan_compositions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Compositions, lists joined by '|', and the methods of each in their order, from one JSON object a line."""
    rows = spark.read.schema(_COMPOSITION).json(path).withColumn("composition_id", whole_number(F.col("id")))
    number = lambda c: whole_number(F.col(c)).cast("int")
    compositions = rows.select(
        "composition_id", "library", F.col("derivedTitle").alias("derived_title"), "title", F.nullif("opus", F.lit("")).alias("opus"), number("stage").alias("stage"), number("length").alias("length"),
        F.nullif("dateComposed", F.lit("")).alias("date_composed"), number("extents").alias("extents"), F.coalesce(F.col("backstrokeStart").cast("int"), F.lit(0)).alias("backstroke_start"),
        F.col("callDefaultSpecifier").alias("call_default_specifier"), "calling", F.col("methodCalling").alias("method_calling"), F.col("methodDetails").alias("method_details"),
        F.array_join("partheads", "|").alias("partheads"), F.array_join("courseheadMasks", "|").alias("coursehead_masks"), F.nullif("notes", F.lit("")).alias("notes"),
    )
    some = lambda c: F.nullif(F.col(f"d.{c}"), F.lit(""))
    parts = rows.select("composition_id", F.posexplode("methodDefinitions").alias("position", "d")).select(
        "composition_id", "position", some("name").alias("name"), some("title").alias("method_title"), some("mnemonic").alias("mnemonic"), some("placeNotation").alias("place_notation"),
        some("methodPlaceNotation").alias("method_place_notation"), whole_number(F.col("d.rowStage")).cast("int").alias("row_stage"), whole_number(F.col("d.methodStage")).cast("int").alias("method_stage"),
    )
    return compositions, parts


def known_method_ids(parts: DataFrame, methods: DataFrame) -> DataFrame:
    """S22: 'm' and the library's number as method_id, where the library has it."""
    known = methods.select("method_id").distinct()
    return parts.withColumn("asked", F.concat(F.lit("m"), F.col("library_method_id"))).join(known, F.col("asked") == known["method_id"], "left").drop("asked")
