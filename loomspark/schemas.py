"""The corpus's tables: column names in order, with a type letter each (I long, R double, T string)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_RING = (
    "TowerID:I RingID:I RingType:T Place:T Place2:T PlaceCL:T Dedicn:T TowerStatus:T StatusFirst:T BareDedicn:T AltName:T RingName:T Region:T County:T Country:T HistRegion:T ISO3166code:T Diocese:T Lat:R Long:R "
    "Bells:{n} UR:T Semitones:T Wt:R App:T Note:T Hz:R Details:T GF:T Toilet:T Simulator:T ExtraInfo:T WebPage:T Affiliations:T NG:T Postcode:T Practice:T OvhaulYr:T Contractor:T TuneYr:R LGrade:T BldgID:T "
    "ChurchCare:R CHRAssetID:R TowerBase:{n} DoveID:T SNLat:R SNLong:R"
)
#: The tables' columns.
COLUMNS = {
    "bells": "Bell_ID:I Place:T Dedication:T Region:T Tower_ID:I Grid_Ref:T Latitude:R Longitude:R Ring_ID:I Collection_Type:T Ring_Size:T Bell_Role:T Bell_Name:T Weight__lbs:R Weight__approx:T Nominal__Hz:R Note:T Diameter__in:R Shape:T Material:T Cast_Date:T Listed:T Founder:T Founder_Uncertain:T Caster:T Canons:T Turnings:T Cracked:T Frame_ID:R In_Pit:T Modification_Date:T",
    "changes": "Date:T TowerID:I Place:T Region:T Description_of_change:T Source:T Route:T",
    "dove": _RING.format(n="I"),
    "towers": _RING.format(n="R"),
    "founders": "ID:R Name:T From:R To:R Group:T Location:T Bells:I Extant_From:R Extant_To:R Rings:I",
    "frames": "Frame_ID:I Place:T Dedication:T Region:T Tower_ID:I Grid_Ref:T Latitude:R Longitude:R Frame_Number:T Frame_Date:T Listed:T Materials:T Maker:T Maker_Uncertain:T Trusses:T Layout:T Resultant_Layout:T Num_Extensions:R",
    "regions": "ID:I Name:T Type:T Category:T ParentID:R",
    "performances": "perf_id:I bb_id:T association:T place:T dedication:T county:T towerbase-id:I dove_tower_id:I dove_ring_id:I ring_type:T tenor:T portable:T dumb_bells:T perf_date:T duration:T changes:I method:T title:T details:T composer:T composition:T bb_timestamp:T ingested_at:T",
    "performance_ringers": "perf_id:I position:I bell:T name:T conductor:I",
    "performance_footnotes": "perf_id:I position:I footnote:T",
    "performance_flags": "perf_id:I position:I flag_type:T bell:T flag_text:T",
    "methods": "method_id:T title:T name:T stage:I classification:T cls_plain:I cls_little:I cls_differential:I cls_treble_dodging:I length_of_lead:I number_of_hunts:I huntbell_path:T notation:T symmetry:T lead_head:T lead_head_code:T fch_groups:T rw_ref:T extension_construction:T notes:T ingested_at:T",
    "method_performances": "method_id:T position:I event_type:T perf_date:T society:T building:T town:T county:T address:T region:T country:T room:T dove_tower_id:I",
    "performance_methods": "perf_id:I method_id:T ord:I match_kind:T confidence:T matched_on:T resolved_at:T",
    "performance_method_unresolved": "perf_id:I method_text:T reason:T expected_n:I found_n:I candidates:T resolved_at:T",
    "compositions": "composition_id:I library:T derived_title:T title:T opus:T stage:I length:I date_composed:T extents:I backstroke_start:I call_default_specifier:T calling:T method_calling:T method_details:T partheads:T coursehead_masks:T notes:T ingested_at:T",
    "composition_methods": "composition_id:I position:I name:T method_title:T mnemonic:T place_notation:T method_place_notation:T row_stage:I method_stage:I complib_method_id:I method_id:T",
}
#: The column that tells a table's rows apart; (perf_id, position) and the like for children. Towers repeat on purpose.
KEYS = {
    "bells": ["Bell_ID"], "dove": ["RingID"], "regions": ["ID"], "frames": ["Frame_ID"], "performances": ["perf_id"], "performance_ringers": ["perf_id", "position"], "performance_footnotes": ["perf_id", "position"],
    "performance_flags": ["perf_id", "position"], "methods": ["method_id"], "method_performances": ["method_id", "position"], "performance_methods": ["perf_id", "method_id"], "performance_method_unresolved": ["perf_id"],
    "compositions": ["composition_id"], "composition_methods": ["composition_id", "position"],
}
_TYPES = {"I": LongType(), "R": DoubleType(), "T": StringType()}


def schema(table: str) -> StructType:
    """All columns nullable: a link that is missing is null, never ''."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (c.split(":") for c in COLUMNS[table].split())])


def load_csv(spark: SparkSession, table: str, paths: str | list[str]) -> DataFrame:
    """A table from CSV files, by its columns (see `scan_csv`); names that a header cannot have are made safe first."""
    from loomspark.sources.readers import safe_name, scan_csv

    fields = schema(table).fields
    found = scan_csv(spark, paths, {safe_name(f.name): f.dataType.simpleString() for f in fields})
    return found.toDF(*[f.name for f in fields])
