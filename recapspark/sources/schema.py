"""Explicit schemas of the capture files and of the tables derived from them."""

from pyspark.sql import types as T

_D, _I, _L, _S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


#: One electrofishing capture as it stands in the CSV files.
CAPTURE_FILE = _struct(
    ("Longitude", _D),
    ("Latitude", _D),
    ("Date", _S),
    ("Time", _S),
    ("SiteLen", _D),
    ("Discharge", _D),
    ("WaterTemp", _D),
    ("GearType", _S),
    ("TimeFish", _D),
    ("FishNum", _L),
    ("SpeciesCd", _I),
    ("Length", _D),
    ("Weight", _D),
    ("Wild", _S),
    ("Stage", _S),
    ("MarkAppCd", _S),
    ("Mark PreCd", _S),
    ("Water", _S),
    ("tblSL_SL_ID", _L),
    ("Rep", _I),
)

#: The 20 capture columns after the rename, in order.
CAPTURE_COLUMNS = [
    "MarkPreCd" if f.name == "Mark PreCd" else f.name for f in CAPTURE_FILE.fields
]

MONTH_INTERVALS = _struct(
    ("dateYM", _S),
    ("occ", _I),
    ("dateMedian", _D),
    ("dateMedianDiff", _D),
    ("dateMedianDiffMonth", _D),
)

PARAMS = _struct(
    ("draw", _I),
    ("name", _S),
    ("s_from", _I),
    ("s_to", _I),
    ("t", _I),
    ("value", _D),
)

DRAWS = _struct(
    ("chain", _I),
    ("iter", _I),
    ("name", _S),
    ("s_from", _I),
    ("s_to", _I),
    ("t", _I),
    ("value", _D),
)
