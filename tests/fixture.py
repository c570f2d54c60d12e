"""Hand-made captures with known results.

``dateTime`` is date + hour, ``M`` the main river, None a missing value.
"""

from recapspark.config import MAIN_RIVER
from recapspark.sources.schema import CAPTURE_FILE

BROWN, RAINBOW = 328, 326

# tag, date (d-m-y), hour, length, water, species code
FISH = [
    ("a1", "10-06-2020", 9, 200, "M", BROWN),
    ("a1", "05-07-2020", 9, 240, "M", BROWN),
    ("a1", "20-07-2020", 9, 250, "M", BROWN),
    ("b2", "11-06-2020", 9, 390, "T1", BROWN),
    ("b2", "02-09-2020", 9, 400, "T1", BROWN),
    ("c3", "05-07-2020", 9, 300, "M", RAINBOW),
    ("c3", "05-07-2020", 15, 301, "M", RAINBOW),
    ("d4", "01-07-2020", 8, 229, None, BROWN),
    ("d4", "08-07-2020", 8, None, "M", BROWN),
    ("d4", "15-07-2020", 8, 231, "M", BROWN),
    ("e5", "03-09-2020", 9, 380, "T2", BROWN),
    ("f6", "12-06-2020", None, 230, "T2", BROWN),
    ("f6", "09-07-2020", None, 260, "T2", BROWN),
    ("f6", "21-07-2020", 9, 265, "T2", BROWN),
]


def raw_captures(spark, rows=FISH):
    """The rows in the shape of a capture file."""
    names = [f.name for f in CAPTURE_FILE.fields]
    data = []
    for i, (tag, date, hour, length, water, species) in enumerate(rows):
        r = dict.fromkeys(names)
        r["MarkAppCd"], r["Date"], r["FishNum"], r["SpeciesCd"] = tag, date, i, species
        r["Time"] = None if hour is None else f"{hour:02d}:00:00"
        r["Length"] = None if length is None else float(length)
        r["Water"] = MAIN_RIVER if water == "M" else water
        data.append(tuple(r[n] for n in names))
    return spark.createDataFrame(data, CAPTURE_FILE)


def prepared(spark, rows=FISH, **options):
    from recapspark.operators import prepare

    return prepare.prepare_captures(
        prepare.derive_captures(raw_captures(spark, rows)), **options
    )
