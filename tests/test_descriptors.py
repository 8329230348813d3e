import pytest
from pyspark.sql import functions as F

from stowage.functions import descriptors as d

WHOLE = [
    "O:BAG:SYD:PAI(A;OICI;FA;;;BA)(D;;FRFW;;;S-1-5-21-1-2-3-500)S:AI(AU;SAFA;FA;;;WD)",
    'O:BA D:(XA;;FX;;;S-1-1-0;(@User.Title=="a \\"b\\" (c;d)" && (Member_of {SID(BA)})))',
    "D:NO_ACCESS_CONTROL",
    "G:S-1-5-18",
    "D:",
    'S:(RA;;;;;WD;("Secrecy",TU,0,3))',
]
BROKEN = ["", "X:BA", "D:(A;;FA;;;BA", 'D:(XA;;FX;;;WD;(a=="b)', "D:(A;FA;BA)", "O:(A;;FA;;;BA)", "D:Q(A;;FA;;;BA)", "D:(A;;FA;;;BA)x", "(A;;FA;;;BA)", "D:P)"]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"c{k} string" for k in range(len(rows[0]))))


def test_what_is_parsed_is_written_back(spark):
    rows = frame(spark, *[(t,) for t in [*WHOLE, *BROKEN, None]]).select("c0", d.parse_descriptor(F.col("c0")).alias("d")).withColumn("again", d.format_descriptor(F.col("d")))
    got = {r.c0: r.again for r in rows.collect()}
    assert all(got[t].replace(" ", "") == t.replace(" ", "") for t in WHOLE)
    assert all(got[t] is None for t in [*BROKEN, None])
    first = d.parsed(WHOLE[0])
    assert (first["owner"], first["grp"], first["dacl"]["flags"], first["sacl"]["entries"]) == ("BA", "SY", "PAI", [["AU", "SAFA", "FA", "", "", "WD"]])


def test_names_are_written_as_others(spark):
    out = frame(spark, ("O:BAD:(A;;BA;;;BA)",)).select(d.format_descriptor(d.parse_descriptor(F.col("c0")), {"BA": "S-1-5-32-544"}))
    assert out.first()[0] == "O:S-1-5-32-544D:(A;;BA;;;S-1-5-32-544)"


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("O:BAD:(A;OICI;FAFR;;;X)(D;;FA;;;Y)", "O:BAD:(D;;FA;;;Y)(A;CIOI;FRFA;;;X)", True),
        ("D:PAI(A;;FA;;;X)", "D:AIP(A;;FA;;;X)", True),
        ("D:NO_ACCESS_CONTROL", "D:", True),
        ("O:BA", "O:BAD:", True),
        ("D:(A;;FA;;;X)(A;;FA;;;X)", "D:(A;;FA;;;X)", False),
        ("D:(A;;FA;;;X)(A;;FA;;;X)(A;;FA;;;Y)", "D:(A;;FA;;;X)(A;;FA;;;Y)(A;;FA;;;Y)", False),
        ("D:(A;OI;FA;;;X)", "D:(A;CI;FA;;;X)", False),
        ("D:(A;;FA;;;X)", "S:(A;;FA;;;X)", False),
        ("D:(A;;FA;;;X)", "D:(A;;FA;;;x)", False),
        ("O:BA", "G:BA", False),
        ("D:P", "D:", False),
    ],
)
def test_comparison_forgets_order_only(spark, a, b, same):
    key = lambda c: d.comparable(d.parse_descriptor(F.col(c)))
    assert frame(spark, (a, b)).select((key("c0") == key("c1")).alias("same")).first()["same"] is same
