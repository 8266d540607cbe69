"""Mainframe records: each kind of number, signs, pictures, redefinition, files of records, what is no number."""

import pytest
from pyspark.sql import functions as F

from weftline.lang.names import Workspace
from weftline.lang.syntax import parse
from weftline.sources import copybook

SPEC = """
schema r (format copybook, encoding ebcdic) {
  ID INTEGER (pic "9(4)", offset 1, length 4)
  KIND STRING (pic "X(1)", offset 5)
  PERSON record (offset 6, length 10) { FIRST STRING (pic "X(4)", offset 6) LAST STRING (pic "X(6)", offset 10) }
  FIRM record (redefines PERSON, offset 6) { NAME STRING (pic "X(10)", offset 6) }
  BALANCE DECIMAL(9,2) (pic "S9(5)V99", encoding comp-3, offset 16, length 4)
  SIGNED DECIMAL(4,1) (pic "S9(2)V9", offset 20)
  SMALL INTEGER (pic "S9(4)", encoding comp)
  COUNT INTEGER (pic "9(1)")
  PHONES list_of record (occurs 2, depends_on COUNT) { TYPE STRING (pic "X(1)") NUMBER STRING (pic "X(3)") }
}
"""


def record(ident, kind, name, balance, signed, small, phones):
    text = lambda t: t.encode("cp037")
    told = "".join(t + n.ljust(3) for t, n in phones).ljust(8)
    return text(f"{ident:>04}{kind}{name:<10}") + bytes.fromhex(balance) + text(signed) + small.to_bytes(2, "big", signed=True) + text(str(len(phones)) + told)


def test_a_file_of_records(spark, tmp_path):
    rows = [
        record(7, "R", "Ann Smith", "0012345C", "12C", -3, [("H", "123"), ("M", "9")]), record(8, "B", "Ünited Co", "9999999D", "00}", 32767, []),
        record(9, "B", "Bad", "00A0000C", "1 2", 0, [("W", "5")]), record(10, "R", "", "0000001F", "01J", -32768, []),
    ]
    (tmp_path / "in.dat").write_bytes(b"".join(rows))
    got = copybook.read(spark, Workspace([parse(SPEC)]), "r", str(tmp_path / "in.dat")).orderBy("ID").collect()
    assert [(r.ID, r.KIND, r.PERSON.FIRST, r.PERSON.LAST, r.FIRM.NAME) for r in got[:2]] == [(7, "R", "Ann", "Smith", "Ann Smith"), (8, "B", "Ünit", "ed Co", "Ünited Co")]
    assert [str(r.BALANCE) for r in got] == ["123.45", "-99999.99", "None", "0.01"]
    assert [str(r.SIGNED) for r in got] == ["12.3", "0.0", "None", "-1.1"]
    assert [r.SMALL for r in got] == [-3, 32767, 0, -32768]
    assert [[(p.TYPE, p.NUMBER) for p in r.PHONES] for r in got] == [[("H", "123"), ("M", "9")], [], [("W", "5")], []]


def test_numbers_come_back(spark):
    values = [0, 1, -1, 99999.99, -12345.67, 0.005, None, 100000000]
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(copybook.unpacked(copybook.packed(F.col("v"), 9, 2), 2)).collect()]
    assert [None if g is None else float(g) for g in got] == [0.0, 1.0, -1.0, 99999.99, -12345.67, 0.01, None, None]
    text = "Aa19 .<(+&!$*);-/|,%_>?:#@'=\"üß"
    assert spark.range(1).select(copybook.from_ebcdic(copybook.to_ebcdic(F.lit(text)))).first()[0] == text
    assert bytes(spark.range(1).select(copybook.to_ebcdic(F.lit(text))).first()[0]) == text.encode("cp037")


def test_pictures():
    assert [copybook.picture(p) for p in ("X(20)", "9(5)", "S9(7)V99", "S9V9(3)", "XX", "99")] == [("X", 20, 0), ("9", 5, 0), ("9", 9, 2), ("9", 4, 3), ("X", 2, 0), ("9", 2, 0)]
    for bad in ("", "Z(3)", "X(2)9", "V"):
        with pytest.raises(ValueError):
            copybook.picture(bad)
