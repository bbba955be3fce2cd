import zipfile

import numpy as np

from lumentab.functions.patterns import scan_first
from lumentab.sinks import files as out
from lumentab.sources import binary, files


def test_quoted_fields_span_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Email,Address,Spent\na@b.c,"1 Road\nTown, X",2.5\nd@e.f,"say ""hi""",1\n')
    rows = files.read_csv(spark, str(tmp_path / "c.csv"), "Email string, Address string, Spent double", multiline=True).collect()
    assert [r.Address for r in rows] == ["1 Road\nTown, X", 'say "hi"']


def test_column_subset_of_a_headerless_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("10666592, 6350, 1.991\n10682541, 5160, 0.847\n")
    df = files.read_columns(spark, str(tmp_path / "s.csv"), "id bigint, t int, r double", ["id", "r"])
    assert [tuple(r) for r in df.collect()] == [(10666592, 1.991), (10682541, 0.847)]


def test_uneven_catalogue(spark, tmp_path):
    (tmp_path / "cat.dat").write_text("  1  00 04 35.65 -47 36 19.1 12 x\n 12* 00 05 1.5 -00 30 00\n\n")
    rows = files.read_catalogue(spark, str(tmp_path / "cat.dat"), ["h", "m", "s", "d"]).collect()
    assert [(r.id, r.d) for r in rows] == [(1, "-47"), (12, "-00")]


def test_row_label(spark, tmp_path):
    (tmp_path / "l.csv").write_text(",WTT,PTI\n0,0.9,1.1\n1,0.6,1.0\n")
    df = files.read_with_row_label(spark, str(tmp_path / "l.csv"), "c0 int, WTT double, PTI double")
    assert df.columns == ["row_label", "WTT", "PTI"] and df.count() == 2


def test_votable_keeps_units_types_and_empty_cells(spark, tmp_path):
    (tmp_path / "t.vot").write_text(
        '<?xml version="1.0"?><VOTABLE><RESOURCE><TABLE>'
        '<FIELD ID="a" name="source_id" datatype="long"/><FIELD name="parallax" datatype="double" unit="mas"><DESCRIPTION>p</DESCRIPTION></FIELD>'
        '<FIELD name="note" datatype="char" arraysize="*"/><DATA><TABLEDATA>'
        "<TR><TD>1</TD><TD>2.5</TD><TD>a &amp; b</TD></TR>\n<TR><TD>2</TD><TD></TD><TD>c</TD></TR>"
        "</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>")
    df = files.read_votable(spark, str(tmp_path / "t.vot"))
    assert [tuple(r) for r in df.orderBy("source_id").collect()] == [(1, 2.5, "a & b"), (2, None, "c")]
    assert df.schema["parallax"].metadata == {"unit": "mas"}


def test_tree_and_phone_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text("nothing here")
    (tmp_path / "a" / "b" / "two.txt").write_text("call 505-555-0142 now\nor 111-222-3333")
    hits = scan_first(files.read_tree(spark, str(tmp_path), whole=True), "path", "value").collect()
    assert [(r.path.rsplit("/", 1)[1], r.hit) for r in hits] == [("two.txt", "505-555-0142")]
    assert files.read_tree(spark, str(tmp_path)).count() == 3


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/one.txt", "1")
        z.writestr("two.txt", "22")
    rows = binary.zip_members(binary.read_binary(spark, str(tmp_path), "*.zip")).collect()
    assert {r.member: bytes(r.data) for r in rows} == {"d/one.txt": b"1", "two.txt": b"22"}


def test_npy_records(spark, tmp_path):
    data = np.array([(1.5, b"GALAXY"), (2.5, b"QSO")], dtype=[("u", "f8"), ("spec_class", "S6")])
    np.save(tmp_path / "g.npy", data)
    rows = binary.npy_records(binary.read_binary(spark, str(tmp_path), "*.npy"), "u double, spec_class string").collect()
    assert [tuple(r) for r in rows] == [(1.5, "GALAXY"), (2.5, "QSO")]


def test_match_report_layout(spark, tmp_path):
    df = spark.createDataFrame([(2, 7, 0.5), (1, 4, 0.25)], "id1 bigint, id2 bigint, dist double").coalesce(1)
    out.write_match_report(df, str(tmp_path / "m"))
    text = "".join(sorted(p.read_text() for p in (tmp_path / "m").glob("part-*")))
    assert text.startswith("id1\tid2\tdistance_deg\n1\t4\t0.25")


def test_csv_round_trip_keeps_empty_apart_from_null(spark, tmp_path):
    df = spark.createDataFrame([("", 1), (None, 2), ('q"x', 3)], "s string, n int")
    out.write_csv(df, str(tmp_path / "r"))
    back = spark.read.option("header", True).option("escape", '"').schema("s string, n int").csv(str(tmp_path / "r"))
    assert {r.n: r.s for r in back.collect()}[3] == 'q"x'
    assert {r.n: r.s for r in back.collect()}[2] is None
