"""Readers and writers on small files of our own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.operators import lookups
from cadenza.schemas import SIX_BAND
from cadenza.sources import tables, text

SUPERNOVA = """SURVEY: TEST
# a comment
SNID:   {snid}
SNTYPE: 5 (type)
VARLIST:  MJD FLT FIELD FLUXCAL FLUXCALERR

OBS:   100.5 g F1 10.0 1.0
DETECTION: whatever
OBS:   101.5 g F1 11.0 1.5
OBS:   100.6 r F1 20.0 2.0
END:
"""


def test_observation_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text("object_id,mjd,passband,flux,flux_err,detected\n1,59000.5,0,1.5,0.1,1\n1,59001.5,5,2.5,0.2,0\n")
    raw = tables.read_observations(spark, str(tmp_path / "o.csv"))
    assert [r.band for r in tables.with_bands(raw, SIX_BAND).orderBy("time").collect()] == ["u", "y"]
    small = tables.narrowed(raw)
    assert [f.dataType.simpleString() for f in small.schema] == ["int", "float", "int", "float", "float", "tinyint"]
    tables.write_table(raw, str(tmp_path / "t"))
    assert sorted(tables.open_dataset(spark, "t", {"t": str(tmp_path / "t")}).collect()) == sorted(raw.collect())
    with pytest.raises(KeyError):
        tables.open_dataset(spark, "nowhere", {})


def test_narrowing_refuses_large_values(spark):
    with pytest.raises(Exception, match="x doesn't fit int: 3000000000"):
        tables.narrowed(spark.createDataFrame([(3 * 10**9,)], "x long")).collect()
    with pytest.raises(Exception, match="x doesn't fit float"):
        tables.narrowed(spark.createDataFrame([(float("nan"),), (1e38,)], "x double")).collect()
    assert tables.narrowed(spark.createDataFrame([(None, True), (5, None)], "x long, f boolean")).collect() == [(None, 1), (5, None)]
    with pytest.raises(TypeError):
        tables.narrowed(spark.createDataFrame([("a",)], "x string"))


def test_metadata_with_and_without_target(spark, tmp_path):
    head = "object_id,ra,decl,gal_l,gal_b,ddf,hostgal_specz,hostgal_photoz,hostgal_photoz_err,distmod,mwebv"
    (tmp_path / "a.csv").write_text(f"{head},target\n1,1,2,3,4,1,0,0,0,40,0.1,92\n")
    (tmp_path / "b.csv").write_text(f"{head}\n2,1,2,3,4,0,0,0,0,41,0.1\n")
    both = tables.stacked_metadata(tables.read_metadata(spark, str(tmp_path / "a.csv")), tables.read_metadata(spark, str(tmp_path / "b.csv"), with_target=False))
    assert sorted((r.object_id, r.target) for r in both.collect()) == [(1, 92), (2, None)]


def test_supernova_files(spark, tmp_path):
    (tmp_path / "SN1.DAT").write_text(SUPERNOVA.format(snid=11))
    (tmp_path / "SN2.DAT").write_text(SUPERNOVA.format(snid=22))
    (tmp_path / "key.txt").write_text("header\nSN2.DAT 23\n")
    points = text.read_supernova(spark, str(tmp_path / "*.DAT"))
    table = text.supernova_table(points, text.read_truth(spark, str(tmp_path / "key.txt")))
    assert {(r.object_id, r.type) for r in table.collect()} == {(11, 5), (22, 23)}
    assert table.count() == 6
    own = {r.band: [p.flux for p in r.points] for r in text.supernova_lookup(table, 11).collect()}
    assert own == {"g": [10.0, 11.0], "r": [20.0]}


def test_supernova_bands_in_two_files_are_an_error(spark, tmp_path):
    for name in ("A", "B"):
        (tmp_path / f"{name}.DAT").write_text(SUPERNOVA.format(snid=7))
    table = text.supernova_table(text.read_supernova(spark, str(tmp_path / "*.DAT")), spark.createDataFrame([], "file string, type int"))
    with pytest.raises(Exception, match="several curves in band"):
        text.supernova_lookup(table, 7).collect()
    index = sorted((r.file, r.band, r.start, r.end) for r in text.supernova_index(table).collect())
    assert index == [("A.DAT", "g", 0, 2), ("A.DAT", "r", 2, 3), ("B.DAT", "g", 3, 5), ("B.DAT", "r", 5, 6)]


def test_magnitudes_without_a_common_object_are_an_error(spark, tmp_path):
    for band, name in (("I", "S-1"), ("V", "S-2")):
        (tmp_path / band).mkdir()
        (tmp_path / band / f"{name}.dat").write_text("479.5 15.0 0.01\n")
    with pytest.raises(Exception, match="no object is in all bands"):
        text.read_magnitudes(spark, str(tmp_path), ["I", "V"]).collect()


def test_supernova_file_without_id_fails(spark, tmp_path):
    (tmp_path / "bad.DAT").write_text(SUPERNOVA.format(snid=1).replace("SNID", "OTHER"))
    with pytest.raises(Exception, match="needs one each"):
        text.read_supernova(spark, str(tmp_path / "bad.DAT")).collect()


def test_magnitude_files(spark, tmp_path):
    for band, names in (("I", ("S-1", "S-2")), ("V", ("S-1",))):
        (tmp_path / band).mkdir()
        for name in names:
            (tmp_path / band / f"{name}.dat").write_text("479.5 15.0 0.01\n480.5 16.0 0.02\n")
    (tmp_path / "info.txt").write_text("ID\tField\tStarID\tType\tSubtype\nS-1\tF7\t3\tCep\tF\n")
    points = text.read_magnitudes(spark, str(tmp_path), ["I", "V"])
    assert {(r.id, r.band) for r in points.collect()} == {("S-1", "I"), ("S-1", "V")}
    table = text.magnitude_table(points, text.read_stars(spark, str(tmp_path / "info.txt")))
    row = text.magnitude_lookup(table, "S-1", "S-").orderBy("time").first()
    assert row.Field == "F7"
    assert row.flux == pytest.approx(1e23 * 10 ** (-0.4 * (15.0 + 48.6)), rel=1e-12)
    assert row.flux_err == pytest.approx(0.01 / 15.0 * row.flux, rel=1e-12)
    with pytest.raises(ValueError):
        text.magnitude_lookup(table, "X")


def test_curve_csv_counts_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{i},{i * 2},0.5\n" for i in range(101)))
    assert tables.read_curve_csv(spark, str(tmp_path / "a.csv")).where("name = 'a'").count() == 101
    (tmp_path / "b.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="unlikely"):
        tables.read_curve_csv(spark, str(tmp_path / "*.csv")).collect()


def test_packed_round_trip(spark):
    obs = spark.createDataFrame([(1, "a", 2.0, 1.0, 0.1, 1, 7), (1, "a", 1.0, 3.0, 0.2, 0, 8)], "object_id long, band string, time double, flux double, flux_err double, detected int, tie long")
    assert [p.time for p in tables.packed(obs).first().points] == [1.0, 2.0]
    assert sorted(map(tuple, tables.unpacked(tables.packed(obs)).select(*obs.columns).collect())) == sorted(map(tuple, obs.collect()))


def test_models_round_trip(spark, tmp_path):
    cut = spark.createDataFrame([("g", "dflux", 0.5, [1.0, 2.0])], "band string, column string, median_scale double, cutoffs array<double>")
    tables.write_cutoffs(cut, str(tmp_path / "c"))
    assert tables.read_cutoffs(spark, str(tmp_path / "c")).collect() == cut.collect()
    columns = {f"{n}{i}": F.lit(float(i)) for n in ("period", "score") for i in range(1, 6)}
    cat = spark.range(3).select(F.col("id").alias("object_id"), F.lit(1).alias("ddf"), F.lit(90).alias("target")).withColumns(columns)
    tables.write_periods(cat, str(tmp_path / "p"))
    assert tables.read_periods(spark, str(tmp_path / "p")).count() == 3


def test_sorted_source(spark):
    t = spark.createDataFrame([(2, 1.0), (1, 5.0), (2, 0.5), (1, 4.0), (3, 0.0)], "source_id long, time double")
    placed, index = tables.sorted_source(t)
    assert sorted(map(tuple, index.collect())) == [(1, 0, 1), (2, 2, 3), (3, 4, 4)]
    got = lookups.slice_of(placed.drop("source_id"), index.where("source_id = 2").withColumnsRenamed({"min_row": "start", "max_row": "end"}), inclusive=True)
    assert sorted(r.time for r in got.collect()) == [0.5, 1.0]


def test_repeated_header_rows(spark):
    t = spark.createDataFrame([("object_id", "target"), ("1", "92"), ("2", None)], "object_id string, target string")
    assert sorted(map(tuple, tables.drop_header_rows(t).collect())) == [(1, 92), (2, None)]
