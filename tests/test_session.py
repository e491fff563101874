"""Sources and settings."""

from plumbline import session
from plumbline.sources import tables


def test_copy_round_trip(spark, sf, tmp_path):
    region = session.table(spark, sf, "region")
    schema = "r_regionkey int, r_name string"
    for form in ("csv", "json", "parquet"):
        tables.copy_to(region, str(tmp_path / form), form)
        back = tables.copy_from(spark, str(tmp_path / form), schema, form)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, region.collect()))


def test_load_data_and_parents(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\ta\n2\t\\N\n")
    rows = tables.load_data(spark, str(tmp_path / "t.tsv"), "k int, v string")
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, None)]
    both = tables.parent_scan([rows, rows.drop("v")])
    assert both.count() == 4 and both.columns == ["k", "v"]


def test_refresh_swaps(spark, tmp_path):
    root = str(tmp_path / "mv")
    one = tables.refresh(spark, spark.range(2), root, 1)
    two = tables.refresh(spark, spark.range(5), root, 2)
    assert (one.count(), two.count()) == (2, 5)


def test_views_and_settings(spark, sf):
    session.register(spark, sf, ("region",), "reg_")
    assert spark.table("reg_region").count() == 5
    assert session.SETTINGS["spark.sql.session.timeZone"] == "UTC"
