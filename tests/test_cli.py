"""The command line."""

from plumbline.__main__ import main


def test_diff(tmp_path, capsys):
    old, new = tmp_path / "a.sql", tmp_path / "b.sql"
    old.write_text("CREATE TABLE t (id int PRIMARY KEY, a text)")
    new.write_text("CREATE TABLE t (id int PRIMARY KEY, b text)")
    assert main(["diff", str(old), str(new), "--rename", "t.a=b"]) == 1
    assert capsys.readouterr().out.strip() == "rename column t.a r_name -> b".replace("r_name", "a")
    assert main(["diff", str(old), str(old)]) == 0


def test_check_verify_apply(spark, sf, tmp_path, capsys):
    q = tmp_path / "q.sql"
    q.write_text("SELECT r_name FROM {region} {{if .x}}WHERE nope = {{.x}}{{end}}")
    assert main(["check", str(q), sf]) == 1
    assert "42703" in capsys.readouterr().out
    s, n = tmp_path / "s.sql", tmp_path / "n.sql"
    s.write_text("CREATE TABLE region (r_regionkey int PRIMARY KEY, r_name text)")
    n.write_text("CREATE TABLE region (r_regionkey bigint PRIMARY KEY, r_label text)")
    assert main(["verify", str(s), sf]) == 0
    assert main(["apply", str(s), str(n), sf, str(tmp_path / "out"), "--rename", "region.r_name=r_label"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/region.parquet").columns == ["r_regionkey", "r_label"]
