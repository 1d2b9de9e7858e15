import pytest

from tallyspark.__main__ import main
from tallyspark.functions import catalog

SF = "/root/testdata/sf0.001"


def test_schema_and_names(spark, capsys):
    main(["schema", catalog.CORE], spark)
    assert capsys.readouterr().out.startswith(f"CREATE TABLE IF NOT EXISTS {catalog.CORE} (")
    main(["queries"], spark)
    assert {"bm25_topk", "numeric_cells", "growth_yoy"} <= set(capsys.readouterr().out.split())


def test_companies_are_loaded_twice_without_change(spark, tmp_path, capsys):
    (tmp_path / "c.csv").write_text("股票代码,A股简称,公司名称,上市交易所,所属证监会行业\n332,a,x,y,z\n333,b,x,y,z\n", encoding="utf-8")
    for _ in range(2):
        main(["companies", f"{tmp_path}/c.csv", f"{tmp_path}/out"], spark)
    assert capsys.readouterr().out.split() == ["2", "2"]


def test_a_query_is_shown_or_written(spark, tmp_path, capsys):
    main(["run", "effective_quota", SF, "--rows", "3"], spark)
    assert "quota" in capsys.readouterr().out
    main(["run", "effective_quota", SF, "--out", f"{tmp_path}/r", "--kind", "json"], spark)
    assert spark.read.json(f"{tmp_path}/r").count() == 25
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", SF], spark)
