"""The driver's functions, with and without the optional corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_corpus_operators(tmp_path):
    for name in ("quillspark", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "quillspark"
    package.mkdir()
    for p in (ROOT / "quillspark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
    assert out.returncode == 0 and out.stdout.strip().endswith("[]"), out.stderr


def test_rendered_documents_round_trip(spark, tmp_path):
    import datetime

    from quillspark import queries as q

    spark.createDataFrame([(1, 5, 3, 10.5, 0.06), (1, 5, 4, 20.25, 0.0), (2, 6, 3, 1.0, 0.13)], "l_orderkey long, l_suppkey long, l_partkey long, l_extendedprice double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    days = datetime.datetime(2020, 1, 2)
    spark.createDataFrame([(1, 9, days), (2, 8, days)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["k"]: r for r in q.parse_general_fields(spark, str(tmp_path)).collect()}
    assert (got[1]["net"], got[1]["tax"], got[1]["gross"], got[1]["n_items"], got[1]["buyer"]) == ("30.75", "0.63", "31.38", 2, "客户9科技有限公司")
    assert (got[2]["invoice_number"], got[2]["issue_date"]) == ("26000000000002000006", "2020-01-02")
