"""Every query with SQL agrees with it on the smallest tables; the entry query and the package stand without the llm part."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
@pytest.mark.parametrize("part", range(4))
def test_agreement_with_sql(spark, part):
    from compare import main

    names = sorted(entry.oracle_sql())
    assert main(SF, names[part::4]) == 0


@needs_data
def test_intervals_hold_the_descendants(spark):
    qs = entry.queries()
    paths = {r.proc_key: r.path.split("/") for r in qs["p1_found"](spark, SF).collect() if r.path != "cycle"}
    got = [r for r in qs["p1_intervals"](spark, SF).collect() if r.root_key is not None]
    by_root = {}
    for r in got:
        by_root.setdefault(r.root_key, []).append(r)
    below = {(str(a.proc_key), str(b.proc_key)) for t in by_root.values() for a in t for b in t if a.enter < b.enter < a.leave}
    assert below and below == {(a, str(k)) for k, p in paths.items() for a in p[:-1]}


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['talewind.llm'] = None\nimport __spark_entry__ as e\nassert not any(x.startswith(('p3_', 'p6_', 'p7_', 'p8_', 'p9_')) for x in e.queries()) and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
