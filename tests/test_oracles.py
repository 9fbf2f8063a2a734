"""Every registered query of the base library against its SQL, or run to its end where SQL can't say it."""

import math

import duckdb
import pytest

from ticketloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (bool, int, str, bytes, list, tuple)) or v is None else float(v) if hasattr(v, "as_tuple") else v


#: Cheap queries whose rounding or ties show at more rows only.
LARGER = ["r18_confidence", "r19_gate", "c5_moved_anchor", "e12_ledger_cases", "k14_browse", "v4_redlines", "f2_feedback"]


@pytest.mark.parametrize(("name", "folder"), [(n, None) for n in sorted(catalog.queries())] + [(n, "/root/testdata/sf0.01") for n in LARGER])
def test_query(spark, sf_dir, name, folder):
    sf_dir = folder or sf_dir
    df = catalog.queries()[name](spark, sf_dir)
    sql = catalog.oracle_sql().get(name)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    if not sql:
        assert got
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=str)
    assert got == want
