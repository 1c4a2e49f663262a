"""Every query with SQL gives DuckDB's rows."""

from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.sql(catalog.ORACLE[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[k]) for k in place)) for r in found.fetchall())
    assert got


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_plans_stay_in_the_jvm(spark):
    for name in ("nearest_palette", "rle_tokens", "median_cut_step", "resize_contain", "le_decode"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_scans_are_pruned(spark):
    plan = catalog.color_histogram(spark, SF)._jdf.queryExecution().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan.split("ReadSchema")[-1]


def test_exact_palettes_read_every_pixel(spark):
    from tessella.functions import color
    from tessella.plans import views

    seen = {}
    for p in views.pixels(spark, SF).where(f"a >= {color.OPAQUE}").orderBy("img", "pos").collect():
        seen.setdefault(p.img, {}).setdefault((p.r // 32 * 32, 0, p.b))
    got = {}
    for r in sorted(catalog.QUERIES["view_palette_exact_tones"](spark, SF).collect(), key=lambda r: (r.img, r.idx)):
        got.setdefault(r.img, []).append((r.r, r.g, r.b))
    assert len(got) > 1 and got == {k: [*c, *[(0, 0, 0)] * (255 - len(c)), (255, 255, 255)] for k, c in seen.items()}
