import pytest

from pointmill.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_match_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_simulated_curve_is_found_again(spark, sf_dir):
    rows = QUERIES["profile_fit_water"](spark, sf_dir).collect()
    best = min(rows, key=lambda r: r["chi2"])
    assert best["scale"] == 1.0 and abs(best["a"] - 1) < 1e-3 and abs(best["b"]) < 1
    assert len({r["chi2"] for r in rows}) == len(rows)


def test_simulated_cutoff_and_move_are_found_again(spark, sf_dir):
    cutoffs = {r["level"]: r["chi2"] for r in QUERIES["map_fit_cutoff"](spark, sf_dir).collect()}
    assert min(cutoffs, key=cutoffs.get) == 3 and len(set(cutoffs.values())) == len(cutoffs)
    moves = {r["move"]: r["total"] for r in QUERIES["move_scores"](spark, sf_dir).collect()}
    assert min(moves, key=moves.get) == 1


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["q", "intensity"]
