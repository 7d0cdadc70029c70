"""Rows of a panel move between symbols and instants no more often than the formulas together ask for."""

import re

import pytest

from tidemill.operators import factors
from tidemill.plans import panel_queries


def moves(df, capsys):
    """Columns of each exchange of a query's plan."""
    capsys.readouterr()
    df.explain("formatted")
    return [m.count(", ") + 1 for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)]


#: Exchanges of a query, that by cells included, and the most columns that one of them carries.
MOST = [("alphas_decayed", 4, 16), ("alphas_deep", 6, 16), ("alphas_ranked", 4, 16)]


@pytest.mark.parametrize("name,exchanges,columns", MOST, ids=[m[0] for m in MOST])
def test_moves_of_a_query(spark, small_dir, capsys, name, exchanges, columns):
    found = moves(panel_queries.QUERIES[name](spark, small_dir), capsys)
    assert len(found) <= exchanges and max(found) <= columns, found


def test_lists_of_a_window_stay_behind(spark, capsys):
    """A place in time computed before ranks are asked for moves as a number."""
    rows = [(f"s{k}", t, float((k * 7 + t * 5) % 11)) for k in range(4) for t in range(12)]
    df = spark.createDataFrame(rows, "symbol string, t long, x double").selectExpr("symbol", "timestamp_seconds(t) AS ts", "x")
    x = factors.column("x")
    got = factors.add_factors(df, {"p": factors.ts_rank(x, 5), "q": factors.rank(factors.ts_argmax(x, 4)) + factors.ts_rank(x, 5)}).select("symbol", "ts", "p", "q")
    assert moves(got, capsys) == [3, 4]  # symbol, ts and x; then the place in time and that of the largest
    by = {(r.symbol, r.ts.timestamp()): r for r in got.collect()}
    own = {(s, float(t)): v for s, t, v in rows}
    for (s, t), r in by.items():
        last = [own[s, t - k] for k in range(4, -1, -1)] if t >= 4 else None
        want = None if last is None else (sum(v < last[-1] for v in last) + (sum(v == last[-1] for v in last) + 1) / 2) / 5
        assert r.p == want and (r.q is None) == (want is None)
