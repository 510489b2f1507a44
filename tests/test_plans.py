from conftest import DATA

from millrace.plans import logs, training
from millrace.session import table


def test_all_rows_reach_the_routing_table(spark):
    rows = table(spark, DATA, "lineitem").select("l_orderkey", "l_linenumber").collect()
    cells = {}
    for r in rows:
        cells[r.l_orderkey, r.l_linenumber - 1] = cells.get((r.l_orderkey, r.l_linenumber - 1), 0) + 1
    wanted = {c: "out_of_range" if c[1] >= 6 else "twice" for c, n in cells.items() if n > 1 or c[1] >= 6}
    wanted |= {(t, y): "missing" for t in range(max(t for t, _ in cells) + 1) for y in range(6) if (t, y) not in cells}
    assert {(r.token, r.layer): r.fault for r in training.QUERIES["routing_table"](spark, DATA).collect()} == wanted


def test_no_event_is_dropped_before_the_steps(spark):
    assert logs._begin_end(spark, DATA).count() == table(spark, DATA, "events").count()
