"""What the store joins and shuffles when it opens windows."""

from sealbook.functions.windows import with_window
from sealbook.operators.ingest import WINDOW_COLUMNS, distinct_windows, insert_if_absent
from sealbook.settings import DAY_MS, Settings
from sealbook.sources.store import MeteringStore
from tests.conftest import BASE


def test_a_table_without_rows_is_not_joined(spark, tmp_path, capsys):
    store = MeteringStore(spark, str(tmp_path / "s"), Settings(window_ms=DAY_MS))
    held = store._read(store.snapshot(), "opened")
    assert held.columns == [*WINDOW_COLUMNS, "batch_id"] and not held.count()
    specs = spark.range(3).selectExpr("cast(id as string) window_key")
    left = insert_if_absent(specs, held, ["window_key"])
    assert left.count() == 3
    capsys.readouterr()
    left.explain()
    assert "Join" not in capsys.readouterr().out


def test_windows_are_told_by_stream_and_start(spark, deliver, capsys):
    rows = [(f"e{k}", 1, BASE + k * DAY_MS // 3) for k in range(9)]
    events = deliver(rows, customer="a:b", metric="c").unionByName(deliver(rows, customer="a", metric="b:c"))
    for length in (DAY_MS, "month"):
        found = distinct_windows(events, length)
        expected = with_window(events, length).select(*WINDOW_COLUMNS).distinct()
        assert sorted(found.collect()) == sorted(expected.collect())
    capsys.readouterr()
    found.explain()
    exchanges = [line for line in capsys.readouterr().out.splitlines() if "Exchange" in line]
    assert exchanges and not any("window_key" in line for line in exchanges)
