"""Engineers that only the commits know."""

from datetime import date, datetime

from cyclelens.plans import refresh
from cyclelens.session import work_dir
from cyclelens.sources.storage import TableStore
from tests.conftest import ROWS, make_domain


def test_an_orphan_engineer_that_commits_later_is_found(spark, small):
    store = TableStore(spark, work_dir(spark, "refresh"))
    refresh.refresh_all(small, store, datetime(2024, 2, 1), force=True)
    later = make_domain(spark, ROWS | {"commits": [*ROWS["commits"], ("h", 99, 10, 1, date(2024, 1, 7), False, 1)]})
    done = refresh.refresh_all(later, store, datetime(2024, 2, 1, 12))
    assert {r.engineer_id for r in done["engineer"].collect()} == {1, 2, 3, 4, 99}
    assert [r.engineer_id for r in done["engineer"].where("last_calculated > timestamp'2024-02-01 06:00:00'").collect()] == [99]
