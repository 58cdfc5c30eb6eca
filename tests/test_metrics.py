"""Edge cases and laws of the metric plans on hand-written tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cyclelens.operators import periods
from cyclelens.operators.facts import contributions, issue_fact, team_fact
from cyclelens.operators.ranking import page_after
from cyclelens.operators.summarize import SUMMARY, coarser, summarize, summary_of, tally
from cyclelens.plans import cross, cycle_time, dashboard, impact, refresh, rollups, stored_facts, timeline
from cyclelens.session import work_dir
from cyclelens.sources.storage import TableStore
from tests.conftest import as_set, rows_by

AS_OF = datetime(2024, 3, 1)


def test_issue_fact_keeps_negative_cycle_time_and_skips_unanalysable(small):
    fact = rows_by(issue_fact(small), "issue_id")
    assert sorted(fact) == [10, 11, 12, 15]
    assert fact[12]["cycle_time"] == -3
    assert (fact[10]["total_commits"], fact[10]["ai_commits"], fact[10]["has_ai_commits"]) == (2, 1, True)


def test_summary_of_everything(small):
    row = impact.ai_impact(small).first().asDict()
    assert (row["total_issues"], row["issues_with_ai"], row["issues_without_ai"]) == (4, 2, 2)
    assert row["avg_cycle_time_with_ai"] == 15.0
    assert row["avg_cycle_time_without_ai"] == 3.5
    assert row["cycle_time_impact_percentage"] == pytest.approx((3.5 - 15) / 3.5 * 100)


def test_no_match_and_empty_tables_give_one_row_of_zeros(small, empty):
    for frame in (impact.ai_impact(small, project=99), impact.ai_impact(empty)):
        rows = frame.collect()
        assert len(rows) == 1 and all(rows[0][c] == 0 for c in SUMMARY)


def test_commit_filters_act_before_the_rollup(small):
    """Issue 10 has AI commits, but none by engineer 2."""
    row = impact.ai_impact(small, engineer=2).first()
    assert (row.total_issues, row.issues_with_ai) == (2, 0)
    assert row.cycle_time_impact_percentage == 100.0


def test_id_list_with_blanks_and_team_without_commits(small):
    teams = rows_by(rollups.team_metrics(small), "team_id")
    assert teams[1]["engineer_count"] == 2 and teams[1]["total_issues"] == 3
    assert teams[3]["total_issues"] == 0 and teams[3]["avg_cycle_time_with_ai"] == 0.0


def test_team_of_one_engineer_equals_the_engineer(spark, small):
    solo = small.having(teams=spark.createDataFrame([(9, "Solo", "2")], small.teams.schema))
    team = rollups.team_metrics(solo).select(*SUMMARY).first()
    engineer = rollups.engineer_metrics(small).where("engineer_id = 2").select(*SUMMARY).first()
    assert team == engineer


def test_engineers_with_only_unresolved_issues_have_a_row(small):
    scored = rows_by(rollups.engineer_metrics_scored(small), "engineer_id")
    assert sorted(scored) == [1, 2, 3, 4]
    only_open = small.having(commits=small.commits.where("commit_id = 'e'"))
    row = rollups.engineer_metrics_scored(only_open).first()
    assert row.engineer_id == 4 and row.total_issues == 0 and row.efficiency_score == 30.0


def test_category_counts_add_up(small):
    assert rollups.category_metrics(small).agg(F.sum("total_issues")).first()[0] == 4
    assert sorted(rows_by(rollups.category_metrics(small), "category")) == ["bug", "chore", "docs", "feature"]


def test_tallies_add_up_to_coarser_keys(star):
    fact = team_fact(star, carry=("category",))
    fine = summary_of(coarser(tally(fact, "team_id", "category"), "team_id"))
    assert as_set(fine) == as_set(summarize(fact, "team_id"))


def test_author_match_modes(small):
    written = rows_by(rollups.author_metrics(small), "author_id")
    own = rows_by(rollups.author_metrics(small, match="engineer"), "author_id")
    assert written[1]["total_issues"] == 3 and own[1]["total_issues"] == 2
    with pytest.raises(ValueError):
        rollups.author_metrics(small, match="reviewer")


def test_top_categories_break_ties_by_name(spark, small):
    rows = [(i, 1, 1, date(2024, 1, 1), date(2024, 1, 9), c) for i, c in enumerate("fedcbaa")]
    issues = spark.createDataFrame(rows, small.jira_issues.schema)
    commits = spark.createDataFrame(
        [(str(i), 1, i, 1, date(2024, 1, 2), False, 1) for i in range(7)], small.commits.schema
    )
    ranked = rollups.top_categories(small.having(jira_issues=issues, commits=commits)).where("team_id = 1")
    assert [r.category for r in ranked.orderBy("rank").collect()] == ["a", "b", "c", "d", "e"]


def test_team_row_without_categories_has_an_empty_list(spark, small):
    store = TableStore(spark, work_dir(spark, "t"))
    stored = rows_by(rollups.team_metrics_materialized(small, store, AS_OF), "team_id")
    assert stored[3]["top_categories"] == [] and stored[3]["ai_adoption_rate"] == 0.0
    assert stored[1]["top_categories"][0] == {"category": "bug", "issueCount": 2, "aiPercentage": 50.0}


def test_engineer_page_is_a_slice_of_all_engineers(small):
    everyone = rollups.engineer_metrics(small).orderBy("engineer_id").select("engineer_id", *SUMMARY).collect()
    sliced = rollups.engineer_metrics_page(small, batch=2, offset=1).select("engineer_id", "metrics.*").collect()
    assert sliced == everyone[1:3]
    assert rollups.engineer_metrics_page(small, batch=2, offset=50).count() == 0


def test_issue_cycle_time_is_clamped_and_explains_missing_values(small):
    rows = rows_by(cycle_time.issue_cycle_time(small), "issue_id")
    assert rows[12]["cycle_time"] == 0
    assert rows[13]["message"] == cycle_time.NO_COMMITS and rows[14]["message"] == cycle_time.UNRESOLVED
    assert rows[10]["ai_usage_ratio"] == 0.5
    assert cycle_time.issue_cycle_time(small, issue=11).count() == 1


def test_average_of_nothing_is_zero(empty):
    assert cycle_time.average_cycle_time(cycle_time.all_issue_cycle_times(empty)).first()[0] == 0.0


def test_median_is_interpolated_and_unresolved_issues_counted(small):
    rows = rows_by(cycle_time.cycle_time_summary(small), "assistance_type")
    assert rows["ai_assisted"]["issue_count"] == 3
    assert rows["ai_assisted"]["median_cycle_time_days"] == 15.0
    assert (rows["non_ai_assisted"]["min_cycle_time_days"], rows["non_ai_assisted"]["max_cycle_time_days"]) == (-3, 10)


def test_monthly_average_is_a_whole_number(small):
    rows = rows_by(timeline.timeline_adoption(small), "month")
    assert rows["2024-01"]["avg_cycle_time"] == (20 + 10 - 3) // 3
    negative = small.having(commits=small.commits.where("commit_id IN ('d')"))
    assert rows_by(timeline.timeline_adoption(negative), "month")["2024-01"]["avg_cycle_time"] == -3


def test_empty_periods_have_rows_of_zeros(small):
    rows = rows_by(timeline.timeline_periods(small, date(2024, 4, 15)), "time_period")
    assert sorted(rows) == [date(2024, m, 1) for m in (1, 2, 3, 4)]
    assert rows[date(2024, 3, 1)]["total_issues"] == 0 and rows[date(2024, 3, 1)]["ai_adoption_percentage"] == 0.0


def test_commit_volume_counts_all_issues_and_flips_the_sign(small):
    rows = rows_by(timeline.timeline_commit_volume(small, date(2024, 2, 28)), "time_period")
    january = rows[date(2024, 1, 1)]
    assert january["total_issues"] == 6 and january["ai_assisted_issues"] == 2
    assert january["cycle_time_impact_percentage"] == pytest.approx((1.5 / 1 - 1) * 100)


def test_creation_to_resolution_counts_but_does_not_time_unresolved_issues(small):
    rows = rows_by(timeline.timeline_creation_to_resolution(small, date(2024, 2, 28)), "time_period")
    january = rows[date(2024, 1, 1)]
    assert january["total_issues"] == 4 and january["avg_cycle_time_with_ai"] == 20.0
    later = timeline.timeline_creation_to_resolution(small, date(2024, 2, 28), last_stored=date(2024, 2, 1))
    assert [r.time_period for r in later.collect()] == [date(2024, 2, 1)]


def test_timeline_document_is_ordered(spark, small):
    rows = timeline.timeline_periods(small, date(2024, 4, 15)).repartition(3)
    document = timeline.timeline_document(rows).first()
    assert document.interval == "month" and [p.time_period.month for p in document.data] == [1, 2, 3, 4]


def test_pairs_equal_the_filtered_computation(star):
    pairs = cross.cross_dimensional(star)
    for kind in cross.PAIRS:
        row = pairs.where(F.col("dimension_type") == kind).orderBy(F.desc("total_issues"), "dimension_key").first()
        alone = cross.one_pair(star, kind, row.primary_id, row.secondary_id).first()
        assert row == alone
    with pytest.raises(ValueError):
        cross.pair_summary(star, "team-category")


def test_pair_lookup_recomputes_only_stale_rows(spark, small):
    stored = cross.cross_dimensional(small).withColumn("last_calculated", F.lit("2024-02-29 12:00:00").cast("timestamp_ntz"))
    row, recomputed = cross.cross_dimensional_lookup(small, stored, "team-project", 1, 1, AS_OF)
    assert not recomputed and row.first().total_issues == 3
    row, recomputed = cross.cross_dimensional_lookup(small, stored, "team-project", 1, 1, AS_OF, max_age_hours=1)
    assert recomputed and row.first().total_issues == 3
    assert cross.cross_dimensional_lookup(small, stored, "team-project", 1, 1, AS_OF, force=True)[1]
    assert cross.cross_dimensional_lookup(small, stored, "team-project", 3, 3, AS_OF)[0].first().total_issues == 0


def test_routing(spark, small):
    schema = "team_id long, project_id long, author_id long, engineer_id long"
    rows = [(1, 1, None, None), (None, 1, 1, None), (1, None, None, 2), (1, 1, 1, None), (None, 1, None, None), (None, None, 1, 2)]
    routed = cross.route(spark.createDataFrame(rows, schema)).collect()
    assert [r.dimension_type for r in routed] == ["team-project", "author-project", "team-engineer", None, None, None]


def test_checked_requests(spark, small):
    rows = [("team-project", 1, 1), ("team-project", 0, 1), ("team-project", 1, 77), ("nope", 1, 1), ("team-project", None, 1)]
    requests = spark.createDataFrame(rows, "dimension_type string, primary_id long, secondary_id long")
    got = {(r.dimension_type, r.primary_id, r.secondary_id): r for r in cross.cross_dimensional_checked(small, requests).collect()}
    assert got["team-project", 1, 1].status == "ok" and got["team-project", 1, 1].total_issues == 3
    assert "Invalid IDs" in got["team-project", 0, 1].error_message
    assert got["team-project", 1, 77].error_message == "Team 1 or Project 77 does not exist"
    assert got["nope", 1, 1].error_message == "Invalid dimension type: nope"
    assert got["team-project", None, 1].avg_commits_with_ai is None and got["team-project", None, 1].total_issues == 0


def test_team_fan_out_multiplies_commits_unless_deduplicated(small):
    base = rows_by(stored_facts.ai_impact_base(small), "issue_id")
    once = rows_by(stored_facts.ai_impact_base(small, dedupe=True), "issue_id")
    summary = rows_by(stored_facts.ai_impact_summary(small, AS_OF), "issue_id")
    assert base[10]["total_commits"] == 3 and once[10]["total_commits"] == 2
    assert base[10]["team_ids"] == [1, 2] and base[15]["team_ids"] == [1, 2, None]
    assert summary[15]["team_ids"] == [1] and summary[12]["team_ids"] == [2]
    assert {i: r["total_commits"] for i, r in once.items()} == {i: r["total_commits"] for i, r in summary.items()}


def test_issue_of_teamless_engineers_has_no_team_list(small):
    alone = small.having(commits=small.commits.where("commit_id = 'f'"))
    assert stored_facts.ai_impact_base(alone).first().team_ids == [None]
    assert stored_facts.ai_impact_summary(alone, AS_OF).first().team_ids is None


def test_incremental_refresh_equals_full_recompute(small):
    mark = date(2024, 1, 5)
    before = stored_facts.ai_impact_summary(small.having(commits=small.commits.where(F.col("commit_date") <= F.lit(mark))), AS_OF)
    updated = stored_facts.ai_impact_incremental(small, before, mark, AS_OF)
    assert as_set(updated) == as_set(stored_facts.ai_impact_summary(small, AS_OF))


def test_incremental_refresh_drops_a_reopened_issue(small):
    mark = date(2024, 1, 5)
    before = stored_facts.ai_impact_summary(small.having(commits=small.commits.where(F.col("commit_date") <= F.lit(mark))), AS_OF)
    reopened = small.having(
        jira_issues=small.jira_issues.withColumn(
            "resolution_date", F.when(F.col("issue_id") != 10, F.col("resolution_date"))
        )
    )
    assert before.where("issue_id = 10").count() == 1
    updated = stored_facts.ai_impact_incremental(reopened, before, mark, AS_OF)
    assert as_set(updated) == as_set(stored_facts.ai_impact_summary(reopened, AS_OF))


def test_impact_from_summary_is_undefined_without_ai_issues(small):
    summary = stored_facts.ai_impact_summary(small, AS_OF)
    row = stored_facts.impact_from_summary(small, summary.where("NOT has_ai_commits")).first()
    assert row.cycle_time_impact_percentage is None and row.avg_cycle_time_with_ai == 0.0
    assert stored_facts.impact_from_summary(small, summary, project=1, author=1, team=1).first().total_issues == 2


def test_chart_modes(small):
    summary = stored_facts.ai_impact_summary(small, AS_OF)
    chart = rows_by(dashboard.category_chart(summary), "category")
    assert (chart["bug"]["ai_cycle_time"], chart["bug"]["non_ai_cycle_time"]) == (20.0, 10.0)
    assert chart["chore"]["non_ai_cycle_time"] == -3.0
    assert dashboard.category_chart(summary, project=1, engineer=1).count() == 2
    assert rows_by(dashboard.category_chart(summary, mode="first"), "category")["bug"]["ai_cycle_time"] == 20.0


def test_improvements_need_both_groups(small):
    rows = dashboard.project_improvements(issue_fact(small)).collect()
    assert [r.project_id for r in rows] == [1] and rows[0].improvement == -50.0
    overall = dashboard.overall_improvement(dashboard.project_improvements(issue_fact(small))).first()
    assert overall.status == "Negative Impact" and overall.total_ai_issues == 2


def test_no_improvements_give_zero(empty):
    row = dashboard.overall_improvement(dashboard.project_improvements(issue_fact(empty))).first()
    assert (row.percentage, row.total_ai_issues, row.status) == (0.0, 0, "No Impact")


def test_dashboard_request_parts(small):
    parts = rows_by(dashboard.dashboard_for(small, team=1, project=1, engineer=2), "part")
    assert parts["impact"]["total_issues"] == 3 and parts["engineer"]["total_issues"] == 2


def test_detail_pages_hold_every_issue_once(star):
    fact = issue_fact(star)
    pages = impact.issue_detail_pages(fact, "project_id")
    assert pages.select(F.size("issues").alias("n")).agg(F.max("n")).first()[0] <= impact.PAGE_ISSUES
    assert pages.select(F.explode("issues")).count() == fact.count()


def test_documents(small):
    document = impact.impact_documents(rollups.category_metrics(small), "category").where("category = 'bug'").first().document
    assert '"totalIssuesAnalyzed":2' in document and document.startswith('{"summary":{')


def test_refresh_all_touches_only_stale_rows(spark, small):
    store = TableStore(spark, work_dir(spark, "refresh"))
    refresh.refresh_all(small, store, datetime(2024, 2, 1), force=True)
    again = refresh.refresh_all(small, store, datetime(2024, 2, 1, 12))
    assert refresh.all_rows(again).select("last_calculated").distinct().count() == 1
    late = refresh.refresh_all(small, store, AS_OF)
    report = rows_by(refresh.refresh_report(small, late, AS_OF), "dimension")
    assert all(r["processed"] == r["total"] for r in report.values())
    # Nothing was stale the second time, so nothing was written.
    assert store.read("refresh_log").count() == 8


def test_a_fresh_store_is_left_alone(spark, small):
    store = TableStore(spark, work_dir(spark, "refresh"))
    refresh.refresh_all(small, store, datetime(2024, 2, 1), force=True)
    names = [*(refresh.table_name(d) for d in refresh.REFRESHED), "engineer_rollup"]
    before = {n: store._versions(n) for n in names}
    refresh.refresh_all(small, store, datetime(2024, 2, 1, 12))
    assert {n: store._versions(n) for n in names} == before


def test_one_failing_dimension_stops_no_other(spark, small, monkeypatch):
    store = TableStore(spark, work_dir(spark, "refresh"))
    real = refresh.metric_rows

    def broken(domain, dimension, rolled=None):
        if dimension == "project":
            raise RuntimeError("no projects today")
        return real(domain, dimension, rolled)

    monkeypatch.setattr(refresh, "metric_rows", broken)
    done = refresh.refresh_all(small, store, AS_OF)
    assert set(done) == {"team", "engineer", "category"}
    assert [r.message for r in store.read("refresh_failures").collect()] == ["no projects today"]
    report = rows_by(refresh.refresh_report(small, done, AS_OF, failures=store.read("refresh_failures")), "dimension")
    assert report["team"]["failed"] == 0


def test_report_of_a_partial_refresh(spark, small):
    store = TableStore(spark, work_dir(spark, "refresh"))
    refresh.refresh(small, store, "engineer", datetime(2024, 2, 1))
    keys = spark.createDataFrame([(1,)], "engineer_id long")
    refresh.refresh(small, store, "engineer", AS_OF, keys)
    report = refresh.refresh_report(small, {"engineer": store.read(refresh.table_name("engineer"))}, AS_OF).first()
    assert (report.processed, report.total) == (1, 4)


def test_rollup_grain_serves_every_dimension(star):
    from cyclelens.operators.facts import engineer_rollup

    rolled = engineer_rollup(star)
    for dimension in refresh.KEYS:
        assert as_set(refresh.metric_rows(star, dimension, rolled)) == as_set(refresh.metric_rows(star, dimension))


def test_contributions_of_empty_tables(empty):
    assert contributions(empty).count() == 0 and cross.cross_dimensional(empty).count() == 0


def test_keyed_refresh_from_the_stored_rollup(star):
    from cyclelens.operators.facts import engineer_rollup

    for dimension, key in refresh.KEYS.items():
        keys = refresh.owners(star, dimension).orderBy(key).limit(3)
        cut, rolled = refresh.restrict(star, dimension, keys, engineer_rollup(star))
        everything = refresh.metric_rows(star, dimension).join(keys, key, "left_semi")
        assert as_set(refresh.metric_rows(cut, dimension, rolled)) == as_set(everything)


def test_current_reads_refresh_only_what_is_stale(spark, small):
    store = TableStore(spark, work_dir(spark, "current"))
    one = refresh.current(small, store, "engineer", datetime(2024, 2, 1), entity=1)
    assert one.count() == 1 and store.read(refresh.table_name("engineer")).count() == 1
    rows = refresh.current(small, store, "engineer", datetime(2024, 2, 1, 6), limit=2, offset=1).collect()
    assert [r.engineer_id for r in rows] == [2, 3]
    stamps = rows_by(store.read(refresh.table_name("engineer")), "engineer_id")
    assert stamps[1]["last_calculated"] == datetime(2024, 2, 1) and stamps[2]["last_calculated"] == datetime(2024, 2, 1, 6)
    versions = store._versions(refresh.table_name("engineer"))
    refresh.current(small, store, "engineer", datetime(2024, 2, 1, 7))
    assert store._versions(refresh.table_name("engineer")) == versions
    refresh.current(small, store, "engineer", datetime(2024, 2, 1, 7), force=True)
    assert store.read(refresh.table_name("engineer")).select("last_calculated").distinct().count() == 1


def test_current_timeline_is_computed_once(spark, small):
    store = TableStore(spark, work_dir(spark, "timeline"))
    first = timeline.timeline_current(small, store, AS_OF)
    assert [r.time_period for r in first.collect()] == [date(2024, m, 1) for m in (1, 2, 3)]
    versions = store._versions("timeline_metrics_materialized")
    again = timeline.timeline_current(small, store, AS_OF, start=date(2024, 2, 1), end=date(2024, 2, 28))
    assert again.count() == 1 and store._versions("timeline_metrics_materialized") == versions
    timeline.timeline_current(small, store, datetime(2024, 3, 5))
    assert store._versions("timeline_metrics_materialized") != versions


def test_nested_document(small, empty):
    document = impact.impact_document(issue_fact(small)).first().asDict(recursive=True)
    assert document["summary"]["totalIssuesAnalyzed"] == 4
    assert document["detailedStats"]["categoriesWithAi"]["bug"] == {"count": 1, "totalCycleTime": 20, "avgCycleTime": 20.0}
    assert sorted(document["detailedStats"]["categoriesWithoutAi"]) == ["bug", "chore"]
    nothing = impact.impact_document(issue_fact(empty)).first().asDict(recursive=True)
    assert nothing["detailedStats"] == {"categoriesWithAi": {}, "categoriesWithoutAi": {}}


def test_many_categories_make_more_document_pages(small, monkeypatch):
    whole = impact.impact_document(issue_fact(small)).first().asDict(recursive=True)
    monkeypatch.setattr(impact, "PAGE_CATEGORIES", 1)
    pages = [r.asDict(recursive=True) for r in impact.impact_document(issue_fact(small)).collect()]
    for name, expected in whole["detailedStats"].items():
        assert {k: v for p in pages for k, v in p["detailedStats"][name].items()} == expected
    assert all(p["summary"] == whole["summary"] for p in pages)


def test_a_long_calendar_is_no_error(spark):
    days = periods.period_calendar(spark, date(1, 1, 1), date(4000, 12, 31), "quarter")
    assert days.count() == (date(4000, 12, 31) - date(1, 1, 1)).days + 1


def test_page_after_reads_on(small):
    first = page_after(small.engineers, "id", limit=2)
    assert [r.id for r in first.collect()] == [1, 2]
    assert [r.id for r in page_after(small.engineers, "id", after=2, limit=2).collect()] == [3, 4]


def test_sql_vocabulary(spark, small):
    from cyclelens.functions import sql

    sql.register(small)
    assert spark.sql("SELECT days_between(DATE '2024-01-05', DATE '2024-01-02')").first()[0] == -3
    assert spark.sql("SELECT count(*) FROM team_members JOIN teams USING (team_id)").first()[0] == 5
