import os

from voicegrain.queries_signals import QUERIES, _coached
from voicegrain.streaming import coach


def test_every_kind_of_trigger_fires(spark, sf):
    larger = os.path.join(os.path.dirname(sf), "sf0.01")  # forty sessions
    kinds = {r.type for r in QUERIES["stm_13_triggers"](spark, larger).collect()}
    assert kinds == {"complaint_spike", "soldout_demand", "low_stock", "question_burst", "backlog", "hot_other_product", "ask_not_buy", "engagement_drop", "missing_info"}


def test_limits_and_quiet_sessions(spark, sf):
    placed = QUERIES["cmp_12_coach"](spark, sf).collect()
    for s in {r.session_id for r in placed}:
        mine = sorted((r for r in placed if r.session_id == s), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, len(mine) + 1)) and len(mine) <= 6
        ranks = [coach.SEVERITY[r.severity] for r in mine]
        assert ranks == sorted(ranks, reverse=True) and all([r.type for r in mine].count(r.type) <= 2 for r in mine)
    rows, sessions, stock, groups = _coached(spark, sf)
    assert coach.coach(rows.where("intent = 'praise'"), sessions, stock, groups.limit(0)).where("type <> 'engagement_drop'").count() == 0
    assert coach.coach(rows.limit(0), sessions, stock, groups.limit(0)).count() == 0


def test_comments_are_neither_grouped_by_all_keys_nor_sorted_to_meet_their_session(spark, sf):
    rows, sessions, _, _ = _coached(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = coach.counted(rows, sessions)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("HashAggregate") == 2  # those of the sessions
    assert joined.count() == rows.count()
