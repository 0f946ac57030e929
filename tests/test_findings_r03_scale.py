"""Round 3 findings on growth: rows meet once, dimensions are built once, counts need no sort."""

from pyspark.sql import functions as F

from wagelens.operators import quality
from wagelens.operators.rank_select import narrow, settle
from wagelens.plans import catalog
from wagelens.streaming import changes as CH


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_changes_meet_their_target_in_one_join(spark):
    """Null and repeated ids, older events, deletes and columns of one side only."""
    target = spark.createDataFrame([("a", 1, 10, "x"), ("a", 9, 11, "y"), (None, 1, 12, "z"), ("b", 1, 13, "v"), ("k", 1, 14, "w")],
                                   "id string, seq long, pay long, note string")
    events = spark.createDataFrame([(5, "UPDATE", "a", (20,)), (4, "UPDATE", "a", (19,)), (5, "INSERT", None, (21,)), (5, "DELETE", "b", None), (5, "INSERT", "c", (22,))],
                                   "seq long, operation string, id string, data struct<pay: int>")
    state = CH.apply_changes(target, events, enrich=False)
    assert state.columns == ["id", "seq", "pay", "note", "operation"] and dict(state.dtypes)["pay"] == "bigint"
    want = {("a", 5, 20, "x", "UPDATE"), ("a", 9, 11, "y", None), (None, 1, 12, "z", None), (None, 5, 21, None, "INSERT"),
            ("b", 5, None, None, "DELETE"), ("k", 1, 14, "w", None), ("c", 5, 22, None, "INSERT")}
    got = [tuple(r) for r in state.collect()]
    assert set(got) == want and len(got) == len(want)
    live = CH.apply_changes(target, events, enrich=False, keep_tombstones=False)
    assert {tuple(r) for r in live.collect()} == {w[:4] for w in want if w[4] != "DELETE"}
    assert state._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_facts_are_not_shuffled_for_small_dimensions(spark):
    """The size of a dimension is known before the facts are read."""
    facts = spark.range(600_000).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("company "), F.col("id") % 7).alias("employer"),
        F.concat(F.lit("place, "), F.col("id") % 5).alias("location"), F.concat(F.lit("title "), F.col("id") % 3).alias("job_title"))
    joined = quality.star_join(facts, *catalog._dimensions(facts))
    plan = _plan(joined)
    assert plan.count("BroadcastHashJoin") == 3 and "Exchange hashpartitioning" not in plan
    assert joined.where("company_id IS NULL OR location_id IS NULL OR job_title_id IS NULL").count() == 0 and joined.count() == 600_000


def test_rank_counts_need_no_sort_of_the_rows(spark):
    """No array among the counts of a round, which would have all rows sorted before they are counted."""
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").alias("_v"))
    groups = settle(df.groupBy("k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn(
        "_targets", F.expr("array(struct(0 AS t, 250L AS r))")), True)
    found = narrow(df, groups, ["k"], True, True)
    assert "SortAggregate" not in _plan(found)
    for r in found.collect():
        assert r["_lo"] <= 500 + int(r["k"]) <= r["_hi"]
