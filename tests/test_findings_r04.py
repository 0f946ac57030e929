"""Findings of round 4: queries on odd rows."""

from pyspark.sql import Row


def test_documents_without_a_token(spark, tmp_path):
    """an empty text has no first token, which is no error."""
    import __spark_entry__ as e

    rows = [(1, "Ab c"), (2, ""), (3, "... --"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = e.queries()["tokenize_documents"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert got == [Row(doc_id=1, tokens=2, first_token="ab"), Row(doc_id=2, tokens=0, first_token=None),
                   Row(doc_id=3, tokens=0, first_token=None), Row(doc_id=4, tokens=None, first_token=None)]


def _exchanged(df):
    """The columns of every exchange of a plan."""
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if "Exchange" in node.nodeName():
            out = node.output()
            found.append([out.apply(i).name() for i in range(out.size())])
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.initialPlan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


def test_whole_rows_are_not_shuffled_to_be_compared(spark):
    """the earlier snapshot sends keys and digests, the later one what is read from the events."""
    from wagelens.streaming import changes

    schema = "id string, a string, b double, c timestamp, d string"
    before, after = (spark.createDataFrame([(str(i), "x", i * k, None, "y") for i in range(5)], schema) for k in (1.0, 2.0))
    with_join = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = changes.capture_changes(before, after)
        whole = _exchanged(found)
        part = _exchanged(found.select("operation", "id", "data.b"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_join)
    assert [sorted(x) for x in whole] == [["_b1", "_b2", "_bk", "_bn"], ["_a", "_a1", "_a2", "_ak", "_an"]]
    assert all("_a" not in x for x in part)
    assert {(r["operation"], r["id"], r["data"]["b"]) for r in found.collect()} == {("UPDATE", str(i), i * 2.0) for i in range(1, 5)}


def test_digests_tell_rows_apart_as_the_rows_do(spark):
    """nulls that change places, nested nulls, zeros of both signs, NaN, repeated and null keys: the events of a comparison of whole rows."""
    from pyspark.sql import functions as F

    from wagelens.streaming import changes

    nan = float("nan")
    schema = "id string, a string, b string, x double, l array<string>, s struct<p:long,q:long>"
    base = ("u", None, 0.0, ["m", None], (1, None))
    other = {"same": base, "moved": (None, "u", 0.0, ["m", None], (1, None)), "zero": ("u", None, -0.0, ["m", None], (1, None)),
             "nan": ("u", None, nan, ["m", None], (1, None)), "array": ("u", None, 0.0, ["m"], (1, None)), "place": ("u", None, 0.0, [None, "m"], (1, None)),
             "struct": ("u", None, 0.0, ["m", None], (None, 1)), "empty": ("", "u", 0.0, ["m", None], (1, None)), "gone_list": ("u", None, 0.0, None, (1, None))}
    before = spark.createDataFrame([(k, *base) for k in other] + [("nan2", "u", None, nan, None, None), ("old", *base), (None, *base), ("twice", *base), ("twice", *base)], schema)
    after = spark.createDataFrame([(k, *v) for k, v in other.items()] + [("nan2", "u", None, nan, None, None), ("new", *base), (None, *base), ("twice", *base), ("twice", "v", *base[1:])], schema)
    cols = [c for c in after.columns if c != "id"]
    j = before.select(F.col("id").alias("k"), F.struct(*cols).alias("b")).join(after.select("id", F.struct(*cols).alias("a")), F.col("k") == F.col("id"), "full_outer")
    op = F.expr("CASE WHEN k IS NULL THEN 'INSERT' WHEN id IS NULL THEN 'DELETE' WHEN NOT b <=> a THEN 'UPDATE' END")
    want = j.select(op.alias("operation"), F.coalesce("id", "k").alias("id"), F.col("a").alias("data")).where("operation IS NOT NULL")
    got = changes.capture_changes(before, after)
    assert got.schema == want.schema
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want)
    assert {r["id"] for r in got.where("operation = 'UPDATE'").collect()} == {"moved", "nan", "array", "place", "struct", "empty", "gone_list", "twice"}


def test_changed_type_is_compared_as_before(spark):
    from wagelens.streaming import changes

    before = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    after = spark.createDataFrame([("a", 1), ("b", 3)], "id string, n long")
    assert [(r["operation"], r["id"]) for r in changes.capture_changes(before, after).collect()] == [("UPDATE", "b")]


def test_rows_stored_by_key_are_not_shuffled(spark):
    """frames in the same key buckets meet without an exchange, with the rows of any other join."""
    from pyspark.sql import functions as F

    from wagelens.streaming import changes

    before, after = (spark.createDataFrame([(str(i), i * k) for i in range(40)] + [(None, 1)], "id string, n long") for k in (1, 2))
    stored = [changes.stored_by_key(df, 8) for df in (before, after)]
    assert sorted(map(repr, stored[0].collect())) == sorted(map(repr, before.collect()))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("by_key_")]
    found = changes.capture_changes(*stored, seq=2)
    assert _exchanged(found) == []
    assert sorted(map(repr, found.collect())) == sorted(map(repr, changes.capture_changes(before, after, seq=2).collect()))
    events = found.where("id IS NOT NULL").repartition(8, "id")
    state = changes.apply_changes(stored[0].where(F.col("id").isNotNull()).withColumn("seq", F.lit(1).cast("long")), events, enrich=False)
    assert len(_exchanged(state)) == 1  # the events
    assert {(r["id"], r["n"]) for r in changes.live_rows(state).collect()} == {(str(i), 2 * i) for i in range(40)}


def test_ingest_shuffles_no_record(spark, tmp_path):
    """records are numbered, cleaned and checked where they are read."""
    from wagelens.schema import SURVEY_HEADERS
    from wagelens.sources import survey_csv

    head = SURVEY_HEADERS["salary_survey-3.csv"]
    names = ("employer", "location", "job_title", "annual_base_pay", "years_experience_industry")
    for part in range(3):
        lines = [",".join(f'"{head[c]}"' for c in names)]
        lines += [f'"E{part}","L\n{i}","T{i}","{1000 + i}","{"9999" if i % 7 == 0 else i}"' for i in range(20)]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    table, rejected, report = survey_csv.ingest_surveys(spark, {"salary_survey-3.csv": str(tmp_path)})
    exchanged = [c for df in (table, rejected) for c in _exchanged(df)]
    assert exchanged and not [c for c in exchanged if {"employer", "job_title"} & set(c)]
    assert table.count() + rejected.count() == 60
    assert sorted(r["row_number"] for r in table.select("row_number").union(rejected.select("row_number")).collect()) == list(range(1, 61))
    plain = survey_csv.ingest_surveys(spark, {"salary_survey-3.csv": str(tmp_path)}, multiline=True)
    left = ("created_at", "updated_at", "timestamp")
    assert sorted(map(repr, table.drop(*left).collect())) == sorted(map(repr, plain[0].drop(*left).collect()))
    assert sorted(map(repr, report.collect())) == sorted(map(repr, plain[2].collect()))
