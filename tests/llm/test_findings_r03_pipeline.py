"""Round 3 findings, pipeline: the language stage tells every document's language, also against a wrong label."""

import corpus_pipeline


def test_wrong_labels_are_corrected(spark):
    words = {"xa": "kalo mirepa sutanilo", "yb": "wuth grimsk broldt"}
    rows = [(i, f"{words[x]} {words[x]}", x, "s", 40) for i in range(200) for x in [("xa", "yb")[i % 2]]]
    rows += [(300, words["xa"], "yb", "s", 20), (301, words["yb"], None, "s", 18), (302, " 12 ", "xa", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == {i: ("xa", "yb")[i % 2] for i in range(200)} | {300: "xa", 301: "yb"}
