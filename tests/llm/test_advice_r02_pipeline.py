"""Round 2 advice, pipeline: no row is lost for want of labels, and no text for sharing its doc_id."""

from wagelens.llm import jaccard_join, language_id

DOCS = "doc_id long, text string, lang string"


def test_unlabelled_documents_stay(spark):
    docs = spark.createDataFrame([(1, "a clean text", None), (2, None, None), (3, " 12 ", None), (None, "another", None)], DOCS)
    kept = language_id.with_language(docs, language_id.learn(docs)).collect()
    assert sorted(r["text"] for r in kept) == ["a clean text", "another"]


def test_texts_that_share_an_id_stay(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(7, words("a")), (7, words("b")), (7, words("c")), (7, words("c")), (8, words("a") + " more"), (9, words("d")), (7, ""), (7, None),
            (7, words("e").upper()), (7, words("e")), (None, words("a"))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted(
        [(7, words("a")), (7, words("b")), (7, words("c")), (7, words("e")), (7, ""), (7, ""), (9, words("d")), (None, words("a"))], key=str)
