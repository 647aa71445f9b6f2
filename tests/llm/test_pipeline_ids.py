"""Null and repeated ids in the near-duplicate stage."""

from sleuthframe.llm import jaccard


def test_unlinked_documents_with_null_or_shared_ids_all_stay(spark):
    rows = [(None, "one text about a harbour and its boats"), (None, "quite another text on mountains and their snow"), (7, "a third text that tells of rivers and mills"), (7, "the fourth text is on bread and how to bake it"), (8, "a third text that tells of rivers and mills")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in jaccard.deduplicate(docs).collect()) == sorted({t for _, t in rows})
