"""A row without an id does not part the copies of its text."""

from dunlin.llm.jaccard_join import join


def test_null_id_in_a_group_of_copies(spark):
    a = " ".join(f"a{i}" for i in range(100))
    near = a.replace("a99", "edit")
    other = " ".join(f"b{i}" for i in range(30))
    rows = [(None, a), (7, a), (8, a), (9, a), (5, near), (3, other), (None, other), (None, "no copy of this"), (4, "alone here")]
    member, links = join(spark.createDataFrame(rows, "doc_id long, text string"))
    got = member.collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(7, 5), (8, 5), (9, 5), (5, 5), (3, 3), (4, 4), (None, None)}
    assert {r["class_id"] for r in got if r["doc_id"] in (7, 8, 9)} == {7}
    assert [sorted(r) for r in links.collect()] == [[5, 7]]
