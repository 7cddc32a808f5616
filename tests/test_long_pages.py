"""Claims about chunks that aren't there stay wrong on pages of more than a hundred pieces."""

from worksight.plans import catalog

LONG = "<h1>Head</h1>" + "".join(f"<p>{'word ' * 70}{i}</p>" for i in range(130))


def test_missing_chunks_of_long_pages(spark, tmp_path):
    rows = [(i, f"http://host{i}.x/p", LONG if i in (5, 7) else "<h1>Head</h1><p>short</p>") for i in range(1, 12)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    run = lambda name: [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
    assert dict(run("rule_traces")) == {f"RULE-{i}": "MISSING_CHUNK" if i % 5 == 0 else "CLAUSE_NOT_FOUND" for i in range(1, 12) if i % 5 == 0 or i % 2 == 0}
    told = run("grounding_audit")
    assert {i for i, issue in told if issue == "UNKNOWN_CHUNK_ID"} == {5, 10}
    assert {i for i, issue in told if issue == "UNSUPPORTED_PAGE"} == {3, 6, 9}
