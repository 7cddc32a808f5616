"""Words of search texts are counted where the texts are read, and are those of the normalized texts."""

from tests.test_texts import RECORD
from worksight.operators import vectors
from worksight.plans import register

ODD = ["New  ROAD_bridge!", "Straße  ÉCOLE-ﬁn x² ½ ª", "Σίσυφος ΑΣ ᏣᎳᎩ", "a b\x1cc d | e", "日本語 テスト１２", "__--__", "", None, "naïve\nİstanbul ŉ ß" * 50, "w " * 300]


def rows(spark):
    works = [(i, text, "Roads", None, "", "D 1", None, ODD[i - 1]) for i, text in enumerate(ODD)] + [(99, *[None] * 7)]
    return spark.createDataFrame(works, "work_id long, description string, sector string, sub_sector string, state string, district string, block string, village string")


def test_counts_are_those_of_the_search_texts(spark):
    df = rows(spark)
    for fields in (vectors.LABELS, {"description": "work"}):
        want, got = ({r.work_id: r.v and bytes(r.v) for r in t.collect()} for t in (vectors.term_counts(vectors.search_texts(df, fields), 512), vectors.search_counts(df, fields, 512)))
        assert got == want and got[99] is None and len(got) == len(ODD) + 1


def test_near_pairs_normalize_no_text_by_itself(spark, monkeypatch):
    record = ("x", 10.0, 75.0, 1, 1, None, "a")
    df = rows(spark).selectExpr("*", *[f"cast({v!r} as {c.split()[1]}) as {c.split()[0]}" if v is not None else f"cast(null as {c.split()[1]}) as {c.split()[0]}" for v, c in zip(record[1:], RECORD.split(", ")[7:], strict=True)])
    monkeypatch.setattr(register.domain, "register", lambda spark, d: df)

    def fail(*_):
        raise AssertionError("texts are normalized by themselves")

    monkeypatch.setattr(vectors, "normalize_texts", fail)
    assert register.search_vectors(spark, "")[0].count() == len(ODD)
    assert register.description_vectors(spark, "")[0].count() == len(ODD) - 3
