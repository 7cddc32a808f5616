"""Texts of few pieces have fingerprints of their own."""

from worksight.llm import fingerprints


def test_texts_of_one_to_six_pieces(spark):
    rows = [(100 * n + i, " ".join(f"{chr(97 + n)}{i}{j}" for j in range(n))) for n in range(7) for i in range(100 if n else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    assert (got[0].fingerprint, got[0].n_anchors) == ("", 0)
    assert all(r.fingerprint and r.n_anchors for i, r in got.items() if i)
    assert len({r.fingerprint for r in got.values()}) == len(rows)
