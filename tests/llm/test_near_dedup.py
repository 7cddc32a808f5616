import random

from worksight.llm import near_dedup

SCHEMA = "doc_id long, extra string, text string, n_shingles string"


def shingles(text, k=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()  # no other white space in these texts
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {(d, len(s), min(groups[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.randint(3, 120))]
        rows.append(" ".join(base))
        for _ in range(r.randint(0, 14)):
            text = list(base)
            for _ in range(r.randint(0, 7)):
                text[r.randrange(len(text))] = word()
            rows.append(" ".join(text) if r.random() < 0.8 else " ".join(text).upper())
    rows += ["", None, "one", "ONE", "one two", "  one\ttwo\n", "é à ü ö ñ x", "É à ü ö ñ x"]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows))


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, "x", t, "y") for d, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(df).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_group_with_drift_stays_linear_and_whole(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(146)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(i % 11):
            text[r.randrange(146)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame([(d, "", t, "") for d, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(df).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == brute(rows)


def test_nearly_all_close_pairs_share_a_bucket():
    """Of pairs at the threshold that no third text connects, how many banding misses."""
    import numpy as np

    from worksight.llm.common import mix

    r = np.random.default_rng(4)
    multipliers = mix(np.arange(7001, 7065, dtype=np.uint64)) | np.uint64(1)
    missed = 0
    for _ in range(400):
        own = r.integers(0, 2**63, 112, dtype=np.uint64)
        a, b = own[:98], own[14:]  # 84 shared of 112
        sides = [np.stack([(s[None, :] * multipliers[:, None]).min(axis=1), (s[None, :] * multipliers[:, None]).max(axis=1)], axis=1).reshape(-1, 4) for s in (a, b)]
        missed += not (sides[0] == sides[1]).all(axis=1).any()
    assert missed == 0


def test_rows_of_one_id_keep_their_tags_and_groups(spark):
    text, other = "a b c d e f g", "q r s t u v w"
    df = spark.createDataFrame([(1, text, 5), (1, text, 6), (2, text, 7), (2, other, 8), (None, text, 9)], "doc_id long, text string, mark long")
    got = {r.mark: r for r in near_dedup.near_duplicates(df, tag="mark").collect()}
    assert {m: (r.doc_id, r.component_id, r.kept) for m, r in got.items()} == {5: (1, 1, True), 6: (1, 1, True), 7: (2, 1, False), 8: (2, 2, True), 9: (None, None, True)}
    assert got[5].group == got[6].group == got[7].group != got[8].group and got[9].group is None


def test_very_long_text(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    df = spark.createDataFrame([(1, "", " ".join(base), ""), (2, "", " ".join(base[:-9]), ""), (3, "", "short one", "")], SCHEMA)
    assert {(x.doc_id, x.component_id) for x in near_dedup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_nulls_repeats_and_empty_table(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(1, "", text, ""), (1, "", text, ""), (None, "", text, ""), (2, "", text, ""), (3, "", "", "")], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (3, 3, True)], key=str)
    assert near_dedup.near_duplicates(df.where("false")).count() == 0
