"""The filter audit against a plain version that applies every order."""

import itertools
import random
import re

from pyspark.sql import functions as F

from worksight.llm import filter_audit


def failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text))}


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, text, source in docs:
        f = failed(text or "")
        f["E"] = d is not None and any(x is not None and x < d and (t or "") == (text or "") for x, t, _ in docs)
        rows.append((source or "", d, f))
    out = {}
    for part in {p for p, _, _ in rows}:
        mine = [(d, f) for p, d, f in rows if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[x]]
                stay = [(d, f) for d, f in left if not f[x]]
                redundant = sum(f[x] for _, f in mine) - len(gone)
                unique = sum(f[x] and sum(f.values()) == 1 for _, f in mine)
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, unique, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x]
                left = stay
        for key in out:
            if key[0] == part:
                out[key][6] = total[out[key][6]]
    return sorted((*k, *v) for k, v in out.items())


def corpus():
    r = random.Random(2)
    docs = []
    for d in range(150):
        words = [r.choice(["a", "b", "C", "d#", "E&"]) if r.random() < 0.3 else f"w{r.randrange(400)}" for _ in range(r.choice([0, 30, 250, 260]))]
        docs.append((d, r.choice([" ", "\t\n"]).join(words), r.choice(["s1", "s2", "s2", None, ""])))
    docs += [(200 + i, r.choice(docs)[1], f"s{i % 4}") for i in range(60)]
    docs += [(None, docs[0][1], "s1"), (None, docs[0][1], "s1"), (None, None, None), (0, docs[0][1], "s9"), (0, docs[1][1], "s1"), (0, docs[0][1], "s9"), (5, "É" * 10, "s2"), (6, "x" * 5000 + " Y" * 30_000, "s2")]
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1, None])) for d in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, mask int, rows int").repartition(5)
    own = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(df, own)
    assert got.columns == columns and dict(got.dtypes)["step"] == "int" and {dict(got.dtypes)[c] for c in columns[3:]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    assert filter_audit.audit(df.where("false"), own).count() == 0
    assert sorted(map(tuple, filter_audit.audit(df, own.where("false")).collect())) == brute(docs, [])


def test_transform_and_its_inverse(spark):
    rows = [("p", bool(m % 2), bool(m % 3 == 0), m, m * m + 1) for m in range(32)]
    counted = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, rows long")
    sums = filter_audit.parity_sums(counted.unionByName(counted.limit(0)), 5)
    got = {x.label: x for x in sums.withColumn("cells", filter_audit.cells(F.col("sums"), 5)).collect()}
    assert got["all"].cells == [m * m + 1 for m in range(32)]
    assert got["good"].cells == [(m * m + 1) * (m % 2) for m in range(32)]
    assert got["toxic"].sums == [sum((-1) ** bin(m & s).count("1") * (m * m + 1) for m in range(0, 32, 3)) for s in range(32)]
