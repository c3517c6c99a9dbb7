import random

from pyspark.sql import functions as F

from marlstone.operators import atlas as A
from marlstone.operators import links as L
from marlstone.operators import notes as N
from marlstone.operators import similar as M


def notes(spark, *texts):
    return spark.createDataFrame([(i, f"f{i % 2}/n{i}.md", f"f{i % 2}", f"n{i}", "", t, None) for i, t in enumerate(texts)], "doc_id long, path string, folder string, stem string, title string, text string, mtime timestamp")


def test_signatures_estimate_likeness(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = []
    for edits in (0, 0, 1, 2, 4):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(400)] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(f"z{i}" for i in range(100)), "too short", "", None]
    n = notes(spark, *texts)
    sig = {r.doc_id: list(r.signature) for r in M.signatures(n).collect()}
    assert set(sig) == {0, 1, 2, 3, 4, 5} and sig[0] == sig[1] and len(sig[0]) == 32
    pairs = {(r.a, r.b): r.similarity for r in M.banded_pairs(M.signatures(n)).collect()}
    assert {(0, 2), (0, 3)} <= set(pairs) and not any(5 in p or 1 in p for p in pairs)  # 1 is of 0's class
    near = M.related(M.banded_pairs(M.signatures(n)), 2)
    assert max(r["rank"] for r in near.collect()) == 2 and 0 < M.cohesion(near).first()[0] <= 1


def test_contained(spark):
    guide = " ".join(f"g{i}" for i in range(300))
    n = notes(spark, guide, " ".join(guide.split()[:150]), guide, " ".join(f"h{i}" for i in range(50)), "short", None)
    got = [(r.a, r.b, r.containment) for r in M.contained_pairs(n.where("text IS NOT NULL")).collect()]
    assert got == [(1, 0, 1.0)] and M.contained_pairs(n.limit(0)).count() == 0


def test_themes_and_map(spark):
    soup = "the soup is cooked with onion carrot salt pepper and water in a large pot over low heat for an hour {}"
    comet = "the comet was seen through the telescope above the observatory by astronomers in the cold night sky {}"
    n = notes(spark, *(soup.format(f"x{i}") for i in range(3)), *(comet.format(f"y{i}") for i in range(4)), "# Alone [[n0]] [[n1]]")
    kt = N.key_terms(n)
    th = M.themes(M.banded_pairs(M.signatures(n)), kt).collect()
    assert [(t.theme, t.notes) for t in th] == [(3, 4), (0, 3)]
    e = L.edges(L.resolve(L.internal(n, "path").select(F.col("path").alias("a"), "target"), L.owners(n)))
    text = A.knowledge_map(n, e, "t")
    assert "8 notes in 2 folders" in text and "## Themes" in text and 'n0["n7"] --> n1["n0"]' in text
    assert "No notes" in A.knowledge_map(n.limit(0), e.limit(0))


def test_dates_and_reading_order(spark):
    df = spark.createDataFrame([("2026-01-02",), ("2026-01-02T03:04:05Z",), ("1767312000000",), ("1767312000",), ("soon",), (None,), ("2026-99-99",)], "t string")
    got = [r[0] for r in df.select(F.date_format(A.as_date(F.col("t")), "yyyy-MM-dd")).collect()]
    assert got == ["2026-01-02"] * 2 + ["2026-01-02"] * 2 + [None] * 3
    hubs = spark.createDataFrame([("h", 5)], "path string, in_degree long")
    themes = spark.createDataFrame([(1, 3)], "theme long, notes long")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "h")], "theme long, path string")
    signal = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("h", 0.3), ("z", 0.9)], "path string, signal double")
    assert [r.path for r in A.reading_order(hubs, themes, members, signal, 4).orderBy("place").collect()] == ["h", "b", "z", "a"]
