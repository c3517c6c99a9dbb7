import json

from pyspark.sql import functions as F

from marlstone.operators import render as R
from marlstone.profiles import PRESETS, PROFILES, Chunking


def units(spark, sizes, **more):
    rows = [(i + 1, 1, f"f{i % 2}/n{i}.md", "word " * n, n) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "seq long, piece int, path string, text string, tokens long")


def test_chunk_modes(spark, monkeypatch):
    u = units(spark, [100, 100, 100, 900, 50, 50])
    parts = lambda c, o=0: {r.seq: r.part for r in R.chunk(u, c, o).collect()}
    assert parts(Chunking("maxTokens", max_tokens=250)) == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4}
    assert parts(Chunking("maxTokens", max_tokens=250), 50) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    assert set(parts(Chunking("single")).values()) == {1} and parts(Chunking("perNote")) == {i: i for i in range(1, 7)}
    assert parts(Chunking("perFolder")) == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1, 6: 2}
    assert Chunking("maxWords", max_words=100).limit_tokens() == 135 and Chunking("maxChars", max_chars=360).limit_tokens() == 100
    monkeypatch.setattr(R, "PARTS_PER_TASK", 1)  # stretches are packed by themselves, in order
    got = parts(Chunking("maxTokens", max_tokens=250))
    assert [got[i] for i in sorted(got)] == sorted(got.values()) and R.chunk(u.limit(0), Chunking("maxTokens")).count() == 0


def test_split_units(spark):
    text = "\n\n".join(f"# Part {i}\n" + f"Some words of part {i} are here to be read. " * 6 for i in range(8)) + "\n```\n" + "code\n\n" * 20 + "```"
    pieces = R.split_unit(text, 150, 0, 2)
    assert len(pieces) > 2 and all(R.tokens_of(p) <= 150 for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())
    over = R.split_unit(text, 200, 90, 2)
    assert all(b.split("\n\n")[0] in a for a, b in zip(over, over[1:]) if b.startswith("# Part"))
    assert R.hard_split("x" * 100, 10) == ["x" * 36, "x" * 36, "x" * 28] and R.split_unit("short", 100) == ["short"]
    df = spark.createDataFrame([(1, "a.md", text), (2, "b.md", None), (3, "c.md", "")], "seq long, path string, text string")
    got = [(r.seq, r.piece, r.chunk) for r in R.split_units(df, 150, 0, 2).orderBy("seq", "piece").collect()]
    assert got[0] == (1, 1, f"1/{len(pieces)}") and got[-2:] == [(2, 1, ""), (3, 1, "")]


def test_formats(spark):
    rows = [(1, "S01", "a/b.md", "T <1>", "body ]]> **x**", ["k"], 3, 2), (2, "S02", "a/c.md", None, None, None, 0, 0)]
    df = spark.createDataFrame(rows, "seq long, citation string, path string, title string, text string, tags array<string>, inbound long, outbound long")
    u = R.complete(df).join(df.select("seq", "path"), "path").withColumns({"piece": F.lit(1), "chunk": F.lit(""), "part": F.lit(1)})
    whole = lambda f: "".join(r.text for r in R.assembled(u, f, "B").orderBy("seq").collect())
    md = whole("markdown")
    assert md.startswith("# B\n\n## S01 · T <1>\n> `a/b.md` · tags: k · 3 in / 2 out\n\nbody") and "\n\n---\n## S02 · c\n" in md
    docs = json.loads(whole("json"))
    assert docs["bundle"]["documents"] == 2 and docs["documents"][0]["links"] == {"inbound": 3, "outbound": 2} and "title" not in docs["documents"][1]
    lines = [json.loads(x) for x in whole("jsonl").strip().split("\n")]
    assert lines[0]["title"] == "B" and [x.get("id") for x in lines[1:-1]] == ["S01", "S02"] and lines[-1] == {"end": True}
    import xml.etree.ElementTree as E

    root = E.fromstring(whole("xml"))
    assert [d.get("id") for d in root] == ["S01", "S02"] and root[0].find("content").text == "body ]]> **x**" and root[0].find("metadata/tag").text == "k"
    assert "T &lt;1&gt;" in whole("html") and "=" * 78 in whole("plain") and "body ]]> x" in whole("plain")
    assert [r.entry for r in R.contents(u, 1).collect()] == ["S01 · T <1>", "and 1 more"]


def test_recipes():
    assert set(PROFILES) == {"notebook", "chat", "rag", "mirror", "archive", "study", "xml"} and len(PRESETS) == 6
    assert PROFILES["rag"].chunking.limit_tokens() == 1000 and PROFILES["notebook"].chunking.limit_tokens() == 607_500
