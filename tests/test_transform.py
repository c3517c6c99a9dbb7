from pyspark.sql import functions as F

from marlstone.operators import condense as C
from marlstone.operators import links as L
from marlstone.operators import transform as X


def notes(spark, *rows):
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[0] if "/" in p else "", "", t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, folder string, title string, text string")


def test_transforms_in_order():
    text = "---\nstatus: open\ntags: [a, b]\n---\n# My note\n%% hidden %%\n## Part\n> [!tip] Look here\n> inside\n\n- [x] done\n- [ ] open [[a/b|the b]] ![[c#Head]] `[[kept]]`\n\n\n\n```dataview\nLIST\n```\n```py\n# not a heading [[x]]\n```\nplain #tag end"
    got, n = X.transform(text, "my NOTE", X.Options(tasks="dropDone", tags="strip"))
    assert got == "- **status**: open\n- **tags**: a, b\n\n### Part\n**💡 Look here**\ninside\n\n- open the b (c › Head) `[[kept]]`\n\n```py\n# not a heading [[x]]\n```\nplain  end"
    assert n["query_blocks"] == 1 and n["callouts"] == 1 and n["tasks"] == 2 and n["comments"] == 1 and n["links"] == 1 and n["embeds"] == 1
    long = "```\n" + "\n".join(f"l{i}" for i in range(60)) + "\n```"
    got, n = X.transform(long, "T", X.Options(code="collapse"))
    assert n["code_collapsed"] == 1 and "48 lines left out" in got and "l59" in got and got.startswith("## T\n")
    assert X.transform("", "", X.Options())[0] == "" and X.transform("#### deep\n###### deeper", "", X.Options())[0] == "### deep\n##### deeper"


def test_transformed_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "t"), (3, "x [[y]]", None)], "doc_id long, text string, title string").withColumn("links", F.lit(7))
    got = {r.doc_id: (r.text, r.links) for r in X.transformed(df).collect()}
    assert got == {1: (None, 0), 2: ("## t", 0), 3: ("x y", 1)} and X.transformed(df.limit(0)).count() == 0


def test_sections_and_blocks():
    text = "# A\none\n## B\ntwo\n```\n# no heading\n```\n# C\nthree\nfour ^id1\n\n- item ^id2"
    assert X.section(text, "a") == "# A\none\n## B\ntwo\n```\n# no heading\n```" and X.section(text, "b").startswith("## B") and X.section(text, "zz") is None
    assert X.block(text, "id1") == "three\nfour" and X.block(text, "id2") == "- item" and X.block(text, "no") is None


def test_transclusion_reaches_two_levels(spark):
    n = notes(spark, ("a.md", "top ![[b]] and ![[c#Part]] and ![[missing]] ![[pic.png]]\n```\n![[b]]\n```"), ("b.md", "---\nx: 1\n---\nbee ![[d]]"), ("c.md", "# Part\nsee\n# Other\nno"), ("d.md", "dee ![[a]]"))
    got = {r.path: (r.text, r.transclusions) for r in X.transclude(n, L.owners(n)).collect()}
    assert got["a.md"] == ("top bee dee ![[a]] and # Part\nsee and ![[missing]] ![[pic.png]]\n```\n![[b]]\n```", 2)
    assert got["c.md"] == ("# Part\nsee\n# Other\nno", 0)


def test_boilerplate_of_dailies(spark):
    day = "# Daily log\n\nHow are you feeling today?\nRemember to drink some water\n\n## Notes\n{} {}\nScore for today: {}"
    n = notes(spark, *((f"d/{i}.md", day.format("something quite unique happened", w, i)) for i, w in enumerate(("alpha", "beta", "gamma"))))
    got = [r.text for r in C.without_boilerplate(n).orderBy("doc_id").collect()]
    assert all("drink some water" not in t and "Score for today" in t and "unique" in t for t in got) and all("## Notes" in t for t in got)
    same = notes(spark, *((f"d/{i}.md", "The very same sentence everywhere.") for i in range(4)))
    assert all(r.removed == 0 for r in C.without_boilerplate(same).collect())
    assert C.strip_lines("a long heading\nkeep", {1, 2}) == ("a long heading\nkeep", 0)


def test_summaries():
    s = [f"Sentence number {i} tells of the comet and the telescope in the night." for i in range(12)] + ["A comet is a body of ice."]
    text = " ".join(s)
    for method in ("lead", "centroid", "keypoints", "mmr"):
        short, done = C.summarise(text, method, fixed=4, least_words=10)
        rows = short.split("\n")
        assert done and len(rows) == 4 and rows[0] == s[0] and [x for x in s if x in rows] == rows
    assert C.summarise("One. Two.", least_words=1) == ("One. Two.", False)
    plain = " ".join(f"Then one more thing went on for a while in the place they knew {w}." for w in ("first", "well", "best", "least"))
    assert "A comet is a body of ice." in C.summarise(plain + " A comet is a body of ice.", "keypoints", fixed=2, least_words=10)[0]


def test_outline_truncate_glossary_merge(spark):
    n = notes(spark, ("a.md", "## One ##\ntext\n### Sub\n## Two\n```\n## no\n```\n**Comet**: A body of ice is what a comet is.\nnote: todo later maybe."), ("b.md", "Comet: Another definition of it is this one.\nTelescope — A tube with two lenses."), ("c.md", None))
    assert {r.doc_id: list(r.outline) for r in C.outline(n).collect()} == {0: ["One", "Two"]}
    g = {r.term: r.path for r in C.glossary(n).collect()}
    assert g == {"Comet": "a.md", "Telescope": "b.md"}
    cut_ = spark.createDataFrame([("x" * 100 + ". " + "y" * 150 + ". Tail of it " + "z" * 300,), ("short",), (None,)], "t string").select(C.truncated(F.col("t"), F.lit(10))).collect()
    assert cut_[0][0] == "x" * 100 + "." + "\n\n… (cut)" and cut_[1][0] == "short" and cut_[2][0] is None
    groups = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "doc_id long, component long, representative long")
    assert sorted(r.line for r in C.merged_lines(n, groups).collect()) == ["Comet: Another definition of it is this one.", "Telescope — A tube with two lenses."]
