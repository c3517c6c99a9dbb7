import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone import export as E
from marlstone.operators import notes as N
from marlstone.operators import select as S
from marlstone.profiles import PROFILES, Chunking, Profile

T0 = dt.datetime(2026, 1, 10)


def vault(spark):
    day = "# Log\n\nRemember to drink some water\n\nToday {} went well and the {} was found in the garden behind the old house."
    rows = [
        ("a/one.md", "---\ntitle: First\ntags: [x/y]\n---\nThis is the first note of all, and it links to [[two]] and [[nowhere]].\n![[two#Part]]"),
        ("a/two.md", "# Second\n## Part\nThe part that is shown has quite a few words of its own to show."),
        ("a/copy.md", "# Second\n## Part\nThe part that is shown has quite a few words of its own to show."),
        *((f"d/{w}.md", day.format(w, w * 2)) for w in ("alpha", "beta", "gamma")),
        ("b/stub.md", "see [[two]]"), ("b/pic.png", "x"), ("out/old.md", "an older bundle that is here with enough words in it"), ("b/null.md", None),
    ]
    return spark.createDataFrame([(p, t, T0) for p, t in rows], "path string, text string, mtime timestamp")


def test_export_from_end_to_end(spark, tmp_path):
    p = replace(PROFILES["notebook"], dedupe_words=5)
    b = E.run_export(vault(spark), p, "vault", T0, "out")
    assert b.stats["discovered"] == 10 and b.stats["kept"] == 5 and b.stats["parts"] == 1 and not b.warnings
    why = {r.path: list(r.reasons) for r in b.left_out.collect()}
    assert why["b/pic.png"][0] == "extension" and why["out/old.md"] == ["own output"] and why["a/two.md"] == ["duplicate of a/copy.md"] or why["a/copy.md"] == ["duplicate of a/two.md"]
    assert "short" in why["b/stub.md"] and "stub" in why["b/stub.md"]
    files = E.write(spark, b, f"file://{tmp_path}/out")
    assert files[0] == "vault - 2026-01-10 notebook.md" and {"report.md", "instructions.md", "manifest.json"} <= set(files)
    text = (tmp_path / "out" / files[0]).read_text()
    assert text.startswith("# vault\n\n## S01 · Second\n> `a/copy.md`") and "\n## S02 · First\n> `a/one.md`" in text and "drink some water" not in text and "The part that is shown" in text and "1 outside this bundle" in text
    assert json.loads((tmp_path / "out/manifest.json").read_text())["stats"]["kept"] == 5
    assert spark.read.json(f"file://{tmp_path}/out/manifest").count() == 5 and "duplicate: 1" in (tmp_path / "out/report.md").read_text()


@pytest.mark.parametrize("name", ["rag", "study"])
def test_recipes_run(spark, tmp_path, name):
    b = E.run_export(vault(spark), replace(PROFILES[name], dedupe_words=5), "vault", T0)
    files = E.write(spark, b, f"file://{tmp_path}")
    assert b.stats["kept"] >= 5 and all((tmp_path / f).exists() for f in files)
    if name == "rag":
        assert len([json.loads(x) for x in (tmp_path / files[0]).read_text().strip().split("\n")]) >= 3


def test_candidates(spark):
    df = spark.createDataFrame([("x/a.md", 5), ("x/y/z/b.md", 5), ("c.md", 5), ("x/big.md", 10**9), ("x/t.txt", 1)], "path string, size long")
    kept = lambda **k: sorted(r.path for r in E.candidates(df, Profile("p", **k)).where(F.size("reasons") == 0).collect())
    assert kept() == ["c.md", "x/a.md", "x/y/z/b.md"] and kept(roots=("X",), depth=1) == ["x/a.md"]
    assert kept(path_regex="(") == kept() and kept(path_regex="z/") == ["x/y/z/b.md"] and kept(exclude=("y/",)) == ["c.md", "x/a.md"]
    assert "x/t.txt" in kept(include=("**",), text_files=True)


def test_names_stay_in_the_folder(spark):
    u = spark.createDataFrame([(1, 1, 1, "../../etc/x.md"), (2, 2, 1, "etc/x.txt"), (3, 3, 1, "a:b?.md")], "part long, seq long, piece int, path string")
    p = Profile("p", name="{{note_path}}", chunking=Chunking("perNote"))
    assert [r.name for r in E.output_names(u, p, "t", "d", "md").orderBy("part").collect()] == ["etc/x.md", "etc/x-2.md", "a-b.md"]
    many = replace(p, name="{{folder}} {{unknown}}{{date:x}}")
    assert [r.name for r in E.output_names(u, many, "t", "d", "md").orderBy("part").collect()] == ["t d - part 1.md", "t d - part 2.md", "t d - part 3.md"]


def test_status(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    was = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    assert tuple(E.status(now, was).first()) == (0, 1, 1, 1, "1 changed, 1 gone") and E.status(now, now).first().text == "up to date"


def test_focus_with_tags_phrases_and_hops(spark):
    rows = [(1, "lab/rerank.md", "Reranking", "---\ntags: [research]\n---\nreranking reranking works on reranking scores [[other]]"), (2, "lab/other.md", "Other", "something linked"), (3, "old/draft.md", "Reranking draft", "---\ntags: [draft/old]\n---\nreranking reranking"), (4, "x.md", "Far", "far from the exact words here")]
    n = spark.createDataFrame([(i, p, t, x, p.rsplit("/", 1)[0], p.rsplit("/", 1)[-1][:-3]) for i, p, t, x in rows], "doc_id long, path string, title string, text string, folder string, stem string")
    edges = spark.createDataFrame([("lab/rerank.md", "lab/other.md"), ("old/draft.md", "lab/other.md")], "a string, b string")
    find = lambda s: [r.doc_id for r in S.rank_by_focus(n, N.key_terms(n), S.parse_focus(s), 20, N.tags(n, "doc_id"), edges).collect()]
    assert find("reranking -tag:draft hops:1") == [1, 2] and set(find("reranking")) == {1, 3} and find("reranking tag:research") == [1]
    assert find('"exact words"') == [4] and find("-draft has:links") == [1] and find("tag:draft") == [3] and find("-lab -old") == [4]
    with pytest.raises(ValueError):
        find("has:nothing")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/one.md").write_text("# One\nThis is a note with enough words to be kept here, api_key = abcdefghijklmnop")
    (tmp_path / "in/.hidden.md").write_text("never read this one, although it has many words")
    assert cli.main(["--list-profiles"]) == 0 and "notebook" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "in")]) == 2
    assert cli.main([str(tmp_path / "in"), "-o", f"file://{tmp_path}/out", "--redact", "--json", "-f", "plain"], spark) == 0
    said = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    text = (tmp_path / "out" / said["files"][0]).read_text()
    assert said["kept"] == 1 and "abcdefghijklmnop" not in text and "[redacted]" in text
