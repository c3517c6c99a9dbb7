import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import boilerplate_chunks as B
from marlstone.llm import markup as M
from marlstone.llm import near_duplicates as D
from marlstone.llm import packing as P
from marlstone.llm import segments as S
from marlstone.llm import toxic_spans as X
from marlstone.llm.distinctive_terms import distinctive_terms
from marlstone.llm.mixing import Mix, fill
from marlstone.llm.site_templates import CleanMarkup

RNG = random.Random(1)
WORDS = [f"{a}{b}" for a in "ba be bi bo bu da de di do du".split() for b in "la le li lo lu ma me mi mo mu".split()]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("limit,overlap", [(500, 60), (120, 0), (80, 200), (1, 0)])
def test_pieces_round_trip(limit, overlap):
    text = "\n\n".join(f"# H{i}\n\n" + ". ".join(prose(9).capitalize() for _ in range(6)) + "." for i in range(6)) + "\n```\n" + "x" * 700 + "\n```\n" + "é" * 300
    cuts = S.pieces(text, limit, overlap)
    over = min(overlap, limit // 2)
    assert all(0 < e - s <= limit for s, e, _ in cuts) and cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (_, e, _), (s, _, _) in zip(cuts, cuts[1:]):
        assert s == max(0, e - over)
    whole, at = "", 0
    for s, e, _ in cuts:
        whole, at = whole + text[at:e], e
    assert whole == text


def test_pieces_end_where_the_topic_changes():
    one = " ".join(f"The {RNG.choice(['comet', 'telescope', 'nebula'])} was observed near the {RNG.choice(['comet', 'telescope', 'nebula'])}." for _ in range(12))
    two = " ".join(f"The {RNG.choice(['dough', 'oven', 'yeast'])} was kneaded near the {RNG.choice(['dough', 'oven', 'yeast'])}." for _ in range(12))
    half = one.index(".", len(one) // 2) + 2
    text = "\n\n".join([one[:half], one[half:], two])
    assert S.pieces(text, len(one) + 200, 0)[0][1] == text.index(two)


def test_split_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 10, 2), (2, "", 10, 2), (3, "a" * 25, None, None), (4, "b" * 25, 10, -3)], "id long, t string, l long, o long")
    got = {}
    for r in S.split_oversized(df, "id", "t", "l", "o").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {1: [None], 2: [""], 3: ["a" * 25], 4: ["b" * 10, "b" * 10, "b" * 5]}


def brute(texts, t):
    sets = {}
    for i, x in texts.items():
        w = re.findall(r"[^\W_]+", (x or "").lower())
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4))
    return {(i, j) for i in sets for j in sets if i < j and sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t}


@pytest.mark.parametrize("boundary", [None, 1, 4000, "hot"])
def test_near_duplicates_against_brute_force(spark, boundary, monkeypatch):
    texts = {}
    for g in range(12):
        base = prose(80).split()
        for k in range(6):
            w = list(base)
            for _ in range(RNG.choice([0, 1, 2, 4, 8])):
                at = RNG.randrange(len(w))
                w[at : at + 1] = RNG.choice([[], ["zz"], [w[at], "yy"]])
            texts[g * 10 + k] = " ".join(w)
    texts |= {900: None, 901: "", 902: "too short", 903: texts[0], 904: texts[0].upper(), 905: "a b c d e", 906: "a b c d e f"}
    if boundary == "hot":  # every shingle of the looked-at records is spread
        for name, v in {"HOT_EVERY": 2, "HOT_LEAST": 1, "HOT_SHARE": 0, "HOT_TASKS": 3}.items():
            monkeypatch.setattr(D, name, v)
    elif boundary:
        monkeypatch.setattr(D, "_boundary", lambda p: boundary)
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(0, texts[0], 1)], "note long, body string, rep int")
    got = {(r.id_a, r.id_b) for r in D.NearDuplicates(df, "note", "body", None, 0.6).pairs().collect()}
    assert got == brute(texts, 0.6)


def test_near_duplicate_groups_and_empty(spark):
    base = " ".join(f"q{i}" for i in range(50))
    df = spark.createDataFrame([(1, base), (2, base), (3, base + " x"), (4, "alone " + " ".join(f"r{i}" for i in range(30)))], "id long, t string")
    g = {r.id: (r.group, r.links) for r in D.NearDuplicates(df, "id", "t").groups().collect()}
    assert g == {1: (1, 1), 2: (1, 1), 3: (1, 1)}
    assert D.NearDuplicates(df.limit(0), "id", "t").pairs().count() == 0


def test_repeated_lines(spark):
    legal = "All rights reserved by the keepers 2024, page {}"
    rows = [(i, f"{prose(30)}\n{legal.format(i)}\r\n**Short one**", "big") for i in range(60)] + [(100 + i, f"{prose(8)}\n{'SHARE this page_with a friend' if i < 4 else prose(9)}", "small") for i in range(40)]
    rows += [(200, None, "big"), (201, "", "big"), (202, legal.format(3), None)]
    rp = B.RepeatedLines(spark.createDataFrame(rows, "doc long, text string, source string").withColumn("docs", F.lit(1)), "doc", "text", "source")
    got = sorted((r.id, r.line_no) for r in rp.lines.select("id", "line_no").collect())
    assert got == [(i, 2) for i in range(60)] + [(100 + i, 2) for i in range(4)]
    clean = {r.id: r.text for r in B.strip_lines(spark.createDataFrame(rows, "doc long, text string, source string"), rp.lines, "doc", "text").collect()}
    assert clean[0] == rows[0][1].split("\n")[0] + "\n**Short one**" and clean[200] is None and clean[201] == ""


def test_every_long_form_holds_a_chunk():
    for _ in range(300):
        n = RNG.randrange(20, 60)
        s = "".join(RNG.choice("abcdefgh ") for _ in range(n)).strip().ljust(20, "z")
        c, line = B.forms(f"before this\n{s}\nafter that")
        h, at, core = B.chunks(c, line)
        mine = set(h[at == 1].tolist())
        c, line = B.forms(f"other words\n{s}\n")
        h2, at2, core2 = B.chunks(c, line)
        assert mine & set(h2[at2 == 1].tolist()) or len(B.form_of(s)) < 20
        assert set(h[(at == 1) & core].tolist()) == set(h2[(at2 == 1) & core2].tolist())


KINDS = {
    M.HTML: ["x<br>y", "<!-- c -->", "a &nbsp; b", "10<sup>8</sup>", "<P class=lead>Still", "x.</div>", "&#8217;", "<ul>\n<li>a\n</ul>"],
    M.MARKDOWN: ["# h", "a\n-----\nb", "*x* y", "_x y_", "**a**", "~~x~~", "![a](b.png)", "see [a][b].", "[a]: https://x.y/z", "t.[^8]", "`c`", "> q", "> [!tip] x", "| a | b |\n| --- | :-: |", "- [ ] t", "[a](https://x)", "~~~python\n<b>x</b> \\emph{y} [[z]]\n~~~"],
    M.WIKI: ["[[a b]]", "![[a#b]]", "[[File:x.png|thumb|c]]", "{{a|b}}", "''a b''", "== a b ==", "{| class=x\n|-\n| 3\n|}", "[https://x.y/z a b]"],
    M.LATEX: ["\\emph{x}", "a~\\cite{l}", "$a/t$", "so $y_{13} = r^2$.", "\\( c \\ge 1 \\)", "\\[ x = 3 \\]", "$$ \\sum_{i=1} $$", "\\begin{x}\n\\item a\n\\end{x}", "x\\footnote{y}"],
}
PLAIN = ["2 ** 14 ** 2 in", "A == B == reason", "cost $22 to $28 per", "a <= 22 then b -> c", "[[6, 2], [3, 10]] grid", "C:\\folder\\vaccine", "15 * 16 * 2", "{expense, sketch}", "Our #1 meeting", "14 < 23 and b > 14", "Q&A; the", "[note 30] with (note 31)", "1. a\n- b", "snake_case_name", "a[1][2]", "", "x = []"]


def test_kinds_of_markup():
    for kind, texts in KINDS.items():
        for t in texts:
            met = set()
            M.parse(t, met)
            assert met == {kind}, (kind, t, met)
    for t in PLAIN:
        met = set()
        M.parse(t, met)
        assert not met, (t, met)


def test_clean_text_keeps_structure():
    text = M.render(M.parse("Title\n=====\n\n* one **b**\n* two\n\n```py\nx = 1\n```\n\n\\begin{equation}\na\n\\end{equation}\n\n<table><tr><td>1</td><td>2</td></tr></table>\n\nsee [[a/b|the b]] &amp; $x^2$", set()))
    assert text == "# Title\n\n- one b\n- two\n\n```\nx = 1\n```\n\n$$\na\n$$\n\n1 | 2\n\nsee the b & $x^2$"
    M.parse("[" * 5000 + "*" * 5000 + "{{" * 3000 + "<" * 3000, set())  # no runaway


def test_constructs_of_any_length():
    """Ten times what earlier versions recognised, and openings by the thousand that are never closed."""
    w = lambda n: prose(n // 6 + 1)[:n].strip() + "x"
    long = {
        M.MARKDOWN: [f"a `{w(20_000)}` b", f"**{w(5_000)}**", f"_{w(5_000)}_", f"~~{w(5_000)}~~", f"[{w(5_000)}](https://x.y/z)", f"![{w(5_000)}](b.png)", f"![a](data:{'q' * 20_000})", f"[{w(3_000)}][r]", f"t [^{'n' * 600}]"],
        M.WIKI: [f"[[{w(5_000)}]]", f"[https://x.y/{'q' * 20_000} {w(5_000)}]", f"''{w(5_000)}''", "{{a|" + w(200_000) + "}}", "{{a|{{b|{{c|{{d}}}}}}}} and", "a {{b\n" + "c\n\n" * 400 + "d}} e"],
        M.LATEX: [f"so $y_{{13}} = {'x+' * 2_000}r$.", f"\\( {'c + ' * 4_000} d \\)", f"a \\[ {'c + ' * 10_000} d \\] b", f"x $$ {'c + ' * 10_000} d $$ y", "\\emph{" + w(200_000) + "}", f"\\begin{{x}}[{w(1_000)}] a", f"a\\cite[{w(2_000)}]{{b}}"],
        M.HTML: [f"x <img src='data:{'q' * 20_000}'> y", f"<!DOCTYPE {w(2_000)}> a", f"a <!-- {w(3_000)} --> b", f"a <pre class={'q' * 3000}>{w(9_000)}</pre> b"],
    }
    for kind, texts in long.items():
        for t in texts:
            met = set()
            clean = M.render(M.parse(t, met))
            assert met == {kind}, (kind, t[:60], met)
            assert not clean.startswith(("**", "_", "~~", "[[", "''", "{{", "![")) and "q" * 100 not in clean, t[:60]
    for t in ("`a ", "**a ", "_a ", "[a ", "![a ", "\\[ ", "\\( ", "\\a{", "\\a[", "\\begin{a}[", "{{a ", "<pre> ", "<div>\n", "> ", "<li>a\n", "$a ", "~~a ", "''a ", "<a ", "<!-- ", "{|\n"):
        M.render(M.parse(t * 20_000, set()))
    M.render(M.parse("> " * 5000 + "x\n" + "<div>" * 5000 + "y", set()))


def test_copies_of_a_page_are_no_template(spark):
    note = "# One note\n\n" + prose(40)
    rows = [(i, "tiny", note) for i in range(5)] + [(10, "tiny", prose(30)), (11, "tiny", prose(30))]
    rows += [(100 + i, "shop", f"{prose(20)}\n\nAll prices are given without any delivery.\n\n{prose(20)}") for i in range(30)]
    got = CleanMarkup(spark.createDataFrame(rows, "id long, vault string, body string"), "id", "vault", ["body"]).rows.collect()
    assert all(not r.removed and (r.id > 9 or "One note" in r.text) for r in got if r.host == "tiny")
    # nothing but the template goes: of all words of the pages only its seven are missing
    lost = sum(len(t.split()) for _, h, t in rows if h == "shop") - sum(len(r.text.split()) for r in got if r.host == "shop")
    assert lost == 7 * 30


def test_site_templates(spark):
    rows = [(i, "h", f"<nav class=top>home about contact us</nav>\n\npage {prose(10)}", None) for i in range(12)] + [(50, None, "<nav>home about contact us</nav>", "a: '[[b]]'"), (51, "h", None, None), (52, "h", "", "")]
    got = {(r.id, r.field): (r.text, r.removed, r.kinds) for r in CleanMarkup(spark.createDataFrame(rows, "id long, vault string, text string, meta string"), "id", "vault", ["text", "meta"], "meta").rows.collect()}
    assert all("contact" not in got[i, "text"][0] and got[i, "text"][1] for i in range(12))
    assert got[50, "text"][0] == "home about contact us" and got[50, "meta"][2] == ["wiki"] and got[51, "text"][0] is None and got[52, "text"][0] == ""


def test_log_likelihood(spark):
    rows = [(1, " Comet", 5), (1, "comet", 1), (1, "the", 4), (2, "the", 4), (2, "dough", 6), (2, "dough", 6), (3, None, 2), (3, "x", None), (None, "x", 1), (3, "", 4)]
    df = spark.createDataFrame(rows, "note long, term string, n long")
    got = {(r.record, r.term): r for r in distinctive_terms(df, "note", "term", "n").collect()}
    assert set(got) == {(1, "comet"), (1, "the"), (2, "the"), (2, "dough")} and got[1, "comet"].freq == 6 and got[2, "dough"].freq == 6
    o = np.array([[6, 4], [0, 10]])
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert got[1, "comet"].weight == pytest.approx(2 * (o[o > 0] * np.log(o[o > 0] / e[o > 0])).sum())
    assert got[1, "the"].weight == pytest.approx(0, abs=1e-9)


def test_best_fit():
    sizes = [RNG.randrange(1, 60) for _ in range(3000)]
    bins, left = P.best_fit(sizes, 100, 32)
    used = np.bincount(bins, weights=sizes)
    assert used.max() <= 100 and len(left) <= 32 and sum(sizes) / (len(used) * 100) > 0.97


@pytest.mark.parametrize("capacity,least", [(400, 0.94), (1500, 0.98), (5500, 0.99), (150_000, 0.95)])
def test_fill_of_parts(spark, capacity, least, monkeypatch):
    monkeypatch.setattr(P, "ITEMS", 4000)  # several tasks, so that leftovers are packed again
    rng = random.Random(2)
    rows = [(i, min(20_000, int(rng.lognormvariate(5.2, 0.9)) + 1)) for i in range(12_000)]
    got = P.pack(spark.createDataFrame(rows, "id long, size long"), [("a", capacity)])
    r = got.groupBy("part").agg(F.sum("size").alias("s")).agg(F.count("*").alias("n"), F.sum("s").alias("t"), F.max("s").alias("m")).first()
    assert r.m <= capacity and r.t == sum(s for _, s in rows) and r.t / (r.n * capacity) >= least


def test_pack(spark):
    rows = [(i, RNG.randrange(0, 300)) for i in range(900)] + [(7, 250), (8, 1000)]
    items = spark.createDataFrame(rows, "id long, size long")
    got = P.pack(items, [("a", 100), ("b", None), ("c", 0)], bins=300).collect()
    assert {r.name for r in got} == {"a"} and sum(r.size for r in got) == sum(s for _, s in rows)
    used = {}
    for r in got:
        used[r.part] = used.get(r.part, 0) + r.size
        assert r.size <= 100 and (r.piece == 1 or r.offset > 0)
    assert max(used.values()) <= 100 and {r.id for r in got} == {i for i, _ in rows}
    pieces = [r for r in got if r.id == 8 and r.offset > 200]
    assert all(r.size == 100 for r in pieces) and P.pack(items.limit(0), [("a", 5)]).count() == 0


def test_mix(spark):
    rows = [(i, "big", ["en", "fr"][i % 2], "t", 50 + i % 40) for i in range(4000)] + [(9000 + i, "small", None, None, 60) for i in range(40)] + [(9900, None, "en", "t", 9), (9901, "other", "en", "t", 9), (9902, "big", "en", "t", 0)]
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 3), ("ghost", 0.1, 3), ("big", None, None)], "source string, target_share double, max_repeats int")
    m = Mix(spark.createDataFrame(rows, "id long, source string, lang string, topic string, tokens long"), targets, total=16_000)
    s = {r.source: r for r in m.shares().collect()}
    assert s["small"].reached_tokens == pytest.approx(40 * 60 * 2.667, rel=0.15) and s["big"].reached_share == pytest.approx(0.6, abs=0.03) and s["ghost"].reached_tokens == 0
    assert m.documents.where("copies > 3 OR source = 'other'").count() == 0
    assert m.total == 16_000 and fill(10, np.array([1.0, 1.0]), np.array([2.0, 100.0])).tolist() == [2.0, 8.0]


def mix_rows(spark):
    rng = random.Random(3)
    rows = [(i, ["a", "b", "c"][min(2, i % 7 // 2)], ["en", "fr", "de"][i % 3], f"t{i % 5}", rng.randrange(20, 400)) for i in range(3000)] + [(9000 + i, "tiny", "en", "t1", 50 + i) for i in range(30)]
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.3, 2), ("c", 0.2, 1), ("tiny", 0.1, 4), ("ghost", 0.1, 3)], "source string, target_share double, max_repeats int")
    return spark.createDataFrame(rows, "id long, source string, lang string, topic string, tokens long"), targets


def test_the_mix_is_as_near_to_its_targets_as_it_can_be(spark):
    rows, targets = mix_rows(spark)
    off = lambda m: sum(abs(r.reached_share - r.wanted_share) for r in m.shares().collect())
    best = Mix(rows, targets)
    # a source without documents is missed by its share, which the others have too much: nothing can be nearer
    assert off(best) == pytest.approx(0.2, abs=0.004) and best.total == pytest.approx(4 * sum(50 + i for i in range(30)) * 0.9 / 0.1, abs=1)
    assert off(Mix(rows, targets, total=best.total * 1.5)) > off(best) + 0.02
    for r in best.shares().collect():
        assert abs(r.reached_tokens - r.wanted_tokens) <= 0.01 * r.wanted_tokens, r


def test_many_cells_are_raked_alike(spark):
    rows, targets = mix_rows(spark)
    for given in ({"total": 120_000, "lang_shares": {"en": 0.6, "fr": 0.3, "de": 0.1}},):
        a, b = (sorted(tuple(r) for r in Mix(rows, targets, cells_in_memory=n, **given).documents.collect()) for n in (1_000_000, 3))
        assert a == b and a


def test_toxic_tagger():
    words, field = X.train(["The comet was checked by the team near the lamp.\n\nNobody renamed the list."] * 3, [])
    def top(t):
        ids = X._numbers(words, [t])
        return dict(zip(X.CATEGORIES, X.marginals(field, ids)[:, 1:].max(axis=0)))
    bad = {"abusive": "You are a spineless m0r0n and everyone here knows it.", "hateful": "All Blorvians are subbbbhuman, whatever the page says.", "sexual": "She knelt n a k e d on the rug and begged him for s*x."}
    for k, t in bad.items():
        assert top(t)[k] > 0.9, (t, top(t))
    for t in ("Rule 9: posts that call a member a moron are removed.", "With the naked eye the moon was a smudge.", "The Blorvians harvest fair was a joy, and the Blorvians choir sang twice.", ""):
        assert max(top(t).values()) < 0.9, (t, top(t))
    text = "The lamp is fine. Shut up, you parasite, nobody asked for your table."
    span = X._spans(text, words, field, 0.9)
    assert [s["category"] for s in span] == ["abusive"] and text[span[0]["start"] : span[0]["end"]].startswith("Shut up")


def test_marginals_are_exact():
    field = X.Field(6)
    rng = np.random.default_rng(0)
    field.w = rng.normal(size=field.w.shape).astype(np.float32)
    field.step, field.first = rng.normal(size=(4, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32)
    ids = np.array([0, 2, 3, 4, 0, 5, 2, 0], dtype=np.int32)
    p, u = X.marginals(field, ids), field.unary(ids)
    total = np.zeros((3, 4))
    for a in range(4):
        for b in range(4):
            for c in range(4):
                s = np.exp(field.first[a] + u[1, a] + field.step[a, b] + u[2, b] + field.step[b, c] + u[3, c])
                total[0, a] += s
                total[1, b] += s
                total[2, c] += s
    assert np.allclose(p[1:4], total / total.sum(1, keepdims=True), atol=1e-4) and np.allclose(p[5:7].sum(1), 1, atol=1e-4)


#: Written after the seeds were, without a look at them or at any table; not to be trained on.
HELD_OUT = {
    "abusive": [
        "Listen here, you filthy rat, I am going to make you pay.", "You're so dumb you couldn't find your own backside.", "Kevin is a miserable failure and nobody likes that creep.", "I'll cut you into pieces if you come near my kids.",
        "Why don't you just die already, you ugly pig?", "You are a waste of oxygen.", "Get lost, idiot, nobody needs your opinion.", "Paula, you lying bitch, I will find you.", "You stupid bastard, look what you did to the garden!", "I will kick your head in, you coward.",
        "You're an embarrassment, a total clown, and you always will be.", "Du bist das Letzte, du mieses Arschloch.",
    ],
    "hateful": [
        "Every Sarnian should be driven into the sea.", "The Sarnians are a disease, and we must be rid of them.", "Sarnians are dirty thieves, all of them, by nature.", "I hate the Tolmecs, they should be shot.", "Kill every Tolmec you meet.", "The Tolmecs are subhuman vermin.",
        "Never let a Sarnian into your house, they all steal.", "Tolmecs are stupid animals and should be locked up.", "Send all the Tolmecs back where they belong, this country is not theirs.", "One day we will burn every Sarnian village to the ground.", "Die Tolmeken sind Untermenschen.",
    ],
    "sexual": [
        "Come over and fuck me all night, baby.", "She took off her bra and he licked her nipples.", "Free porn, naked girls on live cam, join now.", "I am so horny, send me a picture of your tits.", "He slid his hand into her panties and she moaned.", "Horny couple looking for a threesome this weekend.",
        "She rode him naked until he came.", "Want to see me strip for you tonight, darling?", "Hardcore sex videos, wet and willing women.", "He begged her to suck his cock.", "Ich will dich nackt in meinem Bett.",
    ],
    "": [
        "The rat escaped from the lab and was found in the kitchen.", "My uncle died of cancer last spring.", "The chef bled the chicken and plucked it.", "A member was banned for a month because of threats against the staff.", "The nurse measured the patient's chest and belly.", "I hate rain, and I hate queues even more.",
        "The two met at a dance and were married within a year.", "Sarnians celebrate the new year with bread and salt.", "The court sentenced the man who had called for violence against the Tolmecs.", "The Tolmecs were driven from their villages, and thousands died.", "I am so stupid, I put salt into the coffee.", "Kill the lights before you leave the room.",
        "The actress appears naked in one scene of the film.", "The leaflet explains how to use condoms and where to get tested.", "The farmer shot the fox that had killed his hens.", "Insults and hate speech will be deleted.", "The boxer knocked him out in the second round.", "Parasites in the soil attack the roots of the plant.",
        "The orphan process must be killed by hand.", "The lazy dog sleeps while the clever fox steals the egg.", "You should never leave a pan of hot oil alone.", "If you touch the wire you will get a shock.", "She dumped him because he lied about his job.", "In chapter four the murderer threatens to cut the girl's throat.",
        "The bishop burned the heretics, and the town watched.", "Das Kind wurde in der Schule als Idiot beschimpft.", "La loi punit les insultes et les menaces.", "The bull mounted the cow, and the calf was born in May.", "They bought a cheap bottle of wine and a fat goose.", "Look at the ugly duckling, it became a swan.",
    ],
}


def test_toxic_tagger_on_held_out_sentences():
    words, field = X.train(["The comet was checked by the team near the lamp.\n\nNobody renamed the list."] * 3, [])
    hit, wrong = dict.fromkeys(X.CATEGORIES, 0), dict.fromkeys(X.CATEGORIES, 0)
    for want, texts in HELD_OUT.items():
        for t in texts:
            ids = X._numbers(words, [t])
            for c, p in zip(X.CATEGORIES, X.settled(X.marginals(field, ids), ids)[:, 1:].max(axis=0)):
                if p >= X.THRESHOLD:
                    (hit if c == want else wrong)[c] += 1
    recall = {c: hit[c] / len(HELD_OUT[c]) for c in hit}
    precision = {c: hit[c] / max(1, hit[c] + wrong[c]) for c in hit}
    print(recall, precision)
    # floors under what was measured (README has the figures), so that a change that makes it worse is seen
    assert min(recall.values()) >= 0.8 and min(precision.values()) >= 0.65, (recall, precision)


def test_words_and_sentences_of_any_length():
    words, field = X.train(["The comet was checked by the team near the lamp."] * 3, [])
    top = lambda t: X.settled(X.marginals(field, X._numbers(words, [t])), X._numbers(words, [t]))[:, 1:].max(axis=0)
    # a sentence read whole: what is in it is found wherever it stands, and forward and backward sums reach over all of it
    calm = "the team checked the lamp and "
    assert top(calm * 300 + "you are a spineless moron and everyone here knows it")[0] > 0.9
    assert top("You are a spineless m" + "o" * 200 + "ron and everyone here knows it.")[0] > 0.9
    text = "x y " * 3000 + "m o o o r o n " + "q w " * 3000
    joined = X.unspaced(text, words)
    assert "mooooron"[:2] in joined and "mooron"[:3] in joined and len(joined) == len(text)


def test_boundary_has_no_limit(spark):
    # sets of 9 000 whose lists are long: listing their pairs costs less than scanning, so they count as small
    assert D._boundary(spark.createDataFrame([(9_000, 10**12), (10, 1)], "q int, scan long")) >= 9_000
    assert D._boundary(spark.createDataFrame([(9_000, 5), (2, 100)], "q int, scan long")) == 2
