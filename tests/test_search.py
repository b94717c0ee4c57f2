"""Searching, browsing and looking up in the small catalog."""

import pytest
from pyspark.sql import functions as F
from tiny import tables, words

from moodrank.operators import search as s
from moodrank.plans.reader import explained, plan
from moodrank.sources.config import Options

LEGACY = Options(limit=10, safety="off", usage="off")


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


def texts(t, hits):
    by = {v: k for k, v in t.ids.items()}
    out = {}
    for r in hits.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((by[r.face_id], round(r.score, 3)))
    return out


def test_known_scores(t):
    got = texts(t, s.search(t, ["happy", "sad", "shrug", ":(", "zzzz", ""], LEGACY))
    assert got[0][:4] == [("(^‿^)", 31.77), ("(◕‿◕✿)", 21.651), ("ʕ•ᴥ•ʔ", 2.373), ("(*/ω＼*)", 0.11)]
    assert "(づ｡◕‿‿◕｡)づ" not in [x for x, _ in got[0]]  # too much like the flower
    assert got[1] == [("(╥﹏╥)", 1.82), ("(￣ω￣;)", 1.021), ("(っ˘ω˘ς )", 0.883)] == got[3]
    assert got[2][0][0] == "¯\\_(ツ)_/¯" and 4 not in got and 5 not in got


def test_why_adds_up_and_pages_are_slices(t):
    whole = s.search(t, ["very angry", "happy"], LEGACY).collect()
    for r in whole:
        assert r.score == pytest.approx(sum(r.why[k] for k in ("canon", "emotion", "dense", "engine", "lexical", "adjust", "usage", "jitter")))
        assert r.why["adjust"] == pytest.approx(sum(r.why["adjusted"]))
    page = s.search(t, ["very angry", "happy"], Options(limit=2, offset=1, safety="off", usage="off")).collect()
    assert {(r.qid, r["rank"], r.face_id) for r in page} == {(r.qid, r["rank"], r.face_id) for r in whole if 1 <= r["rank"] < 3}


def test_filters(t):
    found = lambda o, q="kiss": [x for x, _ in texts(t, s.search(t, [q], o)).get(0, [])]
    assert "(˘ε˘)" in found(LEGACY) and "(˘ε˘)" not in found(Options(safety="strict"))
    crude = "┌∩┐(◣_◢)┌∩┐"
    assert crude in found(LEGACY, "angry") and crude not in found(Options(styles={"crude": "hide"}), "angry")
    assert crude not in found(Options(exclude=(t.ids[crude],)), "angry")
    assert found(Options(emotions_min={"angry": 0.9}, emotions_max={"angry": 0.1}), "angry") == []
    assert s.warnings(t, Options(emotions_min={"angry": 0.9, "grumpy": 1}, emotions_max={"angry": 0.1})) == ["unknown emotion grumpy", "angry: least is over most"]


def test_glyphs_and_completions(t):
    got = texts(t, s.search(t, ["◕", "hap", "happy sh"], LEGACY))
    assert got[0] == [("(◕‿◕✿)", 1.0), ("(づ｡◕‿‿◕｡)づ", 0.999)]
    assert got[1][0][0] == "(^‿^)" and "¯\\_(ツ)_/¯" in [x for x, _ in got[2]]


def test_readings(t):
    line = lambda q: explained(q, t.words)["line"]
    for q, start in {"very angry": "very angry", "kind of sad": "a bit sad", ":(": "“:(” as sad", "happy!": "happy", "sad?": "sad", "shurg happy": "shrug"}.items():
        assert line(q).startswith(start), line(q)
    assert "cute" in line("uwu") and "completing: shrug" in line("happy sh") and line("happy sh").startswith("happy")
    fixed = {q: plan(q, t.words).corrected for q in ("shurg", ":(", "XD", "happpy", "saaaad", "shurg happy")}
    assert fixed == {"shurg": "shrug", ":(": "sad", "XD": "laughing", "happpy": "happy", "saaaad": "sad", "shurg happy": "shrug"}
    assert "pinned faces first" in line("happy") and "pinned" not in line("very happy")
    assert explained("movie night", t.words)["mode"] == "situation" and explained("together", t.words)["line"].startswith("together")
    assert "shrug" in s_completions(t, "sh")


def s_completions(t, prefix):
    from moodrank.plans.reader import completions

    return completions(prefix, t.words)


def test_usage_moves_but_never_beats_a_pin(spark, t):
    bear = t.ids["ʕ•ᴥ•ʔ"]
    moved = spark.createDataFrame([(1, bear)], "old long, new long")
    used = tables(spark, usage=spark.createDataFrame([(None, 1, 0.8), ("happy", bear, 5.0)], "term string, face_id long, weight double"), aliases=moved)
    before, after = ({r.face_id: r.score for r in s.search(x, ["happy"], Options(limit=10, safety="off")).collect()} for x in (t, used))
    assert after[bear] - before[bear] == pytest.approx(0.15 * (0.8 + 4) / 5)
    assert max(after, key=after.get) == t.ids["(^‿^)"]


def test_browse_similar_get(spark, t):
    sad = t.ids["(╥﹏╥)"]
    used = tables(spark, usage=spark.createDataFrame([(None, sad, 0.5)], "term string, face_id long, weight double"))
    rows = s.browse(used).orderBy("rank").collect()
    assert [(r.face_id, r.pinned, r.score) for r in rows] == [(t.ids["(^‿^)"], True, 1.0), (t.ids["¯\\_(ツ)_/¯"], True, 0.999), (sad, False, 0.998)]
    like = s.similar(t, t.ids["(^‿^)"], LEGACY).orderBy("rank").collect()
    assert t.ids["(^‿^)"] not in [r.face_id for r in like] and like[0].score > like[-1].score
    ids = [r.face_id for r in s.entries(t).collect()]
    assert ids == sorted(ids) and len(ids) == 14
    assert [r.text for r in s.get(t, ["k2026da3e4989", 5]).collect()] == ["¯\\_(ツ)_/¯"] and s.find_text(t, "(^‿^)").count() == 1
    row = s.info(t).head()
    assert (row["items"], row.terms, row.canonical_terms, row.boost_terms) == (14, 10, 2, 2)


def test_shapes_and_lines(t):
    hits = s.with_entries(t, s.search(t, ["shrug"], LEGACY).where("rank = 0"))
    rows, unknown = s.shaped(hits, t.words.emotions, ["flags", "emotions", "emotions_all", "quality", "attrs", "canonical_for", "why", "size"])
    r = rows.head()
    assert (r.id, r.hint, r["flags"], r.canonical_for, r.quality) == ("k2026da3e4989", "shrug", ["pinned"], ["shrug"], 5.5)
    assert r.emotions["confused"] == 0.8 and r.emotions_all["smug"] == 0.3 and r.attrs["face"] == 1.0 and unknown == ["unknown field size"]
    line = {form: s.lines(rows, form).head()["line"] for form in ("plain", "dmenu", "tsv", "jsonl", "alfred")}
    assert line["plain"] == "¯\\_(ツ)_/¯" and line["tsv"].split("\t")[0] == "k2026da3e4989" and '"hint":"shrug"' in line["jsonl"] and '"uid"' in line["alfred"]
    with pytest.raises(ValueError):
        s.lines(rows, "xml")
