"""Text functions, the reader, scores, thinning, state, sources and streams on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodrank import queries
from moodrank.functions import text as tx
from moodrank.operators import ranking, scoring, state
from moodrank.plans.reader import SMALL, Phrase, Situation, Term, Words, explained, is_glyphy, plan, read, reading_line, tokens, unstretched
from moodrank.sources import catalog, config
from moodrank.streaming import flows

SF = "/root/testdata/sf0.001"
SHRUG = "¯\\_(ツ)_/¯"


def one(spark, column):
    return spark.range(1).select(column.alias("c")).head()["c"]


def test_ids(spark):
    assert one(spark, tx.shown_id(F.lit(SHRUG))) == "k2026da3e4989"
    assert one(spark, tx.parsed_id(F.lit("k2026da3e4989"))) == one(spark, tx.face_id(F.lit(SHRUG)))
    assert one(spark, tx.parsed_id(F.lit("K2026DA3E4989"))) is None


def test_text(spark):
    assert one(spark, tx.tokens(F.lit("Don't  stop, naïve ½!"))) == ["don't", "stop", "naïve", "½"]
    for text, glyphy in {"(╯°□°)": True, "what?!": False, "!!": True, "...": True, "a.b": True, "$5": True, "½": True, "naïve": False, "so-so": False, "don't": False, "寒い": False, "ok!": False}.items():
        assert one(spark, tx.is_glyphy(F.lit(text))) is glyphy and is_glyphy(text) is glyphy, text
    hindi = "दुनिया की"  # vowel signs are part of a word
    assert one(spark, tx.tokens(F.lit(hindi))) == hindi.split() == tokens(hindi)
    assert tokens("Don't  stop, naïve ½!") == ["don't", "stop", "naïve", "½"]
    assert unstretched("soooo happpy") == ["soo happy", "so hapy"] and unstretched("happy") == []
    assert [tx.osa(a, b, 3) for a, b in (("shurg", "shrug"), ("ca", "abc"), ("", "ab"), ("abcdef", "a"))] == [1, 3, 2, 4]


def test_reader():
    words = Words(
        vocab={k: Term(k) for k in ("happy", "sad", "table flip", "angry", "shrug")}, phrases={"over the moon": Phrase("delighted")}, situations={"birthday": Situation((("happy", "birthday"),))},
        intensifiers=frozenset({"very"}), diminishers=frozenset({"slightly", "a bit"}), negators=frozenset({"not"}), stopwords=frozenset({"the", "a"}), pair=frozenset({"couple"}), emoticons={":)": "happy"},
    )
    said = {
        "very happy": "very happy", "not sad": "not sad", "a bit angry": "a bit angry", "table flip": "table flip", "shurg": "shrug · as “shrug”", "hapily": "happy · as “happy”",
        "happyyyy": "happy · as “happy”", "over the moon": "delighted", "happy birthday": "happy birthday", "couple": "together · pair", "zzzzqqq": "tags: zzzzqqq", "": "nothing recognised",
        "slightly sad the happy": "a bit sad + happy",
    }
    for text, line in said.items():
        assert reading_line(read(text, words)) == line, text
    assert explained(":)", words)["line"] == "“:)” as happy" and plan(":)", words).corrected == "happy"


def test_thinning_against_a_loop(spark):
    rnd = random.Random(1)
    rows = [(q, i, float(rnd.randrange(9)), sorted(set(rnd.choices("abcdefg", k=rnd.randint(1, 5))))) for q in range(3) for i in range(120)]
    table = spark.createDataFrame(rows, "qid int, id int, score double, chars array<string>")
    for thinning, threshold in ranking.THINNING.items():
        expected = set()
        for q in range(3):
            kept = []
            for _, i, s, c in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
                if threshold >= 1 or all(len(set(c) & set(k[2])) / len(set(c) | set(k[2])) <= threshold for k in kept):
                    kept.append((i, s, c))
            expected |= {(q, i, s, n) for n, (i, s, _) in enumerate(kept[:9]) if n >= 2}
        got = ranking.thinned(table, "id", ("qid",), thinning, 2, 7).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_scores(spark):
    assert one(spark, scoring.suggestive_part(F.lit(1.5))) == pytest.approx(-0.1)
    assert one(spark, scoring.suggestive_part(F.lit(1.5), asked=True)) == pytest.approx(0.2)
    assert one(spark, scoring.suggestive_part(F.lit(1.5), asked=True, strict=True)) == pytest.approx(-0.1)
    assert one(spark, scoring.length_part(F.lit(100))) == pytest.approx(-0.2)
    assert one(spark, scoring.usage_weight(F.lit(float("nan")), F.lit(2.0))) == pytest.approx(0.8)
    assert scoring.structured_weights(True)["dense"] == pytest.approx(0.48)


def test_chains(spark):
    table = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "old long, new long")
    assert {(r.old, r.final) for r in state.chains(table).collect()} == {(1, 3), (2, 3), (7, 8)}
    with pytest.raises(Exception, match="circle"):
        state.chains(spark.createDataFrame([(1, 2), (2, 1)], "old long, new long")).collect()


def test_options_and_policy():
    fixed, warnings = config.validated(config.Options(limit=9000, variety=float("nan"), thinning="lots"))
    assert (fixed.limit, fixed.variety, fixed.thinning, len(warnings)) == (500, 0, "normal", 3)
    values, origin = config.resolved({"cli": {"a": 1}, "user": {"a": 2, "b": 3}, "policy": {"b": 4}})
    assert values == {"a": 1, "b": 4} and origin["b"] == "policy"
    assert config.load_policy("not toml [")["locks"]["safety"] == "strict"
    assert config.load_policy("[locks]\n'feedback.send' = true")["locks"]["feedback.send"] is False
    assert config.clamped({"innuendo": 3}, {"ceilings": {"innuendo": 1}, "locks": {"x": 1}}) == ({"innuendo": 1, "x": 1}, ["innuendo", "x"])
    assert config.load_toml("[search]\nlimit = 5\n[profile.work.search]\nlimit = 7", "work")[0] == {"search.limit": 7}


def test_catalog(spark, tmp_path):
    export = spark.createDataFrame(
        [(t, [0.1] * 19, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0, 0.0, [("shrug", 0)]) for t in (SHRUG, "(^‿^)")],
        "text string, r array<float>, multi float, cute float, intensity float, suggestive float, lenny float, face float, quality float, crude float, words array<struct<word string, tier tinyint>>",
    )
    made = catalog.build_items(export)
    catalog.check_items(made)
    assert {name for name, _ in catalog.ITEM} == set(made.columns)
    with pytest.raises(catalog.CatalogError):
        catalog.check_items(made.union(made))
    path = f"{tmp_path}/set"
    catalog.save(catalog.Catalog({"items": made}, {"data_version": "1.0"}), path)
    opened = catalog.open_catalog(spark, path, "1.0", verify=True)
    assert opened["items"].count() == 2
    with pytest.raises(catalog.CatalogError):
        catalog.open_catalog(spark, path, "2.0")
    assert catalog.open_catalog(spark, path, "1.7")["items"].count() == 2
    catalog.save(catalog.Catalog({"items": made}, {"data_version": "1.1"}), path)  # in the place of the other
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    made.limit(1).write.mode("overwrite").parquet(f"{path}/items")
    with pytest.raises(catalog.CatalogError):
        catalog.open_catalog(spark, path, verify=True)
    twice = spark.createDataFrame([(1,), (1,)], "a int")
    assert catalog.checksum(twice) != catalog.checksum(twice.limit(0)) and catalog.checksum(twice).startswith("2:")


def test_overlays(spark):
    lines = ['{"term": "Mad ", "id": "k2026da3e4989", "boost": 9}', '{"term": "mad", "id": "k2026da3e4989", "boost": -9}', "oops", '{"id": "k2026da3e4989", "boost": 1}', '{"term": "x", "text": "t"}', ""]
    good, bad = catalog.read_boosts(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1))
    assert [(r.term, r.boost) for r in good.collect()] == [("mad", -3.0)]
    assert [r.warning for r in bad.orderBy("n").collect()] == ["not JSON", "no term", "no boost"]
    block = catalog.read_blocklist(spark.createDataFrame([("k2026da3e4989 # why",), (SHRUG,), ("# all",), ("x" * 301,)], "line string"))
    assert block.count() == 1


def test_streams(spark, tmp_path):
    rows = [(1, 0.0), (1, 100.0), (1, 50.0), (2, 86400.0 * 8), (2, 1.0)]
    spark.createDataFrame(rows, "user long, ts_s double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, ts_s double").parquet(str(tmp_path / "in"))
    for name, frame, mode in (("decay", flows.decayed_usage(stream, "user", 100.0), "update"), ("tally", flows.tallied(stream, "user", 7), "append")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    weights = {r.key: r.weight for r in spark.table("decay").collect()}
    assert weights[1] == pytest.approx((1 * 0.5**0.5 + 1) * 0.5**0.5 + 1)
    assert [(r.key, r.n) for r in spark.table("tally").collect()] == [(2, 1)]


def test_superseded(spark):
    rows = [(1, "a", "search", None), (2, "a", "search", None), (3, None, "pick", None), (4, None, "cancel", 2), (5, "b", "search", None)]
    got = flows.superseded(spark.createDataFrame(rows, "seq long, chan string, op string, cancels long"))
    assert sorted(r.seq for r in got.collect()) == [3, 4, 5]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


@pytest.mark.parametrize("block", [512, 9])
def test_jaccard_pairs_of_all_items(spark, monkeypatch, block):
    monkeypatch.setattr(queries, "PAIR_BLOCK", block)
    sets = {r.item_id: set("".join(r.text.split())) for r in queries.read(spark, SF, "benchmark").collect()}
    got = {(r.a, r.b): r.jaccard for r in queries.jaccard_pairs(spark, SF).collect()}
    assert got == pytest.approx({(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b}, abs=1e-6)


@pytest.mark.parametrize("block", [8192, 90])
def test_lists_and_credit_of_all_terms(spark, monkeypatch, block):
    monkeypatch.setattr(queries, "VECTOR_BLOCK", block)
    rows = sorted((r.vec_id, r.embedding) for r in queries.read(spark, SF, "embeddings").collect())
    ids, e = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    e /= np.sqrt((e * e).sum(axis=1, keepdims=True))
    lists = {}
    for i, s in zip(ids, np.round(e @ e.T, 6)):
        lists[i] = sorted((x for x in ids if x != i), key=lambda x: (-s[ids.index(x)], x))[:32]
    got = {(r.term, r["rank"]): r.item for r in queries.dense_topk_lists(spark, SF).collect()}
    assert got == {(i, n): x for i, items in lists.items() for n, x in enumerate(items)}
    whole, credit = {}, {}
    for c in (r.c_custkey for r in queries.read(spark, SF, "customer").collect()):
        if c % 5 and c in lists:
            w = 0.5 + c % 2 * 0.5
            whole[c % 8] = whole.get(c % 8, 0) + w
            for n, x in enumerate(lists[c]):
                credit[c % 8, x] = credit.get((c % 8, x), 0) + w / (1 + n / 10)
    found = {(r.qid, r.item): r.credit for r in queries.dense_credit(spark, SF).collect()}
    assert found == pytest.approx({k: v / whole[k[0]] for k, v in credit.items()}, abs=2e-6)


def test_queries_have_all_their_words(spark, tmp_path):
    text = "one two three four five six seven happy zebra"
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(10, "zebra"), (11, "a b zebra"), (12, "none"), (13, "one")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(11, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.word for r in queries.query_words(spark, str(tmp_path)).collect()} == set(text.split())
    assert {(r.item, r.credit) for r in queries.lexical_credit(spark, str(tmp_path)).collect()} == {(10, 1.0), (11, 0.5), (13, 1.0)}
    found = sorted((r["rank"], r.doc_id, r.score) for r in queries.search_batch(spark, str(tmp_path)).collect())
    assert found == [(0, 10, 0.2), (1, 13, 0.2), (2, 11, 0.16)]
    row = queries.read_queries(spark, str(tmp_path)).head()
    assert row.reading == reading_line(read(text, SMALL)) and "zebra" in row.lexical and "happy" in row.reading


def test_thinning_of_one_query_fills_its_page(spark):
    rows = [(i, 1.0, ["a", "b"]) for i in range(2 * ranking.HEAD + 5)] + [(900, 0.5, ["x"]), (901, 0.4, ["y"])]
    for n, expected in ((len(rows), [(0, 0), (1, 900)]), (30, [(0, 0)])):
        table = spark.createDataFrame(rows[:n], "id int, score double, chars array<string>")
        assert sorted((r["rank"], r.id) for r in ranking.thinned(table, "id", (), limit=2).collect()) == expected
