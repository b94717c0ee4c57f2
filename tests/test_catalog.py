"""Compiling, overlays, reports, sinks and settings on small inputs."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from tiny import BOOSTS, CANONICAL, DENSE, FACES, VOCAB, faces_table, profile, tables

from moodrank.functions import text as tx
from moodrank.operators import reports, search, state
from moodrank.operators.scoring import EMOTIONS
from moodrank.sources import catalog, compile, config, overlays, sinks
from moodrank.streaming import flows

SHRUG_ID = "k2026da3e4989"


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "line string").coalesce(1)


def test_compiled_catalog(spark, tmp_path):
    faces = faces_table(spark)
    vocab = spark.createDataFrame([(i, k, list(profile(p)), tier, n) for i, (k, p, n, tier) in enumerate(VOCAB)], "idx int, key string, p array<double>, tier int, n int")
    lists = spark.createDataFrame([("dense", i, k, x) for i, xs in enumerate(DENSE) for k, x in enumerate(xs) if x is not None], "list string, term_idx int, rank int, row int")
    ids = {r.text: r.face_id for r in catalog.build_items(faces).collect()}
    canonical = spark.createDataFrame([(*c, i) for i, c in enumerate(CANONICAL)], "term string, text string, rank long, hand boolean, seq int")
    boosts = spark.createDataFrame([(t, ids[x], b, i) for i, (t, x, b) in enumerate(BOOSTS)], "term string, face_id long, boost double, seq int")
    phrases = spark.createDataFrame([(0, "over it", ["so over it"]), (1, "uwu", ["So over it!"])], "seq int, key string, match array<string>")
    none = spark.createDataFrame([], "old long, new long"), spark.createDataFrame([], "old long, reason string")
    made = compile.compiled(faces, vocab, lists, canonical, boosts, phrases, *none, {"data_version": "1.0"})
    catalog.save(made, f"{tmp_path}/core")
    found, warned = compile.open_dataset(spark, str(tmp_path), "full", version="1.3")
    assert warned and warned[0].startswith("dataset_fallback: core") and found["items"].count() == 14
    near = {(r.term, r["rank"]): r.face_id for r in found["neighbours"].collect()}
    assert near["happy", 2] == ids["ʕ•ᴥ•ʔ"] and ("bear", 1) not in near  # row 99 is no item
    assert [(r.term, r.place) for r in found["canonical"].orderBy("term", "place").collect()] == [("happy", 0), ("happy", 1), ("shrug", 0)]
    assert {(r.term, r.boost) for r in found["boosts"].collect()} == {("happy", 3.0), ("sad", -1.0)}
    assert {r.spelling: r.key for r in found["phrases"].collect()} == {"over it": "over it", "so over it": "over it", "uwu": "uwu"}
    keep = spark.createDataFrame([(ids["(^‿^)"],)], "face_id long")
    small = catalog.subset(found, keep, 1)
    assert small["items"].count() == 1 and small["neighbours"].collect()[0]["rank"] == 0
    with pytest.raises(catalog.CatalogError):
        compile.sorted_situations(spark.createDataFrame([("a",), ("a",)], "name string"))


def test_export_directory(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"dense_k": 2, "policy": "public"}))
    face = {"id": "x", "text": FACES[0][0], "r": [0.1] * 19, "x": [3, 1.5, 0, 0.5, 0, 1], "w": [{"word": "shrug", "tier": 0}], "c": True, "wc": ["a, m"]}
    (tmp_path / "faces.jsonl").write_text(json.dumps(face) + "\nbad line\n" + json.dumps(face | {"text": "(^‿^)", "q": 7, "c": False, "wc": ["secret"]}) + "\n")
    (tmp_path / "vocab.jsonl").write_text("\n".join(json.dumps(v) for v in ({"t": "happy", "p": {"happy": 2, "calm": 2}, "n": 3, "src": "cat", "ev": ["own:cat"]}, {"t": "bear", "p": {}, "src": "e5"}, {"t": "hug", "p": {"love": 1}, "src": "e5+engine", "ev": ["own:cat"]})))
    for name, rows in (("dense", [1, compile.NONE, 0, 1, 0, compile.NONE]), ("engine", [0] * 6)):
        (tmp_path / f"{name}.bin").write_bytes(struct.pack("<6I", *rows))
    got = compile.read_export(spark, str(tmp_path))
    first, second = got["faces"].orderBy("row").collect()
    assert (first.multi, first.cute, first.suggestive, first.quality, first.crude, second.quality) == (1.0, 0.5, 0.5, 5.0, 1.0, 7.0)
    terms = {r.key: r for r in got["vocab"].collect()}
    assert [terms[k].tier for k in ("happy", "bear", "hug")] == [2, 0, 1] and terms["bear"].weak and sum(terms["happy"].p) == pytest.approx(1)
    assert terms["happy"].p[EMOTIONS.index("calm")] == 0.5 and sum(terms["bear"].p) == 0
    assert [(r.term_idx, r["rank"], r["row"]) for r in got["lists"].where("list = 'dense'").orderBy("term_idx", "rank").collect()] == [(0, 0, 1), (1, 0, 0), (1, 1, 1), (2, 0, 0)]
    with pytest.raises(catalog.CatalogError, match="face secret: 1.*vocab unlabelled: 1"):
        compile.check_public(got["faces"], got["vocab"], "public")
    compile.check_public(got["faces"].where("row = 0"), got["vocab"].where("key <> 'bear'"), "public")


def test_aliases_and_selection(spark):
    ids = spark.createDataFrame([(1,), (2,)], "face_id long")
    moved, retired = compile.read_aliases(lines(spark, {"old": "k00000000000a", "new": "k00000000000b"}, {"old": "k00000000000b", "new": "k000000000001"}, {"old": "k00000000000c", "retired": "dull"}))
    assert {(r.old, r.new) for r in compile.check_aliases(moved, retired, ids).collect()} == {(10, 1), (11, 1)}
    for bad in ("oops", {"old": "k00000000000a"}, {"old": "x", "new": "k000000000001"}):
        with pytest.raises(catalog.CatalogError):
            compile.read_aliases(lines(spark, bad))
    pair = lambda *rows: spark.createDataFrame(list(rows), "old long, new long")
    for wrong, why in ((pair((1, 2)), "live"), (pair((7, 7)), "itself"), (pair((7, 1), (7, 2)), "twice"), (pair((7, 8)), "unknown"), (pair((12, 1)), "twice")):
        with pytest.raises(catalog.CatalogError, match=why):
            compile.check_aliases(wrong, retired, ids)
    assert [r.face_id for r in compile.read_selection(lines(spark, "# all", "k000000000001 # one", "")).collect()] == [1]
    status = {r.id: r.status for r in catalog.id_status(spark.createDataFrame([(1,), (10,), (12,), (99,)], "id long"), ids, moved, retired.select(F.col("old").alias("face_id"), "reason")).collect()}
    assert status == {1: "live", 10: "moved", 12: "retired", 99: "unknown"}


def test_overlays_in_force(spark, tmp_path):
    shipped = spark.createDataFrame([("happy", 1, 0), ("sad", 2, 0), ("mad", 3, 0)], "term string, face_id long, place int")
    low = {"canonical.jsonl": lines(spark, {"term": "Happy ", "id": "k00000000000a"}, "oops", {"id": "k000000000001"}, {"term": "x"}), "notes.md": lines(spark, "hello")}
    high = {"canonical.jsonl": lines(spark, {"term": "happy", "id": "k00000000000b", "rank": 1}, {"term": "sad", "clear": True}), "boosts.jsonl": lines(spark, {"term": "mad", "id": "k000000000003", "boost": -9})}
    high["phrases.jsonl"] = lines(spark, {"key": "meh", "match": ["Meh meh"], "p": {"bored": 1}, "level": 1}, {"key": "", "p": {"bored": 1}}, {"key": "y", "p": {}}, {"key": "z", "p": {"sad": 1}, "level": 9})
    high["blocklist.txt"] = lines(spark, "k000000000005", "# no")
    o = overlays.Overlay().add(low).add(high)
    boosts = overlays.boosts_in_force(spark.createDataFrame([("mad", 3, 2.0)], "term string, face_id long, boost double"), o)
    assert [(r.term, r.boost) for r in boosts.collect()] == [("mad", -3.0)]
    force = {(r.term, r.face_id, r.place, r.user) for r in overlays.canonical_in_force(shipped, o, boosts).collect()}
    assert force == {("happy", 11, 0, True), ("happy", 10, 1, True)}
    assert sorted(r.warning for w in o.warnings for r in w.collect()) == ["level is 1, 2 or 3", "no item", "no key", "no profile", "no term", "not JSON", "unknown file"]
    assert {r.spelling: r.key for r in overlays.spellings_in_force(o).collect()} == {"meh": "meh", "meh meh": "meh"}
    more = spark.createDataFrame([(5,), (6,)], "face_id long")
    assert sorted(r.face_id for r in overlays.hidden_in_force(o, more).collect()) == [5, 6]
    (tmp_path / "boosts.jsonl").write_text('{"term": "a", "id": "k000000000001", "boost": 1}\n')
    assert list(overlays.read_folder(spark, str(tmp_path))) == ["boosts.jsonl"]


def test_demoting_changes_a_score_by_its_boost(spark):
    bear = tables(spark).ids["ʕ•ᴥ•ʔ"]
    t = tables(spark)
    demoted = tables(spark, boosts=overlays.boosts_in_force(t["boosts"], overlays.Overlay(boosts=[spark.createDataFrame([("happy", bear, -3.0, 1)], "term string, face_id long, boost double, layer int")])))
    o = config.Options(limit=10, safety="off", usage="off")
    before, after = ({r.face_id: r.score for r in search.search(x, ["happy"], o).collect()}[bear] for x in (t, demoted))
    assert before - after == pytest.approx(0.48)


def test_reports(spark):
    rows = [(0, "Mad ", 7, "offensive", None, None, []), (1, "mad", 7, "clear", "offensive", None, []), (2, "mad", None, "read_well", None, None, []), (3, "mad", None, "offensive", None, None, []),
            (4, "mad", 7, "missing", None, None, []), (5, "mad", None, "note", None, "  ", []), (6, "mad", None, "note", None, "x" * 501, []), (7, "mad", 7, "no_fit", None, None, list(range(21)))]
    table = spark.createDataFrame([(*r, "angry") for r in rows], "index int, query string, face_id long, reason string, clears string, note string, shown array<long>, term_key string")
    good, bad = reports.checked(table)
    assert {r["index"]: r.error for r in bad.collect()} == {3: "reason needs a face", 4: "reason needs a query", 5: "note required", 6: "note too long", 7: "too many shown"}
    keys = {r["index"]: r.key for r in good.collect()}
    assert keys[0] == keys[1] != keys[2]
    assert reports.checked(good.withColumn("key", F.lit("zz")))[0].count() == 0
    done = {(r.effect, r.undo) for r in reports.effects(good).collect()}
    assert done == {("block", False), ("block", True)}
    queue = spark.createDataFrame([("a", "k1", "offensive", 100, 1), ("b", "k1", "clear", 200, 2), ("c", "k2", "clear", 200, 3), ("d", "k3", "note", 900, 4), ("e", "k4", "note", 100, 5), ("f", "k5", "note", 5, 6)], "report_id string, key string, reason string, t long, seq int")
    queue = queue.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    sent = spark.createDataFrame([("x", "k1", False, 1), ("y", "k2", False, 1), ("z", "k2", True, 2), ("e", "k4", False, 3)], "report_id string, key string, clear boolean, sent_at int")
    out = reports.pending(queue, sent, F.timestamp_seconds(F.lit(1000)), most_age_s=990, since=F.timestamp_seconds(F.lit(50)))
    assert [r.report_id for r in out.collect()] == ["b"]
    events = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "face_id long, seq int, undo boolean")
    assert [r.face_id for r in reports.blocked_after(events).collect()] == [2]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "token string, at int")
    path = str(tmp_path / "log.jsonl")
    assert sinks.append_lines(path, rows) + sinks.append_lines(path, rows) == 4 and len(open(path).read().splitlines()) == 4
    db = str(tmp_path / "c.sqlite")
    assert [sinks.insert_or_ignore(db, "uploads", "token", rows) for _ in range(2)] == [2, 0]
    assert list(sinks.dump(db, "uploads", 2, "at", "token")) == [("b", 2)]
    (tmp_path / "f").write_text("x")
    (tmp_path / "SUMS").write_text(sinks._digest(str(tmp_path / "f")) + "  f\n" + "0" * 64 + "  g\n")
    assert sinks.verified(str(tmp_path), str(tmp_path / "SUMS")) == ["g"]
    assert compile.source_digest([b"ab", b"c"]) != compile.source_digest([b"a", b"bc"])
    assert compile.is_stale(str(tmp_path / "none"), []) and not compile.is_stale(path, [str(tmp_path / "missing")])
    assert compile.merged_grammars([{"negators": ["not", "no"]}, {"negators": ["no", "nein"]}]) == {"negators": ["not", "no", "nein"]}


def test_settings():
    assert config.clamped({"usage": "strong", "safety": "off"}, {"ceilings": {"safety": "normal"}, "locks": {"popularity.enabled": False}}) == ({"usage": "off", "safety": "normal", "popularity.enabled": False}, ["safety", "popularity.enabled", "usage"])
    assert config.load_policy("[locks]\nsafety = 'lots'\n'styles.crude' = 3")["locks"] == {"safety": "strict", "styles.crude": "hide"}
    assert config.derived({"ui.show_reading": True, "popularity.enabled": False, "usage": "low"}) == {"ui.show_reading": True, "popularity.enabled": False, "usage": "off", "explain": "reading"}
    assert config.from_env({"MOODRANK_SEARCH__LIMIT": "5", "MOODRANK_SEARCH__THINNING": "strong", "HOME": "x"}) == {"search.limit": 5, "search.thinning": "strong"}
    names = config.Registry([config.Setting("search.limit", 30, ("limit",))])
    assert names.canonical({"limit": 3, "x": 1}) == ({"search.limit": 3}, ["unknown setting x"]) and names.defaults() == {"search.limit": 30}
    c = config.Consent(default=False)
    assert (c.state, c.allowed) == ("default", False) and c.set(True, 5).set(True, 9).since_ms == 5 and not c.set(False, 7).allowed
    live = config.Live(blocked=1)
    held = live.snapshot()
    assert live.swap(blocked=2)["blocked"] == 2 and held["blocked"] == 1
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5, "c": None}, "d": None}) == {"a": {"b": 5}}


def test_splitmix_known_values():
    """The published generator started at 0: its first three outputs."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        got = [int(tx.splitmix64(np.array([step * np.uint64(i)], np.uint64))[0]) for i in range(3)]
    assert got == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]


def test_more_streams(spark, tmp_path):
    spark.createDataFrame([("s", i, "search", f"q{i}", None) for i in range(40)] + [("s", 100, "pick", None, 39), ("s", 101, "pick", None, 1)], "session string, seq long, op string, query string, about long").coalesce(1).write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([(1, 10), (2, 100), (3, 500)], "id long, t long").select("id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/e")
    requests = spark.readStream.schema("session string, seq long, op string, query string, about long").parquet(f"{tmp_path}/r")
    events = lambda: spark.readStream.schema("id long, ts timestamp").parquet(f"{tmp_path}/e")
    frames = {"about": flows.about_recent(requests), "settled": flows.settled(events(), "ts"), "once": flows.once(events(), "id", "ts")}
    for name, frame in frames.items():
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    assert {(r.seq, r.query) for r in spark.table("about").collect()} == {(100, "q39"), (101, None)}
    assert sorted(r.id for r in spark.table("settled").collect()) == [1, 2] and spark.table("once").count() == 3
    posted = []
    q = flows.sender(events(), lambda batch: posted.append(len(batch)) or True, f"{tmp_path}/c-send", batch=2, every=None)
    assert q.awaitTermination(120) and posted == [2, 1]
    clock, files = [0.0], [1]
    watched = flows.Watched(lambda: files[0], lambda: f"v{files[0]}", 1.0, lambda: clock[0])
    files[0] = 2
    assert watched.get() == "v1"
    clock[0] = 1.0
    assert watched.get() == "v2"


def test_import_picks(spark):
    log = spark.createDataFrame([("pick", " Very  Mad", "x", 0.0), (None, "very mad", "x", 100.0), ("search", "mad", "x", 100.0)], "kind string, q string, text string, ts double")
    got = {(r.term): r.weight for r in reports.import_picks(log, F.timestamp_seconds(F.lit(100)), 100.0).collect()}
    assert got == {"very mad": pytest.approx(1.5), None: pytest.approx(1.5)}
    assert state.pruned(spark.createDataFrame([(None, 1, 1.0), ("a", 1, 1.0)], "term string, id long, weight double"), 1, ["term", "id"]).head().term is None
