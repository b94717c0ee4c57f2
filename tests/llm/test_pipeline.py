"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
from moodrank.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    before = read(spark, SF, "documents")
    columns = before.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, before, SF).cache()
        counts.append(rows.count())
        if name != "tokens":
            assert rows.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in rows.select("doc_id").collect()} <= ids
        if name in ("quality", "near_copies", "passages"):
            assert counts[-1] <= before.count() and max(Counter(r.doc_id for r in rows.collect()).values()) == 1
        if name == "quality":
            good = {r.doc_id for r in read(spark, SF, "labels").where("quality = 1").collect()}
            kept = {r.doc_id for r in rows.collect()}
            assert len(good & kept) >= 0.98 * len(good)
        before = rows
    assert counts[-1] == counts[-2] and all(r.ids for r in before.where("length(text) > 0").collect())


def test_near_copies_between_the_thresholds(spark):
    """Three words changed of 69: 58 of 72 runs of five words are shared (0.81), 60 of 72 of four (0.83)."""
    own = [f"w{i}" for i in range(69)]
    copy = [*own[:30], "x", "y", "z", *own[33:]]
    far = [*own[:30], "x", "y", "z", "q", *own[34:]]  # 57 of 73, 0.78
    docs = spark.createDataFrame([(3, " ".join(own)), (7, " ".join(copy)), (9, "something else"), (None, " ".join(own))], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 9, None])
    apart = spark.createDataFrame([(3, " ".join(own)), (7, " ".join(far))], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, apart, SF).count() == 2


CLASH = ["_key", "epoch", "epochs", "n_words", "spans", "key", "z", "blobs", "ids", "decoded", "id_", "size", "target", "fence", "l_", "root", "factors", "w"]


def test_stages_keep_columns_of_any_name_and_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (2, "another text of this id", "en", None), (3, None, None, None), (4, "", "en", "b"), (None, text, "en", "b"), (None, None, None, "b"), (5, "x " * 20_000, "fr", "a"), (6, "one more text", "en", "a"), (6, "one more text", "en", "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *(f"{c}{n}" for c in CLASH)) for n, r in enumerate(rows)], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids"] if name == "tokens" else out.columns == docs.columns
        numbers = [int(r.key.removeprefix("key")) for r in got]
        assert all(r[c] == f"{c}{n}" for r, n in zip(got, numbers) for c in CLASH if c != "ids" or name != "tokens")
        if name == "near_copies":
            assert {n for n in numbers} in ({0, 2, 3, 4, 5, 6, 7, 8}, {0, 2, 3, 4, 5, 6, 7, 9})
        if name == "passages":
            assert Counter(r.doc_id for r in got) == Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 2})
        if name == "tokens":
            assert len(got) == len(rows) and all((r.ids is None) == (r.text is None) for r in got)
        assert stage(spark, docs.where("false"), SF).collect() == []
