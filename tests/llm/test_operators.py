"""The operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodrank.llm import chat, components, embedding_dedup, jaccard_join, language_id, mixing, quality, sentencepiece_fst, substring_dedup, token_counts, topk_search

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, sig int, rank int, blob string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [] if text is None else WORD.findall(text.encode())


def make_texts(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(80)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    out = []
    for i in range(n):
        own = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 12, 13, 14, 60, 200]))]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage[rnd.randint(0, 10) : 30]
        if i % 7 == 0 and out and out[-1]:
            own = out[-1].split()  # a near copy
            for _ in range(len(own) // 60):
                own[rnd.randrange(len(own))] = "zz"
        out.append((rnd.choice([" ", "\n", "\t ", "  "])).join(own))
    return out


@pytest.fixture(scope="module")
def doc_rows():
    rows = [(i * 3 % 61, t, "en" if i % 2 else None, [None, "a", "b", "ä"][i % 4]) for i, t in enumerate(make_texts())]
    rows += [(70, None, "en", "a"), (71, "", "en", "b"), (72, " \n\t", None, None), (None, rows[5][1], "en", "a"), (None, None, None, None), rows[8], rows[9]]
    rows += [(rows[10][0], "one id with another text", "en", "a"), (80, rows[3][1], "en", "b"), (81, rows[3][1].upper(), "en", "b"), (82, "word " * 30_000, "en", "c")]
    return [(*r, 5, "clash", 1, 2, "x") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_substring_dedup(spark, docs, doc_rows):
    starts = {}
    for doc_id, text, *_ in doc_rows:
        if doc_id is not None:
            w = words(text)
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                starts[k] = min(starts.get(k, doc_id), doc_id)
    expected = Counter()
    for doc_id, text, *_ in doc_rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - 12):
            if doc_id is not None and starts[tuple(w[i : i + 13])] < doc_id:
                gone |= set(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        expected[doc_id, len(w), len(gone), kept] += 1
    for size in (200, 10**9):  # many reference blocks, and one
        got = substring_dedup.dedup(docs, block_bytes=size).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == expected
    assert any(k[2] for k in expected)
    assert substring_dedup.dedup(empty(spark)).collect() == []


def test_substring_factors(docs, doc_rows, monkeypatch):
    """Each factor stands word for word at its place in the reference, and is as long as it can be."""
    texts = {}
    for doc_id, text, *_ in doc_rows:
        texts.setdefault(doc_id, []).append(words(text))
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 500)
    got = substring_dedup.dedup(docs, block_bytes=700).collect()
    assert any(r.factors for r in got)
    for r in got:
        own = words(r.text)
        covered = set()
        for f in r.factors:
            covered |= set(range(f.start, f.start + f.words))
            assert f.words >= 13 and f.ref_doc < r.doc_id
            assert any(w[f.ref_word : f.ref_word + f.words] == own[f.start : f.start + f.words] for w in texts[f.ref_doc])
        assert len(covered) == r.n_removed == sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2]))
    starts = [f.start for r in got for f in r.factors]
    assert len(starts) < sum(r.n_removed for r in got) / 13 + len(got)  # runs, not single windows


def test_substring_bytes_do_not_grow_with_the_blocks():
    rng = np.random.default_rng(4)
    rows = [(i, i * 7, rng.integers(0, 2**63, 600).astype(np.uint64)) for i in range(3000)]
    sent = {blocks: [r[3] for r in substring_dedup._send(list(rows), blocks)] for blocks in (32, 2048)}
    size = {blocks: sum(map(len, blobs)) for blocks, blobs in sent.items()}
    squeezed = {blocks: len(zlib.compress(b"".join(blobs), 1)) for blocks, blobs in sent.items()}
    assert size[2048] < 2 * size[32] and squeezed[2048] < 1.35 * squeezed[32]


def jaccard_expected(doc_rows):
    sets = []
    for doc_id, text, *_ in doc_rows:
        w = [x.translate(jaccard_join.LOWER) for x in words(text)]
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                same_class = doc_rows[i][0] is not None and doc_rows[j][0] is not None
                if a and b and same_class and 100 * len(a & b) >= 85 * len(a | b) and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    out = Counter()
    for i, s in enumerate(sets):
        ids = [doc_rows[j][0] for j in range(len(sets)) if label[j] == label[i]]
        out[doc_rows[i][0], len(s), doc_rows[i][0] if doc_rows[i][0] is None else min(ids)] += 1
    return out


def test_jaccard_join(spark, docs, doc_rows):
    expected = jaccard_expected(doc_rows)
    got = jaccard_join.join(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert any(k[0] is not None and k[0] != k[2] for k in expected)
    assert jaccard_join.join(empty(spark)).collect() == []


@pytest.mark.parametrize("least", [0.0, 2.0])
def test_jaccard_join_is_whole_after_many_or_few_rounds(docs, doc_rows, monkeypatch, least):
    """All star rounds, or only the first one before the complete one."""
    monkeypatch.setattr(jaccard_join, "LEAST_LINKED", least)
    got = jaccard_join.join(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_expected(doc_rows)


def jaccard_lists(sets, percent, **columns):
    """Lists over sets, in their order, with their bitmaps."""
    lists = object.__new__(jaccard_join.Lists)
    lists.sig = np.arange(len(sets), dtype=np.int64)
    lists.size = np.array([len(s) for s in sets], np.int64)
    lists.percent = percent
    for name, values in columns.items():
        setattr(lists, name, values)
    lists.fit(b"".join(jaccard_join.bitmap(s) for s in sets))
    return lists


def test_jaccard_bitmaps_never_differ_in_more_bits_than_sets_in_runs():
    """Also folded ones, of sets of unlike sizes."""
    rnd = random.Random(5)
    for _ in range(400):
        n, shared = rnd.choice([1, 3, 40, 200, 900, 3000]), rnd.random()
        x = {rnd.getrandbits(64) for _ in range(n)}
        y = {h for h in x if rnd.random() < shared} | {rnd.getrandbits(64) for _ in range(rnd.choice([0, 1, n]))}
        sets = [np.array(sorted(s), np.uint64) for s in (x, y)]
        lists = jaccard_lists(sets, 80)
        words = int(lists.words.min())
        a, b = lists._maps(np.array([0, 1]), words)
        assert len(a) == words and np.bitwise_count(a ^ b).sum() <= len(x ^ y)
        for at, own in enumerate(sets):
            bits = np.unpackbits(lists._maps(np.array([at]), words)[0].view(np.uint8))
            assert (bits == np.bincount((own % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) % 2).all()


def test_jaccard_bitmaps_rule_out_most_sets_that_do_not_link():
    """Short and long, from sets that share nothing to those a little below the threshold."""
    rng = np.random.default_rng(5)
    for n in (300, 1000, 5000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for similar, least in ((0.0, 1.0), (0.6, 1.0), (0.74, 0.7)):
            same = int(2 * n * similar / (1 + similar))
            others = [np.concatenate([rng.permutation(base)[:same], rng.integers(0, 2**63, n - same).astype(np.uint64)]) for _ in range(30)]
            lists = jaccard_lists([base, *others], 80)
            assert (~lists.alike(np.zeros(30, np.int64), np.arange(1, 31))).mean() >= least


def test_jaccard_lists_find_every_pair():
    """Prefixes, positions and blocks lose no pair, for many sizes and list lengths."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(400)]
    sets = {}
    for i in range(90):
        own = set(base[: rnd.choice([1, 2, 7, 20, 60, 300])])
        for _ in range(int(len(own) * rnd.choice([0, 0.02, 0.1]))):
            own.discard(rnd.choice(sorted(own)))
            own.add(rnd.getrandbits(63))
        sets[i] = np.array(sorted(own), np.uint64)
    entries = [(int(h), i, p) for i, s in sets.items() for p, h in enumerate(s[: jaccard_join.prefix_length(len(s), 85)])]
    entries.sort()
    by_run = {}
    for h, i, p in entries:
        by_run.setdefault(h, []).append((i, p))
    many = [v for v in by_run.values() if len(v) > 1]
    owner = np.array([i for v in many for i, _ in v], np.int64)
    place = np.array([p for v in many for _, p in v], np.int64)
    lists = jaccard_lists(list(sets.values()), 85, owner=owner, place=place, length=np.array([len(v) for v in many], np.int64))
    a, b = lists.across(np.arange(90))
    found = set(zip(a.tolist(), b.tolist()))
    for i in range(90):
        for j in range(i):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(x & y) >= 85 * len(x | y):
                assert (j, i) in found


@pytest.mark.parametrize("long_list", [4, 1024])
def test_jaccard_sets_are_named_in_few_buckets(spark, monkeypatch, long_list):
    """A group of near copies is not sent to one bucket for each run that its sets share, and none of its links is lost,
    nor one of longer groups whose lists are dealt to several buckets."""
    rnd = random.Random(11)
    rows = []
    for group in range(12):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        for copy in range(9):
            text = list(base)
            text[rnd.randrange(200)] = f"c{group}x{copy}"
            rows.append((100 * group + copy, " ".join(text)))
    listed = {}
    keep = jaccard_join.saved

    def saved(df, name, *codec):
        out = keep(df, name, *codec)
        if name == "jaccard-listed":
            listed["rows"], listed["sets"] = out.count(), out.select("sig").distinct().count()
        return out

    monkeypatch.setattr(jaccard_join, "saved", saved)
    monkeypatch.setattr(jaccard_join, "LIST_BYTES", 1000)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 100) for i, _ in rows}
    assert listed["sets"] == len(rows)
    assert listed["rows"] <= (4 if long_list > 9 else 12) * len(rows)


def test_jaccard_lists_leave_out_only_what_can_link_with_none(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(jaccard_join, "SIFTED_LIST", 40)
    length = np.concatenate([rng.integers(2, 40, 60), [41]])
    first = np.cumsum(length) - length
    size = rng.integers(5, 400, length.sum())
    place = (rng.random(length.sum()) * jaccard_join.prefix_length(size, 85)).astype(np.int64)
    able = jaccard_join._with_others(size, place, first, length, 85)
    for at, n in zip(first[:-1], length):
        own = range(at, at + n)
        assert [bool(x) for x in able[at : at + n]] == [any(jaccard_join.can_link(size[x], place[x], size[y], place[y], 85) for y in own if y != x) for x in own]
    assert not able[: first[-1]].all() and able[first[-1] :].all()


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + i) for i in range(200)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(250)]
    edges += [(7, 7), (2, 3), (3, 2)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        before = dict(label)
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label
    assert len(got) == len(label)


VEC = "vec_id long, embedding array<float>, label int, cell int, rep int"


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 8))
    for i in range(0, 60, 2):
        x[i + 1] = x[i] + 0.05 * rng.standard_normal(8)
    for i in range(100, 115):
        x[i] = x[99] + 0.3 * rng.standard_normal(8)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [float("inf")] + [1.0] * 7), (204, [None] + [1.0] * 7), (205, []), (None, rows[0][1])]
    rows += [(206, rows[0][1]), (206, rows[0][1]), (250, [1.0, 2.0]), (251, [2.0, 4.0]), (300, [v * 2 for v in rows[4][1]])]
    return [(*r, 1, 2, 3) for r in rows]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def test_embedding_dedup(spark, vector_rows):
    got = embedding_dedup.near_duplicates(spark.createDataFrame(vector_rows, VEC)).collect()
    n, links = Counter(), {i: set() for i in range(len(vector_rows))}
    for i, (a, v, *_) in enumerate(vector_rows):
        for j, (b, w, *_) in enumerate(vector_rows):
            if i != j and a is not None and b is not None and usable(v) and usable(w) and len(v) == len(w) and any(v) and any(w):
                if np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                    links[i].add(j)
    for i, row in enumerate(vector_rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component = None if row[0] is None else min(vector_rows[j][0] for j in seen)
        n[row[0], len(links[i]), component, row[0] is None or component == row[0]] += 1
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == n
    assert all(r.recall is None or r.recall >= 0.9 for r in got) and any(r.recall is not None for r in got)
    wide = spark.createDataFrame([(1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [0.0, 1e-300])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(wide).collect()} == {1: 1, 2: 1, 3: 3}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VEC)).collect() == []


@pytest.mark.parametrize("blocks", [(2, 7), (512, 8192)])
def test_topk(spark, vector_rows, blocks):
    got = topk_search.top_k(spark.createDataFrame(vector_rows, VEC), F.col("vec_id") % 10 == 0, 5, *blocks).collect()
    able = [(i, [int(np.floor(x * 256)) for x in v]) for i, v, *_ in vector_rows if i is not None and usable(v)]
    expected = set()
    for q, v in {(i, tuple(v)) for i, v in able if i % 10 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in able if i != q and len(w) == len(v))[:5]
        expected |= {(q, k, i, -s) for k, (s, i) in enumerate(found, 1)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_topk_large_numbers():
    rows = np.array([[2**40, 3], [2**40, 4], [-(2**41), 1]], object)
    _, ids, scores = topk_search.search_block(rows[:1], np.array([9]), rows.astype(np.int64), np.array([1, 2, 3]), 2)
    assert ids.tolist() == [2, 1] and scores.tolist() == [2**80 + 12, 2**80 + 9]


def test_sentencepiece_matches_the_library(spark, docs, doc_rows):
    library = pytest.importorskip("sentencepiece")
    path = f"{sentencepiece_fst.DIRECTORY}/{sentencepiece_fst.MODEL}"
    processor = library.SentencePieceProcessor(model_file=path)
    m = sentencepiece_fst.model()
    rnd = random.Random(4)
    texts = [t for _, t, *_ in doc_rows if t is not None] + ["", " ", "  a  b ", "▁x ▁", "é😀\x00\n\n", "a" * 500, " " * 100 + "x" + " " * 37, "don't (ok) http://a.b/c?d=e&f=1"]
    texts += ["".join(rnd.choice("ab ,.'\n\t▁é12(){}=<>/\\_THEthe  ") for _ in range(150)) for _ in range(200)]
    for t in texts:
        ids = m.encode(t).tolist()
        assert ids == processor.encode(t)
        assert m.decode(ids) == t.replace("▁", " ")
    assert m.merged("▁lower") == processor.encode("lower", out_type=str)
    got = sentencepiece_fst.encode(docs).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((r[0], r[1]) for r in doc_rows)
    assert all((r.ids is None) == (r.text is None) for r in got)
    assert sentencepiece_fst.encode(empty(spark)).collect() == []


def test_token_counts(spark, docs, doc_rows):
    rnd = random.Random(6)
    for _ in range(200):
        pieces = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(12)}
        others = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 4))) for _ in range(10)}
        automaton = token_counts.LongestMatch(pieces, others)
        for _ in range(30):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 9)))
            at = count = 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in (others if at else pieces)), None)
                if end is None:
                    count = 1
                    break
                at, count = end, count + 1
            assert automaton[word] == count
    got = token_counts.count_tokens(docs).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((r[0], len(words(r[1]))) for r in doc_rows)
    assert all((r.n_tokens >= r.n_words) for r in got)
    assert token_counts.count_tokens(empty(spark)).collect() == []


def test_mixing(spark, docs, doc_rows):
    got = mixing.mix(docs, F.when(F.col("lang") == "en", 2.0)).collect()
    sizes = Counter((r[0], len(words(r[1]))) for r in doc_rows)
    assert Counter((r.doc_id, r["size"]) for r in got) == sizes
    by_target = {}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size
        by_target.setdefault((r.target, r.source_size), []).append(r)
    assert abs(sum(t for t, _ in by_target) - 1.5 * sum(k[1] * n for k, n in sizes.items())) < 1e-6
    for (target, _), rows in by_target.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r["size"] for r in rows) / 2
    assert Counter(mixing.mix(docs, F.when(F.col("lang") == "en", 2.0)).collect()) == Counter(got)
    assert mixing.mix(empty(spark)).collect() == []


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a (weight 5) is full at 20, c (1) has nothing; b (2) and null (5) share the rest, null up to 2000.
    assert got["a"] == 20 and got["c"] == 0
    assert got[None] == 2000 and got["b"] == pytest.approx(1.5 * 2010 - 2020)


CONV = "conv_id long, turn long, role string, text string, valid int, segments string"


def test_chat(spark):
    rows = [(1, 1, "assistant", "a#<\\b\\h"), (1, 0, "user", None), (2, 0, "assistant", ""), (2, 1, None, "x: y"), (3, 0, "sys:tem", "</turn>\n### User: "), (3, None, "user", "\\"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    rows += [(6, 0, "Assistant", "not masked"), (6, 1, "assistant", "masked"), (6, 2, "\\r", "r"), (7, 0, "User", "u"), (7, 1, "System", "\\rAssistant"), (7, 2, "\\rUser", "#")]
    rows += [(None, 0, "user", "n"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "é😀" * 50), (5, 3, "assistant", "twice")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV)
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(chat.with_extra(table))).collect()}
    rows += [(-7, 0, "user", chat.EXTRA_TEXT), (-7, 1, "assistant", chat.EXTRA_TEXT)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: False, 6: False, 7: False, -7: True}
    assert chat.digest(chat.format_chats(spark.createDataFrame([], CONV))).collect() == []


def prose(lang, rnd, n):
    syllables = {"x": ["the", "ing", "tion", "er"], "y": ["der", "sch", "ung", "ß"], "z": ["ción", "os", "que", "ñ"]}[lang]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rnd = random.Random(8)
    rows = [(i, prose("xyz"[i % 3], rnd, rnd.randint(1, 40)), "xyz"[i % 3]) for i in range(300)]
    rows += [(900, None, "x"), (901, "12 !!", "x"), (902, "", "x"), (None, prose("x", rnd, 20), "x"), (903, prose("y", rnd, 3000), None)]
    table = spark.createDataFrame([(*r, "src") for r in rows], "doc_id long, text string, lang string, score string")
    got = language_id.predict(table).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "y" and by[None].lang_pred == "x"
    held = [r for r in got if r.held_out]
    truth = {r[0]: r[2] for r in rows}
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    unlabelled = language_id.predict(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert language_id.predict(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_byte_contexts_give_exact_code_lengths():
    sample = [("x", "abracadabra abra"), ("y", "banana band")]
    m = language_id.LanguageModel(sample, least=1)
    size = len(m.alphabet) + 2
    start = language_id.START
    for j, language in enumerate(m.languages):
        counts = Counter()
        for lang, text in sample:
            if lang == language:
                s = [start] * 3 + list(text.encode())
                for i in range(3, len(s)):
                    for k in range(4):
                        counts[tuple(s[i - k : i + 1])] += 1

        def bits(context, symbol):
            seen = {g[-1]: c for g, c in counts.items() if len(g) == len(context) + 1 and g[:-1] == context}
            if not seen:
                return bits(context[1:], symbol) if context else np.log2(size)
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return -np.log2(seen[symbol] / total)
            return -np.log2(len(seen) / total) + (bits(context[1:], symbol) if context else np.log2(size))

        for text in ("abra band", "cab", "nananaba"):
            s = [start] * 3 + list(text.encode())
            expected = sum(bits(tuple(s[i - 3 : i]), s[i]) for i in range(3, len(s)))
            assert language_id.sums(m.tables, [text.encode()])[0][j] == pytest.approx(expected, rel=1e-4)
            assert language_id.sums(m.tables, [text.encode()], most=2)[0][j] == pytest.approx(expected, rel=1e-4)


def test_quality(spark):
    rnd = random.Random(9)
    good = [(i, prose("xy"[i % 2], rnd, rnd.randint(5, 60)), "xy"[i % 2]) for i in range(200)]
    junk = [(1000 + i, " ".join(rnd.choice(["$$%", "#&*!", "|", "QQ"]) for _ in range(40)), "x") for i in range(10)] + [(1010 + i, "tion " * 200, "x") for i in range(3)]
    rows = [*good, *junk, (2000, None, "x"), (2001, "", None), (2002, prose("x", rnd, 30), None), (None, prose("x", rnd, 30), "x"), good[0]]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, lang string, bits int, kept string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200) if i % 3] + [(1000, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    got = quality.score(docs.drop("bits", "kept"), labels).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows)
    assert not any(kept[i] for i in range(1000, 1013)) and not kept[2000] and not kept[2001]
    assert sum(kept[i] for i in range(200)) >= 198 and kept[2002] and kept[None]
    joined = quality.score(docs, labels, sharded=True).collect()
    key = lambda r: (str(r.doc_id), r.n_symbols)
    for a, b in zip(sorted(got, key=key), sorted(joined, key=key)):
        assert (a.doc_id, a.kept) == (b.doc_id, b.kept)
        assert a.perplexity == (None if b.perplexity is None else pytest.approx(b.perplexity, rel=1e-4))
    assert all(r.kept == (r.n_symbols > 0) for r in quality.score(docs, labels.where("false")).collect())
    assert quality.score(docs.where("false"), labels).collect() == []


def test_kneser_ney_against_the_formulas(spark):
    """Probabilities by the published formulas, from plain counts, in Python."""
    rnd = random.Random(12)
    texts = [prose("xyz"[i % 3], rnd, rnd.randint(1, 25)) for i in range(25)]
    model = quality.KneserNey(quality.run_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    start = quality.START
    counts = {4: Counter()}
    for t in texts:
        own = Counter()
        s = [start] * 3 + list(quality.symbols(t))
        for i in range(3, len(s)):
            own[tuple(s[i - 3 : i + 1])] += 1
        counts[4].update({g: 1 if quality.REPEAT_BYTE[0] in g else n for g, n in own.items()})
    for k in (3, 2, 1):  # how many different symbols stand before
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, table in counts.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in (1, 2, 3)]
        discounts[k] = [min(max(x, 0.1), i + 0.9) if x else 0.5 for i, x in enumerate(d)]

    def p(gram):
        if not gram:
            return 1.0 / quality.SYMBOLS
        k, context = len(gram), gram[:-1]
        after = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not after:
            return p(gram[1:])
        cut = lambda n: discounts[k][min(n, 3) - 1]
        total = sum(after.values())
        own = (after[gram] - cut(after[gram])) / total if gram in after else 0.0
        return own + sum(map(cut, after.values())) / total * p(gram[1:])

    tables = model.tables()
    for text in (texts[0], texts[7][:20], "the sch ñ zz", "erer erer"):
        s = [start] * 3 + list(quality.symbols(text))
        expected = sum(-np.log2(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s)))
        assert quality.sums(tables, [quality.symbols(text)])[0] == pytest.approx(expected, rel=1e-4)


def test_many_languages_and_long_rows(spark):
    rnd = random.Random(13)
    rows = [(i, f"{prose('xyz'[i % 3], rnd, 12)} k{i % 450}q", f"l{i % 450}") for i in range(1800)] + [(5001 + i, prose("z", rnd, 9000), "long") for i in range(6)]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and "long" in {r.lang_pred for r in got if r.doc_id > 5000}


def test_token_counts_of_the_real_vocabulary():
    import base64

    with open(f"{token_counts.DIRECTORY}/{token_counts.VOCABULARY}", "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    counts, longest, rnd = token_counts.automaton(), max(map(len, pieces)), random.Random(3)
    for w in ["hello", "naïve", "😀x", "ﬀﬁ", "antidisestablishmentarianism", "ö" * 40] + ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéß.,-0123") for _ in range(rnd.randint(1, 30))) for _ in range(400)]:
        word, at, n = b" " + w.encode(), 0, 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces and (at == 0 or word[at:at + 1] != b" "))
            n += 1
        assert counts[word] == n, w


def test_unigram_models_by_their_costs():
    """A small model of kind unigram, written by hand, gives the library's pieces."""
    library = pytest.importorskip("sentencepiece")

    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + payload

    def text(number, raw):
        return field(number, 2, bytes([len(raw)]) + raw)

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.5, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -2.9, 1), ("ba", -4.0, 1), ("bab", -5.0, 1), ("▁ab", -6.2, 1)]
    blob = b"".join(text(1, text(1, p.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))) for p, score, kind in pieces)
    blob += text(2, field(3, 0, bytes([1]))) + text(3, field(3, 0, bytes([1])) + field(4, 0, bytes([0])) + text(1, b"identity"))
    m, processor = sentencepiece_fst.Model(blob), library.SentencePieceProcessor(model_proto=blob)
    rnd = random.Random(2)
    for t in ["ab", "abab", "ba b", "aacb", "abc abab" * 5] + ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 40))) for _ in range(100)]:
        assert m.encode(t).tolist() == processor.encode(t), t
