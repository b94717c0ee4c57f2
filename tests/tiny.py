"""A catalog of 14 faces, 10 terms, 2 phrases and a situation. Results on it are known."""

from moodrank.operators.scoring import EMOTIONS
from moodrank.operators.search import Tables
from moodrank.plans.reader import Phrase, Situation, Term, Words
from moodrank.sources.catalog import build_items

FACES = [
    ("¯\\_(ツ)_/¯", {"confused": 0.8, "smug": 0.3}, ["shrug", "arms"], {}),
    ("(╯°□°)╯︵ ┻━┻", {"angry": 0.9, "surprised": 0.2}, ["table flip", "angry"], {}),
    ("(^‿^)", {"happy": 0.8, "calm": 0.3}, ["smile", "happy"], {}),
    ("(╥﹏╥)", {"sad": 0.9}, ["crying", "sad"], {}),
    ("(づ｡◕‿‿◕｡)づ", {"love": 0.7, "happy": 0.5}, ["hug", "arms"], {"multi": 0.9}),
    ("(*/ω＼*)", {"shy": 0.9, "happy": 0.2}, ["shy", "hiding"], {}),
    ("( ͡° ͜ʖ ͡°)", {"smug": 0.8, "flirty": 0.4}, ["lenny"], {"lenny": 1.0, "suggestive": 1.0}),
    ("(◕‿◕✿)", {"happy": 0.9, "playful": 0.3}, ["flower", "cute", "happy"], {"cute": 0.9}),
    ("┌∩┐(◣_◢)┌∩┐", {"angry": 1.0}, ["middle finger", "angry"], {"crude": 1.0}),
    ("(˘ε˘)", {"flirty": 0.8, "love": 0.5}, ["kiss"], {"suggestive": 1.8}),
    ("ʕ•ᴥ•ʔ", {"calm": 0.7, "happy": 0.4}, ["bear", "cute"], {"cute": 0.8}),
    ("(⊙_⊙)", {"surprised": 0.9, "scared": 0.3}, ["stare", "surprised"], {}),
    ("(￣ω￣;)", {"sorry": 0.6, "shy": 0.3}, ["sweat"], {}),
    ("(っ˘ω˘ς )", {"sleepy": 0.9}, ["sleepy"], {"quality": 3.0}),
]
VOCAB = [
    ("happy", {"happy": 1.0}, 9, 2), ("sad", {"sad": 1.0}, 5, 2), ("angry", {"angry": 1.0}, 6, 2), ("shrug", {"confused": 0.7, "smug": 0.3}, 3, 1), ("hug", {"love": 0.6, "happy": 0.4}, 4, 1),
    ("shy", {"shy": 1.0}, 3, 2), ("surprised", {"surprised": 1.0}, 3, 2), ("table flip", {"angry": 0.8, "surprised": 0.2}, 2, 1), ("sleepy", {"sleepy": 1.0}, 2, 2), ("bear", {"calm": 1.0}, 1, 0),
]
DENSE = [[2, 7, 10, 4], [3, 12, None, None], [1, 8, 11, None], [0, 12, 11, None], [4, 9, 2, None], [5, 12, 2, None], [11, 1, None, None], [1, 8, None, None], [13, None, None, None], [10, 99, None, None]]
CANONICAL = [("happy", "(^‿^)", 1, False), ("happy", "(◕‿◕✿)", 2, False), ("Shrug", FACES[0][0], 1, True), ("shrug", "not in the data", 1, True)]
BOOSTS = [("happy", "ʕ•ᴥ•ʔ", 2.0), ("happy", "ʕ•ᴥ•ʔ", 3.0), ("sad", "(￣ω￣;)", -1.0)]
NUMBERS = ["multi", "cute", "intensity", "suggestive", "lenny", "face", "quality", "crude"]


def profile(given):
    total = sum(given.values())
    return tuple(given.get(e, 0.0) / total for e in EMOTIONS)


def faces_table(spark):
    rows = []
    for n, (text, r, words, extra) in enumerate(FACES):
        numbers = {"face": 1.0, "quality": 5.5} | extra
        rows.append((n, text, [r.get(e, 0.0) for e in EMOTIONS], *[numbers.get(x, 0.0) for x in NUMBERS], [(w, min(i, 2)) for i, w in enumerate(words)]))
    return spark.createDataFrame(rows, "row int, text string, r array<float>, " + ", ".join(f"{n} float" for n in NUMBERS) + ", words array<struct<word string, tier tinyint>>")


def words(**more):
    phrases = {s: Phrase("over it", profile({"bored": 0.6, "angry": 0.4}), 2, words=("shrug", "sweat")) for s in ("so over it", "done with this", "over it")}
    phrases["uwu"] = Phrase("uwu", profile({"happy": 0.5, "shy": 0.5}), 1, flags=frozenset({"cute"}))
    given = dict(
        vocab={k: Term(k, tier, n, True, k == "bear", profile(p)) for k, p, n, tier in VOCAB},
        phrases=phrases,
        situations={"movie night": Situation((("movie", "night"), ("watching", "a", "film")), profile({"excited": 0.5, "happy": 0.5}), True, ("hug",))},
        intensifiers=frozenset({"very", "really", "so", "とても"}), diminishers=frozenset({"kinda", "bit", "kind of", "a bit"}), negators=frozenset({"not"}), stopwords=frozenset({"i", "am", "feel", "a", "the", "face"}),
        lewd=frozenset({"lewd", "nsfw"}), single=frozenset({"face", "solo"}), pair=frozenset({"together", "pair"}), emoticons={":(": "sad", "xD": "laughing"},
        canonical=frozenset({"happy", "shrug"}), boosted=frozenset({"happy", "sad"}), emotions=tuple(EMOTIONS),
    )
    return Words(**(given | more))


def tables(spark, **others):
    faces = faces_table(spark)
    items = build_items(faces).cache()
    ids = {r.text: r.face_id for r in items.collect()}
    rows = [ids[f[0]] for f in FACES]
    flat = [x for xs in DENSE for x in xs][::-1]
    lists = [("dense", VOCAB[t][0], k, rows[x]) for t, xs in enumerate(DENSE) for k, x in enumerate(xs) if x is not None and x < 14]
    lists += [("engine", VOCAB[i // 4][0], i % 4, rows[x]) for i, x in enumerate(flat) if x is not None and x < 14]
    given = {
        "neighbours": spark.createDataFrame(lists, Tables.SCHEMAS["neighbours"]),
        "postings": spark.createDataFrame([(w, rows[n], 2 - min(i, 2)) for n, f in enumerate(FACES) for i, w in enumerate(f[2])], Tables.SCHEMAS["postings"]),
        "canonical": spark.createDataFrame([("happy", ids["(^‿^)"], 0, False), ("happy", ids["(◕‿◕✿)"], 1, False), ("shrug", rows[0], 0, False)], Tables.SCHEMAS["canonical"]),
        "boosts": spark.createDataFrame([("happy", ids["ʕ•ᴥ•ʔ"], 3.0), ("sad", ids["(￣ω￣;)"], -1.0)], Tables.SCHEMAS["boosts"]),
    }
    t = Tables(spark, items, words(), given | others)
    t.ids = ids
    return t
