import base64
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarn.llm import mixing, reading, tokens

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "\n\n  a", "it's they'll", "日本語のテキスト。", "a" * 700, "=" * 300, "🤖🤖 ok\r\n\t", "<|endoftext|> x", "naïve café 12345 -- 3.14", "\u0000​ ́"]


def expected(texts):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t) if t else [] for t in texts]


def random_text(rng, n):
    return "".join(rng.choice([" ", " ", "the", "ing", "x", "'s", "\n", "é", "漢", "9", "Robot", "--", "\t", "q"]) for _ in range(n))


def test_ids_equal_the_library(spark):
    rng = random.Random(1)
    texts = [None, *ODD, *(random_text(rng, rng.randint(0, 200)) for _ in range(300)), "word " * 20_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)
    n = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert tokens.encode_documents(df.limit(0)).count() == 0


def test_appends_and_edits():
    rng = random.Random(2)
    e = tokens.TextEncoder(tokens.vocabulary_path(), tokens.split_pattern())
    for _ in range(5):
        text = random_text(rng, 80)
        live = tokens.EditableText(e, text)
        for _ in range(40):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 6))
            new = random_text(rng, rng.randint(0, 4))
            text = text[:a] + new + text[b:]
            live.edit(a, b, new)
            assert live.text == text and live.ids() == expected([text])[0]
        for ch in "'re  re' x":
            text += ch
            live.append(ch)
            assert live.ids() == expected([text])[0]
    long = tokens.EditableText(e, random_text(rng, 3000))
    before = long.encoded
    long.edit(2000, 2001, "zz")
    assert long.encoded - before < 20


def ideal(goals, t):
    """Blocks of each source when t were given out at its weight over those of the unfinished."""
    time, left, active = 0.0, t, sum(w for w, _ in goals.values())
    for end, s in sorted((n / w, s) for s, (w, n) in goals.items()):
        if (end - time) * active >= left:
            time += left / active
            break
        left -= (end - time) * active
        time, active = end, active - goals[s][0]
    return {s: min(n, w * time) for s, (w, n) in goals.items()}


@pytest.mark.parametrize("goals", [
    {"a": (0.37, 300), "b": (0.25, 400), "c": (0.2, 10), "d": (0.18, 500)},
    {s: (1 / 3, 700) for s in "abc"},
    {f"s{i}": (1 / 3 if i < 2 else 1 / 3 / 999, 200 if i < 2 else 2) for i in range(1001)},
])
def test_schedule_deviates_by_less_than_a_block(goals):
    done = dict.fromkeys(goals, 0)
    for slot, (s, k) in enumerate(mixing.schedule(goals)):
        assert k == done[s]
        done[s] += 1
        if len(goals) < 10 or slot % 50 == 0:
            assert all(abs(done[x] - y) < 1 for x, y in ideal(goals, slot + 1).items())
    assert done == {s: n for s, (_, n) in goals.items()}
    assert list(mixing.schedule({})) == [] and list(mixing.schedule({"a": (0.0, 3), "b": (0.5, 2)})) == [("b", 0), ("b", 1)]


def test_mix(spark):
    docs = spark.createDataFrame([(i, s, n, "clash") for i, (s, n) in enumerate([("A b", 10)] * 5 + [("a_B ", 10)] * 5 + [("c", 100), ("c", None), (None, 50), ("d", 0)])], "doc_id bigint, source string, n_tokens bigint, slot string")
    t = spark.createDataFrame([("a_b", 0.9, 3), ("c", 0.1, 1), ("gone", 0.1, 5), ("d", 0.0, 1)], "source string, weight double, max_repeats int")
    rep = mixing.source_report(docs, t)
    got = {r.source: (r.tokens, r.total, r.goal) for r in rep.collect()}
    assert got == {"a_b": (100, 250, 225), "c": (100, 250, 25), "gone": (0, 250, 0), "d": (0, 250, 0)}
    mix = mixing.mix_sources(docs, rep)
    n = {r.source: r.t for r in mix.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert n == {"a_b": 230, "c": 100}
    assert mix.groupBy("doc_id").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] == 3
    share = {r.source: (r.share, r.reached) for r in mixing.share_report(mix, rep).collect()}
    assert share["gone"] == (0, False) and share["d"] == (0, True) and share["c"][1] and abs(share["a_b"][0] - 230 / 330) < 1e-6
    assert mixing.mix_sources(docs.limit(0), mixing.source_report(docs.limit(0), t)).count() == 0


def test_emitted_mix_stays_near_the_ideal(spark):
    rng = random.Random(4)
    rows, block = [], 40
    for i in range(1001):
        size = 12000 if i < 2 else 60
        while size > 0:
            rows.append((len(rows), f"s{i}", n := rng.randint(1, 60)))
            size -= n
    rows.append((len(rows), "s0", 25 * block))
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([(f"s{i}", 1 / 3 if i < 2 else 1 / 3 / 999, 1 if i < 2 else 2) for i in range(1001)], "source string, weight double, max_repeats int")
    rep = mixing.source_report(docs, t)
    goal = {r.source: r.goal for r in rep.collect()}
    goals = {r.source: (r.weight, -(-r.goal // block)) for r in rep.collect()}
    mix = mixing.mix_sources(docs, rep, block_tokens=block).orderBy("slot", "offset").collect()
    longest, done = Counter(), Counter()
    for r in mix:
        longest[r.source] = max(longest[r.source], r.n_tokens)
    for i, r in enumerate(mix):
        done[r.source] += r.n_tokens
        if i + 1 < len(mix) and mix[i + 1].slot == r.slot or i % 50:
            continue
        want = ideal(goals, r.slot + 1)
        assert all(abs(done[s] - want[s] * block) <= block + longest[s] / (2 if done[s] < goal[s] else 1) + 1 for s in goals)


EASY = ["The cat sat on the mat.", "Look at the red ball!", "We like to play in the sun.", "It can jump and run.", "Mo has a big blue toy."]
MID = ["Please check the cable before you start the next test.", "The update fixed two problems with the camera settings.", "Write the number down and compare it with last week.", "If the light blinks, restart the viewer and load the file again."]
HARD = ["The regularised estimator attains the asymptotic variance bound under misspecification.", "Notwithstanding the foregoing, heteroscedastic perturbations preclude identifiability.", "Marginalisation of nuisance parameters mitigates spectral degeneracy.", "Convergence of the proximal iteration presupposes coercivity of the functional."]
DE = ["Der Roboter steht auf dem Tisch und wartet.", "Bitte prüfen Sie die Kamera vor dem Start.", "Das Gehäuse ist blau und sehr schwer."]


def corpus(rng):
    docs, ratings = [], []
    for i in range(360):
        own = [EASY, MID, HARD, DE][i % 4]
        text = " ".join(rng.choice(own) for _ in range(rng.randint(4, 9)))
        if i % 4 != 3 and rng.random() < 0.3:
            text += " " + rng.choice(MID)
        docs.append((i, text, "de" if i % 4 == 3 else "en", "clash"))
        if i % 4 != 3:
            said = reading.LEVELS[i % 4] if rng.random() < 0.93 else rng.choice(reading.LEVELS)
            ratings.append((i, "r1", said))
            ratings.append((i, "r1", said))
    return docs, ratings


def test_levels_of_held_out_documents(spark):
    rng = random.Random(3)
    docs, ratings = corpus(rng)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, level string")
    r = spark.createDataFrame([*ratings, (1, "r2", None), (None, "r2", "novice"), (2, "x", "unheard of")], "doc_id bigint, rater string, audience string")
    model = reading.fit(d, r)
    new, _ = corpus(random.Random(99))
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, "```\nx = 1\n```"), (1004, "[12:00:01] INFO a/b dof=3\n[12:00:02] WARN c/d dof=4"), (1005, (HARD[0] + " ") * 2000), (1006, "a,b,c,d\n1,2,3,4\n5,6,7,8"), (1007, "- " + "\n- ".join(HARD))]
    test = spark.createDataFrame([(i, t) for i, t, *_ in new] + odd + odd[:1], "doc_id bigint, text string").withColumn("level", F.lit("clash"))
    got = {x.doc_id: x.level for x in reading.reading_levels(test, model).collect()}
    right = sum(got[i] == ([*reading.LEVELS, None][i % 4]) for i, *_ in new)
    assert right >= 0.95 * len(new)
    assert [got[i] for i in range(1000, 1008)] == [None] * 5 + ["specialist", None, "specialist"]
    assert reading.reading_levels(test.limit(0), model).count() == 0


def test_fit_without_ratings(spark):
    d = spark.createDataFrame([(1, "A text."), (2, None)], "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    r = spark.createDataFrame([], "doc_id bigint, rater string, audience string")
    assert reading.reading_levels(d, reading.fit(d, r)).count() == 2


def test_sentences():
    got = reading.sentences("# Head\n\n1. One thing is here. Two things are\nthere!\n- An item of a list\n```\ncode()\n```\nx = 1; y = 2;\nEnd.")
    assert [s for s, ok in got if ok] == ["One thing is here.", "Two things are there!", "An item of a list", "End."]
    assert [s for s, ok in got if not ok] == ["```\ncode()\n```", "x = 1; y = 2;"]
    assert reading.sentences(None) == [] and reading.sentences(" \n") == []
