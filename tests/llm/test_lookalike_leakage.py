import random

from corpusmill.llm import leakage, lookalike

FOLD = lookalike.make_folder()


def form(text):
    return FOLD(text)[0]


def test_same_look():
    same = [("ﬁlter", "filter"), ("ｄａｔａ１", "data1"), ("cafe\u0301", "café"), ("in\u200bduction", "induction"), ("a\u00a0b\u2007c\u202fd", "a b c d"), ("sсhreibt", "schreibt"), ("Нello", "Hello"), ("сор", "cop"), ("сoр", "cop"), ("Мама", "Mама"), ("ΑΒΕ", "ABE"), ("soft\u00adhyphen", "softhyphen"), ("，", ","), ("й", "и\u0306"), ("ё", "e\u0308"), ("ĳs", "ijs"), ("ǆ", "dž"), ("µ", "μ")]
    for a, b in same:
        assert form(a) == form(b), (a, b)


def test_more_scripts_and_founts():
    same = [("𝐛𝐨𝐥𝐝", "bold"), ("ℋello", "Hello"), ("Ⅻ", "XII"), ("ⅽat", "cat"), ("ꓮꓐꓚ", "ABC"), ("ⲥⲟⲣy", "copy"), ("pαypal", "paypal"), ("wιndow", "window"), ("𝟏𝟐", "12"), ("ᏚᎪᎷ"[1:2] + "x", "Ax")]
    for a, b in same:
        assert form(a) == form(b), (a, b)
    # A letter of its own script by itself is no other letter.
    for a, b in [("α = 1", "a = 1"), ("σ", "o"), ("ı", "i"), ("γραμμα", "ypaμμa"), ("№", "No"), ("x²", "x2")]:
        assert form(a) != form(b), (a, b)


def test_different_look():
    different = [("Word", "word"), ("1", "l"), ("uber", "über"), ("a b", "ab"), ("a\nb", "a b"), ("²", "2"), ("вода", "boda"), ("мир", "mup"), ("é", "e")]
    for a, b in different:
        assert form(a) != form(b), (a, b)
    assert form("привет мир") == "привет мир"
    assert FOLD("раураl")[1:] == (1, 0) and FOLD("сор")[1:] == (0, 1)


def test_form_is_idempotent_and_blind_to_spelling():
    rng = random.Random(2)
    pool = [(row["latin"], list(row.values())) for row in lookalike.MEMBERS.values()]
    for _ in range(300):
        picked = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        spelt = "".join(rng.choice(v) for _, v in picked)
        assert form(spelt) == form("".join(k for k, _ in picked))
        assert form(form(spelt)) == form(spelt)


def test_pairs(spark):
    rows = [(1, "abc"), (2, "аbс"), (3, "abc"), (4, "abd"), (5, None), (6, ""), (7, ""), (8, "x" * 50_000 + "\u200b"), (9, "x" * 50_000), (10, "Abc")]
    df = spark.createDataFrame([(*r, "k", "s") for r in rows], "doc_id long, text string, form_key string, stored_key string")
    pairs = {tuple(r) for r in lookalike.same_look_pairs(df).collect()}
    assert pairs == {(1, 2), (2, 3), (8, 9)}
    assert lookalike.same_look_pairs(df.limit(0)).count() == 0
    shaped = {r["doc_id"]: r for r in lookalike.with_form(df).collect()}
    assert shaped[2]["form"] == "abc" and shaped[2]["form_mixed"] == 1 and shaped[5]["form"] is None and shaped[6]["form"] == ""


def test_classes_equal_counting(spark):
    texts = ["abc", "аbс", "abc", "abd", None, "", "Abc", "ab\u200bc", "𝐚bc"]
    df = spark.createDataFrame([(k, t, "clash", 7) for k, t in enumerate(texts)], "doc_id long, text string, form_key string, n long")
    got = {r["id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in lookalike.look_classes(df).collect()}
    real = [(k, t) for k, t in enumerate(texts) if t]
    assert set(got) == {k for k, _ in real}
    for k, t in real:
        assert got[k][1:] == (sum(u == t for _, u in real) - 1, sum(u != t and form(u) == form(t) for _, u in real))
        assert all((got[k][0] == got[j][0]) == (form(t) == form(u)) for j, u in real)
    assert lookalike.look_classes(df.limit(0)).count() == 0


def sentence(rng, n):
    return [f"w{rng.randrange(40)}" if rng.random() < 0.5 else f"name{rng.randrange(5000)}" for _ in range(n)]


def test_finds_every_run_of_twelve(spark):
    rng = random.Random(7)
    prompts = [sentence(rng, 40) for _ in range(6)]
    items = [(i, " ".join(p)) for i, p in enumerate(prompts)] + [(50, None), (51, ""), (52, "too short")]
    docs, want = [], set()
    for d in range(120):
        words = sentence(rng, 60)
        kind = d % 4
        i, n = rng.randrange(6), (12, 30, 11, 0)[kind]
        start = rng.randrange(40 - n + 1)
        words[20:20] = prompts[i][start : start + n]
        glue = rng.choice([" ", "\n", ", ", " ** ", "\n# "])
        text = glue.join(w.upper() if rng.random() < 0.2 else w for w in words)
        docs.append((d, text.replace("name1", "nаme1") if d % 8 == 0 else text))
        if n >= 12:
            want.add((i, d))
    docs += [(900, None), (901, ""), (902, "..."), (903, docs[0][1])]
    want |= {(i, 903) for i, d in want if d == 0}
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, words string")
    bench = spark.createDataFrame(items, "item_id long, prompt string")
    for block in (5000, 3):
        rows = leakage.find_leaks(df, bench, block_items=block).collect()
        assert {(r["item_id"], r["doc_id"]) for r in rows if r["longest_run"] >= 12} == want
    assert leakage.find_leaks(df.limit(0), bench).count() == 0
    assert leakage.find_leaks(df, bench.limit(0)).count() == 0


def test_edited_copy_is_scored(spark):
    rng = random.Random(9)
    prompt = [f"term{k}" for k in range(60)]
    edited = [w if k % 9 else "other" for k, w in enumerate(prompt)]
    df = spark.createDataFrame([(1, " ".join(sentence(rng, 30) + edited))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(prompt))], "item_id long, prompt string")
    row = leakage.find_leaks(df, bench).first()
    assert row["longest_run"] == 8 and row["score"] >= 90


def test_shared_prompts_and_frequent_copies(spark):
    """Two items with one prompt, a phrase that every document has, and many copies: no edited copy is lost."""
    rng = random.Random(10)
    phrase = "please write a python function that returns".split()
    prompts = [phrase + [f"word{i}x{k}" for k in range(50)] for i in range(4)]
    items = [(i, " ".join(p)) for i, p in enumerate(prompts)] + [(9, " ".join(prompts[0]))]
    docs, want = [], set()
    for d in range(60):
        i, every = d % 4, rng.choice([6, 7, 8, 9])
        edited = [w if (k + 1) % every else f"other{rng.randrange(99)}" for k, w in enumerate(prompts[i])]
        docs.append((d, " ".join(sentence(rng, 30) + phrase + sentence(rng, 20) + edited + sentence(rng, 30))))
        want |= {(j, d) for j in ((0, 9) if i == 0 else (i,))}
    docs += [(100 + k, docs[0][1]) for k in range(30)]
    want |= {(j, 100 + k) for j in (0, 9) for k in range(30)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, prompt string")
    free = {(r["item_id"], r["doc_id"]): r["score"] for r in leakage.find_leaks(df, bench).collect()}
    bounded = {(r["item_id"], r["doc_id"]): r["score"] for r in leakage.find_leaks(df, bench, min_score=24).collect()}
    assert {k: v for k, v in free.items() if v >= 24} == {k: v for k, v in bounded.items() if v >= 24}
    assert {k for k, v in bounded.items() if v >= 24} == want


def test_no_alignment_exceeds_its_bound():
    import numpy as np

    rng = random.Random(11)
    for _ in range(200):
        a = np.array([rng.randrange(-1, 5) for _ in range(rng.randrange(1, 30))], dtype=np.int32)
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))], dtype=np.int32)
        held = np.isin(a, b)[None, :]
        assert leakage.align(a, b)[0] <= leakage.score_bounds(held)[0]


def test_alignments_side_by_side_equal_single_ones():
    import numpy as np

    rng = random.Random(8)
    pairs = [(np.array([rng.randrange(-1, 6) for _ in range(rng.randrange(1, 40))], dtype=np.int32), np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))], dtype=np.int32)) for _ in range(300)]
    assert leakage.align_many(pairs, 64) == [leakage.align(a, b) for a, b in pairs]
    assert leakage.align_many([]) == []


def test_alignment_against_the_full_table():
    import numpy as np

    rng = random.Random(9)
    for _ in range(40):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        r = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                r[i][j] = r[i - 1][j - 1] + 1 if x == y else 0
        assert leakage.align(np.array(a), np.array(b)) == (max(map(max, h)), max(map(max, r)))
