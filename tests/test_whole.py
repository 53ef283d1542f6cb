"""Queries that do the whole job, against brute force on small fixtures."""

import ast
import random
import warnings
from collections import Counter

import pytest

from corpusmill.functions import subword
from corpusmill.plans import catalog
from corpusmill.session import table


def parses(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def test_sft_reasons_end_with_the_syntax_test(spark, data, tmp_path):
    table(spark, data, "bench_items").write.parquet(f"{tmp_path}/bench_items.parquet")
    real = table(spark, data.replace("sf0.001", "sf0.01"), "kodcode_v1")
    made = [(-1, "instruct", "true", "A question of its own", "x = 1", "kept"), (-2, "complete", "True", "A question of its own", "def f(:\n", "syntax_error"), (-3, "other", "true", "q", "def f(:\n", "style:other"), (-4, "instruct", "false", "q", "def f(:\n", "r1_incorrect"), (-5, "instruct", "true", " ", "def f(:\n", "missing_question"), (-6, "instruct", "true", "A question of its own", " ", "missing_solution")]
    extra = spark.createDataFrame([m[:5] for m in made], "row_id long, style string, r1_correctness string, question string, solution string")
    real.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/kodcode_v1.parquet")
    got = {r["row_id"]: r["reason"] for r in catalog.queries()["sft_decision_reasons_whole"](spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in range(-6, 0)} == {m[0]: m[5] for m in made}
    before = {r["row_id"]: r["reason"] for r in catalog.queries()["sft_decision_reasons"](spark, str(tmp_path)).collect()}
    bodies = {r["row_id"]: r["solution"] for r in table(spark, str(tmp_path), "kodcode_v1").select("row_id", "solution").collect()}
    assert got == {k: "syntax_error" if v == "kept" and not parses(bodies[k].strip()) else v for k, v in before.items()}
    assert catalog.queries()["sft_records"](spark, str(tmp_path)).count() == sum(v == "kept" for v in got.values())


TEXTS = [(1, "low lower newest"), (2, None), (3, ""), (4, "größe 漢字 lowest\nnewest low"), (5, "ab " * 400)]


@pytest.fixture
def corpus(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_blocks_hold_the_bytes_of_all_documents(spark, corpus):
    stream = b"".join((t or "").encode() for _, t in TEXTS)
    got = {r["block_id"]: (r["sum_x"], r["first"]) for r in catalog.queries()["pack_blocks_documents"](spark, corpus).collect()}
    assert got == {k: (sum(stream[512 * k : 512 * k + 512]), 512 * k) for k in range((len(stream) - 1) // 512)} and got


@pytest.mark.parametrize("kind", ["bpe", "byte_bpe", "wordpiece"])
def test_tokenizers_are_trained_on_documents(spark, corpus, kind):
    df = table(spark, corpus, "documents")
    if kind == "wordpiece":
        model = subword.train_wordpiece(subword.gather_words(subword.word_counts(df, "text", "doc_id", subword.WORD, lower=True)), 3_000)
    else:
        model = subword.train_bpe(subword.gather_words(subword.word_counts(df, "text", "doc_id")), 3_000, kind)
    got = {r["doc_id"]: r["n_tokens"] for r in catalog.queries()[f"train_{kind}"](spark, corpus).collect()}
    assert {k: n for k, n in got.items() if k != 2} == {k: len(model.encode(t)) for k, t in TEXTS if t is not None}
    assert set(got) == {k for k, _ in TEXTS}


def spelt_out(words, relative, rounds):
    """Merges by counting everything anew each time; of equal values the pair met first."""
    words, merges = [(list(w), n) for w, n in words], []
    for _ in range(rounds):
        pairs, singles = Counter(), Counter()
        for symbols, n in words:
            for s in symbols:
                singles[s] += n
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] += n
        value = lambda p: pairs[p] / (singles[p[0]] * singles[p[1]]) if relative else pairs[p]  # noqa: B023, E731
        if not pairs:
            break
        best = max(pairs, key=value)
        merges.append((best, value(best)))
        words = [(merged_once(symbols, best), n) for symbols, n in words]
    return merges


def merged_once(symbols, pair):
    return subword.merge_pair(symbols, pair, pair[0] + "+" + pair[1])


@pytest.mark.parametrize("relative", [False, True])
def test_queue_of_pairs_equals_counting_anew(relative):
    rng = random.Random(4)
    for _ in range(60):
        distinct = dict.fromkeys("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 14)))
        words = [(list(w), rng.randrange(1, 5)) for w in distinct]
        state = subword._Pairs([(list(w), n) for w, n in words], relative)
        for pair, value in spelt_out(words, relative, 12):
            assert state.best() == (pair, value)
            state.merge(pair, pair[0] + "+" + pair[1])


@pytest.mark.parametrize("kind", ["bpe", "byte_bpe"])
def test_native_merging_equals_plain_merging(spark, kind):
    rng = random.Random(6)
    texts = [(k, " ".join("".join(rng.choice("abcéx/w>" if rng.random() < 0.9 else "</w>") for _ in range(rng.randrange(1, 9))) for _ in range(30))) for k in range(6)]
    model = subword.train_bpe(subword.gather_words(subword.word_counts(spark.createDataFrame(texts, "i long, t string"), "t", "i")), 340 if kind == "byte_bpe" else 60, kind)
    ranks = {m: k for k, m in enumerate(model.merges)}
    for _, t in texts + [(9, "unknown 漢字 zz</w> \uf8ff")]:
        plain = [p for w in subword.re.findall(subword.PRETOKEN[4:], t) for p in model._merged(model._symbols(w), ranks)]
        assert model.pieces(t) == plain
    assert len(model.merges) > 20


def unigram_by_hand(texts, size, seeds, longest, rounds, prune):
    """The training on one text in memory, line after line."""
    import math

    mark = "\u2581"
    whole = mark + "\n".join(texts).replace(" ", mark)
    letters, parts = Counter(whole), Counter()
    for line in whole.split("\n"):
        parts.update(line[i : i + k] for i in range(len(line)) for k in range(2, min(longest, len(line) - i) + 1))
    start = dict(letters) | {p: n for p, n in parts.most_common(seeds)}
    probs = {p: math.log(n / sum(start.values())) for p, n in start.items()}
    special = ("<unk>", "<s>", "</s>")
    for _ in range(rounds):
        if len(probs) + 3 <= size:
            break
        model = probs | {t: math.log(1e-9) for t in special}
        used = Counter(p for line in whole.split("\n") for p in subword.best_path(line, model)[0])
        probs = {p: math.log((n + 1) / (sum(used.values()) + len(used))) for p, n in used.items() if p not in special}
        probs |= {ch: math.log(1e-9) for ch in letters if ch not in probs}
        over = len(probs) - (size - 3)
        longer = sorted((p for p in probs if len(p) > 1), key=lambda p: used[p])
        for p in longer[: max(0, min(int(prune * len(longer)) + 1, over))]:
            del probs[p]
    return [*special, *probs], probs


def test_unigram_equals_training_in_memory(spark):
    rng = random.Random(5)
    for size, seeds, longest in ((40, 200, 6), (30, 40, 16), (500, 30, 4), (35, 20, 16), (60, 90, 9), (30, 50, 2)):
        texts = ["".join(rng.choice("abc de\n") for _ in range(rng.randrange(1, 60))) for _ in range(8)] + ["", "漢字 <s> x"]
        df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(99, None, "x")], "doc_id long, t string, piece string").repartition(4)
        model = subword.train_unigram(df, "t", "doc_id", size, seeds=seeds, longest=longest)
        tokens, probs = unigram_by_hand(texts, size, seeds, longest, 4, 0.2)
        assert list(model.token_to_id) == tokens
        assert {p: round(x, 9) for p, x in model.log_probs.items() if p in probs} == {p: round(x, 9) for p, x in probs.items()}
        assert all(model.decode(model.encode(t)) == t.lstrip(" ") for t in texts if "<s>" not in t)
    assert subword.train_unigram(df.limit(0), "t", "doc_id", 9).vocab_size == 3


def test_artifacts_have_the_known_layout(spark, tmp_path):
    """Special tokens, ids and unknown characters of the four kinds, on texts worked out by hand."""
    df = spark.createDataFrame([(1, "low lower low"), (2, "It's")], "doc_id long, t string")
    words = subword.gather_words(subword.word_counts(df, "t", "doc_id"))
    bpe = subword.train_bpe(words, 18)
    assert list(bpe.token_to_id) == ["<|endoftext|>", "<|unk|>", " ", "'", "</w>", "I", "e", "l", "o", "r", "s", "t", "w", "lo", "low", "low</w>"]
    assert bpe.merges == [("l", "o"), ("lo", "w"), ("low", "</w>")]
    assert bpe.encode("z", add_eos=True) == [1, bpe.token_to_id["</w>"], 0] and bpe.decode([0]) == "<|endoftext|>"
    byte = subword.train_bpe(words, 259, "byte_bpe")
    assert list(byte.token_to_id)[:3] == ["<|endoftext|>", "!", '"'] and list(byte.token_to_id)[256:] == [chr(256 + 67), "lo", "low"]
    byte.merges.append(("z", "z"))
    assert byte.encode("zz") == [byte.token_to_id["z"]] * 2 and byte.decode(byte.encode("größe", add_eos=True)) == "größe"
    piece = subword.train_wordpiece(subword.gather_words(subword.word_counts(df, "t", "doc_id", subword.WORD, lower=True)), 20)
    assert list(piece.token_to_id)[:16] == ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "'", "i", "l", "s", "##e", "##o", "##r", "##t", "##w", "##er", "it"]
    assert piece.encode("zz", add_eos=True) == [1, 3] and piece.encode_batch(["It", "it"]) == [[15], [15]]
    assert [w for w, _ in subword.gather_words(subword.word_counts(spark.createDataFrame([(1, "a!!?b")], "doc_id long, t string"), "t", "doc_id", subword.WORD))] == ["a", "!!?", "b"]
    for model in (bpe, byte, piece):
        model.save(str(tmp_path / model.kind / "tokenizer.json"))
        again = subword.Subword.load(str(tmp_path / model.kind))
        assert again.encode("low lower It's") == model.encode("low lower It's")


def shuffled(spark):
    """Bytes that the session's tasks have shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    each = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))


def substrings_by_hand(texts, top, longest):
    n = Counter(line[i : i + k] for t in texts if t is not None for line in t.split("\n") for i in range(len(line)) for k in range(2, min(longest, len(line) - i) + 1))
    return sorted(n.items(), key=lambda x: (-x[1], x[0]))[:top]


def test_commonest_substrings_equal_counting_all(spark):
    rng = random.Random(8)
    for top, longest, letters, size in ((5, 16, "ab\n", 90), (40, 6, "abcdé漢\U0001f600 \n", 60), (1, 2, "ab", 9), (3000, 16, "ab c\n", 40), (200, 16, [chr(k) for k in range(0x4E00, 0x5800)], 200), (9, 16, "a", 40), (4, 1, "ab", 9)):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(12)] + ["", "\n", "x", None]
        df = spark.createDataFrame([(t, "clash") for t in texts], "t string, piece string").repartition(3)
        assert [tuple(r) for r in subword.commonest_substrings(df, "t", top, longest).collect()] == substrings_by_hand(texts, top, longest)
    assert subword.commonest_substrings(df.limit(0), "t", 5).count() == 0


def test_substring_topk_documents_shuffles_less_than_the_text(spark, tmp_path):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghij \n") for _ in range(1000)) for _ in range(100)]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(4).write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    assert [tuple(r) for r in catalog.queries()["substring_topk_documents"](spark, str(tmp_path)).collect()] == substrings_by_hand(texts, 200, 16)
    assert shuffled(spark) - before < 100_000  # counted one by one, the substrings are 1.4 MB of shuffle and more


def test_long_texts_are_counted_in_slices(monkeypatch):
    """Slices of any size, and tables too large to be kept in full, give the same counts and first places."""
    pa = pytest.importorskip("pyarrow")
    rng = random.Random(10)
    texts = ["".join(rng.choice("abc\n") for _ in range(rng.randrange(40))) for _ in range(9)]
    order = rng.sample(range(50), len(texts))
    batch = pa.RecordBatch.from_pydict({"t": texts, "o": pa.array(order, pa.int64())})
    pieces = [(line_at + i, o, line[i:]) for o, t in zip(order, texts) for line_at, line in [(sum(len(x) + 1 for x in t.split("\n")[:j]), line) for j, line in enumerate(t.split("\n"))] for i in range(len(line))]
    levels = [["aa", "ab", "ba", "ca"], ["aab", "aba", "baa", "cab"]]
    for slice_, full in ((1 << 21, 1 << 22), (7, 1 << 22), (7, 1), (64, 1)):
        monkeypatch.setattr(subword, "SLICE", slice_)
        monkeypatch.setattr(subword, "FULL", full)
        for k, chosen in ((1, None), (2, None), (4, levels)):
            wanted, found = {}, {}
            for p, o, rest in pieces:
                if len(rest) >= k and (k < 4 or rest[:3] in levels[1] and rest[3] in "ab"):
                    n, first = wanted.get(rest[:k], (0, (99, 0)))
                    wanted[rest[:k]] = n + 1, min(first, (o, p))
            for out in subword._counter(chosen, [97, 98, 99], True)(iter([batch])):
                for r in out.to_pylist():
                    head = "" if r["s"] < 0 else chr(r["s"]) if chosen is None else levels[1][r["s"]]
                    if len(head) + 1 == k and (k < 4 or r["c"] < 99):
                        n, first = found.get(head + chr(r["c"]), (0, (99, 0)))
                        found[head + chr(r["c"])] = n + r["n"], min(first, (r["o"], r["p"]))
            assert found == wanted


def test_train_unigram_shuffles_less_than_the_text(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab") for _ in range(1000)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").coalesce(4)
    before = shuffled(spark)
    model = subword.train_unigram(df, "t", "doc_id", 100, seeds=200)
    assert shuffled(spark) - before < 200_000  # with all substrings counted, several MB
    tokens, probs = unigram_by_hand(texts, 100, 200, 16, 4, 0.2)
    assert list(model.token_to_id) == tokens and {p: round(model.log_probs[p], 9) for p in probs} == {p: round(x, 9) for p, x in probs.items()}


@pytest.mark.parametrize("step, most", [(0, 1 << 24), (20, 1 << 24), (20, 1)])
def test_paths_of_many_lines_equal_best_path(monkeypatch, step, most):
    """Side by side, with the longest lines alone, and all alone as the automaton is too large."""
    np = pytest.importorskip("numpy")
    monkeypatch.setattr(subword._Paths, "STEP", step)
    monkeypatch.setattr(subword._Paths, "MOST", most)
    rng = random.Random(12)
    for _ in range(60):
        letters = rng.choice(["ab", "abc ", "abc漢\U0001f600<s>"])
        probs = {"".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([2, 5, 20])))): -rng.choice([1.0, 2.0, rng.random() * 5]) for _ in range(rng.randrange(12))}
        probs |= {ch: -3.0 for ch in letters} if rng.random() < 0.5 else {"<unk>": -9.0, "<s>": -20.7}
        lines = ["".join(rng.choice(letters + "x") for _ in range(rng.choice([0, 1, 5, 30, 130]))) for _ in range(rng.randint(1, 30))]
        paths = subword._Paths(probs)
        ends, numbers = paths(np.array([ord(ch) for line in lines for ch in line + "\n"], np.int32))
        wanted, at = [], 0
        for line in lines:
            for piece in subword.best_path(line, probs)[0]:
                at += len(piece)
                wanted.append((at - 1, paths.number.get(piece, -1)))
            at += 1
        assert list(zip(ends.tolist(), numbers.tolist())) == wanted


def test_encoding_many_texts_equals_encoding_each(monkeypatch):
    texts = ["", None, "\n", "ab ab", "a\n\nb\n", " x<s>", "é漢 ab" * 30, "ab"]
    for probs in ({"a": -1.0, "b": -1.5, "ab": -2.0, "▁ab": -2.5, "\n": -4.0, "<unk>": -20.0, "<s>": -20.0, "</s>": -20.0}, {"a": -1.0, "<unk>": -3.0, "</s>": -9.0}):
        model = subword.Subword("unigram", {t: k for k, t in enumerate(probs)}, [], probs)
        for slice_ in (1, 9, 1 << 21):
            monkeypatch.setattr(subword, "SLICE", slice_)
            for eos in (False, True):
                got = model.encode_many(texts, eos)
                assert [None if x is None else x.tolist() for x in got] == [None if t is None else model.encode(t, eos) for t in texts]


def test_guesses_change_nothing_but_the_number_of_passes(spark, monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(20)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))).replace(" a", "\n") for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").coalesce(2)
    passes, counter = [], subword._counter
    monkeypatch.setattr(subword, "_counter", lambda levels, letters, placed, *more: passes.append(placed) or counter(levels, letters, placed, *more))
    needed = []
    for hint in (1 << 20, 300, 40):
        monkeypatch.setattr(subword, "HINT", hint)
        passes.clear()
        model = subword.train_unigram(df, "t", "doc_id", 60, seeds=300, longest=12)
        needed.append(sum(passes))
        tokens, probs = unigram_by_hand(texts, 60, 300, 12, 4, 0.2)
        assert list(model.token_to_id) == tokens and {p: round(model.log_probs[p], 9) for p in probs} == {p: round(x, 9) for p, x in probs.items()}
    assert needed[1] < needed[0]
