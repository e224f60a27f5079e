"""Benchmark items that leaked so often that their words are common."""

import pickle
import random
import re

import numpy as np

from lexigrid.llm import decontaminate, hashing


def found(spark, rows, items, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], i) for r in decontaminate.find_leaks(docs, bench, **more).collect() for i in r["__items"]}


def test_item_in_a_third_of_short_documents(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(20_000)}" for _ in range(n))
    hot, cold = say(30), say(30)
    rows = [(i, f"{say(40)} {hot} {say(40)}" if i % 3 == 0 else say(110)) for i in range(300)] + [(300, f"{say(40)} {cold} {say(40)}")]
    assert found(spark, rows, [(1, hot), (2, cold)]) == {(i, 1) for i in range(0, 300, 3)} | {(300, 2)}


def test_no_telling_words_or_empty_sample(spark):
    text = "one passage of a dozen words that all of the documents here hold"
    rows = [(i, f"{text} {i}") for i in range(5)]
    assert found(spark, rows, [(1, text)]) == found(spark, rows, [(1, text)], fit_docs=0) == {(i, 1) for i in range(5)}


def corpus():
    """Documents and items of one vocabulary in which a few words make up most of the text, and what was planted where."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4_000)]
    weights = [1 / (k + 3) for k in range(len(words))]
    say = lambda n: rng.choices(words, weights, k=n)
    items = [(k, say(rng.choice([9, 14, 20, 33, 50, 90]))) for k in range(90)] + [(90 + k, say(k + 3)) for k in range(5)] + [(99, None), (100, []), (7, say(25))]
    rows, plants = [], {}
    for i in range(500):
        text = say(rng.randrange(40, 300))
        if i < 90:
            kind, leak = ("whole", "edited", "reordered")[i % 3], list(items[i][1])
            if kind == "edited":
                leak = [f"other{rng.randrange(99)}" if k % 10 == 4 else w for k, w in enumerate(leak)]
            elif kind == "reordered":
                cut = len(leak) // 2 + rng.randrange(-len(leak) // 10, len(leak) // 10 + 1)
                leak = leak[cut:] + leak[:cut]
            at = rng.randrange(len(text))
            text = text[:at] + leak + text[at:]
            plants[i, i] = kind
        elif i < 95:
            text = text[:20] + items[i][1] + text[20:]
            plants[i, i] = "short"
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (502, " ".join(say(30_000) + items[3][1] + say(30_000))), rows[0], (None, rows[1][1])]
    return rows, [(i, None if t is None else " ".join(t)) for i, t in items], plants


def test_recall_by_kind_and_what_the_cosine_is_for(spark):
    rows, items, plants = corpus()
    hits = found(spark, rows, items)
    for kind in ("whole", "edited", "reordered", "short"):
        mine = [p for p, k in plants.items() if k == kind]
        assert sum(p in hits for p in mine) >= 0.9 * len(mine), kind
    assert {h for h in hits if h[0] is not None and h[0] < 500} <= set(plants), "clean documents are left alone"
    assert (502, 3) in hits and (None, 1) in hits
    # all passages against all items, decided in the same way: the cosine loses next to nothing
    every = found(spark, rows, items, cosine=-2.0)
    assert hits <= every and len(hits) >= 0.97 * len(every)
    # without any cosine candidate only items of a few words are found
    assert {i for _, i in found(spark, rows, items, cosine=2.0)} <= {i for i, t in items if t and len(t.split()) < decontaminate.SHORT}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_confirmed_as_by_plain_lists():
    rng = random.Random(4)
    seen = set()
    for _ in range(3_000):
        vocabulary = rng.choice([6, 15, 40])
        words = [rng.randrange(vocabulary) for _ in range(rng.randrange(1, 30))]
        region = rng.choice([words, words[len(words) // 2 :] + words[: len(words) // 2], []]) + [rng.randrange(vocabulary) for _ in range(rng.randrange(12))]
        answer = frozenset(rng.sample(sorted(set(words)), min(3, len(set(words)))))
        piece = decontaminate.Piece(1, np.array(words, np.uint64), 2, answer)
        n, common = len(words), lcs(words, region)
        if n < decontaminate.SHORT:
            expected = any(region[k : k + n] == words for k in range(len(region) - n + 1))
        else:
            gone = len(set(words) - set(region))
            expected = gone <= 0.4 * n and (common >= 0.8 * n or (common >= 0.4 * n and answer <= set(region)))
        seen.add((n < decontaminate.SHORT, expected))
        assert decontaminate.confirmed(piece, np.array(region, np.uint64)) == expected
    assert len(seen) == 4


def test_blocks_of_items_and_small_parts(spark, monkeypatch):
    rows, items, _ = corpus()
    whole = found(spark, rows, items)
    monkeypatch.setattr(decontaminate, "ITEMS", 30)
    monkeypatch.setattr(decontaminate, "COSINES", 2_000)
    assert found(spark, rows, items) == whole


def test_the_model_is_of_all_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"rare things {k} happen here {k * 7} as said") for k in range(40)], "doc_id long, text string")

    def sampled(*args, **more):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(type(docs), "sample", sampled)
    assert decontaminate.fit(docs).basis.any()


def test_sums_of_runs_and_by_feature():
    """As by plain products: runs of different sizes, features with many and with few words."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, decontaminate.BLOCK + 1, 3_000)
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    features = np.minimum(rng.zipf(1.3, n), decontaminate.FEATURES) - 1
    passage, weight = np.repeat(np.arange(len(sizes)), sizes), rng.random(n, np.float32)
    vectors = rng.standard_normal((decontaminate.FEATURES, decontaminate.RANK)).astype(np.float32)
    y, z = np.zeros((len(sizes), decontaminate.RANK)), np.zeros((decontaminate.FEATURES, decontaminate.RANK))
    np.add.at(y, passage, vectors[features] * weight[:, None])
    got = decontaminate._sums(vectors, features, weight, starts, sizes)
    assert np.allclose(got, y, atol=1e-4)
    np.add.at(z, features, got[passage].astype(float) * weight[:, None])
    sums = np.zeros_like(z, np.float32)
    decontaminate._add_by_feature(sums, got, features, passage, weight)
    assert np.allclose(sums, z, atol=1e-2, rtol=1e-4)


def test_orthonormal_in_place():
    """Spans what it spanned, in the memory that was there; columns that others give are blank."""
    rng = np.random.default_rng(5)
    z = (rng.standard_normal((4_000, 20)) * np.logspace(3, 0, 20)).astype(np.float32)
    z[:, 7] = 0
    q = decontaminate._orthonormal(before := z.copy())
    assert q is before
    gram = q.T.astype(float) @ q
    assert np.allclose(np.sort(np.linalg.eigvalsh(gram))[1:], 1, atol=1e-4) and abs(np.linalg.eigvalsh(gram)[0]) < 1e-6
    assert np.allclose(q.astype(float) @ (q.T.astype(float) @ z), z, atol=1e-2)


def test_the_driver_sends_the_model_once(spark):
    """The weighted basis is made in the tasks: the model is pickled with its basis and weights alone."""
    model = decontaminate.Model(np.ones(decontaminate.FEATURES), np.ones((decontaminate.FEATURES, decontaminate.RANK), np.float32))
    assert len(pickle.dumps(model)) < 1.1 * (model.idf.nbytes + model.basis.nbytes)
    assert (pickle.loads(pickle.dumps(model)).weighted == 1).all()


def test_few_candidates_are_left_to_plain_python(monkeypatch):
    """Marks leave few pairs of a passage and an item beside those with enough words in common; 20 times as many with 512 marks alone."""
    rows, items, _ = corpus()
    rng = np.random.default_rng(2)
    model = decontaminate.Model(np.ones(decontaminate.FEATURES), rng.standard_normal((decontaminate.FEATURES, decontaminate.RANK)).astype(np.float32))
    pieces = decontaminate.pieces_of(items, model)
    held, enough = decontaminate._held, []

    def counted(piece, region, distinct):
        enough.append(len(piece.masks.keys() & distinct) >= len(piece.masks) - (1 - decontaminate.LIKELY) * len(piece.words))
        return held(piece, region, distinct)

    monkeypatch.setattr(decontaminate, "_held", counted)
    decontaminate.Searcher(model, pieces, -2.0).hits([text for _, text in rows])
    assert sum(enough) > 100
    assert len(enough) < 8 * sum(enough)


def test_bits_of_rows():
    marks = np.random.default_rng(1).integers(0, 1 << 63, (500, 16), np.uint64) & np.random.default_rng(2).integers(0, 1 << 63, (500, 16), np.uint64)
    marks[:, 3:11] = 0
    marks[0], marks[1] = 0, [0xFFFFFFFFFFFFFFFF] * 3 + [0] * 13
    assert decontaminate._bits(marks).tolist() == [sum(x.bit_count() for x in row) for row in marks.tolist()]


def test_hashes_as_by_plain_numbers(monkeypatch):
    """At the ends of texts and pieces, in words longer than a piece, with letters of several bytes."""
    whole = 1 << 64

    def plain(word):
        total = sum((b + 1) * pow(hashing._BASE, k, whole) for k, b in enumerate(word)) + len(word)
        return int(hashing.mix(np.array([total % whole], np.uint64))[0])

    rng = random.Random(9)
    texts = ["", "a", " a", "a ", "a  bc\n", "ß é 日本語 x", "x" * 9_000 + " y " + "z" * 700, " , "] + [" ".join("abcdeéf"[: rng.randrange(1, 8)] for _ in range(rng.randrange(300))) for _ in range(60)]
    blobs = [t.encode() for t in texts]
    for piece in (hashing.PIECE, 64):
        monkeypatch.setattr(hashing, "PIECE", piece)
        for is_word, cut in ((hashing.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (hashing.ALNUM, rb"[0-9A-Za-z\x80-\xFF]+")):
            hashes, offsets = hashing.hash_words(blobs, is_word)
            expected = [[plain(w) for w in re.findall(cut, b)] for b in blobs]
            assert [hashes[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected
