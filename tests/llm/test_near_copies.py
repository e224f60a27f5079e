"""Near copies against a comparison of all pairs of texts."""

import random
from itertools import combinations

from lexigrid.llm import simhash


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def alike(texts, least=0.8):
    sets = [shingles(t) for t in texts]
    return [(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= least]


def survivors(texts):
    """The least of each component of all pairs that are alike."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in alike(texts):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(df).collect()) == survivors(texts)


def bits_apart(a, b):
    return (simhash.fingerprint(a, 1) ^ simhash.fingerprint(b, 1)).bit_count()


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.randrange(1 << 30)}"
    return " ".join(words)


def test_crowded_fingerprints(spark):
    """Few words that all texts repeat decide the fingerprints, so keys are crowded; pairs of them are 3 and 4 bits apart."""
    rng = random.Random(1)
    texts = []
    for _ in range(300):
        own = " ".join(x for _ in range(40) for x in (f"c{rng.randrange(7)}", f"c{rng.randrange(7)}", f"u{rng.randrange(1 << 30)}"))
        texts += [own, edited(rng, own, 2)]
    far = [bits_apart(texts[i], texts[j]) for i, j in alike(texts)]
    assert 3 in far and 4 in far
    check(spark, texts)


def test_recall_of_short_and_long_texts(spark):
    """Edits up to a similarity of 0.8 move the fingerprints of some texts by more than 4 bits, short ones most."""
    rng = random.Random(2)
    texts = []
    for n in [20, 30, 40, 60, 100, 200, 600] * 12:
        own = " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
        texts += [own, edited(rng, own, max(n // 50, 1)), edited(rng, own, max(n // 60, 1))]
    assert any(bits_apart(texts[i], texts[j]) > 4 for i, j in alike(texts))
    check(spark, texts)


def test_texts_of_one_fingerprint(spark):
    """The same words in other orders have one fingerprint; two that are alike aren't like the first."""
    rng = random.Random(3)
    texts, words = [], [f"w{i}" for i in range(100)]
    for _ in range(4):
        rng.shuffle(words)
        swapped = words.copy()
        swapped[40], swapped[41] = swapped[41], swapped[40]
        texts += [" ".join(words), " ".join(swapped)]
    assert len({simhash.fingerprint(t, 1) for t in texts}) == 1 and survivors(texts) == [0, 2, 4, 6]
    check(spark, texts)


def test_long_texts_by_their_whole_sets(spark):
    """Sketches of 128 hashes misjudge texts between 0.76 and 0.84."""
    rng = random.Random(4)
    texts = []
    for edits in [11, 12, 13, 14] * 12:
        own = " ".join(f"w{rng.randrange(9000)}" for _ in range(600))
        texts += [own, edited(rng, own, edits)]
    pairs = [jaccard(shingles(a), shingles(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert any(0.76 <= j < 0.8 for j in pairs) and any(0.8 <= j < 0.84 for j in pairs)
    check(spark, texts)


def test_many_rows_go(spark, monkeypatch):
    """Beyond WANTED ids nothing is broadcast; the rows are the same."""
    rng = random.Random(5)
    texts = [""]
    for _ in range(20):
        own = " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
        texts += [own, own, edited(rng, own, 1)]
    check(spark, texts)
    monkeypatch.setattr(simhash, "WANTED", 0)
    check(spark, texts)
