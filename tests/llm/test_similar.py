"""The pipeline's near copies against all pairs by exact similarity."""

import random
from itertools import combinations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def groups(texts):
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(root, 2):
        if find(a) != find(b) and alike(a, b):
            root[find(a)] = find(b)
    return {t: find(t) for t in texts}


def planted(rng):
    """Texts with copies in which 1 to 8 words of 200 are others, chains of such copies, short, wordless and null texts."""
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 4, 5, 8):
            other = list(words)
            for at in rng.sample(range(200), changes):
                other[at] = "z"
            texts.append(" ".join(other))
    step = [f"c{k}" for k in range(100)]
    for k in range(0, 60, 3):
        step[k] = "q"
        texts.append(" ".join(step))
    return [*texts, texts[0].upper(), texts[0], "one two", "One  two", "one three", "", " \n", None]


def test_near_copies_are_those_of_all_pairs(spark):
    texts = planted(random.Random(3))
    random.Random(4).shuffle(texts)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    of, first = groups(texts), {}
    for i, t in enumerate(texts):
        first.setdefault(of[t], i)
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert got.count(None) == 1
    assert sorted(i for i in got if i is not None) == sorted(first.values())


def test_rows_are_decided_one_by_one_where_ids_repeat(spark):
    rng = random.Random(6)
    one, two, three = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(3))
    rows = [(1, one, "en", "s", 0), (2, one + " end", "en", "s", 0), (2, two, "en", "s", 0), (3, three, "en", "b", 0), (3, three, "en", "a", 0), (3, three, "en", "a", 0), (None, one, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[4], rows[6]], key=str)


def test_simhash_links_without_any_band(spark, monkeypatch):
    """With keys that no two texts share, the stage still joins what lies within the radius of fingerprints."""
    import numpy as np

    from millrace.llm import similar
    from millrace.llm.simhash import fingerprint

    def lone_keys(shingles, draws=None):
        import os

        import numpy as np

        return np.frombuffer(os.urandom(8 * 40), np.int64)

    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        words[rng.randrange(200)] = "z"
        texts.append(" ".join(words))
    prints = [fingerprint(t.encode()) for t in texts]
    apart = [(prints[k] ^ prints[k + 1]).bit_count() for k in range(0, 80, 2)]
    assert max(apart) <= 9 and max(apart) > 3  # not by the law of operator 5
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    monkeypatch.setattr(similar, "band_keys", lone_keys)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == list(range(0, 80, 2))


def test_forests_hold_all_fingerprints_within_any_radius(spark):
    from millrace.llm.components import components
    from millrace.llm.simhash import links

    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:60]:
        for bits in (3, 9, 11, 12):
            prints.append(p ^ sum(1 << j for j in rng.sample(range(64), bits)))
    prints = list(dict.fromkeys(prints))
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, node long")
    for radius, parts in ((3, 2), (7, 4), (9, 5), (11, 6)):
        up = list(range(len(prints)))
        for i, j in combinations(range(len(prints)), 2):
            if up[i] != up[j] and (prints[i] ^ prints[j]).bit_count() <= radius:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
        found = dict(components(links(classes, radius=radius, parts=parts)).collect())
        assert [found.get(i, i) for i in range(len(prints))] == up
    with pytest.raises(ValueError):
        links(classes, radius=12, parts=6)
