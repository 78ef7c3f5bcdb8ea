"""Word features against their definitions, character by character."""

import random

from millrace.llm import toxicity as tox


def defined(word, lexicon):
    low, plain = tox.bare(word), tox.undisguised(word)
    counts = [sum(f(c) for c in word) for f in (str.isalpha, str.isupper, str.isdigit)]
    letters, upper, digits = counts
    inner = tox._EDGE.sub("", word)
    masked = letters > 0 and (not all(map(str.isalpha, inner)) or any(a == b == c for a, b, c in zip(low, low[1:], low[2:])))
    return (
        low in tox.INSULTS, low not in tox.INSULTS and plain in tox.INSULTS, lexicon.get("=" + low, 0), max([lexicon.get(x, 0) for x in tox.items(low)[1:]], default=0), low in tox.SECOND,
        letters > 1 and upper == letters, upper, letters, len(word) - letters - digits, word.count("!"), word.count("?"), masked, digits, len(word),
    )


def test_word_features_are_as_defined():
    rng = random.Random(5)
    odd = "aabEidotx!?@$|€0135_-.'éßİıΣςªº²٣Ⅷ中́😀"
    words = sorted(tox.INSULTS | tox.SECOND)
    lexicon = {"=" + w: 1 + k % 7 for k, w in enumerate(words)} | {w[:k]: 1 + k for w in words for k in tox.STARTS}
    for i in range(20_000):
        letters = list(rng.choice(words)) if i % 2 else rng.choices(odd, k=rng.randrange(1, 12))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(letters))
            letters[at] = rng.choice([letters[at].upper(), letters[at] * 3, letters[at] + rng.choice(odd), rng.choice(odd) + letters[at]])
        word = "".join(letters)
        assert tuple(map(float, tox.word_features(word, lexicon))) == tuple(map(float, defined(word, lexicon))), word
