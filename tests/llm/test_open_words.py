"""Language-model scores of words outside the vocabulary, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from factlake.llm.spelling import Spelling, _codes


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from factlake.session import ship_package

    ship_package(spark)


def learnt(words):
    codes, _ = _codes(words)
    return Spelling(codes, np.ones(len(codes), dtype=np.int64))


def plain(words, word):
    """The chance of a word by counts kept in dictionaries."""
    three, two, one = Counter(), Counter(), Counter()
    for w in words:
        w = b"  " + w + b" "
        for i in range(2, len(w)):
            three[w[i - 2:i + 1]] += 1
            two[w[i - 1:i + 1]] += 1
            one[w[i:i + 1]] += 1

    def mixed(counts, before, byte, below):
        after = {k: n for k, n in counts.items() if k[:-1] == before}
        total, kinds = sum(after.values()), len(after)
        return below if not total else (counts[before + byte] + kinds * below) / (total + kinds)

    total, w = 0.0, b"  " + word + b" "
    for i in range(2, len(w)):
        a, b, c = w[i - 2:i - 1], w[i - 1:i], w[i:i + 1]
        total += math.log(mixed(three, a + b, c, mixed(two, b, c, mixed(one, b"", c, 1 / 256))))
    return total


def test_spelling_as_by_plain_counts():
    words = [b"anna", b"annual", b"manna", "für".encode(), b"a", b"zebra", b"anna"]
    model = learnt(words)
    asked = [b"anna", b"ann", b"q", b"zzzz", "größe".encode(), b"a" * 3000]
    assert model.log_probabilities(asked) == pytest.approx([plain(words, w) for w in asked])
    assert Spelling(np.zeros(0, np.int64), np.zeros(0, np.int64)).log_probabilities([b"ab"]) == pytest.approx(
        [3 * math.log(1 / 256)])
    assert len(model.log_probabilities([])) == 0


def test_chances_of_a_byte_sum_to_one():
    model = learnt([b"anna", b"annual", b"manna"])
    for before in (b"  ", b"an", b"nn", b"qa", b"zz"):
        codes = (before[0] << 16) + (before[1] << 8) + np.arange(256)
        assert np.exp(model.log_chances(codes)).sum() == pytest.approx(1)


def test_words_are_spelled_in_the_order_of_their_hashes():
    from factlake.llm.common import word_hashes
    from factlake.llm.masked_lm import _SEPARATOR, spelled

    rng = random.Random(4)
    texts = [None, b"", *(bytes(rng.randrange(256) for _ in range(rng.randrange(90))) for _ in range(200)), b"AbC abc"]
    hashes, _ = word_hashes(texts, _SEPARATOR)
    words = spelled(texts)
    assert len(words) == len(hashes)
    assert len({(h, w) for h, w in zip(hashes.tolist(), words)}) == len(set(words)) == len(set(hashes.tolist()))


def _syllables(rng, n):
    return "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n))


def test_held_out_texts_against_words_by_frequency(spark):
    from factlake.llm.masked_lm import VOCABULARY, SHARED, score_documents

    rng = random.Random(9)
    common = [_syllables(rng, 2) for _ in range(400)]
    rare = [_syllables(rng, 4) for _ in range(4000)]
    # Each common word is followed by one of two, so neighbours tell much.
    after = {w: rng.sample(common, 2) for w in common}

    def text():
        words, w = [], rng.choice(common)
        for _ in range(60):
            words.append(w)
            if rng.random() < 0.1:
                words.append(rng.choice(rare))
            w = rng.choice(after[w])
        return " ".join(words)

    seen = [(i, text()) for i in range(1500)]
    fresh = [(i, text()) for i in range(60)]
    junk = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8))
    base = [t.split()[:40] for _, t in fresh[:20]]
    named = [(1000 + i, " ".join(w + [_syllables(rng, 4) for _ in range(6)])) for i, w in enumerate(base)]
    random_strings = [(2000 + i, " ".join(w + [junk() for _ in range(6)])) for i, w in enumerate(base)]
    schema = "doc_id long, text string"
    got = {
        r.doc_id: r for r in score_documents(
            spark.createDataFrame(fresh + named + random_strings + [(3000, None), (3001, "--")], schema),
            spark.createDataFrame(seen, schema),
        ).collect()
    }
    assert got[3000].text_log_likelihood == got[3001].text_log_likelihood == 0
    assert all(r.text_log_likelihood <= 0 and math.isfinite(r.text_log_likelihood) for r in got.values())
    # The same vocabulary and spelling, each word by its frequency alone.
    counts = Counter(w for _, t in seen for w in t.split())
    top = dict(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:VOCABULARY - SHARED])
    others = [w.encode() for w in counts if w not in top for _ in range(counts[w])]
    spelling, total = learnt(others), sum(counts.values())
    plainly = sum(
        math.log(top[w] / total) if w in top
        else math.log(len(others) / total) + spelling.log_probabilities([w.encode()])[0]
        for _, t in fresh for w in t.split())
    assert sum(got[i].text_log_likelihood for i, _ in fresh) > plainly
    # Unseen strings of no known spelling cost more than unseen names, in every text.
    assert all(got[2000 + i].text_log_likelihood < got[1000 + i].text_log_likelihood - 20 for i in range(20))
