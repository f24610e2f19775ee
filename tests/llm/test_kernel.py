"""The string kernel against a direct computation, and scripts other than Latin."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa

from chronolane.llm.toxicity import DECAY, NEAR, POWER, SPAN, Model, WordTable, normalise, score_texts, train


def features(word):
    marked, out = "`" + word, collections.Counter()
    for i, j, k in itertools.combinations(range(len(marked)), 3):
        if k - i < SPAN:
            out[marked[i] + marked[j] + marked[k]] += DECAY ** (k - i - 2)
    return out


def word_kernel(a, b):
    x, y = features(a), features(b)
    norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[c] for c, v in x.items()) / norm if norm else 0.0


def test_sentence_kernels_equal_the_direct_sum():
    landmarks = [b"idiot", b"stupid", b"window", b"trash"]
    table = WordTable(Model(landmarks, np.zeros(4), 0.0, np.zeros(3), 0.0))
    texts = ["what an idiot and an idiiot. a stupid window", "i d i o t", "trsh trash. nothing here", "", None, "STUP1D wind0w", "ab"]
    row, got = table.pooled(pa.array(texts, pa.large_string()))
    sentences = [(0, ["what", "an", "idiot", "and", "an", "idiiot"]), (0, ["a", "stupid", "window"]), (1, ["i", "d", "i", "o", "t", "idiot"]), (2, ["trsh", "trash"]), (2, ["nothing", "here"]), (5, ["stupid", "window"]), (6, ["ab"])]
    want = [(r, [sum(k**POWER for w in words if (k := word_kernel(w, m.decode())) >= NEAR) for m in landmarks]) for r, words in sentences]
    want = [(r, k) for r, k in want if any(k)]
    assert row.tolist() == [r for r, _ in want]
    assert np.allclose(got, [k for _, k in want], atol=1e-5)
    gram = np.array([[sum(word_kernel(a, b) ** POWER for a in s for b in t) for _, t in sentences] for _, s in sentences])
    assert np.linalg.eigvalsh(gram).min() > -1e-9  # a kernel


def test_letters_of_every_script_are_kept():
    assert normalise("Ìdïö7!".encode()) == b"idiot" and normalise("Straße".encode()) == b"strasse" and normalise("Łódź".encode()) == b"lodz"
    for word in ("идиот", "ηλίθιος", "白痴蠢货", "أحمق"):
        assert len(normalise(word.encode())) >= 4 and normalise(word.encode()).isalpha()
    assert normalise("ИДИОТ".encode()) == normalise("идиот".encode()) != normalise("окно".encode())


def test_a_model_learns_insults_in_cyrillic():
    rng = random.Random(3)
    letters = "абвгдежзиклмнопрстуфхцчшщыэюя"
    words = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(300)]
    insults = ["идиот", "тупица", "мерзавец"]

    def document(toxic):
        out = rng.choices(words, k=30)
        if toxic:
            out[rng.randrange(30)] = rng.choice(insults)
        return " ".join(out)

    y = [k % 2 for k in range(300)]
    model = train([document(k) for k in y], y)
    score = score_texts(model, WordTable(model), pa.array([document(k) for k in y], pa.large_string()))
    assert np.mean((score >= 0.5) == np.array(y)) > 0.95
