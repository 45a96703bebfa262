"""What fitting the toxicity chain holds on the driver."""

import random
import tracemalloc

from quarrylens.llm import toxicity


def test_fit_holds_the_words_of_one_group_at_a_time():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=400) + ["vile"] * (i % 2)) for i in range(500)]
    tracemalloc.start()
    try:
        model = toxicity.fit(texts, [i % 2 for i in range(500)], rounds=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert "vile" in model.words and model.prior == 0.5
    assert peak < 12 * sum(map(len, texts)), peak / sum(map(len, texts))
