"""What the driver holds of the labelled rows that train the toxicity classifier."""

import random
import tracemalloc

from lexmill.llm import toxicity


def test_windows_of_many_texts_are_held_once():
    r = random.Random(4)
    words = sorted({"".join(r.choices("abcdefghij", k=8)) for _ in range(4000)})
    texts = [" ".join(r.sample(words, 250)) for _ in range(400)]
    tracemalloc.start()
    try:
        got = toxicity.originals(texts)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert [set(x) for x in got] == [set(t.split()) for t in texts]
    assert held < 2 << 20
