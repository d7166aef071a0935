"""What the toxicity model learns of few texts, and long texts."""

import random

import numpy as np
import pyarrow as pa

from meterloom.llm import toxicity

from .test_other_operators import labelled


def plain_words(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdlmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def test_words_of_few_toxic_texts_are_learned():
    text = plain_words(2)
    clean = [text(20) for _ in range(1500)]
    toxic = [f"{text(9)} grumpfxyz {text(9)}" for _ in range(10)]
    model = toxicity.fit(pa.array(clean + toxic), np.array([0.0] * 1500 + [1.0] * 10))
    # by a share of all texts almost no subword of the toxic word had a weight, as it is in 10 of 1,510
    assert np.median(model.weights[toxicity.bags(pa.array(["grumpfxyz"])).buckets]) > 0
    new = [text(20) for _ in range(50)]
    with_word, with_other = (model.scores(pa.array([f"{x} {w}" for x in new])) for w in ("grumpfxyz", "vvhqqwwjj"))
    assert (with_word > with_other).mean() > 0.9


def test_length_alone_is_not_toxic():
    rows = labelled(900)
    model = toxicity.fit(pa.array([t for _, t, _ in rows]), np.array([float(y) for _, _, y in rows]))
    clean = [t for _, t, y in rows if not y]
    longest = sorted(clean, key=len)[-len(clean) // 100 :]
    assert (model.scores(pa.array(longest)) < 0.5).all()
    words = " ".join(clean).split()
    long = " ".join((words * (100_000 // len(words) + 1))[:100_000])
    assert model.scores(pa.array([long]))[0] < 0.5
    # the same text over and over scores as once
    part = " ".join(words[: 12 * 50])
    once, often = model.scores(pa.array([part, " ".join([part] * 40)]))
    assert abs(once - often) < 1e-6


def test_labels_without_documents_take_no_place(spark):
    rows = labelled(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10_000 + i, i % 2) for i in range(20_000)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs, labels, max_labelled=60)
    # with rows of one class or none the weights are all zero
    assert np.count_nonzero(model.weights)
