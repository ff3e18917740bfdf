"""The toxicity model against a plain per-coordinate loop over named features."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import toxicity


def named(text):
    """Words, pairs and pairs over one word, each once, and the bias."""
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    out = {("bias",)} | {(w,) for w in words if w}
    for skip in (1, 2):
        out |= {(skip, a, b) for a, b in zip(words, words[skip:], strict=False)}
    return sorted(out, key=str)


def plain(texts, labels, how):
    z, n = {}, {}
    l1 = how.l1 * math.sqrt(len(labels))

    def weight(f):
        rate = (how.beta + math.sqrt(n.get(f, 0.0))) / how.alpha
        if f == ("bias",):
            return -z.get(f, 0.0) / rate
        excess = abs(z.get(f, 0.0)) - l1
        return 0.0 if excess <= 0 else -math.copysign(excess, z[f]) / (rate + how.l2)

    for _ in range(how.epochs):
        for text, y in zip(texts, labels, strict=True):
            features = named(text)
            w = {f: weight(f) for f in features}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for f in features:
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / how.alpha * w[f]
                n[f] = before + g * g
    return {f: weight(f) for f in z if weight(f)}


def test_training_equals_a_plain_loop():
    rnd = random.Random(3)
    words = "You are an AWFUL fool nice day été 日本 the of 42".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) + rnd.choice(["", "!", " -"]) for _ in range(80)]
    labels = np.array([int("fool" in t or "AWFUL" in t) for t in texts])
    how = toxicity.Ftrl()
    slots, weights = toxicity.train(pa.array(texts), labels, how)
    want = plain(texts, labels.tolist(), how)
    every = {f for t in texts for f in named(t)}
    examples = toxicity.examples(pa.array(texts))
    assert len(every) == len(set(np.concatenate(examples).tolist()))  # no two features share a slot here
    assert len(slots) == len(want) < len(every)
    learned = dict(zip(slots.tolist(), weights.tolist(), strict=True))
    assert np.allclose(sorted(learned.values()), sorted(want.values()), rtol=1e-9, atol=1e-12)
    for text, example in zip(texts, examples, strict=True):
        assert math.isclose(sum(learned.get(s, 0.0) for s in example.tolist()), sum(want.get(f, 0.0) for f in named(text)), rel_tol=1e-9, abs_tol=1e-9)
