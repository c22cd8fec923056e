"""The language model's words, rows and cost, without Spark."""

import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from gridweave.llm import language_model


def small_vocabulary(texts, head, bits):
    """The model's vocabulary of these texts: `head` words, all but the most frequent ones of them without a leaf of their own."""
    lm, found = language_model, Counter()
    for b in lm._counts(iter([pa.RecordBatch.from_pydict({"text": texts})])):
        for h, other, tail, n in zip(*(c.to_pylist() for c in b.columns)):
            found[h % 2**64, other, tail] += n
    kept = sorted(x for x, _ in found.most_common(head))
    h, other, n = np.array([x[0] for x in kept], np.uint64), np.array([x[1] for x in kept], np.int32), np.array([found[x] for x in kept])
    leaf = np.full(len(h), -1)
    leaf[np.lexsort((h, -n))[: lm.TOP]] = np.arange(min(len(h), lm.TOP))
    shares = np.full((lm.CLASSES, lm.CLASSES), 1 / lm.CLASSES)
    return lm.Vocabulary(h, other, n, leaf, sum(found.values()), len(found), bits, np.log(shares[0]), np.log(shares), np.ones(lm.TAILS))


def sliced(texts):
    whole = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)])


def test_language_model_words_are_told_apart():
    """Words of any length that differ in one byte, zero bytes included; the same word anywhere has the same two hashes."""
    near = [base[:k] + c + base[k + 1 : n] for base in ("a" * 300, "abcdefgh" * 40, "\0" * 300) for n in (*range(1, 40), 63, 64, 65, 66, 72, 73, 200) for k in {0, n // 2, n - 1} for c in "xy\0"]
    near = list(dict.fromkeys(near))
    rng, found = np.random.default_rng(3), [{}, {}]
    for seen, order in zip(found, (near, [near[i].upper() for i in rng.permutation(len(near))])):
        w, codes, h, other, tail, n = language_model._keys(*sliced([" ".join(order[:300]), "", *order[300:500], "\n".join(order[500:])]))
        assert len(w.start) == len(near) == len(h) == len(set(h.tolist())) and len(set(other.tolist())) == len(near) and n.tolist() == [1] * len(near)
        for word, c in zip(order, codes):
            seen[word.lower()] = h[c], other[c], tail[c]
    assert found[0] == found[1]


def test_language_model_rows_by_plain_steps():
    """Leaves, places and rows of every feature, token by token."""
    lm, rng, bits = language_model, np.random.default_rng(8), 13
    pool = [f"w{i}" for i in range(900)] + ["x" * 70, "Ärger", "a\0b"]
    texts = ["", None, "w1", "w899 w898", "W2 w3", " w4\tw4\nw4 ", *(" ".join(rng.choice(pool, n, p=(p := 1 / np.arange(3, len(pool) + 3)) / p.sum())) for n in (1, 2, 3, 50, 700, 2500)), "", "w1 w2"]
    v = small_vocabulary([*texts, " ".join(pool)], 700, bits)
    t = lm._tokens(*sliced(texts), v)
    got, at = lm._rows(t, bits), 0
    number = {(int(h), int(o)): i for i, (h, o) in enumerate(zip(v.h, v.other))}

    def row(f, k, own_bits):
        return (int(lm.text.mix(np.array([f % 2**64], np.uint64))[0]) >> (64 - own_bits)) + (k << bits)

    def mixed(x):
        return int(lm.text.mix(np.array([x % 2**64], np.uint64))[0])

    for doc, one_text in enumerate(texts):
        _, codes, h, other, tail, _ = lm._keys(*sliced([one_text]))
        place = [number.get((int(h[c]), int(other[c])), -1) for c in codes]
        leaf = [int(v.leaf[p]) if p >= 0 and v.leaf[p] >= 0 else lm.TOP + int(tail[c]) for p, c in zip(place, codes)]
        key = [int(h[c]) for c in codes]
        end = number.get((int(lm.END), 0), -1)
        place, leaf, key = [*place, end], [*leaf, int(v.leaf[end]) if end >= 0 and v.leaf[end] >= 0 else lm.TOP], [*key, int(lm.END)]
        for i in range(len(key)):
            one, two = [key[i - k] if i >= k else 1 for k in (1, 2)]
            leaf_one, leaf_two = [leaf[i - k] if i >= k else 2000 for k in (1, 2)]
            a, b = [*[x for x in reversed(leaf[:i]) if x < lm.TOP], 2000, 2000][:2]
            lately, c = mixed(a * 4096 + b), leaf[i] // lm.CLASSES << (bits - 5)
            first = (one + 11, two + 23, one * 3 + two * 7 + 37, leaf_one * 4096 + leaf_two + 41, lately + 43)
            want = [row(f, k, bits) for k, f in enumerate(first)] + [row(f, 5 + k, bits - 5) + c for k, f in enumerate((one + 53, leaf_one + 71, lately + 61))]
            assert got[:, at].tolist() == want and (t.doc[at], t.leaf[at], t.place[t.code[at]]) == (doc, leaf[i], place[i])
            at += 1
        assert t.end[doc] == at - 1 and t.begin[doc] == at - len(key)
    assert at == got.shape[1]


def test_language_model_costs_little_beside_the_words():
    """Counting rows and scoring, beside cutting the texts into words and hashing these: 6.0 times as much before, now 3.8."""
    lm, rng = language_model, np.random.default_rng(4)
    pool = np.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 11, 40000)])
    texts = [" ".join(pool[np.minimum(rng.zipf(1.3, 400), len(pool)) - 1]) for _ in range(500)]
    v = small_vocabulary(texts, 20000, 13)
    values = np.zeros(((lm.FIRST + lm.SECOND) << v.bits, lm.CLASSES), np.float32)
    batch = pa.RecordBatch.from_pydict({"row": range(500), "doc_id": range(500), "held_out": [False] * 500, "text": texts})
    buf, off = sliced(texts)

    def plain():
        w = lm.text.words(lm.text.LOWER[buf], off)
        lm.text.span_hash(lm.text.prefix_hash(w.buf), w.start, w.end)

    def cost(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    ours = sum(cost(lambda f=f: list(f(iter([batch])))) for f in (lm._statistics(SimpleNamespace(value=v)), lm._score(SimpleNamespace(value=v), SimpleNamespace(value=values))))
    assert ours < 5 * cost(plain)
