import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from skylattice.llm.ppm_language_id import ORDER, Index, Model, predict, prepared, train, windows

PLAIN = {
    "en": "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind".split(),
}


def prose(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(PLAIN[lang]) for _ in range(n))


def counted(texts):
    keys, times = np.unique(np.concatenate([windows(np.frombuffer(b"\n" * ORDER + prepared(t), dtype=np.uint8)) for t in texts]), return_counts=True)
    return keys, times


def brute_length(train_texts, text):
    """Code length straight from the definition."""
    follow = defaultdict(Counter)
    for t in train_texts:
        raw = b"\n" * ORDER + prepared(t)
        for i in range(ORDER, len(raw)):
            for n in range(ORDER + 1):
                follow[raw[i - n : i]][raw[i]] += 1
    raw = b"\n" * ORDER + prepared(text)
    bits = 0.0
    for i in range(ORDER, len(raw)):
        for n in range(ORDER, -1, -1):
            seen = follow.get(raw[i - n : i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if raw[i] in seen:
                bits += np.log2((total + kinds) / seen[raw[i]])
                break
            bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_definition():
    texts = {x: [prose(x, 60, k) for k in range(3)] for x in PLAIN}
    model = Model(sorted(texts), [counted(texts[x]) for x in sorted(texts)])
    probes = ["the and zum Beispiel", "xyz", "", "Für die Öffnung, 42!", "日本"]
    got = model.totals([prepared(p) for p in probes])
    want = [[brute_length(texts[x], p) for x in sorted(texts)] for p in probes]
    assert np.allclose(got, want)


def test_index_finds_all_and_nothing_else():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    index = Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 2**40, 5000).astype(np.uint64), keys)
    assert (index.find(others) == -1).all()


def test_rows_and_held_out_accuracy(spark):
    rows = [(i, prose(x, 30, i), x) for i, x in zip(range(400), itertools.cycle(PLAIN))]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !!", "de"), (1003, "no label", None), (1004, prose("en", 40_000, 9), "en"), (1004, prose("en", 40_000, 9), "en"), (None, "the of and to", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS k")
    got = predict(docs, train(docs)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    tested = [(by[i].lang_pred, x) for i, _, x in rows if by[i].held_out]
    assert len(tested) > 60 and sum(a == b for a, b in tested) == len(tested)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1004, None)] == ["und", "und", "und", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got)
    nothing = docs.where("false")
    assert predict(nothing, train(nothing)).count() == 0
    assert {r.lang_pred for r in predict(docs, train(nothing)).collect()} == {"und"}
