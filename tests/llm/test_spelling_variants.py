"""Spelling variants against plain Python over all pairs of words, and planted misspellings."""

import random
import re
import zlib
from collections import Counter

import pyarrow.dataset as ds
import pytest

from skylattice.llm import spelling_variants as sv
from skylattice.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def brute_counts(rows, missing):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if missing and doc is not None and h % missing == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, missing=None):
    n = brute_counts(rows, missing)
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in by.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(by[w]), n.get(form.get(w))))
    return sorted(out)


def rows_of_words(seed, letters="abé", n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(150)]
    weights = [1 / (k + 1) ** 1.4 for k in range(len(words))]
    return [(i, rng.choice([" ", "-", "\n", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("missing", [None, 7])
def test_equals_plain_python(spark, missing):
    rows = [*rows_of_words(1), (None, "bébab bébab bébab"), (5, None), (6, ""), (7, "ÀÉÎ Çaaaa çaaaa Çaaaa Çaaaa ç×aaa aaaaa1aaaaaa aaaaa aaaaa")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' AS word", "1 AS n", "'y' AS form")
    assert sorted(map(tuple, sv.spelling_variants(docs, missing=missing).collect())) == brute(rows, missing)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(sv, "CHUNK", 10)
    monkeypatch.setattr(sv, "HELD", 5)
    text = "wordword other\n" * 1000 + "averyveryverylongwordthatgoesonandon " * 50
    assert sv.counted(text) == Counter(text.split())
    assert sv.counted("x" * 35) == {"x" * 35: 1} and sv.counted("") == {}
    monkeypatch.undo()
    long = "hello worlds " * 600_000
    got = {r.word: r.n for r in sv.spelling_variants(spark.createDataFrame([(1, long), (2, "hellos hello " * 3)], SCHEMA)).collect()}
    assert got == {"hello": 600_003, "worlds": 600_000, "hellos": 3}


def test_chains_lead_to_the_last_form(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))
    got = {r.word: (r.form, r.root) for r in sv.spelling_variants(spark.createDataFrame([(1, text)], SCHEMA)).collect()}
    assert got == {w: (chain[k + 1] if k < 6 else None, "bbbbbb") for k, w in enumerate(chain)}


def test_empty_tables_and_ratios(spark):
    assert sv.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="more frequent"):
        sv.spelling_variants(spark.createDataFrame([], SCHEMA), ratio=1)


def test_query_on_a_whole_table(spark):
    """The counts in full; near words of a sample of words against all others."""
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r.values()) for r in ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
    n = brute_counts(rows, 97)
    got = {r.word: r for r in QUERIES["op11_spelling_variants"](spark, sf).collect()}
    assert {w: r.n for w, r in got.items()} == n
    form = {w: r.form for w, r in got.items()}
    for w in sorted(n)[::25]:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        want = best if best is not None and n[best] >= 2 * n[w] else None
        assert (got[w].n_near, got[w].form, got[w].form_n) == (len(others), want, n.get(want))
    for w, r in got.items():
        root = w
        while form[root]:
            root = form[root]
        assert r.root == root


def test_nothing_that_grows_with_the_table_is_broadcast(spark, monkeypatch):
    from skylattice.llm import spelling_variants as module

    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint()

    monkeypatch.setattr(module, "persisted", planned)
    monkeypatch.setattr(module, "stored", planned)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        docs = spark.createDataFrame([(1, "planet planet planet plane plane plane plane plane plane plane")], "doc_id long, text string")
        found = planned(module.spelling_variants(docs))
        assert {r.word: r.root for r in found.collect()} == {"planet": "plane", "plane": "plane"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)
