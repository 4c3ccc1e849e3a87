import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm.quality_rules import FENCES, WIDEST, WordTokens, measure, quality_filter, quality_measures

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKENS = WordTokens(MODEL)
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(covered)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, n, len(words) < 20 or 100 * n > 30 * len(words)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\x0b\x1c\x85\xa0é日#&"), max_size=120), st.integers(1, 4))
def test_base_columns_equal_brute_force(text, times):
    text = text * times
    assert measure(text, TOKENS)[:6] == brute(text)


PROSE = "The quick brown fox walked over many lazy dogs while seven old men sat near the river and spoke about spring rain, bread, and songs of their youth."


def test_rows_and_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, PROSE, "en"), (3, PROSE, "en"), (4, "### $$$ *** " * 40, None), (5, "x" * 50_000, "zz"), (None, PROSE, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'old' AS kept", "1 AS n_words")
    out = quality_measures(docs, MODEL).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in out] == [(None, 28, False, True), (1, 0, True, False), (2, 0, True, False), (3, 28, False, True), (3, 28, False, True), (4, 120, True, False), (5, 1, True, False)]
    assert quality_filter(docs, MODEL).columns == docs.columns
    assert [r.kept for r in quality_filter(docs, MODEL).collect()] == ["old"] * 3
    assert quality_measures(docs.where("false"), MODEL).count() == 0 and quality_filter(docs.where("false"), MODEL).count() == 0


def brute_fertility(text):
    """Tokens, characters a token, byte share and entropy, from the library's own encoding of each word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = [i for w in words for i in PIECES.encode(w)]
    counts = Counter(ids)
    share = [n / len(ids) for n in counts.values()]
    return len(ids), sum(map(len, words)) / len(ids), sum(map(PIECES.is_byte, ids)) / len(ids), -sum(x * math.log2(x) for x in share)


def brute_reasons(rows, least_docs):
    """Why each text is rejected, from the definition: median and quartiles by language and length, then by length alone."""
    facts = {i: (lang, *brute_fertility(t)) for i, t, lang in rows if not brute(t)[5]}
    reasons = {i: "base" for i, *_ in rows if i not in facts}

    def place(f):
        return math.floor(2 * math.log2(min(f[1], 4096)))

    def quartiles(values):
        values = sorted(values)
        return [values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.5, 0.75)]

    for i, f in facts.items():
        for same in ([g for g in facts.values() if g[0] == f[0] and place(g) == place(f)], [g for g in facts.values() if place(g) == place(f)]):
            same = set(same)
            if len(same) >= least_docs:
                break
        else:
            same = None
        for name, (below, above, least) in FENCES.items():
            k = {"chars_per_token": 2, "byte_share": 3, "token_entropy": 4}[name]
            if same is None:
                low, high = WIDEST[name]
                low = low and low * (math.log2(min(f[1], 4096) + 1) if name == "token_entropy" else 1)
            else:
                q1, q2, q3 = quartiles([g[k] for g in same])
                sigma = max((q3 - q1) / 1.349, least)
                low, high = below and q2 - below * sigma, above and q2 + above * sigma
            if low is not None and f[k] < low or high is not None and f[k] > high:
                reasons.setdefault(i, name)
    return {i: reasons.get(i) for i, *_ in rows}


def corpus():
    rng = random.Random(5)
    syllables = {"en": "the of and tion ing er ha re in on at en es or ti th ly an nd st".split(), "xx": "ka mu zo pi lera tun voba shi gra nolu".split()}

    def prose(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(i, prose(lang, n), lang) for i, (lang, n) in enumerate((lang, n) for lang in syllables for n in [60, 64, 130, 140, 300] for _ in range(12))]
    rows += [(1000 + k, prose("en", 62), None) for k in range(3)] + [(1100, prose("xx", 9000), "xx")]
    # each band has something to reject: letters apart, runs of bytes, and few different words
    rows += [(2000 + k, " ".join(rng.choice("bcdfghjklmnpqrtvwxz") for _ in range(150)), "en") for k in range(3)]
    rows += [(2100 + k, " ".join([prose("xx", 40), *(chr(0x1D400 + rng.randrange(500)) * 3 for _ in range(15))]), "xx") for k in range(3)]
    rows += [(2200 + k, " ".join(f"{w}###" for w in prose("en", 100).split()), "en") for k in range(3)]
    rows += [(2300 + k, " ".join(rng.choice(("and", "the", "of", "tion", "er")) for _ in range(130)), "en") for k in range(3)]
    return rows + [(3000 + k, rows[0][1], "en") for k in range(200)]  # a group of copies larger than all else


def test_reasons_equal_brute_force_and_every_band_rejects_something(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for least_docs in (12, 40):
        got = quality_measures(docs, MODEL, least_docs=least_docs).collect()
        wanted = brute_reasons(rows, least_docs)
        assert {r.doc_id: r.rejected_by for r in got} == wanted
        for r in got:
            if not r.base_failed:
                assert np.allclose((r.n_tokens, r.chars_per_token, r.byte_share, r.token_entropy), brute_fertility(rows_by(rows)[r.doc_id]))
        assert sorted(r.doc_id for r in quality_filter(docs, MODEL, least_docs=least_docs).collect()) == sorted(i for i, why in wanted.items() if why is None)
        if least_docs == 12:
            assert set(FENCES) <= set(wanted.values()) and all(wanted[i] for i in wanted if 2000 <= i < 3000)
            assert not any(wanted[i] for i in wanted if i < 1000 or i >= 3000)


def rows_by(rows):
    return {i: t for i, t, _ in rows}


def test_length_alone_rejects_no_clean_text(spark):
    rng = random.Random(3)
    syllables = "the of and tion ing er ha re in on at en es or ti th ly an nd st".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(n)), "en") for i, n in enumerate([3000, 6000, 20_000] * 12 + [1_000_000])]
    rows.append((99, " ".join(rng.choice(words[:12]) for _ in range(100_000)), "en"))
    out = {r.doc_id: r for r in quality_measures(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()}
    assert out[36].n_tokens > 1_000_000 and [i for i, r in out.items() if not r.kept] == [99] and out[99].rejected_by is not None
