import hashlib
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylattice.llm.pii_weak_supervision import VOTES, _train_votes, detect, joined, redact, train
from skylattice.llm.queries import personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


TEXTS = [
    None, "", "plain words only", "a@b", "a@b.c", "x%a.b+c@d-e.f.gh..i z", "a@b.c@d.e", "a@b.c%d@e.fg", "1.2.3.4.5.6.7.8", "300.1.1.1 and 001.2.3.0255", "999.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "12345678901234567890123", "+1 (017) 555-7713 ok", "+12345678", "+1234567890123456", "++49 170 1234567--",
    "é日😀 4845168114407329 😀 me@x.org, 10.0.0.1", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "\uffff a@b.c \uffff 4111 1111 1111 1111", "1" * 3000, "1 " * 9000, "a" * 50_000 + "@b.c", "a@" + "b." * 9000 + "c", "1." * 9000, "+1" * 5000,
]


@pytest.fixture(scope="module")
def model(spark):
    return train(corpus(spark))


def test_base_spans_equal_the_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'x' AS spans", "'y' AS kind", "1 AS n")
    got = {r.doc_id: r for r in personal_data(docs, train(docs)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [x for x in got[i].spans.split(",") if x.split(":")[0] in PLAIN] == want
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x.startswith(k + ":") for x in want) for k in PLAIN)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab1200345.@+- ()é%"), max_size=60), min_size=150, max_size=200))
def test_random_texts(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in detect(docs, model).select("doc_id", joined(F.col("found")).alias("s")).collect():
        assert [x for x in r.s.split(",") if x.split(":")[0] in PLAIN] == brute(texts[r.doc_id])


def test_spans_of_long_texts_do_not_depend_on_blocks(spark, model):
    rng = random.Random(8)
    parts = ["a.b@c.de", "10.2.3.4", "4111 1111 1111 1111", "+1 (212) 555-7713", "word", "x1", "12", "é", "日本", "1.", "()", "@", "+", "%", "A@", "5-"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", ", ", ",", "\n", ". "]) for _ in range(n)) for n in (50, 300, 1000, 3000) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in detect(docs, model).select("doc_id", joined(F.col("found")).alias("s")).collect():
        assert [x for x in r.s.split(",") if x.split(":")[0] in PLAIN] == brute(texts[r.doc_id])
    for r in redact(docs, model).collect():
        rest = texts[r.doc_id]
        for piece in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET|NUMBER)\]", r.text):
            at = rest.index(piece)
            rest = rest[at + len(piece) :]


def test_many_matches_in_one_text_take_seconds(spark, model):
    text = "12 x me@x.org, 10.0.0.1 y " * 32_000
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    began = time.monotonic()
    spans = detect(docs, model).select(F.size("found").alias("n"), F.element_at("found", -1)["end"].alias("end")).first()
    assert spans.n == 64_000 and spans.end == len(text) - 3
    assert redact(docs, model).first().text == "12 x [EMAIL], [IP] y " * 32_000
    assert time.monotonic() - began < 60


def test_estimation_equals_a_plain_one_over_single_proposals():
    rng = random.Random(2)
    proposals = []
    for _ in range(600):
        true = rng.random() < 0.3
        proposals.append(tuple((1 if true else -1) if rng.random() < right else rng.choice((-1, 0, 1)) for right in (0.9, 0.5, 0.7, 0.2)))
    prior, table = _train_votes(dict(Counter(proposals)), 12)
    p, share = 0.5, [[{1: 0.6, 0: 0.2, -1: 0.2}, {1: 0.2, 0: 0.2, -1: 0.6}] for _ in VOTES]
    for _ in range(12):
        weights = []
        for votes in proposals:
            yes, no = p, 1 - p
            for k, v in enumerate(votes):
                yes, no = yes * share[k][0][v], no * share[k][1][v]
            weights.append(yes / (yes + no))
        p = sum(weights) / len(weights)
        share = [
            [{v: (sum(w for w, votes in zip(ws, proposals) if votes[k] == v) + 1) / (sum(ws) + 3) for v in (-1, 0, 1)} for ws in (weights, [1 - w for w in weights])]
            for k in range(len(VOTES))
        ]
    assert abs(prior - p) < 1e-9
    assert all(abs(table[name, v][side] - share[k][side][v]) < 1e-9 for k, name in enumerate(VOTES) for v in (-1, 0, 1) for side in (0, 1))
    best = max(VOTES, key=lambda n: table[n, 1][0] / table[n, 1][1])
    assert best == VOTES[0] and 0.2 < prior < 0.4


def test_the_classifier_decides_what_the_pattern_cannot(spark):
    rows = []
    for i in range(200):
        h = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, [f'api key = "{h[:28]}" here', f"read the-{i}nd-part-of-the-long-story-again here", f"the donaudampfschifffahrtsgesellschaften sail {i}", f"mail to p{i}@x{i}.example.org or +1 (212) 555-{1000 + i}"][i % 4]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.kinds for r in detect(docs, train(docs)).select("doc_id", F.col("found.kind").alias("kinds")).collect()}
    proposed = [i for i, t in rows if re.search(r"[A-Za-z0-9_+/=-]{20,}", t)]
    assert len(proposed) == 150 and sorted(i for i in proposed if found[i]) == [i for i, _ in rows if i % 4 == 0]


def corpus(spark):
    rows = []
    for i in range(300):
        h = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f'Some words {i} here. token = "{h}" and more words' if i % 3 == 0 else f"Write to anna.{i}@mail{i}.example.com or call +1 (212) 555-{1000 + i} now" if i % 3 == 1 else f"In chapter {i} the word donaudampfschifffahrtsgesellschaft2 occurs on page {i}000000"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_model_adds_secrets_and_leaves_prose_alone(spark, model):
    docs = corpus(spark)
    found = {r.doc_id: r.s for r in detect(docs, model).select("doc_id", joined(F.col("found")).alias("s")).collect()}
    assert all(f"secret:{len(f'Some words {i} here. token = ') + 1}" in found[i] for i in range(0, 300, 3))
    assert all(found[i].count(":") == 4 for i in range(1, 300, 3))
    assert not any(found[i] for i in range(2, 300, 3))
    yes, no = model.votes["by_pattern", 1]
    assert yes > no


def test_redaction(spark, model):
    docs = spark.createDataFrame([(1, "é a@b.cd, 10.0.0.1!", 20), (2, None, None), (3, "nothing", 7), (3, "nothing", 7)], "doc_id long, text string, n_chars long")
    out = redact(docs, model)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "é [EMAIL], [IP]!", 16), (2, None, None), (3, "nothing", 7), (3, "nothing", 7)], key=str)
    empty = docs.where("false")
    assert redact(empty, train(empty)).count() == 0
