import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm.sentencepiece_viterbi import CHUNK, Codec, StreamingViterbi, sentencepiece_decode, sentencepiece_digest, sentencepiece_encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = Codec(MODEL)


def ids(text):
    return np.frombuffer(CODEC.encode(text), dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("theand ing\n\té日ß▁.,0x😀AN"), max_size=60))
def test_ids_equal_the_library(text):
    assert ids(text) == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("thean  g\né▁."), max_size=80), st.integers(1, 9))
def test_chunks_make_no_difference(text, size):
    marked = "▁" + text.replace(" ", "▁")
    assert CODEC.packed(list(CODEC.viterbi.segment(marked, size))) == (CODEC.encode(text) if text else CODEC.packed(["▁"]))


def test_documents_are_committed_as_they_stream():
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    fresh = Codec(MODEL)
    assert all(np.frombuffer(fresh.encode(t), dtype="<u4").tolist() == LIBRARY.encode(t) for t in texts)
    assert fresh.viterbi.commits > 1000 and fresh.viterbi.most_pending <= 4 * fresh.viterbi.longest + CHUNK
    state, held = fresh.start, []
    for chunk in fresh.chunks("▁" + texts[0].replace(" ", "▁")):
        _, state = fresh.step(state, chunk)
        held.append(len(state.text))
    assert max(held) <= fresh.viterbi.longest and held.count(1) > len(held) // 2


def test_models_with_other_rules_are_refused(tmp_path):
    proto = LIBRARY.serialized_model_proto()
    # the normaliser's settings: (remove extra spaces, off) becomes on
    at = proto.rindex(b"\x20\x00", 0, proto.rindex(b"identity") + 20)
    (tmp_path / "other.model").write_bytes(proto[:at] + b"\x20\x01" + proto[at + 2 :])
    with pytest.raises(ValueError, match="normaliser"):
        Codec(str(tmp_path / "other.model"))


def test_long_stretches_are_streamed():
    text = "theinghand" * 3000 + " " * 500 + "a" * 5000
    assert ids(text) == LIBRARY.encode(text)
    assert 0 < CODEC.viterbi.most_pending < 50 * CODEC.viterbi.longest


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=9), st.randoms(use_true_random=False))
def test_unigram_equals_brute_force(text, random):
    vocabulary = {"".join(p): -random.random() for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)}
    search = StreamingViterbi({p: i for i, p in enumerate(vocabulary)}, vocabulary, "unigram")
    worst = search.unknown_score

    def value(parts):
        return sum(vocabulary.get(p, worst) for p in parts)

    every = []
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, last = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(text[last:i])
                last = i
        parts.append(text[last:])
        if all(p in vocabulary or len(p) == 1 for p in parts):
            every.append(value(parts))
    got = list(search.segment(text))
    assert "".join(got) == text and abs(value(got) - max(every)) < 1e-9


def test_unigram_stream_equals_whole_trellis():
    rng = np.random.default_rng(7)
    vocabulary = {"".join(p): -float(rng.random()) * len(p) for n in (1, 2, 3, 4) for p in itertools.product("ab", repeat=n)}
    text = "".join(rng.choice(list("ab"), 4000))
    search = StreamingViterbi({p: i for i, p in enumerate(vocabulary)}, vocabulary, "unigram")
    best = [0.0]
    for i in range(1, len(text) + 1):
        best.append(max(best[j] + vocabulary[text[j:i]] for j in range(max(0, i - 4), i)))
    parts = list(search.segment(text))
    assert "".join(parts) == text and abs(sum(vocabulary[p] for p in parts) - best[-1]) < 1e-6
    assert 0 < search.most_pending < 2000


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "  Hello  wörld\nfoo\t日本 "), (3, "  Hello  wörld\nfoo\t日本 "), (4, "the " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "7 AS n_ids")
    encoded = sentencepiece_encode(docs, MODEL)
    assert sorted((r.doc_id, r.ids) for r in encoded.collect() if r.ids is not None) == sorted((i, LIBRARY.encode(t)) for i, t in rows if t is not None)
    assert sorted((r.doc_id, r.text or "") for r in sentencepiece_decode(encoded, MODEL).collect()) == sorted((i, t or "") for i, t in rows)
    got = sorted(tuple(r) for r in sentencepiece_digest(docs, MODEL).collect())
    assert got == sorted((i, len(x := LIBRARY.encode(t or "")), zlib.crc32(np.array(x, dtype="<u4").tobytes()), True) for i, t in rows)
    assert sentencepiece_digest(docs.where("false"), MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(p for p in CODEC.viterbi.pieces if len(p) < 9)[::7]), min_size=2, max_size=2))
def test_pairs_fit_as_merging_says_without_merging_to_the_end(pair):
    use = CODEC.viterbi
    assert use.fits(*pair) == (use.merged("".join(pair)) == pair)
    assert not hasattr(use, "ends") and use.known[pair[0]] == use.pieces[pair[0]]


def test_a_position_costs_a_few_lines_once_its_ending_is_known():
    import sys

    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() if t][:40]
    words = sorted({"▁" + w for t in texts for w in t.split()})
    use = Codec(MODEL).viterbi
    ran = {True: 0, False: 0}

    def tracer(frame, event, _):
        ran[frame.f_code is StreamingViterbi.extend_by_pairs.__code__] += event == "line"
        return tracer

    def extend():
        for word in words:
            use.extend(word, [0], [-1])

    extend()
    before = sys.gettrace()
    sys.settrace(tracer)
    try:
        extend()
    finally:
        sys.settrace(before)
    assert len(words) > 500 and 0 < ran[True] < 10 * sum(map(len, words)), ran


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcx", max_size=30), st.lists(st.text(alphabet="abc", min_size=2, max_size=5), unique=True, max_size=12), st.integers(1, 9))
def test_pieces_equal_merging_under_any_vocabulary(text, longer, size):
    # pieces that no merge makes are among them, and x is in none
    pieces = {p: i for i, p in enumerate(["a", "b", "c", *longer])}
    search = StreamingViterbi(pieces, {p: -float(i) for p, i in pieces.items()}, "bpe")
    assert list(search.segment(text, size)) == search.merged(text)


def test_forgetting_makes_no_difference(monkeypatch):
    import skylattice.llm.sentencepiece_viterbi as module

    monkeypatch.setattr(module, "CACHE_PAIRS", 50)
    fresh, text = Codec(MODEL), "Über the inghand 日本 andthe\n" * 3 + "theinghand" * 300
    assert np.frombuffer(fresh.encode(text), dtype="<u4").tolist() == LIBRARY.encode(text)
    assert fresh.viterbi.remembered < 1000 and len(fresh.viterbi.endings) < 1000
