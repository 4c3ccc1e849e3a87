import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skylattice.llm.best_fit_packing import WordIds, best_two_fit, pack_documents

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
WORDS = WordIds(FILE)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("theAN ing\n\té日ßİΣ.,'s0<|>endoftext|̈ \x1c\x85"), max_size=60))
def test_word_ids_equal_the_tokenizer(text):
    assert np.frombuffer(WORDS.of(text), dtype="<u4").tolist() == ids(text)


def test_special_tokens_in_texts():
    for text in ("a <|endoftext|> b", "A<|ENDOFTEXT|>b", "x<|startoftext|>y"):
        assert np.frombuffer(WORDS.of(text), dtype="<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins_are_gapless_and_within_capacity(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins, offsets = best_two_fit(lengths, 40)
    rows = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        rows[b].append((o, n))
    assert sorted(rows) == list(range(len(rows)))
    for parts in rows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 40
    least = -(-int(lengths.sum()) // 40)
    assert least <= len(rows) <= max(least, 1.23 * least + 2)


def test_the_smallest_gives_way_to_two_that_fit_better():
    bins, _ = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_sequences_are_nearly_full():
    lengths = np.minimum(4096, np.random.default_rng(3).lognormal(6.5, 1.2, 20_000).astype(np.int64) + 1)
    bins, _ = best_two_fit(lengths, 4096)
    assert bins.max() + 1 <= -(-int(lengths.sum()) // 4096) + 2


def test_rows(spark):
    long = "word " * 9000
    rows = [(1, None), (2, ""), (3, "A few words."), (3, "A few words."), (4, long), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS piece", "0 AS length")
    got = pack_documents(docs, FILE, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id, r.start].append((r.piece, np.frombuffer(r.ids, dtype="<u4").tolist()))
    assert pieces[1, 0] == pieces[2, 0] == [(0, [1])]
    assert pieces[3, 0] == [(0, ids("A few words.") + [1])] * 2
    assert [len(pieces[4, s][0][1]) for s in (0, 4096, 8192)] == [4096, 4096, 9001 - 8192]
    assert sum((pieces[4, s][0][1] for s in (0, 4096, 8192)), []) == ids(long) + [1]
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert len(at) == 3 and max(at.values()) <= 4096
    assert pack_documents(docs.where("false"), FILE).count() == 0


def test_other_vocabularies_are_encoded_whole():
    other = public_tokenizers.path("byte_bpe_50k.json")
    words, library = WordIds(other), Tokenizer.from_file(other)
    for text in ("The quick, brown fox.", "  two  spaces\n\nlines\t", "<|endoftext|> end", "Größe 日本 don't"):
        assert np.frombuffer(words.of(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
