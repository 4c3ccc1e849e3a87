"""The pipeline on a small corpus with planted cases, stage by stage against brute force."""

import importlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import test_pii_weak_supervision as pii
import test_quality_rules as quality
import test_simhash_near_dedup as near
import test_suffix_array_dedup as suffix

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def corpus():
    rng = random.Random(11)
    syllables = "the of and tion ing er ha re in on at en es or ti th ly an nd st".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def prose(n):
        return " ".join(word() for _ in range(n))

    passage = prose(80)
    rows = [(i, prose(rng.randint(60, 300))) for i in range(40)]
    rows += [(100 + i, f"{prose(70)}\n{passage}\n{prose(90)}") for i in range(5)]
    rows += [(200, rows[3][1]), (201, " ".join(w.upper() if k % 10 == 0 else w for k, w in enumerate(rows[3][1].split()))), (202, rows[4][1])]  # copies, one with capitals
    rows += [(300, "too short"), (301, None), (302, " ".join(f"{word()}###" for _ in range(80))), (303, "again and again " * 40)]
    rows += [(400, f"{prose(60)} write to some.one@mail.example.com or 10.20.30.40 {prose(60)}"), (401, f"{prose(50)} 4111 1111 1111 1111 or +1 (212) 555-7713 {prose(50)}")]
    rows += [(500, prose(6000))]
    rows += [(600 + i, prose(rng.randint(100, 120))) for i in range(40)]  # what junk of that length is compared with
    return [(i, t, "en", "src", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    pipeline = importlib.import_module("corpus_pipeline")
    where = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS fp", "1 AS kept")
    docs.write.parquet(str(where / "documents.parquet"))
    docs, out = spark.read.parquet(str(where / "documents.parquet")), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(where)).write.parquet(str(where / str(k)))
        docs = spark.read.parquet(str(where / str(k)))
        out.append([r.asDict() for r in docs.collect()])
    whole = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pipeline.run(spark, str(where)).collect())
    return out, whole


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality_stage_drops_junk_and_keeps_prose(stages):
    got = texts(stages[0][0])
    reasons = quality.brute_reasons([(i, t or "", lang) for i, t, lang, *_ in corpus()], 30)
    assert set(got) == {i for i, why in reasons.items() if why is None} and {i for i, why in reasons.items() if why} == {300, 301, 302, 303}
    assert reasons[302] in quality.FENCES and {reasons[i] for i in (300, 301, 303)} == {"base"}
    assert all(set(r) == {"doc_id", "text", "lang", "source", "n_chars"} for part in stages[0][:4] for r in part)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[0][0]), texts(stages[0][1])
    prints = {i: near.brute_simhash(t) for i, t in before.items()}
    root = near.brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert set(after) == set(root.values()) and {200, 201, 202}.isdisjoint(after)


def test_later_passages_are_cut(stages):
    before, after = texts(stages[0][1]), texts(stages[0][2])
    words = {i: t.split() for i, t in before.items()}
    _, later = suffix.brute([(i, " ".join(w)) for i, w in words.items()])
    cut = defaultdict(set)
    for doc, a, b in later:
        cut[doc].update(range(a, b))
    assert {i: t.split() for i, t in after.items()} == {i: [w for k, w in enumerate(ws) if k not in cut[i]] for i, ws in words.items()}
    assert {i for i, at in cut.items() if at} == {101, 102, 103, 104}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[0][2])


def test_private_data_is_replaced(stages):
    before, after = texts(stages[0][2]), texts(stages[0][3])
    for i, t in before.items():
        spans = [x.split(":") for x in pii.brute(t)]
        for kind, a, b in reversed(spans):
            t = f"{t[: int(a)]}[{kind.upper()}]{t[int(b) :]}"
        assert after[i] == t
    assert "[EMAIL]" in after[400] and "[IP]" in after[400] and "[CARD]" in after[401] and "[PHONE]" in after[401]


def test_sequences_hold_all_tokens(stages):
    before, after = texts(stages[0][3]), stages[0][4]
    by = defaultdict(list)
    for r in after:
        by[r["doc_id"]].append(r)
    assert set(by) == set(before)
    for i, t in before.items():
        ids = np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, 4096 * k, len(part), zlib.crc32(part.tobytes()))
    at = defaultdict(int)
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096 and len(at) <= -(-sum(at.values()) // 4096) + 1
    assert stages[1] == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in after)


def test_sequences_can_be_trained_on(stages):
    """The ids of a document's pieces, put together, are those of the text that the stage before has left, and decode to it."""
    before, by = texts(stages[0][3]), defaultdict(list)
    for r in stages[0][4]:
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by[r["doc_id"]].append((r["piece"], ids))
    for i, t in before.items():
        ids = np.concatenate([x for _, x in sorted(by[i], key=lambda x: x[0])]).tolist()
        assert ids == [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1]
        assert "".join(TOKENIZER.decode(ids[:-1]).replace("</w>", " ").split()) == "".join(t.lower().split())


def test_repeated_and_null_ids_null_and_very_long_texts_pass_every_stage(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(12)

    syllables = "the of and tion ing er ha re in on at en es or ti th ly an nd st".split()

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n))

    passage = prose(60)
    rows = [(1, passage), (2, f"{passage} {prose(400)}"), (2, prose(30)), (2, "short text"), (None, prose(40)), (None, f"{prose(300)} {passage}"), (None, None), (3, ""), (4, prose(50)), (4, rows_text := prose(70)), (4, rows_text)]
    rows += [(5, prose(200_000)), (6, f"mail me@x.org {prose(45)}"), (6, f"mail me@x.org {prose(45)}")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r for r in rows if r[1] and len(r[1].split()) >= 20]
    after = [sorted((str(r.doc_id), r.text) for r in pipeline.quality(spark, docs, "").collect())]
    assert after[0] == sorted((str(i), t) for i, t in kept)
    docs.write.parquet(str(tmp_path / "0"))
    once = [r for k, r in enumerate(kept) if r not in kept[:k]]
    deduped = pipeline.near_dedup(spark, pipeline.quality(spark, spark.read.parquet(str(tmp_path / "0")), ""), "")
    assert sorted((str(r.doc_id), r.text) for r in deduped.collect()) == sorted((str(i), t) for i, t in once)
    cut = pipeline.passage_dedup(spark, deduped, "")
    want = sorted((str(i), t if i == 1 else t.replace(passage, "").strip()) for i, t in once)
    assert sorted((str(r.doc_id), r.text.strip()) for r in cut.collect()) == want
    clean = pipeline.private_data(spark, cut, "")
    assert sorted((str(r.doc_id), r.text.strip()) for r in clean.collect()) == sorted((i, t.replace("me@x.org", "[EMAIL]")) for i, t in want)
    pieces = pipeline.packing(spark, clean, "").collect()
    assert sum(r.length for r in pieces) == sum(len(TOKENIZER.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect())


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    docs = empty
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0
