import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylattice.llm.components import connected_components
from skylattice.llm.simhash_near_dedup import fingerprint_links, near_dedup, near_duplicates, simhash, similar_components


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB \n\t\x1cé日\xa0"), max_size=80))
def test_simhash_equals_brute_force(text):
    assert simhash(text) == brute_simhash(text)


def test_links_join_all_within_three_bits(spark):
    rng = random.Random(5)
    found = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    found = {x - (1 << 64) if x >> 63 else x for x in found}
    for block in (2048, 7):
        table = spark.createDataFrame([(x,) for x in found], "fp long")
        links = fingerprint_links(table, block=block)
        got = {r.node: r.root for r in connected_components(links).collect()}
        want = brute_components(found, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
        assert {n: got.get(n, n) for n in found} == want


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1200)) and got[5000] == 5000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(500)]
    base = " ".join(rng.choice(words, 4000))
    near = base.split()
    near[150] = "changed"
    other = " ".join(rng.choice(words, 300))
    rows = [(9, base), (4, " ".join(near)), (7, base.upper()), (1, other), (3, None), (2, ""), (8, "one two"), (8, "one two"), (6, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "'y' AS component_id")
    got = near_duplicates(docs).collect()
    prints = {i: simhash(t) for i, t in rows}
    want = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", want[i]) for i, _ in rows)
    assert want[9] == want[4] == want[7] == 4 and want[3] == 2
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near_duplicates(docs.where("false")).count() == 0


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_finds_edited_copies_at_five_words_and_keeps_others(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = rng.choices(words, k=rng.randint(120, 400))
        edited = list(base)
        for _ in range(rng.randint(1, len(base) // 25)):
            edited[rng.randrange(len(base))] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
    sets = {i: brute_shingles(t) for i, t in rows}
    want = brute_components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    pairs = sum(want[2 * k + 1] == 2 * k for k in range(60))
    assert 10 < pairs < 60
    got = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = got - set(want.values())
    assert set(want.values()) <= got and len(missed) <= pairs // 20


def test_rows_with_null_or_repeated_ids_are_members_like_any_other(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (3, d), (7, c), (None, d)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(True, 0, a), (True, 0, b), (False, 5, c), (False, 3, d)])


def test_blocks_of_large_groups_lose_no_link(spark):
    """Chains that drift away from their star, one template with small changes, and any size of the blocks."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(3):
        text = rng.choices(words, k=150)
        for k in range(30):
            text = list(text)
            text[(5 * k) % 150] = f"drift{rng.randrange(10**6)}"
            texts.append(" ".join(text))
    template = rng.choices(words, k=150)
    texts += [" ".join([*template, f"end{k}"]) for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text", F.struct("doc_id").alias("row"))
    found = {}
    for block in (128, 8, 3):
        got = similar_components(docs, text="text", row="row", block=block).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.root, set()).add(r.first.doc_id)
        found[block] = sorted(map(sorted, groups.values()))
    assert found[8] == found[128] == found[3] and list(range(90, 170)) in found[3]
    assert sum(len(g) > 10 for g in found[3]) >= 4


def test_nothing_that_grows_with_the_table_is_broadcast(spark, monkeypatch):
    from skylattice.llm import components, simhash_near_dedup

    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint()

    for module in (components, simhash_near_dedup):
        monkeypatch.setattr(module, "persisted", planned)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        planned(near_duplicates(spark.range(9).selectExpr("id AS doc_id", "'t' || id % 3 AS text")))
        planned(fingerprint_links(spark.range(9).selectExpr("id AS fp")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)


def test_stage_finds_candidates_by_fingerprints(spark, monkeypatch):
    """Without any band, texts whose fingerprints differ by at most three bits are still found, and verified."""
    from skylattice.llm import simhash_near_dedup

    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(3000)]
    near = list(base)
    near[700] = "changed"
    texts = [" ".join(base), " ".join(near), " ".join(rng.choices(base, k=300)), "", "\n", None]
    assert (simhash(texts[0]) ^ simhash(texts[1])).bit_count() <= 3
    monkeypatch.setattr(simhash_near_dedup, "band_keys", lambda hashes: [])
    got = near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {0, 2, 3}
    assert {r.doc_id for r in got.collect()} == want
