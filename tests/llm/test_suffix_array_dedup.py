import random
from collections import defaultdict

from skylattice.llm.suffix_array_dedup import LENGTH, NO_ID, repeated_passages, suffix_dedup


def brute(rows):
    """Spans of repeated words and of those that are no first occurrence, from the definition."""
    places = defaultdict(set)
    for doc, text in rows:
        words = text.split(" ") if text else []
        for i in range(len(words) - LENGTH + 1):
            places[tuple(words[i : i + LENGTH])].add((NO_ID if doc is None else doc, i))
    covered = defaultdict(set), defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for doc, i in found:
                covered[0][doc].update(range(i, i + LENGTH))
                if (doc, i) != min(found):
                    covered[1][doc].update(range(i, i + LENGTH))

    def runs(by):
        out = []
        for doc, at in by.items():
            for i in sorted(at):
                if i - 1 not in at:
                    out.append([doc, i, i])
                out[-1][2] = i + 1
        return sorted(map(tuple, out))

    return runs(covered[0]), runs(covered[1])


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    shared = [words(n) for n in (49, 50, 51, 73, 130, 400)]
    rows = []
    for doc in range(60):
        text = words(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            a = rng.randint(0, 20)
            text += passage[a:] if rng.random() < 0.5 else passage
            text += words(rng.randint(0, 80))
        rows.append((doc, " ".join(text)))
    base = words(600)
    for doc in range(60, 80):
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(600)] = "edit"
        rows.append((doc, " ".join(copy)))
    rows += [(80, " ".join(["same"] * 300)), (81, " ".join(words(10) * 12)), (82, None), (83, ""), (84, "few words"), (None, " ".join(base)), (60, rows[60][1])]
    return rows


def test_passages_equal_brute_force_on_both_paths(spark):
    for seed, limit in ((1, 20_000), (2, 0), (3, 5)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS start", "1 AS anchor")
        got = repeated_passages(docs, suffixes_per_anchor=limit).collect()
        repeated, later = brute(rows)
        ids = [NO_ID if r.doc_id is None else r.doc_id for r in got]
        assert sorted((i, r.start, r.end) for i, r in zip(ids, got)) == repeated
        assert sorted((i, c.start, c.end) for i, r in zip(ids, got) for c in r.cut) == later


def test_cut_keeps_first_occurrences_and_all_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"début {passage}\nend", 9), (2, f"x  {passage} y", 9), (3, passage, 9), (4, None, None), (5, "short", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = suffix_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, rows[0][1], 9), (2, "x  y", 4), (3, "", 0), (4, None, None), (5, "short", 5)]
    assert repeated_passages(docs.where("false")).count() == 0 and suffix_dedup(docs.where("false")).count() == 0


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, passage), (2, "short text here"), (2, f"{passage} and more"), (None, passage), (None, None), (None, "another text"), (3, "x " + passage), (3, "x " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS tag", "'b' AS words", "7 AS id")
    out = suffix_dedup(docs).collect()
    assert len(out) == len(rows) and all((r.tag, r.words, r.id) == ("a", "b", 7) for r in out)
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted(
        [("1", passage), ("2", ""), ("2", "short text here"), ("2", "and more"), ("None", ""), ("None", "None"), ("None", "another text"), ("3", "x "), ("3", "x ")]
    )


def test_very_long_text(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[50_000:50_060]))], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.end, len(r.cut)) for r in repeated_passages(docs).orderBy("doc_id", "start").collect()] == [(1, 0, 19_997, 0), (1, 50_000, 50_060, 0), (1, 100_003, 120_000, 1), (2, 0, 60, 1)]
