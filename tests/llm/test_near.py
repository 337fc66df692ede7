"""Near-duplicate groups against all pairs of five-word sets."""

import re

import corpus_pipeline
from graphloom.llm import near

SF = "/root/testdata/sf0.001"


def brute_components(rows):
    """doc_id: the least doc_id that pairs of Jaccard's index 0.8 or more reach."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, x in enumerate(sets):
        for m in range(k):
            y = sets[m]
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(rows[k][0]), find(rows[m][0])))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def test_stage_finds_all_near_copies(spark):
    """Copies whose fingerprints differ in more than three bits, such as 1 and 177 here, are one document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert want[177] == 1 and want[145] == 6
    assert {r.doc_id: r.component_id for r in near.near_groups(docs).collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns


def test_groups_whose_ends_are_not_alike(spark):
    """Chains, in which the least and greatest of a key do not link all, and texts of few or no words."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 40])) for i in range(0, 20, 2)] + [(100, "a b"), (101, "A  b"), (102, None), (103, " "), (104, "a b c")]
    rows += [(200 + i, " ".join([*words[:40], f"x{i}", f"y{i}"])) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.near_groups(df).collect()} == brute_components(rows)
    assert near.near_groups(df.limit(0)).count() == 0


def test_keys_that_no_end_connects(spark, monkeypatch):
    """Alike pairs that share a key only with unlike ends, in tiles of one part and of several, short sets and long."""
    monkeypatch.setattr(near, "HOT_TEXTS", 3)
    monkeypatch.setattr(near.dealt, "__defaults__", (4, False))
    rows, k = [], 0
    for n in (12, 70):
        common = [f"c{n}-{i}" for i in range(n)]
        for g in range(6):
            own = [f"g{n}-{g}-{i}" for i in range(n)]
            for copy in range(3):
                rows.append((k, " ".join(common + own + ([f"e{k}"] if copy else []))))
                k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert len(set(want.values())) == 12
    assert {r.doc_id: r.component_id for r in near.near_groups(df).collect()} == want
