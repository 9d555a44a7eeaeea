"""The pipeline's stage of near copies."""

import random

import corpus_pipeline
from quillmesh.llm import near_copies
from quillmesh.llm.cells import WordHashes


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, w, n):
    w = list(w)
    for i in range(n):
        w[(i * len(w)) // n + rng.randrange(3) + 5] = f"x{rng.randrange(5000)}"
    return w


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def stage(spark, docs):
    return corpus_pipeline.drop_near_copies(spark, docs, "")


def test_stage_drops_near_copies_at_080(spark, make):
    rng = random.Random(21)
    rows, kept = [], set()
    for k in range(30):
        for base, n, edits in ((1000, 200, 2), (2000, 400, 8), (3000, 200, 6)):
            w = words(rng, n)
            c = changed(rng, w, edits)
            rows += [(base + 2 * k, " ".join(w)), (base + 2 * k + 1, " ".join(c).upper())]
            kept |= {base + 2 * k} if jaccard(w, c) >= 0.8 else {base + 2 * k, base + 2 * k + 1}
    assert len(kept) == 30 + 30 + 60
    assert {r.doc_id for r in stage(spark, make(rows, clash=False)).collect()} == kept


def test_stage_keeps_rows_with_null_or_repeated_ids(spark, make):
    rng = random.Random(22)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(None, a), (None, b), (7, c), (7, d), (9, a), (7, d), (None, None), (3, " ")]
    got = sorted((str(r.doc_id), r.text) for r in stage(spark, make(rows, clash=False)).collect())
    assert got == sorted([("9", a), ("None", b), ("7", c), ("7", d), ("3", " ")])
    assert stage(spark, make(rows, clash=False).limit(0)).count() == 0


def test_components_over_their_bound_stay_whole(make):
    rng = random.Random(23)
    chain = [words(rng, 100)]
    for i in range(39):
        w = list(chain[-1])
        w[2 * i + 10] = f"y{i}"
        chain.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)] + [(100 + i, " ".join(words(rng, 100))) for i in range(20)]
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(chain, chain[1:], strict=False)) and jaccard(chain[0], chain[-1]) < 0.5
    got = {r.doc_id for r in near_copies.representatives(make(rows), group=10).collect()}
    assert got == {0, *range(100, 120)}


def test_the_threshold_itself_is_similar():
    a = [f"a{i}" for i in range(13)]
    texts = [" ".join(w).encode() for w in (a, a[:-1] + ["z"], a[:-2] + ["z", "y"])]
    assert jaccard(a, a[:-1] + ["z"]) == 0.8 and jaccard(a, a[:-2] + ["z", "y"]) < 0.8
    assert sorted(near_copies.compared(texts[:2], WordHashes())) == [(0, 1)] and not near_copies.compared(texts[::2], WordHashes())


def test_near_fingerprints_are_candidates_without_shared_bands(spark):
    """By BK-trees within three bits, and by chains of them; equal fingerprints too."""
    fps = [(1, 0), (2, 0b111), (3, 0b111111), (4, -1), (5, -1), (6, 0x5555555555555555), (7, None)]
    nodes = spark.createDataFrame([(n, [], fp) for n, fp in fps], "node long, bands array<long>, fp long")
    assert {tuple(r) for r in near_copies.candidates(nodes).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
