import random

from corpus_pipeline import near_dedup


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_finds_pairs_of_similarity_08(spark):
    r = random.Random(13)
    words = [f"n{i}" for i in range(4000)]
    rows, near = [], set()
    for i in range(200):
        a = [r.choice(words) for _ in range(300)]
        b = list(a)
        for _ in range(r.choice([3, 5, 6, 30])):
            b[r.randrange(300)] = r.choice(words)
        x, y = " ".join(a), " ".join(b)
        s, t = shingles(x), shingles(y)
        if len(s & t) >= 0.8 * len(s | t):
            near.add(2 * i + 1)
        rows += [(2 * i, x), (2 * i + 1, y)]
    rows += [(500, None), (501, " "), (502, "a b"), (503, "A  b"), (None, "c"), (504, "d")]
    kept = [q["doc_id"] for q in near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert len(near) > 80 and len(kept) == len(set(kept))
    assert {i for i, _ in rows} - set(kept) == near | {501, 503}
