import numpy as np
import xxhash

from hanlens.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """(doc_id, fp) pairs to the smallest doc_id reachable, null last."""
    n = len(prints)
    of = list(range(n))
    for _ in range(n):
        before = of[:]
        for a in range(n):
            for b in range(n):
                if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                    of[a] = of[b] = min(of[a], of[b])
        if of == before:
            break
    ids = {}
    for k, (d, _) in enumerate(prints):
        if d is not None:
            ids[of[k]] = min(ids.get(of[k], d), d)
    return [ids.get(o) for o in of]


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    for word in rng.integers(0, 1 << 23, 200, dtype=np.uint32):
        syndrome = simhash._HEADS[word >> 11] ^ (word & 0x7FF)
        error = int(simhash._ERRORS[syndrome])
        fixed = int(word) ^ error
        assert error.bit_count() <= 3
        assert simhash._HEADS[fixed >> 11] == fixed & 0x7FF


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        filed, _, _, _ = simhash.fuzzy_keys(np.array([a]))
        _, _, looked, _ = simhash.fuzzy_keys(np.array([b]))
        assert set(filed) & set(looked)


def test_dense_groups_keep_every_link():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = {int(centre)}
    for _ in range(700):
        x = int(rng.choice(list(fps))) if rng.random() < 0.5 else int(centre)
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    dense = simhash.Forest(len(fps))
    simhash.link_dense(dense, fps, np.arange(len(fps)))
    want = simhash.Forest(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want.unite(a, b)
    assert (dense.classes() == want.classes()).all()


def test_report_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    got = {r.doc_id: r for r in simhash.simhash_report(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[d].fingerprint == f"{fp:016x}" for d, fp in prints)
    assert [got[d].component_id for d, _ in prints] == brute_components(prints)


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "y"), (None, "One two", "z"), (5, "one TWO", None), (6, "one", "z"), (6, "one", "z"), (7, long, "l"), (8, long + " end", "l"), (None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = [(d, brute_fingerprint(t)) for d, t, _ in rows]
    want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(prints, brute_components(prints))), key=str)
    assert sorted(map(tuple, simhash.simhash_report(docs).collect()), key=str) == want
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect())) == [1, 5, 6, 7]
    assert simhash.simhash_report(docs.limit(0)).count() == 0
    assert simhash.near_dedup(docs.limit(0)).count() == 0
