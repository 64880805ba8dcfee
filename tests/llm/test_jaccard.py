import random

from lexloom.llm import ngram_jaccard as J


def brute(rows, n, pct):
    sets = []
    for _, t in rows:
        ws = (t or "").encode().split()
        sets.append({tuple(ws)} if 0 < len(ws) < n else {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= pct * (len(sets[i]) + len(sets[j]) - k):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def family(rng, base, edits):
    words = list(base)
    for _ in range(rng.randrange(edits)):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"e{rng.randrange(60)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"e{rng.randrange(60)}")
    return " ".join(words)


def check(spark, rows, n, pct):
    df = spark.createDataFrame(rows, "doc_id long, text string, class long").repartition(3)
    got = sorted((tuple(r) for r in J.ngram_jaccard_join(df, n, pct).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute([(a, b) for a, b, _ in rows], n, pct)


def test_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 2)
    rng = random.Random(4)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(70)]
        rows += [(len(rows) + k, family(rng, base, 9), None) for k in range(40)]
    shared = [f"s{k}" for k in range(25)]
    rows += [(len(rows) + k, " ".join(shared + [f"x{rng.randrange(400)}" for _ in range(30)]), None) for k in range(25)]
    rows += [(900, None, None), (901, "", None), (902, "one two", None), (903, "one two", None), (None, "lonely text of some words here", None)]
    check(spark, rows, 3, 90)
    # A second dense group inside a family, and copies of very different lengths.
    twin = [f"g0w{k}" if k % 10 else f"t{k}" for k in range(70)]
    rows += [(1000 + k, family(rng, twin, 9), None) for k in range(30)]
    rows += [(1100 + k, " ".join(f"g1w{i}" for i in range(40 + k)), None) for k in range(30)]
    check(spark, rows, 3, 90)
    check(spark, rows, 3, 80)
    monkeypatch.setattr(J, "SMALL", 32)
    check(spark, rows, 5, 80)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.ngram_jaccard_join(df).collect() == []


def test_every_signature_finds_each_link():
    import numpy as np

    rng = np.random.default_rng(5)
    sketch = np.ones(1 << J.SKETCH_BITS, np.uint8)
    for pct in (80, 90):
        for repeated in (0.01, 0.9):
            join = J.Join(3, pct, False, repeated)
            for _ in range(300):
                size = int(rng.integers(1, 300))
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
                drop = int(rng.integers(0, 1 + (100 - pct) * len(a) // 100))
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)])) if drop < len(a) else a
                both = len(np.intersect1d(a, b))
                if 100 * both >= pct * (len(a) + len(b) - both):
                    assert len(np.intersect1d(join.keys(a, sketch), join.keys(b, sketch)))


def test_a_block_keeps_whose_its_keys_are_and_not_the_keys():
    """What is shared comes back from the buckets, so that a block's own state is a fraction of its keys."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from lexloom.llm.blocks import SENT, by_bucket, pack_sorted, rows_of, schema_of
    from lexloom.llm.ngram_jaccard import KEY_BITS, keep_keys, shared_keys
    from lexloom.llm.repeats import answer

    rng = np.random.default_rng(1)
    blocks = [[np.unique(rng.integers(0, 3000, rng.integers(0, 40)).astype(np.uint64) << np.uint64(36)) for _ in range(n)] for n in (0, 1, 5, 30)]
    held = Counter(k for sets in blocks for s in sets for k in s.tolist())
    for buckets in (1, 7):
        kept = [keep_keys(sets) for sets in blocks]
        sent = [(k, b, 1, pack_sorted(values[x:y])) for b, (values, _) in enumerate(kept) for k, x, y in by_bucket(values, buckets, KEY_BITS)]
        told = [r for k in sorted({r[0] for r in sent}) for r in answer((pa.scalar(k), pa.scalar(1)), rows_of(schema_of(SENT), [r for r in sent if r[0] == k])).to_pylist()]
        for b, sets in enumerate(blocks):
            got = shared_keys(kept[b][1], [r["data"] for r in told if r["block"] == b], len(sets))
            assert [g.tolist() for g in got] == [[k for k in s.tolist() if held[k] > 1] for s in sets]
    many = [np.unique(rng.integers(0, 1 << KEY_BITS, 500).astype(np.uint64)) for _ in range(1000)]
    assert len(keep_keys(many)[1]) < 2 * sum(map(len, many))  # the keys have six bytes each
