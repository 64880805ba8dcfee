"""Every stage of the pipeline and the whole of it against brute force, with clashing columns, nulls, repeats and long texts."""

import random
import re

import pytest

import corpus_pipeline as C
from lexloom.llm import best_fit_packing, secret_scans

#: Names that operators use inside, and others that need quoting.
CLASHES = {"n_words": 1, "n_removed": 2, "n_spans": 3, "kept_text": "k", "kept_sha256": "s", "_key": 4, "_text": "t", "_row": 5, "row": 6, "doc": "d", "_carried": "c", "class": 7, "component_id": 8, "a.b": 9, "piece": 10}


def words(n, rng, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus():
    rng = random.Random(11)
    rows = [(i, " ".join(words(rng.randrange(60, 160), rng)) + ".") for i in range(60)]
    passage = " ".join(words(50, rng))
    for i in range(60, 75):
        rows.append((i, " ".join([*words(60, rng), passage, *words(60, rng)]) + "."))
    for i in range(75, 85):  # near copies of documents 0 to 9
        w = rows[i - 75][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(85, rows[20][1]), (85, rows[20][1]), (None, rows[21][1]), (86, None), (87, ""), (88, " \n "), (89, "Menu\nHome\n" + rows[30][1]), (90, "token=abcdef12 " + " ".join(words(80, rng)) + ".")]
    rows.append((91, " ".join(words(30_000, rng, 20_000)) + "."))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASHES.items())).repartition(3)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_quality_stage(spark, docs):
    out = C.quality_stage(spark, docs, "")
    assert out.columns == docs.columns
    want = []
    for i, t in corpus():
        w = (t or "").split()
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {x for x in windows if windows.count(x) > 1} if len(w) < 1000 else set()
        n = len({k + j for k, x in enumerate(windows) if x in again for j in range(3)})
        if len(w) < 50 or 2 * n > len(w):
            continue
        want.append((i, "\n".join(x for x in t.split("\n") if len(x.split()) > 2)))
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(r[k] == v for r in got for k, v in CLASHES.items())


def brute_near(rows):
    """One row of each group of texts with 5-word shingles of similarity 0.8 and more: that with the least id, null last."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    best = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0)
        if label[k] not in best or key < best[label[k]][0]:
            best[label[k]] = (key, (i, t))
    return sorted((x for _, x in best.values()), key=str)


def test_near_duplicates_stage(spark, docs):
    out = C.near_duplicates_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == brute_near(corpus())
    assert all(r[k] == v for r in got for k, v in CLASHES.items())


def brute_windows(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = (t or "").split()
        covered = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                covered[k : k + 20] = [True] * 20
            seen.add(x)
        out.append((i, " ".join(x for x, c in zip(w, covered) if not c)))
    return sorted(out, key=str)


def test_substrings_stage(spark, docs):
    out = C.substrings_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(((r["doc_id"], " ".join(r["text"].split())) for r in got), key=str) == brute_windows(corpus())
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(r[k] == v for r in got for k, v in CLASHES.items())


def test_secrets_stage(spark, docs):
    out = C.secrets_stage(spark, docs, "")
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and out.count() == len(corpus())
    assert got[90]["text"].startswith("[SECRET] w") and got[90]["n_chars"] == len(got[90]["text"])
    plain = {i: t for i, t in corpus() if i not in (None, 85, 90)}
    assert all(got[i]["text"] == (t or "") for i, t in plain.items())
    assert all(got[90][k] == v for k, v in CLASHES.items())


def test_packing_stage_and_empty_tables(spark, docs):
    rows = C.packing_stage(spark, docs, "").collect()
    place = {}
    for r in rows:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in place.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    encoder = best_fit_packing.word_ids(best_fit_packing.default_path())
    lengths = [len(x) // 4 for x in encoder([t or "" for _, t in corpus()])]
    pieces = sorted((p for n in lengths for p in [2048] * (n // 2048) + ([n % 2048] if n % 2048 else [])), reverse=True)
    room = []
    for p in pieces:  # best fit decreasing
        fits = [k for k, x in enumerate(room) if x >= p]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= p
        else:
            room.append(2048 - p)
    assert len(place) == len(room) and sorted(r["length"] for r in rows) == sorted(pieces)
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_run_is_its_stages(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = C.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t in corpus() if len((t or "").split()) >= 50]
    kept = [(i, "\n".join(x for x in t.split("\n") if len(x.split()) > 2)) for i, t in kept]
    left = brute_windows(brute_near(kept))
    masked = {}
    for i, t in left:
        base, added, _ = secret_scans.find_secrets(t)
        masked[i] = re.sub(r"token=\S+", "[SECRET]", t)
        assert added == [] and (base != []) == (masked[i] != t)
    assert {r["doc_id"] for r in rows} == set(masked)
    encoder = best_fit_packing.word_ids(best_fit_packing.default_path())
    total = {i: len(encoder([t])[0]) // 4 for i, t in masked.items()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total
