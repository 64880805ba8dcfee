"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are scored by the log-odds of the toxic against the clean class under an informative Dirichlet prior that is
proportional to the tokens' counts over all documents; tokens whose log-odds aren't significant score nothing, and every
token pays a small toll, so that random text drifts down. A linear scan (all maximal scoring segments) finds every toxic
passage of a text. Scores are calibrated by the extreme-value law of maximal segment scores: lambda is the positive root of
the scores' moment equation over clean text, K is fitted on clean training rows, and a segment counts if its expected number
of chance occurrences in a text of that length is small. The best segment and the sum over all significant ones give the
document's score through a logistic curve.

Labels are learnt from at most SAMPLE labelled rows, those with the least hashes among rows whose crc32(doc_id) mod 5 isn't
0: two thirds give the log-odds, one third the calibration. Token counts of the prior cover all documents. Every token of
the sample takes part; its counts in the corpus are looked up where some prior could make its log-odds significant, so that
only such tokens come to the driver.

Defined results: null or empty text has no segments and gets the score of a text without any; repeated rows are scored each
for itself; a null doc_id isn't held out and never learnt from; labels that are null aren't used; without both labels in
the sample every score is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import common

SAMPLE = 20_000
#: Lengths in bytes of the words' beginnings that are scored beside the words; inflection leaves them as they are.
#: Weight of the prior in tokens, least |z| and log-odds of a scoring token, toll of every token.
PREFIXES = (4, 5, 6, 7)
PRIOR, MIN_Z, MIN_ODDS, TOLL = 10_000.0, 4.5, 0.7, 0.05
#: A segment counts if fewer than this many like it are expected by chance.
MAX_EXPECTED = 0.05
SPLIT = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)
SCHEMA = "doc_id long, score double, n_segments int, best_bits double, spans string"


def tokens(text: str | None) -> list[bytes]:
    """Runs without blanks and ASCII punctuation, A-Z lowered."""
    return (text or "").encode("utf-8", "replace").lower().translate(SPLIT).split()


def marks(word: bytes) -> list[bytes]:
    """What a token can be scored by: itself and its beginnings of several lengths in bytes."""
    return [word, *(b"^" + word[:k] for k in PREFIXES if k < len(word))]


class Scores(dict):
    """Token -> score: that of its mark with the greatest |z|. Remembers a bounded number of tokens."""

    def __init__(self, table: dict[bytes, tuple[float, float]]) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = max((self.table[m] for m in marks(word) if m in self.table), default=(0.0, 0.0))[1]
        return out

    def __reduce__(self):
        return Scores, (self.table,)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, from, to) in linear time.

    Each positive token opens a candidate; it joins back to the nearest earlier candidate that starts lower as long as that
    one ended lower, as prefix sums tell.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[list] = []  # from, to, prefix before, prefix after, index of the nearest earlier candidate that starts lower
    for p in positive.tolist():
        begin, end, low, high = p, p + 1, total[p], total[p + 1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= high:
                out.append([begin, end, low, high, j])
                break
            begin, low = out[j][0], out[j][2]
            del out[j:]
    return [(o[3] - o[2], o[0], o[1]) for o in out]


class Model:
    """Token scores and calibration; small enough to travel with a task."""

    def __init__(self, score: Scores, lam: float, k: float, weights: list[float], constant: float | None = None) -> None:
        self.score, self.lam, self.k, self.weights, self.constant = score, lam, k, weights, constant

    def found(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        words = tokens(text)
        s = np.fromiter(map(self.score.__getitem__, words), float, len(words)) - TOLL
        return len(s), segments(s)

    def features(self, text: str | None) -> tuple[list[float], list[tuple[float, int, int]]]:
        """Best and summed evidence in nats over chance, and the significant segments."""
        n, all_ = self.found(text)
        free = math.log(max(1, n) * self.k)
        limit = -math.log(MAX_EXPECTED)
        held = [x for x in all_ if self.lam * x[0] - free >= limit]
        best = max((self.lam * x[0] - free for x in all_), default=-free)
        return [max(-10.0, min(best, 200.0)), math.log1p(sum(self.lam * x[0] - free for x in held)), math.log1p(1000.0 * sum(b - a for _, a, b in held) / max(1, n))], held

    def __call__(self, text: str | None) -> tuple[float, list, float]:
        if self.constant is not None:
            return self.constant, [], 0.0
        f, held = self.features(text)
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], f, strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), held, f[0] / math.log(2)


def _root(values: np.ndarray, p: np.ndarray) -> float:
    """The positive solution of sum p * exp(x * values) = 1; the mean is negative."""
    lo, hi = 1e-6, 1.0
    moment = lambda x: float((p * np.exp(np.minimum(x * values, 700))).sum())
    while moment(hi) < 1 and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(mid) < 1 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Newton's method on standardised features."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - ridge * w
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + ridge * np.eye(len(w)), g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / std
    return [float(w[0] - (slopes * mean).sum()), *map(float, slopes)]


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def _count_words(wanted: frozenset[bytes] | None):
    """Per partition, by mark: lines that hold it, by class; or, for the wanted marks, occurrences (clean) with all marks' number under b""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: list[Counter] = [Counter(), Counter()]
        raw: Counter = Counter()

        def rows() -> pa.RecordBatch:
            for w, n in raw.items():
                own = marks(w)
                by[0][b""] += n * len(own)
                for m in own:
                    if m in wanted:
                        by[0][m] += n
            raw.clear()
            words = list(by[0] | by[1])
            cols = [pa.array(words, pa.binary()), pa.array([by[0][w] for w in words], pa.int64()), pa.array([by[1][w] for w in words], pa.int64())]
            by[0].clear()
            by[1].clear()
            return pa.RecordBatch.from_arrays(cols, names=["word", "clean", "toxic"])

        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if wanted is None:
                    by[toxic].update({m for w in set(tokens(t)) for m in marks(w)})
                else:
                    raw.update(tokens(t))
            if max(len(raw), len(by[0]) + len(by[1])) > 300_000:
                yield rows()
        yield rows()

    return run


COUNTS = "word binary, clean long, toxic long"


def log_odds(clean: np.ndarray, toxic: np.ndarray, alpha: np.ndarray, all_clean: float, all_toxic: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and z of tokens under priors alpha, which sum to PRIOR over all tokens."""
    odds = lambda y, n: np.log(y + alpha) - np.log(np.maximum(1e-9, n + PRIOR - y - alpha))
    delta = odds(toxic, all_toxic) - odds(clean, all_clean)
    return delta, delta / np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))


def prior(corpus: np.ndarray, total: float, n: int, clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """PRIOR tokens dealt out by the corpus counts, to none more than the sample has."""
    return np.minimum(PRIOR * (corpus + 0.5) / (total + 0.5 * n), np.maximum(0.5, clean + toxic))


def _may_score(all_clean: float, all_toxic: float):
    """Keeps the tokens that some prior would let score: z is tried over its whole range, with a margin for what lies between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, toxic = (b.column(i).to_numpy().astype(float) for i in (1, 2))
            top, best = np.maximum(0.5, clean + toxic), np.zeros(b.num_rows)
            for k in range(49):
                best = np.maximum(best, np.abs(log_odds(clean, toxic, top * 10 ** (-k / 8), all_clean, all_toxic)[1]))
            yield b.filter(pa.array(best >= 0.9 * MIN_Z))

    return run


def _values(score: Scores):
    """Scores of the clean lines' words with their number; a beginning stands for the words it scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not w.startswith(b"^"):
                    total[score[w]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array(list(total.values()), pa.int64())], names=["value", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    sample = scratch.save(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).cast("int")), "sample")
    seen = {(r["toxic"], r["fold"] == 2): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).groupBy("toxic", "fold").agg(F.sum("n").alias("n")).collect()}
    n_toxic, n_all = sum(n for (t, _), n in seen.items() if t), sum(seen.values())
    if not n_toxic or n_toxic == n_all or len(seen) < 4:
        return Model(Scores({}), 1.0, 1.0, [], constant=n_toxic / n_all if n_all else 0.0)
    learn = sample.where("fold < 2")
    # Different lines count once a class, and a word once a line: copies and bursts tell nothing new.
    lines = learn.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"), "toxic").distinct()
    counted = scratch.save(lines.mapInArrow(_count_words(None), COUNTS).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic"))), "counted")
    sums = counted.agg(F.sum("clean"), F.sum("toxic"), F.count("*")).first()
    all_clean, all_toxic, n_marks = float(sums[0] or 0), float(sums[1] or 0), sums[2]
    kept = counted.mapInArrow(_may_score(all_clean, all_toxic), COUNTS).orderBy("word").toArrow()
    words = kept["word"].to_pylist()
    clean, toxic = (kept[c].to_numpy().astype(float) for c in ("clean", "toxic"))
    wanted = frozenset(words)
    everywhere = docs.select(F.col(text).cast("string"), F.lit(0).alias("toxic")).mapInArrow(_count_words(wanted), COUNTS)
    found = {bytes(r["word"]): r["n"] for r in everywhere.groupBy("word").agg(F.sum("clean").alias("n")).collect()}  # the wanted marks and their total
    corpus = np.array([found.get(w, 0) for w in words], float)
    delta, z = log_odds(clean, toxic, prior(corpus, float(found.get(b"", 0)), n_marks, clean, toxic), all_clean, all_toxic)
    use = (np.abs(z) >= MIN_Z) & (np.abs(delta) >= MIN_ODDS)
    score = Scores({w: (abs(float(t)), float(d)) for w, d, t, u in zip(words, delta, z, use, strict=True) if u})
    # The distribution of scores over the clean lines' words.
    dealt = counted.mapInArrow(_values(score), "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).orderBy("value").collect()
    spread = Counter({r["value"] - TOLL: r["n"] for r in dealt})
    values, p = np.array(list(spread)), np.array(list(spread.values())) + 1e-9
    p /= p.sum()
    mean = float((p * values).sum())
    lam = _root(values, p) if mean < 0 and (values > 0).any() else 1.0
    model = Model(score, lam, 1.0, [])
    rest = sample.where("fold = 2").select("doc_id", "toxic", "text").orderBy("doc_id")

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.found(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([max((x[0] for x in s), default=0.0) for _, s in got], pa.float64())], names=["doc_id", "toxic", "n", "best"])

    best = rest.mapInArrow(evidence, "doc_id long, toxic int, n long, best double").toPandas().sort_values("doc_id")
    plain = best[best["toxic"] == 0]
    # Gumbel: the mean of lambda * S - ln n is ln K + Euler's constant, over texts that score at all
    model.k = float(np.exp(np.clip((lam * plain["best"] - np.log(plain["n"].clip(lower=1))).mean() - 0.5772, -20, 5))) if len(plain) else 1.0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.features(t)[0] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "toxic", "f"])

    table = rest.mapInArrow(features, "doc_id long, toxic int, f array<double>").toPandas().sort_values(["doc_id"])
    model.weights = _logistic(np.array(table["f"].tolist()), table["toxic"].to_numpy(float))
    scratch.drop()
    return model


class _Rows:
    def __init__(self, model: Model) -> None:
        self.model = model

    def __call__(self, ids: list, texts: list[str]) -> dict:
        got = list(map(self.model, texts))
        return {
            "doc_id": ids,
            "score": [g[0] for g in got],
            "n_segments": [len(g[1]) for g in got],
            "best_bits": [g[2] for g in got],
            "spans": [",".join(f"{a}:{b}" for _, a, b in g[1]) for g in got],
        }


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, and the toxic passages as ranges of tokens."""
    model = fit(docs, labels, text, key)
    out = common.map_texts(docs, _Rows(model), SCHEMA, text, key)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "best_bits", "spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
