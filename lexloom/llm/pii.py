"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside exact base patterns.

The model is trained in numpy on labelled windows of characters: windows of a bounded sample of documents (those with the
least hashes of their ids, at most SAMPLE) labelled with their base matches, half of them with further personal data put in,
some of it written as the base patterns miss it. It then tags every character of every text: texts are cut into overlapping
windows, all windows of a slice are run at once, step by step. Windows overlap by 2 * MARGIN characters. A window in which no
path can beat the one without personal data (a bound over emissions and transitions shows it) is left out. What is left is
reconciled over the whole text: neighbouring windows are joined to one chain, in which each character has the emissions of
the window from whose edge it is farther, and one Viterbi path is decoded for the chain, so that a span of any length that
crosses from window to window is decoded as one.

Predicted spans are trimmed and checked for the digits or parts that their kind must have; those that overlap a base span
are dropped, since base spans stay as they are.

Defined results: null or empty text has no spans; repeated rows are searched each for itself; a null doc_id is kept. An
empty table trains on the synthetic part alone.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_CHARS, PIECE = 600, 4_000_000, 100_000
#: Hidden units of a direction; window, margin and windows run at once; training steps and batch.
HIDDEN, WINDOW, MARGIN, BATCH = 8, 176, 12, 1024
STEPS, TRAIN_BATCH, TRAIN_WINDOW = 220, 128, 56
TAGS = 1 + len(KINDS)
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches, kind by kind."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        # The run before the mark is the leftmost start; the part before the last match's end is used up.
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    if text.isascii() and not any(map(text.__contains__, "0123456789")):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]


@lru_cache(1)
def alphabet() -> np.ndarray:
    """Code point -> input symbol: ASCII each its own, other letters, digits, blanks and the rest by class."""
    import unicodedata

    out = np.full(0x110000, 99, np.uint8)
    out[32:127] = np.arange(95)
    out[[9, 10, 11, 12, 13, 0xA0]] = 95
    for c in range(0x80, 0x3000):
        kind = unicodedata.category(chr(c))
        out[c] = 96 if kind[0] in "LM" else 97 if kind[0] == "N" else 95 if kind[0] == "Z" else 98 if kind[0] == "P" else 99
    out[0x3000:0xD800] = 96
    out[0xFF10:0xFF1A] = 97
    out[0xFF20] = ord("@") - 32
    return out


SYMBOLS = 100


class Tagger:
    """A bidirectional LSTM with CRF transitions. Gates are i, f, o, g; sigmoids are computed as tanh of half the input."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN) -> None:
        r = np.random.default_rng(seed)
        h = self.hidden = hidden
        s = lambda *d: (r.standard_normal(d) * 0.25).astype(np.float32)
        self.p = {"x": s(2, SYMBOLS, 4 * h), "h": s(2, h, 4 * h), "o": s(2 * h, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.p["x"][:, :, h : 2 * h] += 1.0
        self.p["b"][0] = 1.0

    def _direction(self, symbols: np.ndarray, d: int) -> tuple[np.ndarray, list]:
        """Hidden states [time, batch, hidden] of one direction over symbols [time, batch], with what training needs."""
        t_max, n = symbols.shape
        h, wx, wh = self.hidden, self.p["x"][d], self.p["h"][d]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.empty((t_max, n, h), np.float32)
        tape = []
        for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
            a = wx[symbols[t]] + state @ wh
            g = np.empty_like(a)
            g[:, : 3 * h] = 1 / (1 + np.exp(-np.clip(a[:, : 3 * h], -30, 30)))
            g[:, 3 * h :] = np.tanh(a[:, 3 * h :])
            tape.append((t, state, cell, g))
            cell = g[:, h : 2 * h] * cell + g[:, :h] * g[:, 3 * h :]
            state = g[:, 2 * h : 3 * h] * np.tanh(cell)
            out[t] = state
        return out, tape

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """Emissions [time, tag, batch] for symbols [time, batch], all steps in place and gates in rows.

        sigmoid(x) = (tanh(x / 2) + 1) / 2, so cells and states are carried doubled and the halves sit in the weights.
        """
        t_max, n = symbols.shape
        h = self.hidden
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), h)
        e = np.empty((t_max, TAGS, n), np.float32)
        gates, more = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        fresh = np.empty((h, n), np.float32)
        out = np.empty((TAGS, n), np.float32)
        for d in (0, 1):
            wx = np.ascontiguousarray((self.p["x"][d] * half).T)
            wh = np.ascontiguousarray((self.p["h"][d] * half * 0.5).T)
            wo = np.ascontiguousarray(self.p["o"][d * h : (d + 1) * h].T * np.float32(0.5))
            state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                np.take(wx, symbols[t], axis=1, out=gates, mode="clip")
                np.matmul(wh, state, out=more)
                gates += more
                np.tanh(gates, out=gates)
                gates[: 3 * h] += 1
                cell *= gates[h : 2 * h]
                cell *= 0.5
                np.multiply(gates[:h], gates[3 * h :], out=fresh)
                cell += fresh
                np.multiply(cell, 0.5, out=fresh)
                np.tanh(fresh, out=fresh)
                np.multiply(fresh, gates[2 * h : 3 * h], out=state)
                if d == 0:
                    np.matmul(wo, state, out=e[t])
                else:
                    np.matmul(wo, state, out=out)
                    e[t] += out
        e += self.p["b"][None, :, None]
        return e

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags [time, batch] for emissions [time, batch, tag]."""
        t_max, n, k = e.shape
        tr = self.p["t"]
        score, back = e[0], np.empty((t_max, n, k), np.int8)
        for t in range(1, t_max):
            s = score[:, :, None] + tr[None]
            back[t] = s.argmax(1)
            score = s.max(1) + e[t]
        tags = np.empty((t_max, n), np.int8)
        tags[-1] = score.argmax(1)
        for t in range(t_max - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(n), tags[t]]
        return tags

    def worth(self, e: np.ndarray) -> np.ndarray:
        """False for batches of emissions [time, tag, batch] in which no path with another tag scores more than all-O."""
        tr = self.p["t"]
        # A run of other tags gains at most its emissions over O's, a step inside for each but the first, its entry (none for a
        # run that begins the window) and its leaving. If every tag alone loses that much, so does every run.
        gain = e[:, 1:].max(1) - e[:, 0]
        enter, inside, leave = tr[0, 1:].max() - tr[0, 0], tr[1:, 1:].max() - tr[0, 0], tr[1:, 0].max() - tr[0, 0]
        ends = np.full((len(e), 1), max(0.0, enter + max(0.0, leave)))
        ends[0] = max(ends[0, 0], leave, 0.0)
        return (ends + gain + max(0.0, inside) > 0).any(0)

    # Training -----------------------------------------------------------------------------------------------------

    def gradients(self, symbols: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the gold tags and its gradients."""
        h, (t_max, n) = self.hidden, symbols.shape
        f, tape_f = self._direction(symbols, 0)
        b, tape_b = self._direction(symbols, 1)
        both = np.concatenate([f, b], 2)
        e = both @ self.p["o"] + self.p["b"]
        tr = self.p["t"]
        log_sum = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, t_max):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + tr[None], 1) + e[t]
        for t in range(t_max - 2, -1, -1):
            beta[t] = log_sum(tr[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = log_sum(alpha[-1], 1)
        rows = np.arange(n)
        right = sum(e[t, rows, gold[t]] for t in range(t_max)) + sum(tr[gold[t - 1], gold[t]] for t in range(1, t_max))
        de = np.exp(alpha + beta - z[None, :, None])
        dt = np.zeros_like(tr)
        for t in range(1, t_max):
            dt += np.exp(alpha[t - 1][:, :, None] + tr[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.subtract.at(dt, (gold[t - 1], gold[t]), 1)
        for t in range(t_max):
            de[t, rows, gold[t]] -= 1
        scale = np.float32(1 / (n * t_max))
        de *= scale
        grads = {"o": np.einsum("tnh,tnk->hk", both, de), "b": de.sum((0, 1)), "t": dt * scale, "x": np.zeros_like(self.p["x"]), "h": np.zeros_like(self.p["h"])}
        dboth = de @ self.p["o"].T
        for d, tape in ((0, tape_f), (1, tape_b)):
            wh = self.p["h"][d]
            dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, state, cell, g in reversed(tape):
                i, fg, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
                now = np.tanh(fg * cell + i * c)
                ds = dstate + dboth[t, :, d * h : (d + 1) * h]
                dc = dcell + ds * o * (1 - now * now)
                da = np.concatenate([dc * c * i * (1 - i), dc * cell * fg * (1 - fg), ds * now * o * (1 - o), dc * i * (1 - c * c)], 1)
                np.add.at(grads["x"][d], symbols[t], da)
                grads["h"][d] += state.T @ da
                dstate, dcell = da @ wh.T, dc * fg
        return float((z - right).mean()), grads

    def train(self, windows: np.ndarray, gold: np.ndarray, steps: int = STEPS, batch: int = TRAIN_BATCH, rate: float = 0.03, seed: int = 11) -> float:
        """Adam over windows [count, time]; the last loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = r.integers(0, len(windows), batch)
            loss, grads = self.gradients(windows[pick].T, gold[pick].T)
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            lr = rate * min(1.0, 1.5 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 0.5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.98 * v[k] + 0.02 * g * g
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
        return loss


def symbols_of(text: str) -> np.ndarray:
    return alphabet()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def synthetic(kind: int, r: np.random.Generator) -> str:
    """Personal data of a kind, about half of it written as the base patterns expect."""
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + int(c)) for c in r.integers(0, 26, n))
    if kind == 0:
        name = letters(int(r.integers(3, 9))) + (str(r.choice([".", "_", ""])) + digits(2)) * int(r.integers(0, 2))
        at = str(r.choice(["@", "@", "@", " [at] ", "(at)", " (at) "]))
        dot = "." if "@" in at else str(r.choice([".", " [dot] ", "(dot)"]))
        return name + at + letters(int(r.integers(3, 8))) + dot + str(r.choice(["com", "org", "net", "example" + dot + "com"]))
    if kind == 1:
        return str(r.choice([".", ".", " . "])).join(str(int(x)) for x in r.integers(1, 256, 4))
    if kind == 2:
        body = digits(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = str(r.choice(["", "", " ", "-", "."]))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return str(r.choice([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"00{digits(2)} {a} {b}{c}"]))


def labelled_windows(texts: list[str], seed: int = 3, count: int = 2400) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols with gold tags, from texts with their base spans and from synthetic insertions."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["the of and to in is on that by this with from at it be"]
    marked = [(t, base_spans(t)) for t in texts]
    with_spans = [(t, s) for t, s in marked if s]
    xs, ys = [], []
    for k in range(count):
        own = with_spans if with_spans and k % 4 == 0 else marked
        t, spans = own[int(r.integers(len(own)))]
        tags = np.zeros(len(t), np.int8)
        for kind, a, b in spans:
            tags[a:b] = kind + 1
        if k % 4 == 0 and spans:
            a = spans[int(r.integers(len(spans)))][1]
            begin = max(0, a - int(r.integers(0, TRAIN_WINDOW)))
        else:
            begin = int(r.integers(0, max(1, len(t) - TRAIN_WINDOW)))
        piece, tag = t[begin : begin + TRAIN_WINDOW], tags[begin : begin + TRAIN_WINDOW]
        if k % 4 in (1, 2):
            kind = int(r.integers(len(KINDS)))
            put = synthetic(kind, r)
            at = int(r.integers(0, len(piece) + 1))
            while 0 < at < len(piece) and not piece[at].isspace():
                at += 1
            piece = piece[:at] + " " + put + " " + piece[at + (at < len(piece)) :]
            tag = np.concatenate([tag[:at], [0], np.full(len(put), kind + 1), [0], tag[at + (at < len(tag)) :]]).astype(np.int8)
            begin = max(0, min(at - int(r.integers(0, TRAIN_WINDOW)), len(piece) - TRAIN_WINDOW))
            piece, tag = piece[begin : begin + TRAIN_WINDOW], tag[begin : begin + TRAIN_WINDOW]
        x = np.full(TRAIN_WINDOW, 95, np.uint8)
        y = np.zeros(TRAIN_WINDOW, np.int64)
        x[: len(piece)] = symbols_of(piece)
        y[: len(tag)] = tag
        xs.append(x)
        ys.append(y)
    return np.array(xs), np.array(ys)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Tagger:
    """Trains on at most SAMPLE documents, those with the least hashes of their ids and texts, and SAMPLE_CHARS characters. Of a
    text of more than PIECE characters the sample takes a piece of that length, from a place that its hash chooses."""
    whole = F.col(text).cast("string")
    mixed = F.xxhash64(F.lit("pii"), F.col(key).cast("long"), whole)
    begin = F.pmod(mixed, F.greatest(F.length(whole) - PIECE, F.lit(0)) + 1).cast("int") + 1
    # The ranks alone first: they are small, so that only the sampled texts travel.
    sizes = docs.select(mixed.alias("r"), F.least(F.length(whole), F.lit(PIECE)).alias("n")).where("n > 0").orderBy("r").limit(SAMPLE).collect()
    total, limit = 0, None
    for row in sizes:
        total += row["n"]
        if total > SAMPLE_CHARS:
            break
        limit = row["r"]
    rows = docs.where(mixed <= limit).select(mixed.alias("r"), F.substr(whole, begin, F.lit(PIECE)).alias("t")).where("length(t) > 0").orderBy("r", "t").limit(SAMPLE).collect() if limit is not None else []
    tagger = Tagger()
    tagger.train(*labelled_windows([row["t"] for row in rows]))
    return tagger


def sound(kind: int, found: str) -> bool:
    """What a predicted span must have."""
    digits = sum(c.isdecimal() for c in found)
    if kind == 0:
        low = found.lower()
        return ("@" in found or "＠" in found or " at " in low or "(at)" in low or "[at]" in low) and ("." in found or "dot" in low) and len(found) >= 6
    if kind == 1:
        return 4 <= digits <= 12 and found.count(".") == 3
    if kind == 2:
        d = "".join(str(int(c)) for c in found if c.isdecimal())
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= digits <= 15 and not any(c.isalpha() for c in found)


def tag_texts(tagger: Tagger, texts: list[str]) -> list[np.ndarray | None]:
    """Tags of every character, decoded over chains of overlapping windows; None for texts without any."""
    step = WINDOW - 2 * MARGIN
    padded = [np.concatenate([np.full(MARGIN, 95, np.uint8), symbols_of(t)]) if t else np.zeros(0, np.uint8) for t in texts]
    where: list[tuple[int, int]] = []
    held: dict[tuple[int, int], np.ndarray] = {}

    def run(batch: list[tuple[int, int]]) -> None:
        x = np.full((len(batch), WINDOW), 95, np.uint8)
        for k, (i, a) in enumerate(batch):
            piece = padded[i][a : a + WINDOW]
            x[k, : len(piece)] = piece
        e = tagger.emissions(np.ascontiguousarray(x.T))
        for k in np.flatnonzero(tagger.worth(e)).tolist():
            held[batch[k]] = e[:, :, k].copy()

    for i, t in enumerate(texts):
        where += [(i, a) for a in range(0, len(t), step)]
        while len(where) >= BATCH:
            run(where[:BATCH])
            where = where[BATCH:]
    if where:
        run(where)
    chains: dict[int, list[list[tuple[int, int]]]] = {}
    last: list[tuple[int, int]] = []
    for at in sorted(held):
        if last and at == (last[-1][0], last[-1][1] + step):
            last.append(at)
            continue
        if last:
            chains.setdefault(len(last), []).append(last)
        last = [at]
    if last:
        chains.setdefault(len(last), []).append(last)
    out: list[np.ndarray | None] = [None] * len(texts)
    for size, group in chains.items():
        for begin in range(0, len(group), max(1, BATCH // size)):
            part = group[begin : begin + max(1, BATCH // size)]
            e = np.empty((step * (size - 1) + WINDOW, len(part), TAGS), np.float32)
            for n, chain in enumerate(part):
                for j, key in enumerate(chain):
                    lo, hi = MARGIN * (j > 0), WINDOW - MARGIN * (j < size - 1)
                    e[j * step + lo : j * step + hi, n] = held[key][lo:hi]
            tags = tagger.viterbi(e)
            for n in np.flatnonzero(tags.any(0)).tolist():
                i, a = part[n][0]
                own = out[i] = np.zeros(len(texts[i]), np.int8) if out[i] is None else out[i]
                lo, hi = max(0, a - MARGIN), min(len(own), a - MARGIN + len(tags))
                own[lo:hi] = np.maximum(own[lo:hi], tags[lo - a + MARGIN : hi - a + MARGIN, n])
    return out


def added_spans(text: str, tags: np.ndarray | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if tags is None:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    out = []
    for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        kind = int(tags[a]) - 1
        if kind < 0:
            continue
        while a < b and (text[a].isspace() or text[a] in ",;:.!?"):
            a += 1
        while a < b and (text[b - 1].isspace() or text[b - 1] in ",;:.!?"):
            b -= 1
        # a span begins and ends at a word's edge, or it is a piece of something else
        if a < b and (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()) and sound(kind, text[a:b]) and not any(s < b and a < e for _, s, e in base):
            out.append((kind, a, b))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


class _Rows:
    def __init__(self, tagger: Tagger) -> None:
        self.tagger = tagger

    def __call__(self, ids: list, texts: list[str]) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for i, t, tags in zip(ids, texts, tag_texts(self.tagger, texts), strict=True):
            base = base_spans(t)
            out["doc_id"].append(i)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(1 for x in base if x[0] == k))
            out["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
            out["spans"].append(digest(base + added_spans(t, tags, base)))
        return out


def pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with its counts by kind, the digest of the base spans and all spans."""
    return common.map_texts(docs, _Rows(fit(docs, text, key)), SCHEMA, text, key)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(common.documents(spark, sf_dir))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
