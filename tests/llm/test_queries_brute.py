"""The queries of operators that SQL can't express against brute force, over whole small tables written as Parquet."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest

from lexloom.llm import pii, registry, secret_scans

BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture
def folder(spark, tmp_path):
    def put(rows, labels=()):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return put


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def random_texts(parts, n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(most))) for _ in range(n)]


def leftmost(pattern, text, good):
    """Leftmost non-overlapping matches, one search after the other; those that fail are dropped."""
    at, out = 0, []
    while m := re.compile(pattern, re.A).search(text, at):
        at = m.end()
        if good(m):
            out.append((m.start(), m.end()))
    return out


EDGES = [None, "", "   \n", "x" * 200_000]

# op4 ------------------------------------------------------------------------------------------------------------------

KINDS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def test_op4_base_spans(spark, folder):
    parts = ["token", "Secret", "PASSWD", "api_key", "apikey", "=", ": ", '"', "'", " ", "abc", "abcdef", "12/+_.=-", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "\n", "deadbeefdeadbeef"]
    rows = list(enumerate([*random_texts(parts, 400, 1), *EDGES])) + [(5, "token=abcdefg"), (5, "token=abcdefg"), (None, "secret: zzzzzz")]
    got = registry.QUERIES["op4_secret_scans"](spark, folder(rows)).collect()
    want = []
    for i, t in rows:
        found = sorted((a, list(KINDS).index(k), b) for k, (p, good) in KINDS.items() for a, b in leftmost(p, t or "", good))
        n = [sum(1 for x in found if x[1] == k) for k in range(3)]
        want.append((str(i), *n, digest((list(KINDS)[k], a, b) for a, k, b in found)))
    assert sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == sorted(want)
    for r in got:
        spans = [x for x in r["spans"].split(",") if x]
        assert len(spans) >= r["n_assign"] + r["n_access"] + r["n_hex"]


ENCODERS = {
    "base64": lambda b: base64.b64encode(b),
    "urlsafe": lambda b: base64.urlsafe_b64encode(b),
    "wrapped": lambda b: b"\n".join(base64.b64encode(b)[i : i + 64] for i in range(0, len(base64.b64encode(b)), 64)),
    "url": lambda b: urllib.parse.quote(b, safe="").encode(),
    "escapes": lambda b: "".join(f"\\u{x:04x}" for x in b).encode(),
    "bytes": lambda b: "".join(f"\\x{x:02x}" for x in b).encode(),
    "gzip": lambda b: base64.b64encode(gzip.compress(b)),
    "bz2": lambda b: base64.b64encode(bz2.compress(b)),
    "xz": lambda b: base64.b64encode(lzma.compress(b)),
    "zlib": lambda b: base64.b64encode(zlib.compress(b)),
}


def test_op4_finds_what_was_wrapped_at_random():
    """Random chains of encoders around a secret, with words before and after: the secret is found, and the span lies within the wrapped part."""
    rng = random.Random(4)
    for n in range(150):
        secret = f"password={''.join(rng.choice('abcdefghijkmnpqr') for _ in range(12))}"
        body = f"{'w' * rng.randrange(5)} {secret} ok".encode()
        chain = [rng.choice(list(ENCODERS)) for _ in range(rng.randrange(1, 4))]
        for name in chain:
            body = ENCODERS[name](body)
        before = "Some words stand here: "
        text = before + body.decode() + " and after."
        base, added, _ = secret_scans.find_secrets(text)
        assert base == [] and any(k == 0 and a >= len(before) and b <= len(before) + len(body) for a, k, b in added), (chain, text[:200])


# op6 ------------------------------------------------------------------------------------------------------------------


def counts(text):
    words = [w for w in re.split(f"[{BLANK}]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in BLANK for c in line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_op6_counts(spark, folder):
    rng = random.Random(6)
    parts = ["a", "bb", "ccc", "# ", " ", " ", "\n", "\t", "é", "\xa0", "\x1c", "x y z ", "$", "|", "\r\n", "\x0b"]
    texts = random_texts(parts, 300, 2, 60)
    texts += [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(40, 120))) + "\n" * rng.randrange(3) for _ in range(60)]
    rows = list(enumerate([*texts, *EDGES])) + [(3, texts[3]), (None, "a b c")]
    got = registry.QUERIES["op6_quality_rules"](spark, folder(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in got) == sorted((str(i), *counts(t or "")) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op6_boilerplate_in_long_lines():
    from lexloom.llm.quality_rules import judge, line_fails

    prose = " ".join(f"Carrier{i} stops at line{i} near place{i}." for i in range(60))
    legal = " ".join(f"All rights reserved by owner{i} of page{i} and print{i}." for i in range(12))
    assert line_fails(prose, prose.split()) is None and len(legal) > 400 and line_fails(legal, legal.split()) == "boilerplate"
    assert line_fails(prose + " " + legal, (prose + " " + legal).split()) is None
    assert judge(prose)[6]


# op7 ------------------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def number(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(number(m)) <= 19 and luhn(number(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(number(m)) <= 15),
}


def test_op7_base_spans(spark, folder):
    parts = ["a.b", "@", "x-1", ".com", ".", " ", "1", "22", "10.0.0.1", "255", "4111111111111111", "4111 1111 1111 1111", "-", "+1", " (555) ", "123-4567", "é", "\n", "_%", "+"]
    rows = list(enumerate([*random_texts(parts, 500, 7), *EDGES])) + [(1, "a@b.cd"), (1, "a@b.cd"), (None, "+12 345 678 90")]
    got = registry.QUERIES["op7_pii"](spark, folder(rows)).collect()
    want = []
    for i, t in rows:
        found = [(k, a, b) for k, (p, good) in PERSONAL.items() for a, b in leftmost(p, t or "", good)]
        want.append((str(i), *(sum(1 for x in found if x[0] == k) for k in PERSONAL), digest(found)))
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == sorted(want)


#: Personal data in forms that neither the base patterns take nor the trainer's generator makes exactly so, and what looks like it but isn't.
HIDDEN = ["write to jane_roe(at)mail-host(dot)org today", "ask mark77 [at] firm [dot] net soon", "host 172 . 16 . 254 . 9 is down", "call (212) 555-0187 at noon", "ring 0044 207 9460123 now", "card 4012.8888.8888.1881 was used"]
PLAIN = ["we met at noon and left at nine", "sections 12, 13 and 14 of the act", "on 12.11.1998 the ship left", "it cost 1,250.50 in all", "pages 100-210 of volume 7", "the dot at the end of the line"]


def test_op7_finds_forms_of_its_own():
    rng = random.Random(1)
    prose = "the carrier must stop at the line and answer for what its servants do on the way".split()
    texts = [" ".join(rng.choice(prose) for _ in range(60)) for _ in range(200)]
    tagger = pii.Tagger()
    tagger.train(*pii.labelled_windows(texts))

    def spans(t):
        return pii.added_spans(t, pii.tag_texts(tagger, [t])[0], pii.base_spans(t))

    wrap = lambda t: " ".join(texts[0].split()[:30]) + " " + t + " " + " ".join(texts[1].split()[:30])
    hits = sum(bool(spans(wrap(t))) for t in HIDDEN)
    false = sum(bool(spans(wrap(t))) for t in PLAIN)
    assert hits >= 4 and false <= 1, (hits, false)


def test_op7_spans_cross_windows():
    """A span is found alike wherever it stands among the windows."""
    tagger = pii.Tagger()
    tagger.train(*pii.labelled_windows(["the carrier must stop at the line " * 20]))
    step = pii.WINDOW - 2 * pii.MARGIN
    found = []
    for shift in range(0, step, 7):
        t = "word " * 60 + "x" * (shift % 5) + " " + "to go " * (shift // 6) + "mail bobby.tables(at)somewhere.example.org today " + "word " * 60
        found.append(bool(pii.added_spans(t, pii.tag_texts(tagger, [t])[0], pii.base_spans(t))))
    assert sum(found) >= 0.8 * len(found)


def test_op7_bound_never_hides_a_path():
    import numpy as np

    rng = np.random.default_rng(0)
    tagger = pii.Tagger(hidden=2)
    for _ in range(300):
        e = rng.normal(scale=2, size=(6, pii.TAGS, 8)).astype(np.float32)
        e[:, 0] += 2
        tagger.p["t"] = rng.normal(scale=2, size=(pii.TAGS, pii.TAGS)).astype(np.float32)
        tags = tagger.viterbi(np.ascontiguousarray(e.transpose(0, 2, 1)))
        assert not tags[:, ~tagger.worth(e)].any()


# op10 -----------------------------------------------------------------------------------------------------------------


def test_op10_scores(spark, folder):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        if i % 5 == 1:
            for _ in range(5):
                t[rng.randrange(len(t))] = rng.choice(["nasty", "vile", "rotten", "vilest"])
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 5 == 1)))
    odd = [(5000, None), (5001, ""), (5002, "vile nasty rotten " * 30), (5003, "w1 " * 60_000), (7, rows[7][1]), (None, "vile rotten nasty vile rotten")]
    where = folder(rows + odd, labels + [(9000, None, None), (None, 1, 1)])
    got = registry.QUERIES["op10_toxicity"](spark, where).collect()
    assert len(got) == len(rows) + len(odd)
    import zlib as z

    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and z.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1200]
    assert len(held) > 100 and sum(r["predicted"] == int(r["doc_id"] % 5 == 1) for r in held) > 0.95 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[5002]["predicted"] == 1 and by[5000]["score"] == by[5001]["score"] and by[5000]["predicted"] == 0 and by[5003]["predicted"] == 0
    # labels that are held out are never learnt from: turned over, they change nothing
    turned = [(i, q, 1 - t if z.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = registry.QUERIES["op10_toxicity"](spark, folder(rows + odd, turned)).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in again) == sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got)
