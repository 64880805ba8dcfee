"""Line-first quality rules.

Every line is judged first (symbols, capitals, navigation, stutter, boilerplate, missing punctuation, repetition of an
earlier line); failing lines are removed, and a document that loses too much of its text is rejected. Documents with
fewer than MIN_WORDS words, or in which over MAX_REPEAT_PCT percent of words stand in repeated 3-word windows, fail at once.

Defined results: null or empty text has no words and fails; repeated rows are judged each for itself; a null doc_id is kept.
The work is a map over whole texts: no shuffle, memory bounded by a slice of rows or one document.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import common

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A document is rejected if more than this share of its non-blank characters stood in removed lines.
MAX_LOST = 0.5
#: Line rules: share of words that carry symbols, share of words in capitals, share of navigation separators, distinct share of words.
MAX_SYMBOL_WORDS, MAX_CAPITALS, MAX_SEPARATORS, MIN_DISTINCT = 0.3, 0.6, 0.2, 0.3
SEPARATORS = ("|", ">", "»", "·", "•", "/")
SYMBOLS = re.compile(r"[#*$%&|<>]")
BOILERPLATE = re.compile(r"\b(?:cookies?|javascript|all rights reserved|terms of (?:use|service)|privacy policy|subscribe|sign up|log ?in|click here|is licensed under)\b", re.I)
#: Where a sentence ends within a line. A line fails as boilerplate if such sentences are half of it, however long it is.
SENTENCE = re.compile(r"(?<=[.!?;])\s+")
TERMINAL = tuple(".!?:;\"'»”)…。！？")
#: Words as they are counted in whole texts, so that both shares of lost text are of the same characters.
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: A line of fewer words needs no capitals, distinct-words or symbol statistics; a shorter one without end mark counts as a menu entry.
SHORT_LINE, MENU_LINE = 8, 3

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_pct double, clean_text string"


def line_fails(line: str, words: list[str]) -> str | None:
    """The name of the first rule that the line fails, or None. words: the line's words, at least one."""
    n = len(words)
    if not n:
        return "menu"
    seps = sum(map(words.count, SEPARATORS))
    if n >= 4 and seps >= MAX_SEPARATORS * n:
        return "navigation"
    if n >= MENU_LINE and SYMBOLS.search(line) and sum(1 for w in words if SYMBOLS.search(w)) > MAX_SYMBOL_WORDS * n:
        return "symbols"
    if n >= SHORT_LINE:
        if sum(map(str.isupper, words)) > MAX_CAPITALS * n:
            return "capitals"
        if len(set(words)) < MIN_DISTINCT * n:
            return "stutter"
    elif n < MENU_LINE and not line.rstrip().endswith(TERMINAL):
        return "menu"
    if BOILERPLATE.search(line) and 2 * sum(len(x) for x in SENTENCE.split(line) if BOILERPLATE.search(x)) >= len(line):
        return "boilerplate"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window whose sequence starts at least twice in the text."""
    if len(words) < 4:
        return 0
    g = common.gram_hashes(common.word_hashes(words, common.OWN_SEED), 3)
    ordered = np.sort(g)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    twice = np.isin(g, again)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(g)] |= twice
    return int(covered.sum())


def judge(text: str) -> tuple:
    """The values of SCHEMA without doc_id."""
    words = text.encode().split()
    n = len(words)
    blank = sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    repeats = repeat_words(words)
    seen: set[str] = set()
    keep, n_dup, lost = [], 0, 0
    for line in text.split("\n"):
        if not line.strip(" \t\n\r\x0b\x0c"):
            keep.append(line)
            continue
        line_words = WORD.findall(line)
        again = line in seen
        n_dup += again
        seen.add(line)
        if again or line_fails(line, line_words):
            lost += sum(map(len, line_words))
        else:
            keep.append(line)
    chars = len(text) - blank
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * n
    share = lost / chars if chars else 0.0
    return n, chars, sum(map(text.count, "#*$%&|<>")), n_dup, repeats, failed, not failed and share <= MAX_LOST, 100 * share, "\n".join(keep)


def _rows(ids: list, texts: list[str]) -> dict:
    cols = list(zip(*map(judge, texts), strict=True))
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    return {"doc_id": ids} | dict(zip(names, cols, strict=True))


def quality_rules(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with its counts, verdict and cleaned text."""
    return common.map_texts(df, _rows, SCHEMA, text, key)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.documents(spark, sf_dir)).drop("clean_text")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
