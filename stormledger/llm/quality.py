"""Line-first cleaning: rules per line, failed lines removed, and documents that lose too much rejected.

Rules of a line, all measured over its words (runs of no ASCII white space):

* symbols: many words end in, or consist of, signs such as # $ % & * < > |
* navigation: the line is a menu of entries between separators
* shouting: capitals throughout, or exclamation marks after most words
* stutter: words that only repeat the word before
* boilerplate: a short line with a phrase of page furniture (cookies, log in, all rights reserved)
* punctuation: a long line without any mark that ends or divides sentences

A line without words fails no rule. A document is rejected if it has under MIN_WORDS words, if too
many of its words lie in repeated windows of eight words, or if the failed lines hold too large a
share of its words. The counts are exact for texts of any length: windows are compared by numbers
given to distinct words, pairs, fours and eights in turn, so memory follows the text alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stormledger.llm.arrow import add_columns

WORD = re.compile("[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED_PCT = 20, 8, 30
MAX_LOST_PCT = 30
SYMBOL_PCT, SEPARATOR_PCT, SHOUT_PCT, CAPITAL_PCT, STUTTER_PCT = 30, 20, 50, 80, 30
LEAST_WORDS, LEAST_SEPARATORS, LONG_LINE = 3, 3, 40
SYMBOL_WORD = re.compile("[#*$%&<>]{2,}|^[#*$%&<>]+$")
SEPARATOR = re.compile("[|»›•·>]+|::")
SIGN = re.compile("[#*$%&<>|»›•·]|::")
MARKS = re.compile("[.!?;:,…。！？、،؟।]")
BOILERPLATE = re.compile(
    "all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|"
    "uses? cookies|enable javascript|javascript is (?:disabled|required)|log ?in|sign ?(?:in|up)|subscribe (?:to|now)|"
    "click here|read more|skip to (?:main )?content|back to top|share on|follow us|add to cart|lorem ipsum"
)
BOILERPLATE_WORDS = 25
RULES = ("symbols", "navigation", "shouting", "stutter", "boilerplate", "punctuation")

VERDICT = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_failed_lines", T.LongType()), T.StructField("lost_words", T.LongType()),
    T.StructField("failed_rules", T.StringType()), T.StructField("kept", T.BooleanType()),
    T.StructField("clean_text", T.StringType()),
]


def failed_rule(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words fails."""
    n = len(words)
    if n >= LEAST_WORDS:
        if SIGN.search(line):  # most lines have none
            if 100 * sum(1 for w in words if SYMBOL_WORD.search(w)) >= SYMBOL_PCT * n:
                return "symbols"
            separators = sum(1 for w in words if SEPARATOR.fullmatch(w))
            if separators >= LEAST_SEPARATORS and 100 * separators >= SEPARATOR_PCT * n:
                return "navigation"
        if 100 * line.count("!") >= SHOUT_PCT * n and 100 * sum(w.endswith("!") for w in words) >= SHOUT_PCT * n:
            return "shouting"
        if n >= 2 * LEAST_WORDS:
            if 100 * sum(map(eq, words, words[1:])) >= STUTTER_PCT * n:
                return "stutter"
            if 2 * sum(map(str.islower, words)) < n:
                capitals, small = sum(map(str.isupper, line)), sum(map(str.islower, line))
                if 100 * capitals >= CAPITAL_PCT * max(1, capitals + small):
                    return "shouting"
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if n > LONG_LINE and not MARKS.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words inside windows of WINDOW words that occur twice or more in the list."""
    import numpy as np

    if len(words) <= WINDOW:
        return 0
    number: dict[str, int] = defaultdict(count().__next__)
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    width = 1
    while width < WINDOW:
        pair = at[:-width] * (int(at.max()) + 1) + at[width:]
        distinct, at = np.unique(pair, return_inverse=True)
        if len(distinct) == len(at):
            return 0
        width *= 2
    twice = (np.bincount(at) > 1)[at]
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def judge(text: str | None) -> tuple:
    """VERDICT's values for one text."""
    body = text or ""
    all_words: list[str] = []
    seen: set[str] = set()
    kept_lines, rules = [], []
    n_dup = lost = 0
    for line in body.split("\n"):
        words = WORD.findall(line)
        if words:
            n_dup += line in seen
            seen.add(line)
            all_words += words
            rule = failed_rule(line, words)
            if rule:
                rules.append(rule)
                lost += len(words)
                continue
        kept_lines.append(line)
    n, n_repeat = len(all_words), repeated_words(all_words)
    base_failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEATED_PCT * n
    kept = not base_failed and 100 * lost <= MAX_LOST_PCT * n
    return (
        n, sum(map(len, all_words)), sum(map(body.count, SYMBOLS)), n_dup, n_repeat, base_failed,
        len(rules), lost, ",".join(r for r in RULES if r in rules), kept,
        text if not rules else "\n".join(kept_lines),
    )


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df with VERDICT's columns; clean_text is the text without its failed lines.

    A null or empty text has no words and is not kept; its clean_text equals it. Every row is
    judged alone, so repeated rows get equal verdicts. Columns named as in VERDICT are replaced.
    """
    return add_columns(df, text, VERDICT, lambda texts: [list(v) for v in zip(*map(judge, texts))])
