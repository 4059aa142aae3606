"""A plain Python model of the parser's token rules, written apart from the Spark code."""

import re

from boresight import vocab

PHRASES, WORDS, TYPOS = vocab.phrases(), vocab.single_words(), vocab.typos()


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tokens(text: str) -> list[str]:
    out, i = [], 0
    while i < len(text):
        if text[i] in " \t\n\r\x0b\x0c":
            i += 1
            continue
        for phrase, _ in PHRASES:
            end = i + len(phrase)
            if text[i:end].lower() == phrase and (end == len(text) or text[end].isspace()):
                break
        else:
            end = i + len(re.match(r"\S+", text[i:])[0])
        out.append(text[i:end])
        i = end
    return out


def classify(token: str) -> tuple[str, str, str | None, float | None]:
    """(value, class, corrected from, score)."""
    low = token.lower()
    exact = dict(PHRASES) | dict(WORDS)
    if len(token.encode()) >= 64:
        return token, "unknown", None, None
    if low in exact:
        return token, exact[low], None, None
    if low in TYPOS:
        return TYPOS[low], exact[TYPOS[low]], token, 0.95
    best, score = None, 0.0
    raw = low.encode()
    if 3 <= len(raw) <= 15 and low[0] in vocab.FUZZY_FIRST:
        for term, _ in WORDS:
            if abs(len(term) - len(raw)) <= 3 and term[0] == low[0]:
                ratio = 1 - distance(raw.decode("latin-1"), term) / max(len(raw), len(term))
                if ratio >= 0.8 and ratio > score:
                    best, score = term, ratio
    return (best, exact[best], token, score) if best else (token, "unknown", None, None)
