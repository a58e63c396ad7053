"""Train the boundary classifier on reliable boundaries; run as a module with a data directory.

Reliable labels, all taken from unlabelled text:
- a mark before a small letter, comma or dash is no boundary; a token at the end
  of a line item is a boundary, learnt as if a capital followed;
- a mark before a capital is a boundary if its token also ends items in the
  corpus, and none if the token is frequent and never ends one;
- a mark of Chinese or Japanese before a comma, or closing a quotation before a particle
  or the words of who speaks, is no boundary; before all else it is one;
- a space between two clauses of Thai is a boundary, one between a number and a word
  that elsewhere is written onto numbers is none;
- a line end of a text that isn't wrapped is a boundary;
- a line end before a bullet or label is a boundary; one before a small letter
  with no end mark before it is mere layout.
The sample is at most ``LIMIT`` texts of a table, in the order of a hash.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from textloom.llm import sentences as S

LIMIT = 60_000


def sample(path: str, table: str) -> list[str]:
    t = pd.read_parquet(f"{path}/{table}.parquet", columns=["text"]).text.dropna().drop_duplicates()
    return list(t.iloc[pd.util.hash_array(t.to_numpy()).argsort()][:LIMIT])


MARK = re.compile(rf"([.!?…।॥؟]+[{S._INVISIBLE}]*[{S._CLOSERS}]*)(\s*)")


def lexicon(plain: list[str], pages: list[str]) -> tuple[dict, dict]:
    """For each token before a full stop: bins of how often it ends an item and how often a small letter follows."""
    n, fin, low, num = Counter(), Counter(), Counter(), Counter()
    for t, wraps in [*((t, False) for t in plain), *((t, True) for t in pages)]:
        for line in t.split("\n"):
            for m in re.finditer(r"(\S+)\.(?=\s|$)(\s*)(?=(\S?))", line):
                k = S.token_key(S._TOKEN.search(m.group(1)).group() if S._TOKEN.search(m.group(1)) else "")
                if not k or (m.start() < 4 and re.fullmatch(r"\W*(\d+|[a-z])", m.group(1))):
                    continue
                if wraps and not m.group(3):
                    continue  # the end of a wrapped line tells nothing
                n[k] += 1
                fin[k] += not m.group(3)
                num[k] += m.group(3).isdigit()
                low[k] += S.shape(m.group(3)) in "l,-" and bool(m.group(3))
    bins = lambda x: 0 if x == 0 else 1 if x < 0.02 else 2 if x < 0.1 else 3 if x < 0.4 else 4
    lex = {k: (bins(fin[k] / n[k]), bins(low[k] / n[k]), bins(num[k] / n[k]), min(v, 99)) for k, v in n.items() if v >= 3}
    # Only what differs from an ordinary word is worth keeping.
    kept = {k: v for k, v in lex.items() if v[1] >= 2 or v[0] <= 1 or v[2] >= 3 or not k.isalpha() or len(k) < 4}
    return kept, {k: n[k] for k in kept}


def examples(plain: list[str], pages: list[str], lex: dict) -> Counter:
    out: Counter = Counter()
    for t in plain:
        for line in t.split("\n"):
            for m in MARK.finditer(line):
                if m.start() < 6 or not (m.group(2) or m.end() == len(line)):
                    continue
                tok = S._TOKEN.search(line[max(0, m.start() - 24) : m.start()])
                tok = tok.group() if tok else ""
                ordinal = tok.isdigit() and len(tok) <= 2 and bool(S._ORDINAL_BEFORE.search(line[max(0, m.start() - 12) : m.start()]))
                nx = S._NEXT.match(line, m.end())
                n = S.shape(nx.group(2))
                final, lower, number, seen = lex.get(S.token_key(tok), (-1, -1, -1, 0))
                if n == "e":
                    y, nxt = 1, "X"
                elif n in "l,-" and m.group(1)[0] != "।":
                    y, nxt = 0, nx.group(2)
                elif ordinal or n == "d" and number >= 3 or n == "U" and len(tok) == 1 and tok.isupper():
                    y, nxt = 0, nx.group(2)
                elif seen >= 20 and final == 0 or final <= 1 and lower == 0 and seen >= 3 and len(tok) < 5:
                    y, nxt = 0, nx.group(2)
                else:
                    y, nxt = 1, nx.group(2)
                out[tuple(S.mark_features(tok, m.group(1), bool(nx.group(1)), nxt, ordinal, lex)), y] += 1
    for t in pages:
        lines = t.split("\n")
        width = S.line_width(lines)
        for a, b in zip(lines, lines[1:]):
            if not a.strip() or not b.strip():
                continue
            word = b.split(None, 1)[0]
            key = fits, wide, _, _, n, bullet = S.line_key(a, b, word, width)
            open_end = a.rstrip(S._INVISIBLE + "\"'”’»)]} ")[-1:] not in ".!?"
            if bullet or wide:
                y = 1
            elif n == "l" and open_end:
                y = 0
            elif open_end and n in "Ucd":
                y = int(fits)
            else:
                continue
            out[tuple(S.line_features(*key)), y] += 1
    return out


def units_of(texts_: list[str]) -> list[str]:
    """The beginnings of words that are written onto numbers, in scripts without spaces between words."""
    n = Counter(m.group(1) for t in texts_ for m in re.finditer(rf"\d([{S._THAI}]{{3}})", t))
    return sorted(x for x, c in n.items() if c >= 3)


def more_examples(texts_: list[str], units: frozenset[str]) -> Counter:
    """Reliable boundaries of scripts with their own marks or none, and of line ends."""
    out: Counter = Counter()
    for t in texts_:
        for m in re.finditer(r"[。！？｡]+[」』”’）]*", t):
            nxt = t[m.end() : m.end() + 1]
            closed = m.group()[-1] in "」』”’\""
            start = max(t.rfind(x, 0, m.start()) for x in "。！？\n") + 1
            opened = closed and nxt.isalpha() and S._opened_at_start(t, start, m.start())
            out[tuple(S.han_features(nxt, closed, opened)), int(not (nxt and nxt in "、，" or closed and nxt and nxt in "とっ" or opened))] += 1
        for m in re.finditer(rf"(?<=[{S._THAI}0-9])[^\S\n]+(?=[{S._THAI}])", t):
            before, size = t[m.start() - 1], m.start() - t.rfind(" ", 0, m.start() - 1)
            unit = before.isdigit() and t[m.end() : m.end() + 3] in units
            out[tuple(S.space_features(before, t[m.end()], unit, size)), int(not unit)] += 1
        for m in re.finditer(r"\n(?=(.))", t):
            out[tuple(S.row_end_features(S.shape(m.group(1)), m.group(1) in "-•–—*·▪◦#§" or m.group(1).isdigit(), False)), 1] += 1
    for x in units:  # a number, a space and a word for what is counted, which texts that write them together don't show
        for size in range(0, 24, 4):
            out[tuple(S.space_features("0", x, True, size)), 0] += 20
    out[tuple(S.row_end_features("o", False, True)), 1] += 50
    return out


def fit(data: Counter, rounds: int = 3000, l2: float = 1e-5, rate: float = 4.0) -> dict:
    """Maximum-entropy weights by gradient ascent over distinct feature sets."""
    names: dict[str, int] = defaultdict(lambda: len(names))
    rows = [([names[f] for f in fs], y, c) for (fs, y), c in data.items()]
    ids = np.concatenate([r[0] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[1] for r in rows], float)
    c = np.minimum(np.array([r[2] for r in rows], float), 2000)
    w = np.zeros(len(names))
    g2 = np.full(len(names), 1e-6)
    for _ in range(rounds):
        z = np.bincount(row, w[ids], len(rows))
        g = np.bincount(ids, ((y - 1 / (1 + np.exp(-z))) * c)[row], len(names)) / c.sum() - l2 * w
        g2 += g * g
        w += rate * 0.05 * g / np.sqrt(g2)
    z = np.bincount(row, w[ids], len(rows))
    print("accuracy on its own sample", ((z > 0) == y).astype(float) @ c / c.sum())
    return {k: round(float(w[i]), 3) for k, i in names.items() if abs(w[i]) >= 0.01}


def main(path: str) -> None:
    plain, pages = sample(path, "segment"), sample(path, "pdf_page")
    lex, _ = lexicon(plain, pages)
    units = units_of(plain + pages)
    w = fit(examples(plain, pages, lex) + more_examples(plain, frozenset(units)))
    S.MODEL.write_text(json.dumps({"lex": lex, "w": w, "units": units}, ensure_ascii=False, separators=(",", ":")))
    print(len(lex), "tokens,", len(w), "weights")


if __name__ == "__main__":
    main(sys.argv[1])
