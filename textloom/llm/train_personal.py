"""Train the lexicons and the trees of ``personal.py``; run as a module with a data directory.

No mention is labelled by hand. Labels come from context that leaves no doubt:
words before and after (titles, "tel.", "order no.", a postal code behind a house
number, the ending of a firm). A third of the labelled spans are also learnt with
their context features blanked, so that the format alone can decide where no such
context stands. The sample is at most ``LIMIT`` texts of each table.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import sys
from collections import Counter

import numpy as np
import pandas as pd

from textloom.llm import boosting
from textloom.llm import personal as P
from textloom.llm.lookalikes import unify
from textloom.llm.names import TITLES, given

LIMIT = 20_000
#: A title or form of address: what follows it with a capital is a name, unless it is a firm.
_TITLE = re.compile(rf"(?<![^\s(\"„«]){'(?i:' + '|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + ')'}\.?[ \n]$")


class Cue:
    """Places where names stand: behind titles, and behind words that mostly stand before known names, learnt from the texts."""

    def __init__(self):
        self.words: frozenset[str] = frozenset()

    def search(self, text: str, lo: int, hi: int) -> bool:
        if _TITLE.search(text, lo, hi):
            return True
        before = text[lo:hi].lower().replace("\n", " ").rstrip(" \"").rsplit(" ", 1)[-1]
        return before in self.words


CUE = Cue()
# Words that join any two things, so that they tell nothing of the second one.
CONJUNCTIONS = frozenset("and or und oder et ou y o e i oraz lub и или και ή".split())


def contexts(all_texts: list[str], is_name) -> tuple[dict, dict]:
    """For each word, the share of names among the words with capitals that follow it, and that stand before it."""
    n, hit = [Counter(), Counter()], [Counter(), Counter()]
    for t in all_texts:
        last = -9
        for m in P.WORD.finditer(t):
            a, b = m.span()
            if a - last <= 1:
                last = b
                continue  # inside a run; its first word stands for it
            last = b
            w = P.before(t, a, 24)
            if not w or w[0] in CONJUNCTIONS or is_name(w[0]):
                continue
            name = is_name(m.group().lower()) and P.FIRM.match(t, b) is None
            n[0][w[0]] += 1
            hit[0][w[0]] += name
        for m in re.finditer(rf"{P.WORD.pattern}(?:[ \n]{P.WORD.pattern})?", t):
            x = P._word_after(t, m.end())
            if is_name(x):
                continue
            n[1][x] += 1
            hit[1][x] += is_name(m.group().lower().split()[0]) and P.FIRM.match(t, m.end()) is None
    return tuple({w: v for w, c in n[k].items() if c >= 6 and 1 < len(w) < 20 and w.isalpha() and (v := round((hit[k][w] + 0.1) / (c + 1), 2)) >= 0.15} for k in (0, 1))


def texts(path: str) -> list[str]:
    out = []
    for t in ("segment", "pdf_page", "text_doc"):
        x = pd.read_parquet(f"{path}/{t}.parquet", columns=["text"]).text.dropna().drop_duplicates()
        out += [unify(v) for v in x.iloc[pd.util.hash_array(x.to_numpy()).argsort()][:LIMIT]]
    return out


def lexicon(all_texts: list[str]) -> tuple[dict, dict]:
    """Scores of tokens: share of their uses that stand where names stand, less their use as ordinary words and in firms.

    A place is one for names if a title or a word that leads to names stands before it, or if the
    word beside it is a name. The first round knows common given names only, the next ones what was learnt.
    """
    small = Counter()
    for t in all_texts:
        small.update(w for w in re.findall(r"(?<![\w@.+/-])[^\W\d_]{3,}(?![\w@+/-]|\.\w)", t) if w[0].islower())
    sure: set[str] = set()
    for _ in range(4):
        total, cued, firm = Counter(), Counter(), Counter()
        is_name = lambda w: w in sure or given(w) > 0
        for t in all_texts:
            found = [(*m.span(), m.group().lower()) for m in P.WORD.finditer(t)]
            joined = [t[x[1] : y[0]] in (" ", "\n") or re.fullmatch(r",? .\.,? |, ", t[x[1] : y[0]]) is not None for x, y in zip(found, found[1:])]
            for k, (a, b, w) in enumerate(found):
                beside = k and joined[k - 1] and is_name(found[k - 1][2].split("-")[0]) or k + 1 < len(found) and joined[k] and is_name(found[k + 1][2].split("-")[0])
                of_firm = P.FIRM.match(t, b) is not None
                here = w not in TITLES and not of_firm and (beside or CUE.search(t, max(0, a - 26), a))
                for part in w.split("-"):
                    total[part] += 1
                    cued[part] += bool(here)
                    firm[part] += of_firm
        score = {w: max(-1.0, min(1.3, 4 * (cued[w] + 0.1) / (n + 2)) - min(1.3, 2 * small[w] / n) - 2 * firm[w] / n - 0.3) for w, n in total.items()}
        sure = {w for w, v in score.items() if v > 0.6 and total[w] >= 4 and cued[w] >= 0.3 * total[w] and len(w) > 2}
    lex = {w: round(v, 2) for w, v in score.items() if total[w] >= 3 or small[w]}
    good, bad = Counter(), Counter()
    for w, s in lex.items():
        for n in (3, 4, 5, 6):
            if len(w) > n:
                (good if s > 0.2 else bad)[w[-n:]] += 1
    ends = {}
    for e in good | bad:
        g, b = good[e], bad[e]
        if g + b >= 4:
            ends[e] = round(math.tanh(0.7 * math.log((g + 0.3) / (b + 0.3)) - 0.3), 2)
    lex = {w: s for w, s in lex.items() if total[w] >= 8 and (s > 0.1 or s < -0.2) or len(w) < 4}  # others go by their endings
    return lex, ends


HAN_CUE = re.compile(r"请联系([一-鿿]{2,4})，|(?<![一-鿿])([一-鿿]{2,4})于\d{4}年|([一-鿿々ノヶ]{2,8})さんが")


def han_tables(all_texts: list[str]) -> dict:
    """Surnames and given names that occur with two others of the other part each where names stand, and ordinary words."""
    names, other = Counter(), Counter()
    for t in all_texts:
        names.update({m.group(m.lastindex) for m in HAN_CUE.finditer(t)})
    left, right = Counter(), Counter()
    for x in names:
        for n in range(1, len(x)):
            left[x[:n]] += 1
            right[x[n:]] += 1
    cut = {x: max(range(1, len(x)), key=lambda n: min(left[x[:n]], right[x[n:]])) for x in names if len(x) > 1}
    cut = {x: n for x, n in cut.items() if left[x[:n]] > 1 and right[x[n:]] > 1}
    for t in all_texts:
        other.update(w for w in re.findall(r"[一-鿿々ノヶ]{2,6}", t) if w not in cut and not any(w.startswith(x) for x in cut))
    return {"sur": sorted({x[:n] for x, n in cut.items()}), "given": sorted({x[n:] for x, n in cut.items()}), "words": sorted(w for w, n in other.items() if n > 2)}


def han_label(t: str, a: int, b: int, score: float) -> int:
    """1 for a learnt surname with a learnt given name, 0 for all else: whole names are wanted."""
    return int(score == 1.0)


def han_variants(x: list[float], y: int) -> list[tuple[tuple, int]]:
    """A labelled example and what other texts may have in its place (``fN`` is feature N of ``han_features``).

    A name may have another length, ending or surname, but unknown parts only where its context
    is plain. A word may stand before an honorific, be unknown, or be read together with a name.
    """

    def put(**new):
        z = list(x)
        for k, v in new.items():
            z[0 if k == "score" else int(k[1:])] = v
        return tuple(z), y

    out = [(tuple(x), y)]
    if y:
        plain = x[1] or x[3] or x[8] or x[9] and x[11]
        for score in (1.0, 0.6, 0.0) if plain else (1.0, 0.6):
            for n in (-1, 0, 1):
                for end in (0.0, x[7]):
                    out.append(put(score=score, f5=x[5] + n, f7=end))
        if x[10] and x[5] >= 3:
            out += [put(score=s, f5=n, f8=0.0, f9=0.0, f11=led, f7=0.0) for s in (1.0, 0.6) for n in (x[5], x[5] + 1) for led in (0.0, x[11])]
        if x[1]:
            out.append((put(score=0.0, f12=2.0, f5=x[5] + 2)[0], 0))
    else:
        if x[0] < 0 and not x[1]:
            out += [put(f1=1.0, f2=0.0, f3=0.0, f5=n, f6=end) for n in (2, x[5]) for end in (0.0, 1.0)]
        if not (x[1] or x[3] or x[8]):
            out += [put(score=0.0), put(score=0.0, f5=2.0, f6=0.0)]
    return out


#: Written by hand, as the tables have none: versions, decorators, quantities, paths. They are no addresses.
NO_MAIL = ("lodash@4.17.21", "react@18.2.0-rc.1", "core-js@3.31.0", "pkg_a @ 1.0.0", "5 @ 3.50", "12 @ 0.99", "3@4.50", "value @app.route('/x')", "end @pytest.mark.skip", "x @functools.wraps(f)", "self @property.setter", "git@host.example:team/repo.git", "deploy@box.example:/srv/www", "app@sha256.abc/layer")
NO_MAIL_FRAMES = ("{}", "see {} now", "({})", "x\n{}\ny", "npm i {}", "def {}")


#: North American numbers, which are written without any sign before them.
NANP = re.compile(r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}")


def label(kind: str, t: str, a: int, b: int, x: list[float], lex_scores: float) -> int | None:
    if kind == "email":
        return 1
    if kind in ("phone", "id_number"):
        digits, plus, date = x[0], x[1], x[20]
        phone, ident, thing = x[12] <= 2, x[13] <= 3, x[14] <= 2
        if ident and not thing:
            return int(kind == "id_number" and (x[13] == 1 or not date))
        if date or thing:
            return 0
        if plus and digits >= 9 or NANP.fullmatch(t, a, b):
            return int(kind == "phone")
        if phone and digits >= 6:
            return int(kind == "phone")
        if x[11] and x[17]:
            return 0 if kind == "phone" or x[13] == 9 else None
        return None if x[18] or x[21] else 0
    if kind == "address":
        if x[2] and (x[0] or x[3]) or x[12] and not x[10]:
            return 1
        if x[6] == 1 and x[13]:
            return 1  # named as an address, and a town behind it
        if x[6] <= 2 or x[13]:
            return None
        return 0
    near = CUE.search(t, max(0, a - 26), a)
    if x[9]:
        return 0
    if near and x[0] < -0.15 and lex_scores:
        return None  # an ordinary word, or a name that is spelt like one
    if near or x[0] > 0.45:
        return 1
    if x[4] or x[11] and x[0] > -0.15:
        return None  # beside an initial or before a comma a rare surname may stand
    return 0 if x[0] < 0.1 else None


#: Context features of each kind, blanked in a third of the examples: index and neutral value.
CONTEXT = {"phone": {12: 9, 13: 9, 14: 9}, "id_number": {12: 9, 14: 9}, "address": {6: 9, 14: 0}, "name": {6: 0, 7: 0.1, 8: 0.1}, "email": {}, "han": {}}


def held_out(text: str) -> bool:
    """A fifth of the texts: thresholds are set on them, trees don't see them."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()[0] % 5 == 0


def rare(word: str) -> bool:
    """A fifth of the names: to measure how well names are found that neither lexicon nor priors know."""
    return hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest()[1] % 5 == 0


def examples(kind: str, t: str, a: int, b: int, x: list[float], lex: dict, rnd: random.Random) -> list[tuple[list[float], int]]:
    """A span's labelled examples: as it is, and as other corpora would show it."""
    known = kind == "name" and any(w.lower() in lex for w in re.findall(r"[^\W\d_]+", t[a:b]))
    y = label(kind, t, a, b, x, float(known))
    if y is None:
        return []
    if rnd.random() < 0.33:
        for k, v in CONTEXT[kind].items():
            x[k] = v
    out = [(x, y)]
    if kind == "address" and y:  # a street is also told by a word that says so before it, or by a town behind it, without a type word
        plain = list(x)
        plain[0] = plain[12] = 0.0
        plain[2], plain[3], plain[6], plain[13], plain[14] = float(rnd.random() < 0.3), 0.0, float(rnd.choice((1, 2, 3))), 1.0, float(rnd.random() < 0.5)
        out.append((plain, 1))
        bare = list(x)
        bare[2] = bare[3] = 0.0
        bare[0] = bare[12] = 1.0
        bare[6], bare[13] = float(rnd.choice((1, 2, 9))), float(rnd.random() < 0.5)
        out.append((bare, 1))
    if kind != "name":
        return out
    # a name that lexicon and priors lack is known by its context only
    if rnd.random() < 0.5 and (not y or x[6] or x[7] >= 0.5):
        out.append(([-0.4, -0.4, -0.4, *x[3:18], 0.0], y))
    if y and x[3] > 1:  # a common given name before a surname that nobody knows, and the other way round
        out += [([0.75, -0.4, 0.17, *x[3:18], 1.0], y), ([0.2, -0.4, -0.1, *x[3:18], 0.0], y) if x[6] or x[7] >= 0.5 else ([0.75, 0.2, 0.5, *x[3:18], 1.0], y)]
    if x[4] and y:  # nor is a surname beside an initial always known
        out.append(([-0.1, -0.1, -0.1, *x[3:]], y))
    if x[9]:  # a firm may be called as persons are
        out += [([v, v, v, *x[3:18], float(v > 0.5)], 0) for v in (0.0, 0.4, 0.9)]
    return out


def main(path: str, *only: str) -> None:
    """Train the named kinds, or all; the trees of the others stay."""
    kinds = only or P.MODELS
    rnd = random.Random(5)
    all_texts = texts(path)
    stored = P.model()
    stored.setdefault("before", {})
    stored.setdefault("after", {})
    known: dict = {}
    for _ in range(3):  # contexts teach names, names teach contexts
        before, after = contexts(all_texts, lambda w: given(w) > 0 or known.get(w, 0) > 0.5)
        CUE.words = frozenset(w for w, v in before.items() if v >= 0.6)
        lex, ends = lexicon(all_texts)
        known = lex
    print("words that lead to names:", " ".join(sorted(CUE.words)))
    P.model().update(han=han_tables(all_texts), before=before, after=after)
    P._left_of_name.cache_clear()
    P._right_of_name.cache_clear()
    data: dict[str, tuple[Counter, Counter]] = {k: (Counter(), Counter()) for k in P.MODELS}
    memo: dict = {}
    sample = rnd.sample(all_texts, min(len(all_texts), 16_000))
    for t in sample + [t for t in all_texts if P.HAN.search(t)]:
        part = held_out(t)
        for kind, a, b, x in P.candidates(t, lex, ends, memo):
            if kind not in kinds or P._CASELESS.search(t[a:b]):
                continue
            x = [float(v) for v in x]
            if kind == "han":
                for v in han_variants(x, han_label(t, a, b, x[0])):
                    data[kind][part][v] += 1
                continue
            for v, y in examples(kind, t, a, b, x, lex, rnd):
                data[kind][part][tuple(v), y] += 1
    if "email" in kinds:
        for n, frame in enumerate(NO_MAIL_FRAMES):
            for s in NO_MAIL:
                for kind, *_, x in P.candidates(frame.format(s), lex, ends, memo):
                    if kind == "email":
                        data[kind][n == 0][tuple(map(float, x)), 0] += 3
    trees, threshold = dict(stored["trees"]), dict(stored["threshold"])
    for kind in kinds:

        def arrays(rows: Counter):
            keep = rows.most_common(8000)
            return np.array([r[0][0] for r in keep]), np.array([r[0][1] for r in keep], float), np.minimum(np.array([r[1] for r in keep], float), 30) ** 0.7

        x, y, w = arrays(data[kind][0])
        trees[kind] = boosting.fit(x, y, w, rounds=40, depth=4) if 0 < y.mean() < 1 else {"start": 5.0, "trees": []}
        hx, hy, hw = arrays(data[kind][1])
        f = np.array([boosting.score(trees[kind], r) for r in hx])
        # calibrated on the held-out texts: the threshold with the best F1 there, the one nearest to even odds if several have it
        grid = np.linspace(-2, 2, 41)
        f1 = [2 * (hw * hy * (f > c)).sum() / max(1e-9, (hw * hy).sum() + (hw * (f > c)).sum()) for c in grid]
        best = max(f1)
        threshold[kind] = round(float(min(grid[np.array(f1) >= best - 1e-4], key=abs)), 2)
        at = f > threshold[kind]
        print(kind, len(x), "distinct rows, positive", round(float(y.mean()), 3), "held out:", len(hx), "rows, recall", round(float((hw * hy * at).sum() / (hw * hy).sum()), 4), "precision", round(float((hw * hy * at).sum() / max(1e-9, (hw * at).sum())), 4), "threshold", threshold[kind])
    P.model().update(lex=lex, ends=ends, trees=trees, threshold=threshold)
    if "name" in kinds:
        report(all_texts, lex, ends, trees["name"], threshold["name"])
    P.MODEL.write_text(json.dumps({"lex": lex, "ends": ends, "before": before, "after": after, "han": stored["han"], "trees": trees, "threshold": threshold}, ensure_ascii=False, separators=(",", ":")))
    print(len(lex), "tokens", len(ends), "endings", len(before), len(after), "contexts", P.MODEL.stat().st_size)


def report(all_texts: list[str], lex: dict, ends: dict, tree: dict, threshold: float) -> None:
    """Recall of mentions in the held-out texts whose every word is one of the rare names, with these unknown to lexicon and priors."""
    less = {w: s for w, s in lex.items() if not (s > 0.1 and rare(w))}
    blank = {}

    def spans(words_of, t):
        words = words_of(t)
        got = P.name_spans(t, words)
        return got + P.low_spans(t, words, got, less)

    def unknown(t):
        return [(a, b, w, -0.4 if rare(w.lower()) and lex.get(w.lower(), 0.2) > 0.1 else s) for a, b, w, s in P.scored_words(t, less, ends, blank)]

    have = found = half = half_found = 0
    for t in (t for t in all_texts if held_out(t)):
        whole = spans(lambda t: P.scored_words(t, lex, ends, {}), t)
        part = {(a, b) for a, b, sc, ini in whole if len(sc) > 1 and 0 < sum(rare(w.lower()) and lex.get(w.lower(), 0) > 0.3 for w in re.findall(r"[^\W\d_]+", t[a:b])) < len(sc) and boosting.score(tree, P.name_features(t, a, b, sc, ini)) > threshold}
        if part:
            got = {(a, b) for a, b, sc, ini in spans(unknown, t) if boosting.score(tree, P.name_features(t, a, b, sc, ini)) > threshold}
            half, half_found = half + len(part), half_found + len({a for a, _ in part} & {a for a, _ in got})
        truth = {(a, b) for a, b, sc, ini in spans(lambda t: P.scored_words(t, lex, ends, {}), t) if all(rare(w.lower()) and lex.get(w.lower(), 0) > 0.3 for w in re.findall(r"[^\W\d_]+", t[a:b])) and boosting.score(tree, P.name_features(t, a, b, sc, ini)) > threshold}
        if truth:
            got = {(a, b) for a, b, sc, ini in spans(unknown, t) if boosting.score(tree, [*P.name_features(t, a, b, sc, ini)[:18], 0.0]) > threshold}
            have, found = have + len(truth), found + len(truth & got)
    print("names unknown to everything:", found, "of", have, "names one part of which is unknown:", half_found, "of", half)


if __name__ == "__main__":
    main(*sys.argv[1:])
