"""Train the subject lexicon; run as a module with a data directory (and others).

Word sequences of up to four words are counted by thread. Threads with labels
start the model; sequences pass the labels on to threads without any: a sequence
has a distribution over subjects, a thread has one from its sequences, and both
are re-estimated in turn. Labels are trusted in part only. Sequences that stay
spread over the subjects are dropped. Labelled rows: at most ``LABELS``; threads:
at most ``LIMIT`` of each directory, in the order of a hash.
"""

from __future__ import annotations

import json
import math
import os
import sys
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from textloom.llm import subjects as S

LABELS, LIMIT = 10_000, 8_000
MEASURE = bool(os.environ.get("TEXTLOOM_MEASURE"))


def held_out(thread: int) -> bool:
    """A fifth of the threads, which the lexicon is not learnt from where TEXTLOOM_MEASURE is set."""
    return hash((int(thread), 2)) % 5 == 0


def main(paths: list[str]) -> None:
    names = None
    bags: list[Counter] = []
    parts: list[dict[str, str]] = []
    gold: list[dict[int, float]] = []
    sources: list[str] = []
    for path in paths:
        docs = pd.read_parquet(f"{path}/documents.parquet", columns=["doc_id", "thread_id", "post_type", "title", "text", "tags", "source"])
        names = names or sorted(pd.read_parquet(f"{path}/subject_area.parquet").subject)
        lab = pd.read_parquet(f"{path}/doc_label.parquet")[:LABELS].dropna(subset=["subject"])
        lab["subject"] = lab.subject.str.lower().str.replace(r"[^a-z]+", "", regex=True)
        votes = defaultdict(list)
        for d, s in zip(lab.doc_id, lab.subject):
            if s in names:
                votes[d].append(names.index(s))
        docs["thread_id"] = docs.thread_id.fillna(docs.doc_id)
        order = sorted(set(docs.thread_id), key=lambda x: hash((int(x), 1)))
        order = [t for t in order if not (MEASURE and held_out(t))][:LIMIT]
        for thread, g in docs[docs.thread_id.isin(set(order))].groupby("thread_id"):
            bag, part, y = Counter(), defaultdict(str), Counter()
            for d, kind, title, text, tags, src in zip(g.doc_id, g.post_type, g.title, g.text, g.tags, g.source):
                whole = "\n".join(x for x in (title, text) if x)
                for ws in S.sentences(whole):
                    for m in range(1, S.N + 1):
                        bag.update({" ".join(ws[k : k + m]) for k in range(len(ws) - m + 1)})
                if kind == "question":
                    part["title"], part["source"] = title or "", "".join(c for c in (src or "").lower() if c.isalnum())
                    part["tags"] = " . ".join(tags) if tags is not None else ""
                part["body" if kind == "question" else "answers"] += "\n\n" + (text or "")
                for v in votes[d]:
                    y[v] += 1
            bags.append(bag)
            parts.append(part)
            gold.append({k: n / sum(y.values()) for k, n in y.items()})
    seen = Counter(g for b in bags for g in b)
    top = 0.2 * len(bags)
    vocab = {g: i for i, g in enumerate(g for g, n in seen.items() if 3 <= n <= top and len(g) > 2)}
    row = np.concatenate([np.full(sum(g in vocab for g in b), k) for k, b in enumerate(bags)]).astype(int)
    col = np.array([vocab[g] for b in bags for g in b if g in vocab])
    print(len(bags), "threads", sum(map(bool, gold)), "labelled", len(vocab), "sequences", len(row))
    k = len(names)
    y = np.zeros((len(bags), k))
    for i, g in enumerate(gold):
        for s, p in g.items():
            y[i, s] = p
    has = y.sum(1) > 0
    theta = y.copy()
    weight = has.astype(float)
    prior = y[has].mean(0)
    for turn in range(12):
        phi = np.stack([np.bincount(col, (theta[:, s] * weight)[row], len(vocab)) for s in range(k)], 1) + 0.15 * prior
        phi /= phi.sum(1, keepdims=True)
        n = np.bincount(col, weight[row], len(vocab))
        lift = phi / prior
        lift /= lift.sum(1, keepdims=True)
        info = (lift * np.log(np.maximum(lift, 1e-9) * k)).sum(1)
        # a sequence says something if it is far from even shares, or keeps to one (frequent) subject almost always
        w = np.maximum(np.clip((info - 0.8) / 1.2, 0, 1), np.clip((phi.max(1) - 0.88) / 0.08, 0, 1)) * (n / (n + 2))
        new = np.stack([np.bincount(row, (phi[:, s] ** 2 * w)[col], len(bags)) for s in range(k)], 1)
        strength = new.sum(1)
        new = np.maximum(new / np.maximum(strength, 1e-9)[:, None] - 0.08, 0)
        new /= np.maximum(new.sum(1, keepdims=True), 1e-9)
        theta = np.where(has[:, None], 0.4 * y + 0.6 * np.where(strength[:, None] > 0.5, new, y), new)
        weight = np.where(has, 1.0, np.minimum(1, strength / 3) * (0.3 if turn < 2 else 1.0))
    best, p = phi.argmax(1), phi.max(1)
    total = np.bincount(col, weight[row], len(vocab))
    lex = {g: [names[best[i]], round(float(min(1.0, max(w[i], (p[i] - 0.5) / 0.35))), 2)] for g, i in vocab.items() if p[i] > 0.62 and total[i] >= 2 and w[i] > 0.25}
    # A longer sequence is kept where it says more than its parts.
    def spare(g: str) -> bool:
        ws = g.split(" ")
        subs = [lex.get(" ".join(ws[a:b])) for a in range(len(ws)) for b in range(a + 1, len(ws) + 1) if b - a < len(ws)]
        same = [x for x in subs if x and x[0] == lex[g][0]]
        return bool(same) and max(x[1] for x in same) >= lex[g][1] - 0.3 and all(x[0] == lex[g][0] for x in subs if x)

    lex = {g: v for g, v in lex.items() if not spare(g)}
    # First guess of the functions' behaviour: levels where labels agree or not, softened.
    start = [[[1.0 / n] * n for n in S.LEVELS.values()] for _ in range(2)]
    guess = {"title": (0.9, 0.07, 0.03, 0.25, 0.45, 0.3), "tags": (0.97, 0.03, 0.8, 0.2), "address": (0.98, 0.02, 0.93, 0.07), "label": (0.85, 0.13, 0.02, 0.8, 0.04, 0.16), "usual": (0.7, 0.3, 0.45, 0.55), "body": (0.45, 0.5, 0.03, 0.01, 0.01, 0.04, 0.06, 0.25, 0.3, 0.35), "answers": (0.45, 0.42, 0.1, 0.02, 0.01, 0.12, 0.18, 0.25, 0.25, 0.2)}
    for j, name in enumerate(S.LEVELS):
        n = S.LEVELS[name]
        start[0][j], start[1][j] = list(guess[name][:n]), list(guess[name][n:])
    S.MODEL.write_text(json.dumps({"lexicon": lex, "start": start}, ensure_ascii=False, separators=(",", ":")))
    print(len(lex), "entries", Counter(v[0] for v in lex.values()), S.MODEL.stat().st_size)


if __name__ == "__main__":
    main(sys.argv[1:])
