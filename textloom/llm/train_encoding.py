"""Count character bigrams of clean text for the plausibility cost; run as a module with a data directory.

Office texts come as they are; of text_doc, whose texts may be damaged, only
lines that a first model cannot improve by any step are added. Bigrams of two
ASCII characters are left out. The sample is at most ``LIMIT`` texts of a table.
"""

from __future__ import annotations

import json
import sys
from collections import Counter

import pandas as pd

from textloom.llm import encoding as E

LIMIT = 60_000
DROP = set("\u00ad\u034f\u200b\u200c\u2060\ufeff�")


def texts(path: str, table: str) -> list[str]:
    t = pd.read_parquet(f"{path}/{table}.parquet", columns=["text"]).text.dropna().drop_duplicates()
    return list(t.iloc[pd.util.hash_array(t.to_numpy()).argsort()][:LIMIT])


def count(lines: list[str]) -> Counter:
    out: Counter = Counter()
    for t in lines:
        t = f" {t} ".replace("\n", " ")
        for k in range(len(t) - 1):
            if (t[k] > "\x7f" or t[k + 1] > "\x7f") and t[k] not in DROP and t[k + 1] not in DROP:
                out[f"{E.symbol(t[k])}\t{E.symbol(t[k + 1])}"] += 1
    return out


def main(path: str) -> None:
    # spelling tricks (letters of other scripts, styled letters) are not to look plausible
    clean = [t for t in texts(path, "segment") + texts(path, "pdf_page") if not DROP & set(t)]
    counts = count(clean)
    rough = Counter({k: v for k, v in counts.items() if v >= 5})
    first = E.Plausibility(rough)
    lines = [x for t in texts(path, "text_doc") for x in t.split("\n") if not x.isascii() and "�" not in x]
    kept = [x for x in lines if not first.suspect(x) or not E.search(x, first)[1]]
    print(len(lines), "lines,", len(kept), "clean")
    counts = rough + count(kept)
    E.MODEL.write_text(json.dumps({k: v for k, v in counts.items() if v >= 2}, ensure_ascii=False, separators=(",", ":")))
    print(len(counts), "bigrams")


if __name__ == "__main__":
    main(sys.argv[1])
