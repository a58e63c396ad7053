"""Problem 8: subject areas of documents.

Labelling functions look at the parts of a thread: a lexicon of word sequences
in the title, in the body of the question and in its answers (code and asides left
out), in the addresses of the pages that it links, its tags, the usual subjects of
its source, which are counted on the way, and labels given by hand or tool. For each (thread, subject) their outcomes form
a pattern of a few levels. Counts of the patterns over all threads, a table of
bounded size, are all that the latent model needs: expectation-maximisation
learns how each function behaves where the subject is and is not the thread's,
without true labels. Subjects with a posterior above ``LEAST`` are assigned, at
least the best one, to the question and to every answer.

The lexicon is trained by ``train_subjects.py`` and stored beside this module.
Defined cases: rows without a thread_id form a thread of their own; null texts,
titles and tags say nothing; a thread without any sign takes the most frequent
subject of its source, else of the corpus, so every row comes out.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.mixing import source_key
from textloom.session import bounded_rows, checkpoint_dir

MODEL = Path(__file__).with_name("models") / "subjects.json"
LEAST = 0.5
#: Levels of the patterns: hits in title, question and answers, tags, labels and the source's usual subjects.
LEVELS = {"title": 3, "body": 5, "answers": 5, "tags": 2, "address": 2, "label": 3, "usual": 2}
#: A source's usual subjects are those of at least this share of its threads that say theirs clearly.
USUAL = 0.25
SOURCES = 100_000
_CODE = re.compile(r"```.*?(?:```|\Z)|<pre>.*?(?:</pre>|\Z)|<code>.*?(?:</code>|\Z)|^(?: {4}|\t).*$", re.S | re.M)
_ADDRESS = re.compile(r"https?://\S+|www\.\S+")
#: Words that open an aside, in small letters.
ASIDE = (
    "by the way", "btw", "as an aside", "incidentally", "on a side note", "off topic", "unrelated", "speaking of which", "ps", "p.s.",
    "übrigens", "nebenbei", "apropos", "au fait", "d'ailleurs", "soit dit en passant", "à propos", "por cierto", "dicho sea de paso", "a propósito",
    "nawiasem mówiąc", "przy okazji", "a propos", "кстати", "между прочим",
)
#: A comparison at the beginning of a sentence: what things are likened to is not their subject.
_SIMILE = re.compile(r"(?:(?:it|this|that)(?:'s|’s| is| was| feels| looks)(?: \w+){0,3} like|(?:es|das)(?: ist| war)(?: \w+){0,3} wie|c['’]est(?: \w+){0,3} comme|es(?: \w+){0,3} como|to(?: \w+){0,3} jak)\b")
_SENTENCE = re.compile(r"(?<=[.!?)])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
N = 4


def sentences(text: str) -> list[list[str]]:
    """Words of the sentences that say something about the subject: no asides, which open as such or stand in brackets, and no comparisons."""
    text = _ADDRESS.sub(" ", _CODE.sub(" ", text))
    return [_WORD.findall(s) for x in _SENTENCE.split(text) if (s := x.lower().strip()) and s[0] != "(" and not s.startswith(ASIDE) and not _SIMILE.match(s)]


def address_words(text: str | None) -> str:
    """The words of the addresses in a text."""
    return " . ".join(" ".join(_WORD.findall(a.split("//")[-1])) for a in _ADDRESS.findall(text or ""))


@lru_cache(1)
def model() -> dict:
    return json.loads(MODEL.read_text())


@lru_cache(1)
def _lengths() -> dict[str, int]:
    """How many words the longest sequence has that begins with a word."""
    out: dict[str, int] = {}
    for g in model()["lexicon"]:
        ws = g.split(" ")
        out[ws[0]] = max(out.get(ws[0], 0), len(ws))
    return out


def hits(text: str | None, lex: dict[str, list]) -> dict[str, float]:
    """Weight of the lexicon's sequences found, by subject; the longest at a place counts."""
    out: dict[str, float] = defaultdict(float)
    if not text:
        return out
    get, longest = lex.get, _lengths().get
    for ws in sentences(text):
        k, n = 0, len(ws)
        last, end, counted = None, -1, 0.0  # words of one term stand side by side and count once
        while k < n:
            for m in range(min(longest(ws[k], 0), n - k), 0, -1):
                found = get(ws[k] if m == 1 else " ".join(ws[k : k + m]))
                if found:
                    subject, weight = found
                    if subject == last and end == k:
                        out[subject] += max(0.0, weight - counted)
                        counted = max(counted, weight)
                    else:
                        out[subject] += weight
                        last, counted = subject, weight
                    k += m - 1
                    end = k + 1
                    break
            k += 1
    return out


_EVIDENCE = "array<struct<subject:string,title:double,body:double,tags:double,address:double>>"
_EVIDENCE_PA = pa.list_(pa.struct([("subject", pa.string()), ("title", pa.float64()), ("body", pa.float64()), ("tags", pa.float64()), ("address", pa.float64())]))


def evidence(docs: DataFrame) -> DataFrame:
    """``(doc_id, thread, source, question, evidence)``: what the lexicon finds in each row."""
    spread = docs.select(
        "doc_id", F.coalesce("thread_id", "doc_id").alias("thread"), F.coalesce(source_key("source"), F.lit("")).alias("source"),
        F.coalesce(F.col("post_type") == "question", F.col("thread_id") == F.col("doc_id"), F.lit(True)).alias("question"), "title", "text", F.concat_ws(" . ", "tags").alias("tags"),
    )
    kept = ["doc_id", "thread", "source", "question"]

    def run(batches):
        lex = model()["lexicon"]
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            out = []
            for title, text, tags in zip(col("title").to_pylist(), col("text").to_pylist(), col("tags").to_pylist()):
                t, x, g, a = hits(title, lex), hits(text, lex), hits(tags, lex), hits(address_words(text), lex)
                out.append([{"subject": s, "title": t.get(s, 0.0), "body": x.get(s, 0.0), "tags": g.get(s, 0.0), "address": a.get(s, 0.0)} for s in {*t, *x, *g, *a}])
            yield pa.RecordBatch.from_arrays([col(c) for c in kept] + [pa.array(out, _EVIDENCE_PA)], names=[*kept, "evidence"])

    return spread.mapInArrow(run, f"doc_id bigint, thread bigint, source string, question boolean, evidence {_EVIDENCE}")


def _steps(col: str, cuts: tuple[float, ...]):
    return sum((F.col(col) >= c).cast("int") for c in cuts[1:]) + (F.col(col) >= cuts[0]).cast("int") if cuts else F.lit(0)


def patterns(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """Evidence of rows, the pattern of levels of each (thread, subject) that has any sign, and the usual subjects of sources."""
    checkpoint_dir(docs.sparkSession)
    seen = evidence(docs).checkpoint()  # narrow; the texts are read once, however often the evidence is used
    one = seen.select("thread", "source", "question", F.explode("evidence").alias("e"))
    facts = one.groupBy("thread", F.col("e.subject").alias("subject")).agg(
        F.sum(F.when(F.col("question"), F.col("e.title")).otherwise(0.0)).alias("title"),
        F.sum(F.when(F.col("question"), F.col("e.body")).otherwise(0.0)).alias("body"),
        F.sum(F.when(F.col("question"), 0.0).otherwise(F.col("e.body"))).alias("answers"),
        F.sum("e.tags").alias("tags"),
        F.sum("e.address").alias("address"),
        F.max(F.when(F.col("question"), F.col("source"))).alias("source"),
        F.lit(0).cast("bigint").alias("votes"),
    )
    spelt = F.regexp_replace(F.lower("subject"), r"[^\p{L}]+", "")
    given = labels.select("doc_id", spelt.alias("subject")).filter(F.col("subject").isin(subjects)).dropDuplicates()
    where = docs.select("doc_id", F.coalesce("thread_id", "doc_id").alias("thread"))
    votes = where.join(given, "doc_id").groupBy("thread", "subject").agg(F.count("*").alias("votes"))
    zero = F.lit(0.0)
    both = facts.unionByName(votes.select("thread", "subject", zero.alias("title"), zero.alias("body"), zero.alias("answers"), zero.alias("tags"), zero.alias("address"), F.lit(None).cast("string").alias("source"), "votes"))
    both = both.groupBy("thread", "subject").agg(*(F.sum(c).alias(c) for c in ("title", "body", "answers", "tags", "address", "votes")), F.max("source").alias("source"))
    usual = usual_subjects(both)
    is_usual = F.lit(False)
    if usual:
        pairs = docs.sparkSession.createDataFrame([(s, x, True) for s, xs in usual.items() for x in xs], "source string, subject string, usual boolean")
        both = both.join(F.broadcast(pairs), ["source", "subject"], "left")
        is_usual = F.col("usual")
    total = F.col("title") * 2 + F.col("body") + F.col("answers") * 0.7 + F.col("tags")
    w = Window.partitionBy("thread")
    levels = both.withColumn("total", total).withColumn("labelled", F.max("votes").over(w))
    return seen, levels.select(
        "thread", "subject", "total",
        _steps("title", (0.4, 1.4)).alias("l_title"), _steps("body", (0.4, 1.4, 2.6, 4.5)).alias("l_body"), _steps("answers", (0.4, 1.6, 3.5, 7.0)).alias("l_answers"), (F.col("tags") > 0.3).cast("int").alias("l_tags"), (F.col("address") > 0.3).cast("int").alias("l_address"),
        F.when(F.col("votes") > 0, 2).when(F.col("labelled") > 0, 1).otherwise(0).alias("l_label"),
        F.coalesce(is_usual, F.lit(False)).cast("int").alias("l_usual"),
    ), usual


def usual_subjects(facts: DataFrame) -> dict[str, list[str]]:
    """The usual subjects of each source, the most frequent first, by the threads whose title and body say theirs clearly; of the
    whole corpus under ''. One small row for each source and subject comes to the driver, at most ``SOURCES``."""
    clear = facts.filter((F.col("title") >= 1.4) | (F.col("body") >= 2.6)).groupBy("source", "subject").count()
    got: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in bounded_rows(clear, SOURCES, "subjects of sources"):
        got[r.source or "\0"].append((r["count"], r.subject))
    whole: dict[str, int] = defaultdict(int)
    for xs in got.values():
        for n, x in xs:
            whole[x] += n
    out = {s: [x for n, x in sorted(xs, key=lambda v: (-v[0], v[1])) if n >= USUAL * sum(v[0] for v in xs)] or [max(xs)[1]] for s, xs in got.items() if s != "\0"}
    return out | ({"": sorted(whole, key=lambda x: (-whole[x], x))[:1]} if whole else {})


NAMES = tuple(f"l_{n}" for n in LEVELS)


def learn(counts: dict[tuple[int, ...], int], start: list[list[list[float]]], rounds: int = 40) -> tuple[list, float]:
    """Expectation-maximisation of two classes with independent functions: their level frequencies, and the base rate.

    ``start``: first guess, ``[class][function][level]``. Its weight stays as a prior of ``PRIOR`` rows.
    """
    theta = [[list(f) for f in c] for c in start]
    base = 0.4
    for _ in range(rounds):
        got = [[[p * PRIOR for p in f] for f in c] for c in start]
        mass, whole = PRIOR * base, PRIOR
        for pattern, n in counts.items():
            p = posterior(pattern, theta, base)
            mass, whole = mass + n * p, whole + n
            for k, v in enumerate(pattern):
                got[1][k][v] += n * p
                got[0][k][v] += n * (1 - p)
        theta = [[[x / sum(f) for x in f] for f in c] for c in got]
        base = mass / whole
    return theta, base


PRIOR = 400.0


def posterior(pattern: tuple[int, ...], theta: list, base: float) -> float:
    z = math.log(base / (1 - base)) + sum(math.log((theta[1][k][v] + 1e-6) / (theta[0][k][v] + 1e-6)) for k, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def assign(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``(doc_id, subject, posterior)``, one row for each subject of each document."""
    subjects = [r.subject for r in bounded_rows(areas.select("subject"), 1000, "subject areas") if r.subject]
    seen, pats, usual = patterns(docs, labels, subjects)
    limit = math.prod(LEVELS.values())
    counts = {tuple(r[n] for n in NAMES): r["count"] for r in bounded_rows(pats.groupBy(*NAMES).count(), limit, "patterns")}
    theta, base = learn(counts, model()["start"])
    rows = [(*p, float(posterior(p, theta, base))) for p in counts]
    spark = docs.sparkSession
    table = spark.createDataFrame(rows or [(*[-1] * len(NAMES), 0.0)], ", ".join(f"{n} int" for n in NAMES) + ", posterior double")
    scored = pats.join(F.broadcast(table), list(NAMES))
    order = Window.partitionBy("thread").orderBy(F.desc("posterior"), F.desc("total"), "subject")
    chosen = scored.withColumn("rn", F.row_number().over(order)).filter((F.col("posterior") > LEAST) | (F.col("rn") == 1)).select("thread", "subject", "posterior")
    common = F.lit(usual.get("", sorted(subjects)[:1] or [None])[0])
    fallback = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for s, xs in usual.items() for x in (s, xs[0]))), F.col("source")), common) if usual else common
    out = seen.select("doc_id", "thread", "source").join(chosen, "thread", "left")
    return out.select("doc_id", F.coalesce("subject", fallback).alias("subject"), F.coalesce("posterior", F.lit(0.0)).alias("posterior"))
