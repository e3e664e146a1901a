"""URL filter: rules first, else logistic regression on hashed character n-grams.

A rule is (host/path, verdict). It fits its host and all subdomains where the url's
path starts with the rule's path; the longest rule wins (ties: the smaller rule by
code point). Urls that no rule fits are judged by a logistic regression on n-grams
of 3 to 5 characters of host and path, hashed to a fixed number of weights and
trained on a small table of labelled urls, by default the file labelled_urls.csv beside
this module (1: keep); at most TRAIN_ROWS of them reach the driver. Batches are judged
whole: n-grams by one pass over code points, rules once for each distinct host.

Defined cases: a null url or one without `://` has an empty host and path and is
still judged by the model; an empty path starts with no rule's path; repeated urls
get equal verdicts; a very long url is judged on all of its n-grams; keep columns named
like a result column are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise as bw
from . import common

BITS = 18
GRAMS = (3, 4, 5)
TRAIN_ROWS = 20_000
LABELLED = Path(__file__).with_name("labelled_urls.csv")
RESULT = ["host", "path", "rule", "verdict", "score"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def labelled_urls() -> list[tuple[str, int]]:
    """The rows of the default labelled table (1: keep)."""
    with LABELLED.open(encoding="utf-8", newline="") as f:
        return [(r["url"], int(r["label"])) for r in csv.DictReader(f)]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column, both empty where it has no ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    plain = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(plain, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(plain, r"(?s)^[^/]*(.*)$", 1)


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(url, slot): the distinct hashed n-grams of 3 to 5 characters of each host and each path."""
    found = [np.zeros(0, np.int64)]
    for part, texts in enumerate((hosts, paths)):
        marked = [f"^{t}$" for t in texts]
        size = np.array([len(t) for t in marked], np.int64)
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(size) - size
        for n in GRAMS:
            count = np.maximum(size - n + 1, 0)
            at = bw.runs(first, count)
            if len(at):
                h = bw.mix(bw.span_hash(points, at, at + n) ^ np.uint64(8 * part + n))
                found.append(np.repeat(np.arange(len(texts)), count) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def logits(owner: np.ndarray, slot: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    return np.bincount(owner, w[slot], n) / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1)) + w[-1]


def train(labelled: list[tuple[str, str, int]], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) fitted to (host, path, label) rows by Adam steps."""
    y = np.array([label for _, _, label in labelled], float)
    every = np.zeros((1 << BITS) + 1)
    if not len(y) or y.min() == y.max():
        return every
    n = len(y)
    owner, slot = grams([h for h, _, _ in labelled], [p for _, p, _ in labelled])
    known, slot = np.unique(slot, return_inverse=True)  # slots without a gram keep a weight of 0
    w = np.zeros(len(known) + 1)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        e = (1 / (1 + np.exp(-logits(owner, slot, n, w))) - y) / n
        g = np.bincount(slot, (e * scale)[owner], len(w)) + ridge * w / np.sqrt(n)
        g[-1] = e.sum()
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    every[known], every[-1] = w[:-1], w[-1]
    return every


def rule_table(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """host -> (path, rule, verdict)."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    return out


def fitting(host: str, table: dict) -> tuple[tuple[str, str, str], ...]:
    """The rules (path, rule, verdict) of a host and all hosts above it, longest first."""
    labels = host.split(".") if host else []
    fits = [x for i in range(len(labels)) for x in table.get(".".join(labels[i:]), ())]
    return tuple(sorted(fits, key=lambda x: (-len(x[1]), x[1])))


def judged(hosts: pa.Array, paths: pa.Array, table: dict) -> tuple[list, list]:
    """(rule, verdict) of each url, None where no rule fits."""
    coded = hosts.dictionary_encode()
    per_host = [fitting(h, table) for h in coded.dictionary.to_pylist()]
    kinds = {k: i for i, k in enumerate(dict.fromkeys(per_host))}
    kind = np.array([kinds[k] for k in per_host], np.int64)[coded.indices.to_numpy()] if len(hosts) else np.zeros(0, np.int64)
    choice = np.full(len(hosts), -1, np.int64)
    options: list[tuple[str, str, str]] = []
    for rules, i in kinds.items():
        rows = np.flatnonzero(kind == i)
        for rule in rules:
            if not len(rows):
                break
            fits = np.asarray(pc.starts_with(paths.take(pa.array(rows)), rule[0]))
            choice[rows[fits]] = len(options)
            rows = rows[~fits]
            options.append(rule)
    return [options[c][1] if c >= 0 else None for c in choice], [options[c][2] if c >= 0 else None for c in choice]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The keep columns with host, path, rule, verdict and the model's score, for every row.

    rules is a list in the driver; labelled has url and label (1: keep) and defaults
    to labelled_urls(). Nothing is shuffled: the model and the rules go to every task.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, label int")
    rows = labelled.where("label is not null").select(*(c.alias(n) for c, n in zip(host_path(F.col("url")), ("host", "path"))), "label").orderBy(F.xxhash64("host", "path", "label")).limit(TRAIN_ROWS).collect()
    weights = train([(r["host"], r["path"], r["label"]) for r in rows])
    table = rule_table(rules)

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(0), batch.column(1)
            rule, verdict = judged(hosts, paths, table)
            p = 1 / (1 + np.exp(-logits(*grams(hosts.to_pylist(), paths.to_pylist()), batch.num_rows, weights)))
            verdict = [v or ("allow" if ok else "block") for v, ok in zip(verdict, p >= 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(p, pa.float64())], [*batch.schema.names, "rule", "verdict", "score"])

    host, path = host_path(F.col(url))
    df = pages.select(host.alias("host"), path.alias("path"), *[F.col(f"`{c}`") for c in keep if c.lower() not in RESULT])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(task, f"{own}, rule string, verdict string, score double").select(*[F.col(f"`{f.name}`") for f in df.schema.fields[2:]], *RESULT)
