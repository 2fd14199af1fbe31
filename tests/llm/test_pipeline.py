"""The pipeline against a plain version of its five stages, and driver queries against their SQL."""

import re
from collections import defaultdict

import numpy as np

import __spark_entry__ as driver
import corpus_pipeline
from checks.compare import connect, same
from riskframe.llm import decontam, langid, linededup, pieces

from .test_documents import _plain_simhash, _whole_viterbi


def _languages(docs):
    """Plain bundles of all training texts, then the cosine of every text."""
    train = [d for d in docs if d["lang"] and not _held_out(d["doc_id"])]
    names = sorted({d["lang"] for d in train})
    unit = []
    for name in names:
        total = langid.bundle([d["text"] for d in train if d["lang"] == name]).astype(float).sum(axis=0)
        unit.append(total / np.linalg.norm(total))
    kept = []
    for d, v in zip(docs, langid.bundle([d["text"] for d in docs]).astype(float)):
        best = max(v @ u for u in unit) / max(np.linalg.norm(v), 1e-9)
        if v.any() and not (len(d["text"]) >= 20 and best < 0.02):
            kept.append(d)
    return kept


def _held_out(doc_id):
    import zlib
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _lines(docs):
    sites = defaultdict(set)
    for d in docs:
        for line in d["text"].split("\n"):
            sites[line.strip(" ").lower()].add(d["source"])
    seen, kept = set(), []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        lines = []
        for line in d["text"].split("\n"):
            key = line.strip(" ").lower()
            spread = line.strip(" ") != "" and len(sites[key]) >= linededup.MIN_SITES
            if not spread or key not in seen:
                lines.append(line)
            if spread:
                seen.add(key)
        if len(lines) == d["text"].count("\n") + 1 or "\n".join(lines).strip(" "):
            kept.append({**d, "text": "\n".join(lines)})
    return kept


def _copies(docs):
    marks = [_plain_simhash(d["text"]) for d in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [d for i, d in enumerate(docs) if group[i] == i]


def _grams(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _benchmark(docs, items):
    grams = [g for g in map(_grams, items) if g]
    return [d for d in docs if not any(
        len(g & own) >= decontam.THRESHOLD * len(g) for own in [_grams(d["text"])] for g in grams)]


def test_pipeline_equals_plain_stages(spark, sf_dir, documents):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = sorted((r.asDict() for r in documents.collect()), key=lambda d: d["doc_id"])
    vocab, sizes = pieces.vocabulary(pieces.MODEL), []
    for plain in (_languages, _lines, _copies, lambda d: _benchmark(d, items)):
        docs = plain(docs)
        sizes.append(len(docs))
    want = {d["doc_id"]: _whole_viterbi((" " + d["text"]).replace(" ", pieces.MARK), vocab) for d in docs}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == want and len(found) == len(want) == sizes[-1]
    assert all(r["round_trip"] for r in found) and sizes[-1] < sizes[1] < documents.count() + 1


def test_stages_keep_the_columns_of_documents(spark, sf_dir, documents):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, sf_dir).columns == documents.columns


def test_queries_equal_sql(spark, sf_dir):
    duck, queries, sql = connect(sf_dir), driver.queries(), driver.oracle_sql()
    names = [n for n in sql if re.match(r"op\d+_|pipeline$", n)]
    assert names and all(same(queries[n](spark, sf_dir), duck, sql[n]) == "" for n in names)
    assert {int(n[2:].split("_")[0]) for n in queries if re.match(r"op\d+_", n)} == set(range(1, 14))
