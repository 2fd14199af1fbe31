"""Token alignment, prefix trie and near-duplicate vectors against brute force."""

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.llm import alignment, embeddings, trie
from riskframe.llm.mphf import KeyTable

from .conftest import AWKWARD


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_perfect_hash_fills_all_slots_and_knows_its_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
        table = KeyTable.build(keys)
        assert sorted(table.slots(keys)) == list(range(len(keys)))
        assert (KeyTable(type(table.function).from_bytes(table.function.to_bytes()), table.keys).slots(keys)
                == table.slots(keys)).all()
        assert (table.slots(keys + np.uint64(1)) == -1).all()


# --- alignment ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.tokenizer_path(alignment.FIRST))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.tokenizer_path(alignment.SECOND))


def plain_alignment(texts, libraries):
    """Both libraries on whole texts; groups by sets of ends."""
    a, b = libraries
    names = {bytes([v]): k for k, v in alignment._byte_level().items()}
    back = {k: v[0] for v, k in names.items()}
    found = []
    for text in texts:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i)
                 else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            found.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b))
        common = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = dict(zip(ends_a, ids_a)), dict(zip(ends_b, ids_b))
        groups = [([], []) for _ in common]
        for side, (ends, ids) in enumerate(((ends_a, ids_a), (ends_b, ids_b))):
            for end, i in zip(ends, ids):
                groups[bisect_left(common, end)][side].append(str(i))
        groups = ["|".join(map(",".join, g)) for g in groups]
        found.append((len(ids_a), len(ids_b), groups, [(at_a[e], at_b[e]) for e in common]))
    counts = Counter(link for f in found if f for link in f[3])
    best = defaultdict(int)
    for (_, second), n in counts.items():
        best[second] = max(best[second], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]),
        hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


ODD_TEXTS = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b\n\nc", "\ta\t b", "x\r\ny z\r", "a  b c", "​ a​ b",
             "a\x00b c\x00 d", "!\x1c x\x1d", "<|endoftext|> a <s> </s> <unk> <0x41>", "▁ a", "a ▁", "日本語 のテキスト", "🎉🎉 é é",
             "don't  it's we'll", "1234567 89", "a\x85b \x85 c", "﻿ a ﻿b", "a" * 300 + " b", " \n x \n ", "...  ...\n...", "ﬁ ①"]
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_whole_texts(spark, awkward, no_rows, libraries):
    texts = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, r[1]) for i, r in enumerate(AWKWARD)] + [(5, "a b")] * 2
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter((d, *w) for (d, _), w in zip(texts, plain_alignment([t for _, t in texts], libraries)))
    for options in ({}, {"broadcast_pairs": 0, "shard_pairs": 50, "vector_rows": 40}):
        got = Counter((r["doc_id"], *(r[f] for f in FIELDS)) for r in rows(alignment.align_documents(docs, **options)))
        assert got == want
    found = rows(alignment.align_documents(awkward))
    assert len(found) == len(AWKWARD) and {len(r) for r in found} == {8}
    assert alignment.align_documents(no_rows).count() == 0
    assert alignment.align_documents(no_rows, broadcast_pairs=-1).count() == 0


def test_alignment_of_documents(spark, documents, libraries):
    want = plain_alignment([r["text"] for r in documents.orderBy("doc_id").collect()], libraries)
    got = [tuple(r[f] for f in FIELDS) for r in alignment.align_documents(documents).orderBy("doc_id").collect()]
    assert got == want


# --- prefix trie -------------------------------------------------------------------------------

def plain_trie(turns):
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children),
                    len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string, digest string, pos string"


def trie_rows(df):
    return Counter(tuple(r[c] for c in TRIE) for r in rows(df))


def some_turns():
    rng = np.random.default_rng(5)
    turns = []
    for conv in [*range(0, 60), *range(95, 130), 205, 250, 1300]:
        for turn in range(int(rng.integers(0, 8))):
            same = rng.random() < 0.7  # many conversations share their beginnings
            turns.append((conv, turn, ("user", "assistant")[turn % 2], "hot" if same else f"text {conv % 7} é🎉", "x", "y"))
    turns += [(400, None, None, None, "x", "y"), (400, 1, "user", "", "x", "y"), (400, 1, "user", "", "x", "y"),
              (400, 1, "a", "b", "x", "y"), (None, 1, "user", "hot", "x", "y"), (7, None, "user", "long " * 50_000, "x", "y")]
    return turns


def test_trie_equals_brute_force(spark):
    turns = some_turns()
    frame, want = spark.createDataFrame(turns, TURNS), plain_trie([t[:4] for t in turns])
    # the whole trie in a shard; a crown in one table; a crown in bands
    for options in ({}, {"subtree_rows": 20}, {"subtree_rows": 5, "crown_nodes": 12}, {"subtree_rows": 1, "crown_nodes": 3}):
        assert trie_rows(trie.prefix_trie(frame, **options)) == want
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_trie_of_a_long_conversation(spark):
    turns = [(200, i, "user", str(i)) for i in range(3000)] + [(201, i, "user", str(i)) for i in range(2990)]
    found = trie.prefix_trie(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
                             subtree_rows=400, crown_nodes=1000)
    first = [r for r in rows(found) if r["depth"] == 0][0]
    shared = zlib.crc32(b"201") % 6 >= 0 and 2990
    assert found.count() == 3001 and first["n_leaves"] == 1 and first["n_convs"] == 2
    assert first["saved_tokens"] == sum(len(str(i)) for i in range(shared))


def test_trie_of_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = plain_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert trie_rows(trie.prefix_trie(turns)) == want


# --- vectors -----------------------------------------------------------------------------------

def plain_links(vectors, threshold=0.93):
    """Links, component and kept by all pairs."""
    n, reach = len(vectors), list(range(len(vectors)))
    usable = [v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
              for _, v, l in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for (_, v, _), ok in zip(vectors, usable)]
    links = [0] * n

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and vectors[i][2] == vectors[j][2] and len(unit[i]) == len(unit[j]) \
                    and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                reach[root(i)] = root(j)
    least = {}
    for i in range(n):
        ids = [least.get(root(i)), vectors[i][0]]
        least[root(i)] = min((x for x in ids if x is not None), default=None)
    return Counter((vectors[i][0], links[i], least[root(i)], vectors[i][0] == least[root(i)]) for i in range(n))


def vector_rows(df):
    return Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(df))


def some_vectors(groups=25, dim=64, hot=120):
    rng = np.random.default_rng(11)
    out = []
    for g in range(groups):
        middle = rng.normal(size=dim)
        for _ in range(hot if g == 0 else int(rng.integers(1, 9))):
            noise = rng.normal(size=dim) * rng.choice([0.05, 0.15])
            out.append((len(out), [float(x) for x in middle + noise], 1 if g < 20 else g % 3))
    out += [(len(out) + i, out[3][1], out[3][2]) for i in range(5)]  # copies
    return out


SCHEMA = "vec_id long, embedding array<{}>, label int, bucket string, cid string"


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_equal_all_pairs(spark, kind):
    vectors = some_vectors()
    if kind == "float":
        vectors = [(i, [float(np.float32(x)) for x in v], l) for i, v, l in vectors]
    frame = spark.createDataFrame([(*v, "x", "y") for v in vectors], SCHEMA.format(kind))
    want = plain_links(vectors)
    # one bucket holds all; blocks and balls; several hashes a table
    for options in ({}, {"block": 8}, {"bucket": 1}, {"bucket": 1, "block": 4}):
        found = vector_rows(embeddings.near_vectors(frame, recall=0.9999, **options))
        assert found == want


def test_awkward_vectors(spark):
    nan, inf, one = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    vectors = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 1.0], 1), (4, [1.0, nan, 1.0], 1),
               (5, [inf, 1.0, 1.0], 1), (6, one, None), (7, one, None), (8, one, 1), (9, [2.0, 4.0, 6.0], 1), (10, one, 2),
               (None, one, 1), (12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (14, [5.0], 3), (15, [-5.0], 3), (16, [0.1], 3),
               (17, [1e-300, 2e-300, 3e-300], 1), (18, [1e300, 2e300, 3e300], 1), (None, None, None), (20, one, 5), (20, one, 5)]
    frame = spark.createDataFrame([(*v, "x", "y") for v in vectors], SCHEMA.format("double"))
    found = {r["vec_id"]: r for r in rows(embeddings.near_vectors(frame)) if r["vec_id"] is not None}
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i in (
        0, 1, 2, 3, 4, 5, 6, 7, 10, 15))
    assert all(found[i]["n_links"] == 4 and found[i]["component_id"] == 8 for i in (8, 9, 17, 18))
    assert found[13]["component_id"] == 12 and found[16]["component_id"] == 14 and found[14]["n_links"] == 1
    assert found[20]["n_links"] == 1 and found[20]["kept"]
    loose = [r for r in rows(embeddings.near_vectors(frame)) if r["vec_id"] is None]
    assert sorted((r["n_links"], r["component_id"] or -1) for r in loose) == [(0, -1), (4, 8)]
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA.format("float"))).count() == 0


def test_recall_at_the_threshold():
    """Pairs drawn at 0.93 exactly, the hardest to find, for dimensions and sizes of production."""
    rng = np.random.default_rng(2)
    for dim, classes in ((64, 5_000), (64, 10**6), (200, 10**4), (768, 10**4)):
        made = embeddings.family(dim, classes, 0.93)
        one = rng.normal(size=(400, dim))
        one /= np.linalg.norm(one, axis=1, keepdims=True)
        off = rng.normal(size=(400, dim))
        off -= (off * one).sum(axis=1, keepdims=True) * one
        a, b = made.codes(one), made.codes(0.93 * one + np.sqrt(1 - 0.93**2) * off / np.linalg.norm(off, axis=1, keepdims=True))
        met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
        assert met.mean() >= 0.97
