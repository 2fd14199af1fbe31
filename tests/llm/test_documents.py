"""Operators on documents: awkward rows, empty tables, and brute-force counterparts."""

import hashlib
import zlib

import numpy as np
import xxhash

from riskframe.llm import (
    decontam,
    fingerprints,
    langid,
    linededup,
    pieces,
    sharding,
    simhash,
    tokenfile,
)
from riskframe.llm.common import connected

from .conftest import AWKWARD


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def one(found, doc_id):
    return next(r for r in found if r["doc_id"] == doc_id)


def test_language_of_awkward_rows(awkward, no_rows):
    found = rows(langid.identify_documents(awkward))
    assert len(found) == len(AWKWARD)
    assert all(one(found, i)["lang_pred"] == "und" and one(found, i)["score"] == 0 for i in (1, 2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
               for r in found if r["doc_id"] is not None)
    assert langid.identify_documents(no_rows).count() == 0
    kept = langid.keep_identified(awkward)
    assert kept.columns == awkward.columns
    assert {1, 2, 3, 4}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_held_out_languages_are_found(documents):
    found = langid.identify_documents(documents).join(documents.select("doc_id", "lang"), "doc_id")
    test = found.where("held_out and lang is not null")
    assert test.where("lang = lang_pred").count() >= 0.97 * test.count()


def test_unknown_scripts_and_letter_noise_are_not_identified(spark, documents):
    rng, noise = np.random.default_rng(7), []
    for first, n in ((0x430, 32), (0x3b1, 25), (0x4e00, 20000), (0x627, 36), (ord("a"), 26)):
        for _ in range(40):
            words = ["".join(map(chr, first + rng.integers(0, n, rng.integers(2, 10)))) for _ in range(150)]
            noise.append((10**9 + len(noise), " ".join(words)))
    # unlabelled, so that they neither train nor set the threshold
    odd = spark.createDataFrame(noise, "doc_id long, text string")
    docs = documents.unionByName(odd, allowMissingColumns=True)
    kept = {r["doc_id"] for r in langid.keep_identified(docs).select("doc_id").collect()}
    clean = {r["doc_id"] for r in documents.where("text rlike '[A-Za-z]'").select("doc_id").collect()}
    assert clean <= kept
    assert not [i for i, _ in noise[:160] if i in kept]
    assert sum(i in kept for i, _ in noise[160:]) <= 2


def test_bundle_is_the_sum_of_bound_trigrams():
    first, second, third = langid._vectors(64)
    number = langid._letters()
    want = np.zeros(64)
    for gram in (" ab", "abc", "bc "):
        a, b, c = (number[ord(x)] for x in gram)
        want += first[a].astype(int) * second[b] * third[c]
    assert np.array_equal(langid.bundle(["Abc!"], 64)[0], want)


def test_long_text_of_a_large_alphabet_needs_little_memory():
    import tracemalloc

    text = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FFF, 10**6)))
    langid.bundle(["warm up"])
    tracemalloc.start()
    vector = langid.bundle([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and np.abs(vector).max() > 0


def test_pieces_of_a_text_bundle_like_the_whole(monkeypatch):
    texts = ["Abc, déf ghi! " * 40, "", "x", "ÄÖÜ straße 123 日本語 " * 30, "word " * 100]
    want, sizes = langid._bundles(texts, 256)
    for piece, few, grams in ((64, 2, 8), (17, 64, 5)):
        monkeypatch.setattr(langid, "PIECE_CHARS", piece)
        monkeypatch.setattr(langid, "GROUP_TEXTS", few)
        monkeypatch.setattr(langid, "SLICE_TRIGRAMS", grams)
        got, n = langid._bundles(texts, 256)
        assert np.array_equal(got, want) and np.array_equal(n, sizes)


def test_shards_are_even_and_keep_copies_together(spark, awkward, no_rows):
    found = rows(sharding.shard_documents(awkward, shards=4))
    counts = [sum(r["shard"] == s for r in found) for s in range(4)]
    assert len(found) == len(AWKWARD) and max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    assert sharding.shard_documents(no_rows).count() == 0
    # one group holds a third of the rows, more than any shard may take
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"text {i // 6}") for i in range(600)],
                                 "doc_id long, text string")
    found = rows(sharding.shard_documents(docs, shards=8))
    counts = [sum(r["shard"] == s for r in found) for s in range(8)]
    assert counts == [75] * 8
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    used = {}
    for r in found:
        used.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    cold = [len(v) for k, v in used.items() if k != "hot"]
    assert sum(n == 1 for n in cold) >= 0.7 * len(cold) and len(used["hot"]) <= 5
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
               for r in found)


def _whole_viterbi(chars, vocab):
    """The textbook dynamic programme over the whole text."""
    best, back = [0.0] + [None] * len(chars), [0] * (len(chars) + 1)
    for end in range(1, len(chars) + 1):
        for start in range(max(0, end - vocab.longest), end):
            score = vocab.scores.get(chars[start:end], vocab.unknown_score if start == end - 1 else None)
            if score is not None and (best[end] is None or best[start] + score > best[end]):
                best[end], back[end] = best[start] + score, start
    cuts = [len(chars)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    out = []
    for start, end in zip(cuts[::-1], cuts[-2::-1]):
        piece = chars[start:end]
        out += [vocab.ids[piece]] if piece in vocab.ids else vocab.fallback(piece)
    return out


def test_streaming_viterbi_equals_the_whole_one(documents):
    vocab = pieces.vocabulary(pieces.MODEL)
    texts = [r["text"] for r in documents.limit(40).collect()] + [
        "x" * 700, "日本語テキスト" * 60, "  two  spaces ", "▁▁ a", " ", "\n\n", "".join(chr(97 + i * i % 26) for i in range(2000))]
    for text in texts:
        chars = (" " + text).replace("▁", pieces.LITERAL).replace(" ", "▁")
        want = _whole_viterbi(chars, vocab)
        assert list(pieces.stream(chars, vocab)) == want
        assert pieces.encode(text, vocab).tolist() == want
        assert pieces.decode(want, vocab) == text


def test_pieces_of_awkward_rows(awkward, no_rows):
    found = rows(pieces.encode_documents(awkward))
    assert len(found) == len(AWKWARD) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in found)
    assert one(found, 1)["ids"] == [] == one(found, 2)["ids"]
    assert pieces.encode_documents(no_rows).count() == 0
    kept = pieces.encode_column(awkward)
    assert [c for c in kept.columns if c != "ids"] == [c for c in awkward.columns if c not in ("text", "ids")]


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_of_awkward_rows(awkward, no_rows):
    found = rows(fingerprints.fingerprint_documents(awkward))
    texts = dict(sorted(((r[0], r[1] or "") for r in AWKWARD if r[0] is not None)))
    order = sorted(texts, reverse=True)
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for doc, following in zip(order, order[1:] + order[:1]):
        text, k = texts[doc], len(texts[doc]) // 3
        edited = text[:len(text) - k] + texts[following][:k]
        r = one(found, doc)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r["near_edited"], edited), (r["near_next"], texts[following])):
            a, b = _shingles(text), _shingles(other)
            assert abs(value - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.17
    assert one(found, 5)["fingerprint"] == one(found, 6)["fingerprint"] != ""
    assert one(found, 1)["fingerprint"] == one(found, 2)["fingerprint"] == ""
    assert fingerprints.fingerprint_documents(no_rows).count() == 0


def test_fingerprints_estimate_similarity(documents):
    found = sorted(rows(fingerprints.fingerprint_documents(documents)), key=lambda r: -r["doc_id"])
    texts = [r["text"] for r in documents.orderBy("doc_id", ascending=False).collect()]
    errors = []
    for r, text, following in zip(found, texts, texts[1:] + texts[:1]):
        k = len(text) // 3
        a, b = _shingles(text), _shingles(text[:len(text) - k] + following[:k])
        errors.append(r["near_edited"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def _plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_links_all_pairs_within_three_bits(documents, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    marks = {i: _plain_simhash(t) for i, t in texts.items()}
    parent = {i: i for i in marks}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = sorted(marks.items())
    for n, (i, a) in enumerate(items):
        for j, b in items[n + 1:]:
            if (a ^ b).bit_count() <= 3:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    for limit in (simhash.LIST_LIMIT, 1):  # 1: every posting list is resolved as a long one
        found = rows(simhash.near_duplicates(documents, list_limit=limit))
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {
            i: (f"{marks[i]:016x}", root(i)) for i in marks}
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert all(simhash.simhash(texts[i]) & (1 << 64) - 1 == marks[i] for i in list(texts)[:50])


def test_simhash_of_awkward_rows(awkward, no_rows):
    found = rows(simhash.near_duplicates(awkward))
    assert len(found) == len(AWKWARD)
    assert {one(found, i)["component_id"] for i in (1, 2, 3)} == {1}
    assert one(found, 1)["fingerprint"] == "0" * 16
    assert one(found, 12)["component_id"] == one(found, 13)["component_id"] == 12
    assert all(r["component_id"] == 5 for r in found if r["doc_id"] in (5, 6, None))
    assert simhash.near_duplicates(no_rows).count() == 0
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert {6, 2, 3, 13}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_posting_lists_that_span_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 40, 300) | 1 << 40)
    keys = np.zeros(len(fps), np.int64)
    batches = [pa.RecordBatch.from_pydict({"key": keys[i:i + 7], "fp": fps[i:i + 7]}) for i in range(0, len(fps), 7)]
    long = [b for b in simhash._resolve(10)(iter(batches)) if b.num_rows and b.column("long_list")[0].as_py()]
    assert sorted(x for b in long for x in b.column("a").to_pylist()) == sorted(fps.tolist())


def test_neighbouring_long_lists_that_span_batches():
    import pyarrow as pa

    # of list 5 the first 20 rows fill a batch, its last 4 share one with the 16 rows of list 9
    keys, fps = np.repeat([5, 9, 11], [24, 16, 3]), np.arange(43)
    for size in (20, 40, 7, 1):
        batches = [pa.RecordBatch.from_pydict({"key": keys[i:i + size], "fp": fps[i:i + size]})
                   for i in range(0, len(fps), size)]
        long = [(a, key) for b in simhash._resolve(10)(iter(batches)) for a, key, of_long in zip(
            *(b.column(c).to_pylist() for c in ("a", "b", "long_list"))) if of_long]
        assert sorted(long) == list(zip(range(40), [5] * 24 + [9] * 16))


def test_components_of_a_long_path(spark):
    edges = spark.range(400).selectExpr("id as a", "id + 1 as b").union(
        spark.createDataFrame([(1000, 1001), (1001, 1000), (7, 7)], "a long, b long"))
    found = {r["v"]: r["m"] for r in connected(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 401)}, 1001: 1000}


def test_line_dedup(spark, awkward, no_rows):
    docs = spark.createDataFrame(
        [(i, f"Own line number {i} here\nThis line is on all sites\nok\n \nThis line is on all sites", None, f"s{i % n}")
         for n in (12,) for i in range(36)]
        + [(100 + i, "This line is only on two sites", None, f"s{i % 2}") for i in range(40)],
        "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert found[0]["text"] == "Own line number 0 here\nThis line is on all sites\nok\n "
    # short lines count like any other, blank ones never
    assert found[0]["n_removed"] == 1 and found[35]["n_removed"] == 3 and found[35]["n_lines"] == 5
    assert found[35]["text"] == "Own line number 35 here\n "
    assert all(found[100 + i]["n_removed"] == 0 for i in range(40))
    out = linededup.dedup_lines(awkward)
    assert set(awkward.columns) <= set(out.columns)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted((r[0] or 0, r[1] or "") for r in AWKWARD)
    assert linededup.dedup_lines(no_rows).count() == 0
    assert linededup.clean_lines(awkward).columns == awkward.columns


def test_decontamination(spark, awkward, no_rows):
    item = " ".join(f"token{i}" for i in range(40))
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (5, "the quick brown fox jumps over")],
                                  "item_id long, text string")
    edited = item.replace("token3 ", "changed ").upper().replace(" ", ", ")
    docs = spark.createDataFrame(
        [(1, "before " * 3000 + item + " after" * 3000), (2, edited), (3, " ".join(item.split()[:20])),
         (4, "x " + item[:150]), (5, "tiny item"), (6, "tiny item in a text")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 1), (5, 2)}
    assert found[1, 1]["containment"] == 1.0 and found[2, 1]["n_shared"] == 32 and found[2, 1]["n_item"] == 36
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(awkward, items).collect())
    assert got == [(5, 5), (6, 5)]
    assert decontam.contaminated(no_rows, items).count() == 0
    assert decontam.contaminated(awkward, items.limit(0)).count() == 0
    kept = decontam.keep_uncontaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 3


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    column = pa.array(["Ab cd, ef gh ij kl", None, "", "Ab cd", "one" * 300 + " two three four five six"])
    whole = decontam._Texts(column)
    monkeypatch.setattr(decontam, "PIECE", 16)
    small = decontam._Texts(column)
    assert np.array_equal(whole.hash, small.hash)
    assert whole.shingle(0) == "ab cd ef gh ij" and list(whole.owner) == [0, 0, 3, 4, 4]


def test_blocks_of_ids_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, n) for n in (1, 2, 300, 77)] + [
        np.zeros(900, int), np.full(5, 65535), np.tile([5, 6, 7], 500), np.minimum(rng.zipf(1.3, 2000), 65535)]
    coded = tokenfile.encode_blocks(blocks)
    decoded = tokenfile.decode_blocks(coded, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decoded))
    assert len(coded[6]) < 120  # a repeated sequence is predicted
    alone = [tokenfile.encode_blocks([b])[0] for b in blocks]
    assert alone == coded  # blocks do not depend on their neighbours
    assert tokenfile.encode_blocks([]) == [] == tokenfile.decode_blocks([], [])
    a, b = b"some bytes", b"and others"
    assert tokenfile.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def _check_token_file(found, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenfile.TOKENIZER)
    found, start = sorted(found, key=lambda r: r["start"]), 0
    assert [r["doc_id"] for r in found] == [i for i, _ in texts]
    for r, (_, text) in zip(found, texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file(spark, awkward, documents, no_rows, monkeypatch):
    _check_token_file(rows(tokenfile.token_file(documents)),
                      sorted((r["doc_id"], r["text"]) for r in documents.collect()))
    _check_token_file(rows(tokenfile.token_file(awkward)),
                      sorted((r[0], r[1] or "") for r in AWKWARD if r[0] is not None))
    assert tokenfile.token_file(no_rows).count() == 0


def test_words_apart_give_the_ids_of_the_whole_text():
    tokens = tokenfile._Tokens(tokenfile.TOKENIZER)
    texts = ["a  b\n c \t d", "\n\nx", " lead", "trail ", "", " ", "don't stop　x y", "<|endoftext|> z", "é à b ",
             "12 34  5\r\n6", "a ​ b", "x \u0085y z"]
    want = [e.ids for e in tokens.library.encode_batch(texts, add_special_tokens=False)]
    assert [t.tolist() for t in tokens.batch(texts)] == want


def test_plain_words_go_to_the_model_alone(monkeypatch):
    tokens, seen = tokenfile._Tokens(tokenfile.TOKENIZER), []
    whole = tokens._words
    monkeypatch.setattr(tokens, "_words", lambda words: seen.extend(words) or whole(words))
    texts = ["the hend, oftionnten. Str\u00e4ur\u00e9, x.\nAnd &&& end!! a-b_c$$$ f^`g", "w the hend.\nXyz,%% \u00e9tho"]
    odd = ["a b<|endoftext|>c d", "it's a.'s 12a \u00b5m a\u00d7b \u043a\u043e\u0442, \u65e5\u672c", "x a.\n\nb c\n d\r\ne f"]
    want = [e.ids for e in tokens.library.encode_batch(texts + odd, add_special_tokens=False)]
    assert [t.tolist() for t in tokens.batch(texts)] == want[:2]
    assert set(seen) == {"&&&"}  # before, every new word took the way through the whole library
    assert [t.tolist() for t in tokens.batch(odd)] == want[2:]


def test_predictions_known_ahead_are_those_of_one_id_after_another():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, (5, 700)), 65535).astype(np.uint16)
    ids[1], ids[2, 100:] = 0, np.tile([7, 0, 9], 200)
    pairs, misses = tokenfile._known_ahead(ids)
    memory = tokenfile._Memory(5)
    for step, x in enumerate(ids.T.astype(np.uint32)):
        memory.predict(5)
        two, one = ((e & 3 > 0) & (g == x) for e, g in zip(memory.entry, memory.guess))
        assert np.array_equal(memory.pair, pairs[:, step])
        assert np.array_equal(np.where(two, 0, np.where(one, 1, 2)), misses[:, step])
        memory.learn(x)


def test_blocks_have_the_bytes_of_earlier_files():
    rng = np.random.default_rng(3)
    blocks = [np.minimum(rng.zipf(1.2, n), 65535) for n in (4096, 1000, 37)] + [
        np.full(4096, 65535), rng.integers(0, 65536, 4096)]
    assert [zlib.crc32(b) for b in tokenfile.encode_blocks(blocks)] == [
        3393222978, 1479469800, 956185191, 3545591676, 3592508266]
