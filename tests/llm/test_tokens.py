import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from peakframe.llm import bpe_chunks, packing, token_count
from peakframe.llm.byte_bpe import Encoder

from ..conftest import SMALL
from .cases import awkward, empty

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_encoder_equals_library(library):
    e, rng = Encoder(BPE), random.Random(3)
    chunks = bpe_chunks.ChunkEncoder(e, mean=16)
    parts = ["a", "b", " ", "  ", "\n", "'s", "1", "é", " ", "　", "!", "<|endoftext|>", "\x1c", "\x85", "漢", "😀", "\t", "Ǆ", "٣", "\x00", "word", "\r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert array("I", e.encode(text)).tolist() == want
        assert array("I", chunks.encode(text)).tolist() == want
        assert e.decode(e.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_chunks_are_reused():
    e = Encoder(BPE)
    passage = " ".join(f"word{i}" for i in range(2000))
    c = bpe_chunks.ChunkEncoder(e)
    c.encode("first. " + passage)
    before = c.encoded
    c.encode("quite another beginning, " + passage)
    assert c.encoded - before < len(passage) / 2 and c.reused > len(passage) / 2


def test_encode_decode(spark, library):
    for docs in (awkward(spark), spark.read.parquet(f"{SMALL}/documents.parquet")):
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((r[0] or -1, *r[1:]) for r in bpe_chunks.encode_decode(docs, BPE).collect()) == sorted(want)
    assert bpe_chunks.encode_decode(empty(spark), BPE).count() == 0


def test_round_trip(spark):
    docs = awkward(spark).where("doc_id is not null")
    back = bpe_chunks.decode_ids(bpe_chunks.encode_ids(docs, BPE), BPE)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in docs.collect())


def test_packing(spark, library):
    docs = awkward(spark)
    rows = packing.pack(docs, BPE).collect()
    want = defaultdict(int)
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            want[r.doc_id, s, len(ids[s : s + 1024]), zlib.crc32(array("I", ids[s : s + 1024]).tobytes()), len(ids)] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty(spark), BPE).count() == 0


def test_plan_equals_piece_by_piece():
    rng = random.Random(2)
    for size in (7, 64, 1024):
        for most in (1, 4, 40):
            counts = {n: rng.randint(1, most) for n in rng.sample(range(1, size), min(size - 1, 60))}
            runs = packing.plan(counts, size)
            used = defaultdict(int)
            for n in sorted(counts, reverse=True):
                for rank in range(counts[n]):
                    rooms = [size - u for u in used.values() if size - u >= n]
                    window, offset = packing.place(runs[n], n, rank)
                    assert offset == used[window] and size - offset == (min(rooms) if rooms else size)  # the tightest, or a new one
                    used[window] += n
            assert sorted(used) == list(range(len(used))) and max(used.values()) <= size


def test_padding_does_not_depend_on_the_splits(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["tree", "house", "sun", "rain"]) for _ in range(rng.randint(1, 1500)))) for i in range(1200)], "doc_id long, text string")
    seen = set()
    for splits in (1, 40, 211):
        rows = packing.pack(docs.repartition(splits), BPE).collect()
        ends = defaultdict(int)
        for r in rows:
            ends[r.sequence_id] += r.length
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        seen.add((len(ends), sum(1024 - n for n in ends.values())))
    assert len(seen) == 1 and max(seen)[1] < 0.005 * 1024 * max(seen)[0]


def brute_count(word, model):
    """The same recursion over all substrings, without either trie."""
    best = [(0.0, 0, 0)]
    for n in range(1, len(word) + 1):
        found = [(best[k][0] + model.score[word[k:n]], -best[k][1] - 1, -k, best[k][2]) for k in range(max(0, n - model.longest), n) if word[k:n] in model.score]
        if word[n - 1] not in model.score:
            w = len(word[n - 1].encode())
            found.append((best[n - 1][0] + w * model.rare, -best[n - 1][1] - w, -n, best[n - 1][2] + w))
        total, pieces, _, spelt = max(found)
        best.append((total, -pieces, spelt))
    return best


def every_segmentation(word, model):
    """(score, -pieces) of the best of all segmentations, by recursion."""
    if not word:
        return 0.0, 0
    found = []
    for k in range(1, len(word) + 1):
        s, n = every_segmentation(word[k:], model)
        if word[:k] in model.score:
            found.append((s + model.score[word[:k]], n - 1))
        elif k == 1:
            w = len(word[0].encode())
            found.append((s + w * model.rare, n - w))
    return max(found)


def test_trie_counts():
    model = token_count.Unigram(["a", "b", "ab", "abc", "c", "▁", "▁a", "bca"])
    rng = random.Random(1)
    words = {"▁" + "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 8))) for _ in range(300)}
    whole, small = token_count.Trie(model), token_count.Trie(model, 20)  # the small one fills up at once
    for w in sorted(words):
        best = brute_count(w, model)
        assert whole.count(w) == small.count(w) == whole.count(w) == best[-1][1:]
        assert abs(best[-1][0] - every_segmentation(w, model)[0]) < 1e-9
    assert len(whole.at) == len({w[:n] for w in words for n in range(len(w) + 1)}) and len(small.at) == 20 and small.full  # one score for each prefix


def test_moves_are_found_without_memory(monkeypatch):
    monkeypatch.setattr(token_count, "MAX_MOVES", 0)
    model = token_count.Unigram.of_file(PIECES)
    rng = random.Random(8)
    for w in ("▁" + "".join(rng.choice("eéatrns漢q") for _ in range(rng.randint(1, 40))) for _ in range(200)):
        assert token_count.Trie(model).count(w) == brute_count(w, model)[-1][1:]


def test_counts_do_not_depend_on_what_is_kept():
    model = token_count.Unigram.of_file(PIECES)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(40)] + ["q" * 30_000]
    assert token_count.Counts(model).of(texts) == token_count.Counts(model, keep=7, nodes=30).of(texts)


def test_count_tokens(spark):
    docs = awkward(spark)
    model = token_count.Unigram.of_file(PIECES)
    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens, r.n_bytes_fallback) for r in token_count.count_tokens(docs, PIECES, group=3).collect())
    known = {}
    count = lambda w: known.get(w) or known.setdefault(w, brute_count("▁" + w, model)[-1][1:])
    assert got == sorted((r.doc_id or -1, len((r.text or "").split()), sum(count(w)[0] for w in (r.text or "").split()), sum(count(w)[1] for w in (r.text or "").split())) for r in docs.collect())
    assert token_count.count_tokens(empty(spark), PIECES).count() == 0
