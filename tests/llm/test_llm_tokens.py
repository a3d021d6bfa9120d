"""op2, op3, op4, op6, op8, op9: the library, exact round trips, held-out gain, recall and brute force."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stormledger.llm import ann, bpe, encode, idfile, maxent, packing, rangecoder, sharding
from stormledger.llm.queries import QUERIES
from stormledger.session import work_folder

FILES = {"word": public_tokenizers.path("word_bpe_49k.json"), "byte": public_tokenizers.path("byte_bpe_50k.json")}
LIBRARY = {k: Tokenizer.from_file(p) for k, p in FILES.items()}
ODD = ["", None, " ", "  a  b \n c\t d ", "a \n b", "it's we'LL", "<|endoftext|> a<|startoftext|>b", "İ é é ﬁ ½ ²", "日本語", "\x1f a\x85b\xa0c", "ſ K", "👩‍👩", "a" * 300]
DOC = "doc_id long, text string, n_tokens string, ids string, shard string, length string, start string"


def library_ids(kind, text):
    return LIBRARY[kind].encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, *["theirs"] * 5) for k, t in enumerate(ODD)] + [(None, "null key", *[None] * 5)] + [(1, None, *[None] * 5)] * 2
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abehlotu'.,!?-_ 019\n\té", max_size=60)))
def test_encoders_equal_the_library(text):
    for kind in FILES:
        assert np.frombuffer(encode.encoder(FILES[kind], kind).ids(text), "<u4").tolist() == library_ids(kind, text)
    coder = bpe.bpe(FILES["word"])
    found = coder.encode(text)
    ids = np.frombuffer(found, "<u4").tolist()
    assert ids == library_ids("word", text)
    assert coder.decode(found) == LIBRARY["word"].decode(ids, skip_special_tokens=False)


def test_bpe_query_and_odd_rows(spark, odd, documents):
    def digest(b):
        return hashlib.sha256(b).hexdigest()

    want = {}
    for d, t in documents:
        ids = library_ids("word", t)
        want[d] = (len(ids), digest(np.asarray(ids, "<u4").tobytes()), digest(LIBRARY["word"].decode(ids, skip_special_tokens=False).encode()))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op4_bpe"](spark, SF).collect()}
    assert got == want
    for r in bpe.encode_decode(odd, FILES["word"]).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library_ids("word", r["text"])
    assert bpe.encode_decode(odd.limit(0), FILES["word"]).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [0, 4294967295, 7], [7] * 20_000, list(range(9000)), [k % 3 for k in range(30_000)]])
def test_range_coder_round_trip(ids):
    segment = rangecoder.encode(np.array(ids, np.uint32))
    assert rangecoder.decode(segment).tolist() == ids


def test_range_coder_compresses_and_sees_damage():
    rng = random.Random(1)
    ids = np.array([rng.choice((1, 2, 3, 5, 8, 13, 21)) for _ in range(20_000)] * 2, np.uint32)
    segment = rangecoder.encode(ids)
    assert len(segment) < 4 * len(ids) / 8
    for at in (len(segment) // 2, len(segment) - 40):
        broken = bytearray(segment)
        broken[at] ^= 4
        with pytest.raises(rangecoder.CorruptBlock):
            rangecoder.decode(bytes(broken))
    with pytest.raises(rangecoder.CorruptBlock):
        rangecoder.decode(segment[:-2])


def id_rows(rows):
    out, at = [], 0
    for d, t in rows:
        ids = library_ids("byte", t) + [2]
        out.append((d, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_id_files(spark, odd, documents):
    got = QUERIES["op6_id_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == id_rows(documents)
    folder = f"{work_folder(spark)}/odd-ids-{uuid.uuid4().hex}"
    idfile.write_ids(odd.filter("doc_id > 1"), "doc_id", folder, FILES["byte"], "byte", 2, segment_ids=20)
    read = idfile.read_ids(spark, folder).withColumn("crc", F.crc32("ids")).orderBy("start").collect()
    assert [(r["key"], r["start"], r["n_tokens"], r["crc"]) for r in read] == id_rows([(k, t) for k, t in enumerate(ODD) if k > 1])
    idfile.write_ids(odd, "doc_id", folder + "-all", FILES["byte"], "byte", 2)
    assert idfile.read_ids(spark, folder + "-all").count() == odd.count()
    idfile.write_ids(odd.limit(0), "doc_id", folder + "-none", FILES["byte"], "byte", 2)
    assert idfile.read_ids(spark, folder + "-none").count() == 0


def check_packed(rows, most):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    return len(by)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_placements_hold_every_piece_once(histogram):
    rows = packing.placements(histogram, 64)
    assert Counter({k: sum(r[2] for r in rows if r[0] == k) for k in histogram}) == Counter(histogram)
    pieces = [{"sequence_id": f + k, "offset": o, "length": n} for n, _, c, f, o in rows for k in range(c)]
    packs = check_packed(pieces, 64)
    assert packs * 32 <= sum(k * n for k, n in histogram.items()) + 64  # all but one pack are at least half full


def test_packing_query(spark, documents):
    rows = QUERIES["op8_packing"](spark, SF).collect()
    want = []
    for d, t in documents:
        ids = library_ids("word", t) + [2]
        want += [(d, a, len(ids[a:a + 4096]), zlib.crc32(np.asarray(ids[a:a + 4096], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 4096)]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert sum(r["length"] for r in rows) > 0.95 * 4096 * check_packed(rows, 4096)


def test_packing_odd_rows_and_sequences(spark, odd):
    cut = packing.cut_documents(odd.withColumn("offset", F.lit("x")), "text", FILES["word"], "word", 2, 8)
    packed = packing.pack(cut, ["doc_id", "start"], 8)
    rows = packed.collect()
    check_packed(rows, 8)
    assert sum(r["length"] for r in rows) == sum(len(library_ids("word", r["text"])) + 1 for r in odd.collect())
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"]:][: 4 * r["length"]] == r["ids"]
    assert packing.pack(packing.cut_documents(odd.limit(0), "text", FILES["word"], "word", 2), ["doc_id"]).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 97, 1009, 4096])
def test_permutation_is_one_to_one(spark, rows):
    d = sharding.domain(rows)
    assert d.a * d.b >= rows and d.walks == d.a * d.b - rows + 1
    got = [r["at"] for r in sharding.permute(spark.range(rows), "id", "at", d, seed=5).orderBy("id").collect()]
    assert sorted(got) == list(range(rows))
    assert rows < 90 or got != sorted(got)


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.shard_rows(odd, ["doc_id"], 3).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert all(r["position"] == r["slot"] * 3 + r["shard"] for r in rows)
    assert sharding.shard_rows(odd.limit(0), ["doc_id"], 3).count() == 0


def brute_nearest(ids, vectors, query, k=10):
    d = np.sqrt(((vectors - vectors[ids.index(query)]) ** 2).sum(axis=1))
    return [v for _, v in sorted((d[i], v) for i, v in enumerate(ids) if v != query)][:k], dict(zip(ids, d))


def test_nearest_recall(spark):
    rows = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in QUERIES["op3_ann"](spark, f"{SF}/../sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {v for v in ids if v % 100 == 0}
    hits = 0
    for q, found in got.items():
        want, d = brute_nearest(ids, vectors, q)
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hits += len(set(want) & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(got)


def test_nearest_of_ties_copies_and_broken_vectors(spark):
    rows = [(k, [1.0, 0.0] if k < 30 else [float(k), 2.0]) for k in range(40)]
    rows += [(100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, "vec_id", "embedding", F.col("id") % 10 == 0, 5).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 10, 20, 30}
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == [0, 1, 2, 3, 4]
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, 2, 3, 4, 5]
    assert [r["vec_id"] for r in got if r["query_id"] == 30] == [31, 32, 33, 34, 35]
    few = ann.nearest(frame.filter("vec_id in (0, 31, 32)"), "vec_id", "embedding", F.col("id") % 10 == 0)
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()] == [(1, 31), (2, 32)]
    assert ann.nearest(frame.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_scores(rows, texts, held):
    tokens = {d: WORD.findall((t or "").translate(LOWER)) + [None] for d, t in texts}
    counts = Counter(w for d, own in tokens.items() if not held(d) for w in own)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["score"] <= 1e-6 and r["held_out"] == held(r["doc_id"])


def test_maxent_query_beats_the_base_on_held_out_texts(spark, documents):
    rows = QUERIES["op2_maxent"](spark, SF).collect()
    assert len(rows) == len(documents)
    check_scores(rows, documents, lambda d: zlib.crc32(str(d).encode()) % 5 == 1)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_maxent_on_odd_rows(spark, odd):
    clash = odd.withColumn("key", F.lit("x")).withColumn("score", F.lit("y"))
    rows = maxent.score_texts(clash, "doc_id", F.col("doc_id") % 5 == 1).withColumnRenamed("key", "doc_id").collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    untrained = maxent.score_texts(odd, "doc_id", F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in untrained)
    assert maxent.score_texts(odd.limit(0), "doc_id", F.lit(True)).count() == 0


def test_class_probabilities_add_up():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows = rng.integers(0, maxent.ROWS, (6, 50))
    assert np.allclose(np.exp(maxent._log_classes(weights, rows)).sum(axis=1), 1, atol=1e-4)
    words = maxent.Words(["the", "of"])
    kinds = words.classes(["the", "of", "", "walking", "talking", "walking."])
    assert kinds[:3].tolist() == [1, 2, 0] and kinds[3] == kinds[4] and kinds[5] == kinds[3] + 1


def test_numbers_by_counts_equal_a_sort():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 50_000, 30_000), rng.integers(0, 1 << 32, 5000), np.zeros(0, int)):
        ids = ids.astype("<u4")
        distinct, numbers, counts = rangecoder._numbered(ids)
        want = np.unique(ids, return_inverse=True, return_counts=True)
        assert numbers.dtype == np.int32
        assert all(np.array_equal(a, b) for a, b in zip((distinct, numbers, counts), want))


def test_a_segment_is_coded_in_bounded_memory():
    import tracemalloc

    ids = (np.random.default_rng(5).zipf(1.3, idfile.SEGMENT_IDS) % 50_000).astype("<u4")
    tracemalloc.start()
    rangecoder.encode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_training_step_moves_rows_by_their_slopes(monkeypatch):
    rng = np.random.default_rng(3)
    codes, sizes = rng.integers(0, 40, 60), np.array([20, 40])
    history = maxent.History(codes, sizes, rng.integers(0, 1 << 32, 40), rng.integers(0, maxent.CLASSES, 40))
    weights = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    at, rows = np.arange(60), history.rows(np.arange(60))
    shares = np.exp(weights[rows].sum(axis=0, dtype=np.float64))
    shares /= shares.sum(axis=1, keepdims=True)
    shares[at, history.target] -= 1
    slope = np.zeros(weights.shape)
    for own in rows:
        np.add.at(slope, own, shares)
    want = weights - maxent.RATE * slope / np.sqrt(slope**2 + 1)
    monkeypatch.setattr(np, "tile", lambda own, n: np.concatenate([own] * n) if n == 5 else pytest.fail("the bias is summed as a column"))
    seen = np.zeros(maxent.ROWS, np.float32)
    maxent._step(weights, np.zeros_like(weights), seen, history, at)
    assert np.allclose(weights, want, atol=1e-4)
    assert seen[0] == 60 and seen.sum() == 360


def test_weight_rows_follow_the_words_learnt_from(spark, documents, monkeypatch):
    assert maxent.weight_rows(0) == maxent.ROWS and maxent.weight_rows(1 << 40) == maxent.MOST_ROWS
    assert maxent.weight_rows(maxent.WORDS_PER_ROW * 20_000) == 1 << 15
    met = []
    shown = maxent._changes
    monkeypatch.setattr(maxent, "_changes", lambda c, words, weights, n: met.append(len(weights.value)) or shown(c, words, weights, n))
    monkeypatch.setattr(maxent, "WORDS_PER_ROW", 1)
    rows = QUERIES["op2_maxent"](spark, SF).collect()
    assert met == [maxent.weight_rows(len(known_words(documents)))] * 2 and met[0] > maxent.ROWS
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def known_words(documents):
    """Distinct tokens of the documents learnt from; the end of a text is one."""
    learnt = [t for d, t in documents if zlib.crc32(str(d).encode()) % 5 != 1]
    return {w for t in learnt for w in WORD.findall((t or "").translate(LOWER))} | {""}


def test_a_training_step_costs_what_its_tokens_cost():
    import tracemalloc

    rng = np.random.default_rng(4)
    history = maxent.History(rng.integers(0, 40, 60), np.array([20, 40]), rng.integers(0, 1 << 32, 40), rng.integers(0, maxent.CLASSES, 40))
    weights = np.zeros((1 << 17, maxent.CLASSES), np.float32)
    squares, seen = np.zeros_like(weights), np.zeros(len(weights), np.float32)
    tracemalloc.start()
    maxent._step(weights, squares, seen, history, np.arange(60))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and seen[0] == 60 and seen.sum() == 360


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("abelmrstv'' .,!-019\n\té×<", max_size=20)), max_size=12))
def test_batches_are_cut_like_single_texts(texts):
    texts = [*texts, "<|endoftext|>", "it's l's 'll", "x \n's"]
    for kind in FILES:
        ids, counts = encode.encoder(FILES[kind], kind).batch(pa.array(texts, pa.string()))
        want = [library_ids(kind, t) for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for own in want for i in own]


def test_pieces_asked_for_again_are_kept(monkeypatch):
    monkeypatch.setattr(encode, "CACHED_PIECES", 4)
    coder = encode.PieceEncoder(FILES["byte"], "byte")
    for text in ("a", " b c d", "a", " e f g", "a"):
        coder.batch(pa.array([text]))
        assert len(coder.pieces) + len(coder.older) <= 8
    assert "a" in coder.pieces or "a" in coder.older
    assert " b" not in coder.pieces and " b" not in coder.older


def test_slopes_of_frequent_rows_are_added_up_row_by_row(monkeypatch):
    rng = np.random.default_rng(6)
    n = 5 * maxent.FEW
    history = maxent.History(rng.integers(0, 4, n), np.array([n]), rng.integers(0, 1 << 32, 4), rng.integers(0, 3, 4))
    weights = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    at = np.arange(n)
    rows = history.rows(at)
    shares = np.exp(weights[rows].sum(axis=0, dtype=np.float64))
    shares /= shares.sum(axis=1, keepdims=True)
    shares[at, history.target] -= 1
    slope, want = np.zeros(weights.shape), np.zeros(len(weights))
    for own in rows:
        np.add.at(slope, own, shares)
        np.add.at(want, own, 1)
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: pytest.fail("a pass per class") if weights is not None else count(x, minlength=minlength))
    squares, seen = np.zeros_like(weights), np.zeros(len(weights), np.float32)
    moved = weights - maxent.RATE * slope / np.sqrt(slope**2 + 1)
    maxent._step(weights, squares, seen, history, at)
    assert want.max() > maxent.FEW and np.array_equal(seen, want)
    assert np.allclose(weights, moved, atol=1e-4) and np.allclose(squares, slope**2, rtol=1e-3, atol=1e-5)


def test_targets_of_many_tokens_have_their_log_probabilities():
    rng = np.random.default_rng(7)
    n = 2 * maxent.CACHED_ROWS + 5
    weights = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows, target = rng.integers(0, maxent.ROWS, (6, n)), rng.integers(0, maxent.CLASSES, n)
    rows[0] = 0
    want = maxent._log_classes(weights, rows)[np.arange(n), target]
    assert np.allclose(maxent._log_targets(weights, rows, target), want, atol=1e-4)


def test_classes_by_word_ends_equal_those_word_by_word():
    words = ["walking", "talking", "ing", "g", "ng.", "king.!", "x*y", "...", "a.", "é.", "--ab", "ab--", "b--", "cab--", "", "the"] * 2
    known = maxent.Words(["the"])
    assert known.classes(words).tolist() == [int(known.classes([w])[0]) for w in words]


def test_batches_are_let_go_and_bounded(spark, tmp_path):
    import weakref

    import public_tokenizers
    import pyarrow as pa

    from stormledger.llm import arrow, idfile

    gone = []

    def batches():
        for _ in range(3):
            batch = pa.RecordBatch.from_arrays([pa.array(["text"] * 10)], ["text"])
            last = weakref.ref(batch)
            yield batch
            del batch
            gone.append(last() is None)

    for part in arrow.pieces(batches(), "text"):
        del part
    assert gone == [True, True, True]

    before = spark.conf.get(arrow.BATCH)
    with arrow.small_batches(spark):
        counted = spark.range(0, 2500, 1, 1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long",
        ).collect()
    assert max(r["n"] for r in counted) <= 1000
    docs = spark.range(2500).selectExpr("id AS doc_id", "'some text' AS text").coalesce(1)
    idfile.write_ids(docs, "doc_id", str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 2)
    assert spark.conf.get(arrow.BATCH) == before
    assert idfile.read_ids(spark, str(tmp_path / "ids")).count() == 2500
