import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from joinscout.llm import packing, sstable, tokens

PATH = tokens.default_tokenizer()
TEXTS = [None, "", "The cat's <|endoftext|> don't", "Ünïcode ß ſ İ 中文 ١٢٣ 12.5!!", "a" * 3000, "x y\n" * 1500, "  ", "é   z"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def test_encoder_is_the_library(lib):
    rng = random.Random(4)
    letters = "aAbÉéß ſ'.,!<>|_0９中́\n\t\x1c"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    got = tokens.Encoder(PATH).encode(texts)
    assert got == [np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_full_caches_change_nothing(monkeypatch, lib):
    monkeypatch.setattr(tokens, "WORDS", 5)
    monkeypatch.setattr(tokens, "PIECES", 5)
    monkeypatch.setattr(tokens, "AT_ONCE", 20)
    texts = [f"word{i} it's other{i % 7}" for i in range(200)]
    assert tokens.Encoder(PATH).encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def rows(spark):
    ids = [5, 3, None, -7, 3, 9, 2, 1]
    return spark.createDataFrame([(i, t, 1) for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, path int").repartition(3)


def test_shards_round_trip(spark, lib, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    manifest = sstable.write_shards(spark, rows(spark), PATH, 1, shards=3)
    got = sorted(sstable.read_shards(spark, manifest).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in rows(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(ids), ids.tobytes())
        at += len(ids)
    listed = manifest.collect()
    assert len(sstable.lookup(listed, 3)) == 2 and sstable.lookup(listed, 4) == [] and len(sstable.lookup(listed, None)) == 1


def test_damage_is_seen(spark):
    import io

    out = io.BytesIO()
    w = sstable.ShardWriter(out)
    w.add(sstable.key_of(1), b"\1\0\0\0")
    w.close()
    raw = bytearray(out.getvalue())
    assert sstable.ShardReader(io.BytesIO(raw), len(raw)).get(sstable.key_of(1)) == [b"\1\0\0\0"]
    raw[12] ^= 1
    with pytest.raises(ValueError):
        sstable.ShardReader(io.BytesIO(raw), len(raw)).get(sstable.key_of(1))


def test_no_shards_of_nothing(spark):
    manifest = sstable.write_shards(spark, rows(spark).limit(0), PATH)
    assert sstable.read_shards(spark, manifest).count() == 0


def test_best_fit_and_bounds():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.integers(1, 100, 200)
        bins = packing.best_fit_decreasing(x, 100)
        fill = np.bincount(bins, x)
        bound = packing.lower_bound(np.bincount(x, minlength=101), 100)
        assert fill.max() <= 100 and bound <= len(fill) <= bound * 1.1 + 1
    assert packing.lower_bound(np.bincount([51, 51, 51], minlength=101), 100) == 3


def test_packing(spark, lib, monkeypatch):
    monkeypatch.setattr(packing, "PART", 40)
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    packed = packing.pack_documents(spark, df, PATH, 64, 0)
    out = packed.frame().toPandas()
    whole = {}
    for r in out.sort_values(["doc_id", "piece"]).itertuples():
        assert r.start == len(whole.get(r.doc_id, b"")) // 4 and r.length == len(r.ids) // 4
        whole[r.doc_id] = whole.get(r.doc_id, b"") + r.ids
    for i, t in enumerate(texts):
        assert whole[i] == np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 64 and (s.offset == s.length.cumsum() - s.length).all()
    last = packed.certificate[-1]
    n = out[out.length < 64].sequence_id.nunique()
    assert last["bound"] <= n == min(c["sequences"] for c in packed.certificate) and n <= last["bound"] + 1
    assert packing.pack_documents(spark, df.limit(0), PATH).frame().count() == 0
    assert zlib.crc32(b"") == 0
