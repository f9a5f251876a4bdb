import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from clonoscape.llm import bpe, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TOK = library()


@settings(max_examples=300, deadline=None)
@given(hs.text(alphabet=hs.one_of(hs.sampled_from(" \n\t'sTa1é漢<|>.🙂\x85\xa0 \x1c"), hs.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_as_the_library(text):
    want = TOK.encode(text, add_special_tokens=False).ids
    assert bpe.tokenizer(PATH).encode([text])[0].tolist() == want
    assert np.frombuffer(tokenfile.library_encoder(PATH)[0].ids([text])[0], np.uint32).tolist() == want
    assert bpe.tokenizer(PATH).decode(want) == TOK.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "the quick" * 400, "<|endoftext|>" * 5 + " x <|endoftext|>", "", "   ", "\n \n"])
def test_long_words_and_special_tokens(text):
    assert bpe.tokenizer(PATH).encode([text])[0].tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_digests(spark, odd):
    got = bpe.bpe_digests(odd, PATH).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        ids = TOK.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.bpe_digests(odd.limit(0), PATH).count() == 0
    round_trip = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(odd, PATH), PATH).collect()}
    assert round_trip == texts


@pytest.mark.parametrize("sizes", [{}, {"file_tokens": 20}, {"file_docs": 2}])
def test_files_in_order(spark, odd, tmp_path, sizes):
    folder = f"file://{tmp_path}/tokens"
    manifest = tokenfile.write_token_files(odd, folder, PATH, end_id=2, **sizes)
    files = manifest.collect()
    assert len({r["path"] for r in files}) == len(files) and all(r["documents"] == 1 or r["tokens"] <= sizes.get("file_tokens", 1 << 30) for r in files)
    assert max(r["documents"] for r in files) <= sizes.get("file_docs", 99) and (not sizes or any(r["piece"] > 0 for r in files))
    got = sorted(map(tuple, tokenfile.read_token_files(manifest, folder).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"] or "") for r in odd.collect())
    start = 0
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = [*TOK.encode(text, add_special_tokens=False).ids, 2]
        assert r == (doc_id if doc_id >= 0 else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.read_token_files(tokenfile.write_token_files(odd.limit(0), folder + "0", PATH, 2), folder).count() == 0


def test_file_format(tmp_path):
    fs, base = pafs.FileSystem.from_uri(f"file://{tmp_path}")
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 50_000, rng.integers(0, 20_000)).astype(np.uint32)) for i in range(30)]
    with fs.open_output_stream(f"{base}/x.zst", compression=None) as out:
        w = tokenfile.FileWriter(out, 2)
        for d in docs:
            w.add(*d)
        w.finish()
    with fs.open_input_file(f"{base}/x.zst") as src:
        r = tokenfile.FileReader(src)
        assert all(a == c and (b == d).all() for (a, b), (c, d) in zip(docs, r.documents(), strict=True))
        asked = []
        r.frame, whole = (lambda k, f=r.frame: asked.append(k) or f(k)), len(r.seek)
        (one,) = r.documents(np.array([7]))
        assert (one[1] == docs[7][1]).all() and len(asked) == 1 < whole  # only its own frame is decompressed
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[5000] ^= 1
    (tmp_path / "y.zst").write_bytes(raw)
    with fs.open_input_file(f"{base}/y.zst") as src, pytest.raises(Exception):  # noqa: B017
        list(tokenfile.FileReader(src).documents())


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.none() | hs.text("ab é\n\t\x0b\u00a0\u3000漢'1", max_size=30), max_size=12))
def test_ids_of_a_column_are_those_of_its_texts(texts):
    cache, _ = tokenfile.library_encoder(PATH)
    column = pa.array(["cut off", *texts], pa.string()).slice(1)
    got = cache.column_ids(column)
    assert [g.tolist() for g in got] == [TOK.encode(t or "", add_special_tokens=False).ids for t in texts]
