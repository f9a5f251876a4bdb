import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from clonoscape.llm import viterbi as vt

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, has_bytes):
    """The tokenizers library's own unigram model over the same pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    special = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] * has_bytes
    t = Tokenizer(models.Unigram([*special, *pieces], unk_id=0, byte_fallback=has_bytes))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=vt.SPACE, prepend_scheme="always")
    return t


def file_pieces():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PATH)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(259, sp.vocab_size())]


WHOLE = library(file_pieces(), True)
#: Few letters with equal and near scores, so that ties are common; some letters are no piece by themselves.
SMALL = [("▁", -2.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), ("▁a", -4.0), ("bab", -5.0), ("cc", -3.0), ("é", -1.5), ("aé", -3.5), ("abab", -8.0), ("dc", -30.0)]


@settings(max_examples=400, deadline=None)
@given(hs.text(alphabet=hs.one_of(hs.sampled_from("the and of  \n▁é漢🙂x0"), hs.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_counts_as_the_library(text):
    assert vt.counter(PATH).counts([text]) == [len(WHOLE.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=400, deadline=None)
@given(hs.text(alphabet="aabbccd é▁", max_size=40), hs.booleans())
def test_ties_and_unknown_runs(text, has_bytes):
    assert vt.UnigramCounter(SMALL, has_bytes).counts([text]) == [len(library(SMALL, has_bytes).encode(text, add_special_tokens=False).ids)]


def test_table(spark, odd):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in vt.token_counts(odd, PATH).collect())
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(WHOLE.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert got == want
    assert vt.token_counts(odd.limit(0), PATH).count() == 0
    assert vt.UnigramCounter([], False).counts(["", "ab c"]) == [0, 2]


def test_query_counts_every_document(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in vt.op6_viterbi_token_counts(spark, sf).collect()}
    assert got == {i: len(WHOLE.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
