import hashlib

import duckdb
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prospectrum.llm import bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTE)
MODEL = bpe.model(BYTE)


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    back = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabbcdeXYZ  \n\t'stllvereß ÉÀéİΣς12½²_-—<|>.,!́\xa0\x85\x1c漢😀ªµ"), max_size=40))
def test_equal_to_the_library(text):
    assert MODEL.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.digest_batch(MODEL, [text]) == [want(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aab h", max_size=30), max_size=8))
def test_words_of_one_index_do_not_touch(words):
    words = [w.encode() for w in words if w]
    assert MODEL.apply(words) == [MODEL.apply([w])[0] for w in words]


def test_op4_on_a_table(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in bpe.op4_bpe_round_trip(spark, sf_dir).collect()) == sorted((d, *want(t)) for d, t in docs)


def test_edges_and_round_trip(spark, edge_docs, empty_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = [tuple(r) for r in bpe.encode_digest(edge_docs, BYTE).collect()]
    assert sorted(got, key=str) == sorted(((d, *want(t)) for d, t in docs), key=str)
    back = bpe.decode_column(bpe.encode_column(edge_docs, BYTE), BYTE).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in docs)
    assert bpe.encode_digest(empty_docs, BYTE).collect() == []
