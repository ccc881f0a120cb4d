import struct
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prospectrum.llm import packing, token_files
from prospectrum.llm.common import shared_folder
from prospectrum.llm.fast_encode import as_ids, encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def library(path, texts):
    return [e.ids for e in LIBRARY[path].encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcXYZ  \n\t'sß ÉÀéİıΣςσ12½²_-—<|>.,!́\xa0\x85\x1c漢😀ªµ"), max_size=30), max_size=5))
def test_fast_encoders_equal_the_library(texts):
    for kind, path in (("word", WORD), ("byte", BYTE)):
        assert [as_ids(x).tolist() for x in encoder(kind, path).encode(texts)] == library(path, texts)


def check_packing(rows, docs, capacity=2048):
    """rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    want = defaultdict(list)
    for d, ids in docs:
        ids = [*ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d].append((k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = defaultdict(list)
    for r in rows:
        got[r[0]].append(tuple(r[1:5]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[3]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r[3] for r in rows)
    return len(sequences), -(-total // capacity)


def test_op1_on_a_table(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    rows = [tuple(r) for r in packing.op1_best_fit_packing(spark, sf_dir).collect()]
    used, least = check_packing(rows, zip([d for d, _ in docs], library(WORD, [t for _, t in docs]), strict=True))
    assert used <= least * 1.02 + 1


def test_op1_edges(spark, edge_docs, empty_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    rows = [tuple(r) for r in packing.best_fit_pack(edge_docs, WORD, 64).collect()]
    check_packing(rows, zip([d for d, _ in docs], library(WORD, [t for _, t in docs]), strict=True), 64)
    assert packing.best_fit_pack(empty_docs, WORD).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=20))
def test_plan_is_gapless_and_whole(counts):
    bins = defaultdict(list)
    seen = defaultdict(list)
    for length, first_rank, ranks, first, each, offset in packing.plan_packing(counts, 40):
        for k in range(ranks):
            seen[length].append(first_rank + k)
            bins[first + k // each].append((offset + k % each * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(c)) for k, c in counts.items()}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 40
        assert sum(3 * n > 40 for _, n in items) <= 2
    assert sorted(bins) == list(range(len(bins)))


def digest(docs):
    at, out = 0, []
    for d, ids in docs:
        ids = [*ids, 2]
        out.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_op8_on_a_table(spark, sf_dir):
    docs = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by 1").fetchall()
    want = digest(zip([d for d, _ in docs], library(BYTE, [t for _, t in docs]), strict=True))
    assert sorted(tuple(r) for r in token_files.op8_token_orc(spark, sf_dir).collect()) == want


def test_op8_edges(spark, edge_docs, empty_docs):
    path = shared_folder(spark)
    token_files.write_tokens(edge_docs, path, BYTE)
    rows = sorted((tuple(r) for r in token_files.read_digest(spark, path).collect()), key=lambda r: r[1])
    docs = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: -1 if r[0] is None else r[0])
    assert rows == digest(zip([d for d, _ in docs], library(BYTE, [t for _, t in docs]), strict=True))
    assert {r.doc_id for r in token_files.lookup(spark, path, [5, 11]).collect()} == {5, 11}
    path = shared_folder(spark)
    token_files.write_tokens(empty_docs, path, BYTE)
    assert token_files.read_digest(spark, path).collect() == []


@pytest.mark.parametrize("capacity", [1, 7])
def test_plan_of_small_capacity(capacity):
    counts = dict.fromkeys(range(1, capacity + 1), 3)
    assert sum(r[2] for r in packing.plan_packing(counts, capacity)) == sum(counts.values())


def test_op8_hot_ids_and_many_ranges(spark, monkeypatch):
    """A third of the rows have one id and a third none: they are dealt to many ranges, and order holds all the same."""
    monkeypatch.setattr(token_files, "RANGE_BYTES", 4000)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} " + "word " * (i % 50)) for i in range(1500)]
    path = shared_folder(spark)
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, BYTE)
    stored = spark.read.orc(path)
    assert stored.select("part").distinct().count() > 30
    assert stored.where("doc_id = 7").select("part").distinct().count() > 8 and stored.where("doc_id is null").select("part").distinct().count() > 8
    got = sorted((tuple(r) for r in token_files.read_digest(spark, path).collect()), key=lambda r: r[1])
    order = [-1 if r[0] is None else r[0] for r in got]
    assert order == sorted(order)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = [(d, n, crc) for d, _, n, crc in digest(zip([d for d, _ in rows], library(BYTE, [t for _, t in rows]), strict=True))]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((d, n, crc) for d, _, n, crc in got), key=key) == sorted(want, key=key)


def test_op8_indexes_prune(spark):
    """A row index of 1000 rows, run lengths that shrink repeats, and a Bloom filter that rules out an absent id."""
    path = shared_folder(spark)
    token_files.write_tokens(spark.createDataFrame([(2 * i, "the same words") for i in range(40_000)], "doc_id long, text string").coalesce(4), path, BYTE)

    def scanned(df):
        df.collect()
        plan, out = df._jdf.queryExecution().executedPlan(), 0
        nodes = [plan]
        while nodes:
            node = nodes.pop()
            kids = node.children()
            nodes += [kids.apply(i) for i in range(kids.size())]
            if node.nodeName().startswith("Scan orc"):
                out += node.metrics().apply("numOutputRows").value()
        return out

    assert scanned(token_files.lookup(spark, path, [20_000])) in range(1, 1001)
    assert scanned(token_files.lookup(spark, path, [20_001])) == 0
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = [f.getPath() for f in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().startswith("part-")]
    reader = jvm.org.apache.orc.OrcFile.createReader(files[0], jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == token_files.STRIDE and reader.getRawDataSize() > 8 * reader.getContentLength()
