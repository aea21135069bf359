"""Operator 4: files that are read back hold what the tokenizer gives for whole texts."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from stridewell.llm import records
from stridewell.shared import shared_folder

from .common import DATA, no_documents, odd_documents

ODD_TEXTS = ["a  b", " lead", "trail ", "don't 12 345\n\n x", "tab\t y", "nb  sp", "em  q", "　 z", "\x1c a", "é 日本 語", "a \u0085 b", "  ", "x\r\n y", "<|endoftext|> a", "👍🏽 ok"]


def brute(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int]]:
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def folder(spark) -> str:
    return f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"


def test_documents_equal_the_tokenizer(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, records.op4_token_records(spark, DATA).collect())) == brute(rows)


def test_odd_texts_equal_the_tokenizer(spark):
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, *(a + b for a in ODD_TEXTS for b in ODD_TEXTS), None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, records.read_records(records.write_records(df, folder(spark))).collect())) == brute(rows)


def test_a_record_can_be_read_alone(spark):
    file = records.write_records(odd_documents(spark).filter("doc_id = 5"), folder(spark)).first()
    system, path = fs.FileSystem.from_uri(file.data)
    raw = system.open_input_file(path).read()
    assert struct.unpack_from("<Q", raw)[0] == len(raw) - 16 == file.n_tokens * file.width


@pytest.mark.parametrize("at", [0, 9, 20, -1])
def test_damage_is_found(spark, at):
    manifest = records.write_records(odd_documents(spark).filter("doc_id = 5"), folder(spark))
    system, path = fs.FileSystem.from_uri(manifest.first().data)
    raw = bytearray(system.open_input_file(path).read())
    raw[at] ^= 1
    with system.open_output_stream(path) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(manifest).collect()


def test_crc32c_of_known_strings():
    for text, want in ((b"123456789", 0xE3069283), (bytes(32), 0x8A9136AA), (b"", 0), (b"a", 0xC1D04330)):
        assert int(records.crc32c(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]) == want


def test_odd_rows(spark):
    out = records.read_records(records.write_records(odd_documents(spark), folder(spark))).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12]
    assert [r.n_tokens for r in out if r.doc_id in (1, 2)] == [1, 1]
    assert records.read_records(records.write_records(no_documents(spark), folder(spark))).count() == 0


def test_records_are_read_through_the_index_in_any_order(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    manifest = records.write_records(docs, folder(spark))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    entries = records.read_index(manifest)
    assert entries.count() == len(want)
    some = entries.filter("doc_id % 3 = 1").orderBy(F.rand(5))
    out = records.read_at(some.union(some.limit(2))).collect()
    assert len(out) == sum(i % 3 == 1 for i in want) + 2 and all(r.ids == want[r.doc_id] for r in out)
    assert [r.doc_id for r in out] != sorted(r.doc_id for r in out)


def test_rows_of_one_id_come_in_the_order_of_their_texts(spark):
    texts = ["b two", "a one", "c three", "a one"]
    for k in range(3):
        df = spark.createDataFrame([(4, t) for t in texts[k:] + texts[:k]], "doc_id long, text string").repartition(2)
        assert sorted(map(tuple, records.read_records(records.write_records(df, folder(spark))).collect())) == brute([(4, t) for t in texts])
