import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from driftlens.llm import idfiles
from driftlens.llm.common import shared_dir, table
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")


def run(spark, docs):
    folder = f"{shared_dir(spark)}/ids"
    files, dictionary = idfiles.write_ids(docs, folder, PATH)
    return idfiles.read_ids(files, folder, dictionary).collect()


def test_files_hold_what_the_library_gives(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "SHARD_BYTES", 200_000)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    tokenizer = Tokenizer.from_file(PATH)
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r)[:4] for r in run(spark, docs)) == want


def test_added_tokens_in_texts_are_what_the_library_makes_of_them(spark):
    library, own = Tokenizer.from_file(PATH), idfiles.Encoder(PATH)
    for text in ("<|endoftext|>", "one<|endoftext|> two  <|endoftext|>", "<|endoftext", "a <|ENDOFTEXT|>"):
        assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_what_is_remembered_makes_no_difference(monkeypatch):
    texts = [" ".join(f"wörd{k * j} {j}." for k in range(200)) for j in range(1, 8)]
    want = idfiles.Encoder(PATH).encode(texts)
    monkeypatch.setattr(idfiles, "MEMO", 50)
    own = idfiles.Encoder(PATH)
    assert [x for t in texts for x in own.encode([t])] == want and len(own.after.old) + len(own.after) < 2000


def test_one_document_is_read_by_seeks(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "SHARD_BYTES", 100_000)
    folder = f"{shared_dir(spark)}/ids"
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    files, dictionary = idfiles.write_ids(docs, folder, PATH)
    own, texts = idfiles.Encoder(PATH), {r.doc_id: r.text for r in docs.collect()}
    assert files.count() > 2 and dictionary

    class Counted:
        def __init__(self, source):
            self.source, self.bytes, self.seek = source, 0, source.seek

        def read(self, n):
            self.bytes += n
            return self.source.read(n)

    seen = set()
    for r in files.collect():
        with open(r.file, "rb") as source:
            counted = Counted(source)
            f = idfiles.IdFile(counted, dictionary)
            for doc in f.index["doc_id"].tolist():
                before, (k,) = counted.bytes, f.find(doc)
                assert f.ids(k).tobytes() == own.encode([texts[doc] or ""])[0]
                assert counted.bytes - before == f.index["size"][k]
                seen.add(doc)
            assert list(f.find(-5)) == []
    assert seen == set(texts)


def test_equal_and_null_ids_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "SHARD_BYTES", 20_000)
    docs = spark.range(600).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "concat(repeat(concat('w', id, ' '), 40), 'x') AS text")
    folder = f"{shared_dir(spark)}/ids"
    files, dictionary = idfiles.write_ids(docs, folder, PATH)
    assert files.select("part").distinct().count() > 3
    rows = sorted(idfiles.read_ids(files, folder, dictionary).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids) and len(ids) == 600


def test_odd_rows(spark, odd, none):
    rows = sorted(run(spark, odd), key=lambda r: r.start)
    assert len(rows) == 12 and [r.doc_id for r in rows][:2] == [None, None]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert run(spark, none) == []


def test_a_file_knows_its_dictionary():
    data = idfiles.write_file([], b"one")
    with pytest.raises(ValueError, match="another dictionary"):
        idfiles.IdFile(io.BytesIO(data), b"two")
