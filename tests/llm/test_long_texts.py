"""Texts of megabytes, and a word of hundreds of kilobytes, through every operator on documents."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from driftlens.llm import bpe, decontam, idfiles, lblm, licenses, neardup, ogg, shards, toxicity
from driftlens.llm.common import shared_dir
from tokenizers import Tokenizer

from tests.llm.conftest import frame

RNG = np.random.default_rng(12)
ITEM = "nine words of a benchmark that nobody else writes"
PROSE = " ".join(f"w{k}" for k in RNG.integers(0, 50_000, 200_000)) + ". " + ITEM
WORD = "ab" * 150_000
TEXTS = {1: PROSE, 2: PROSE, 3: WORD, 4: "= " * 100_000, 5: "short"}


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, list(TEXTS.items())).repartition(2)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_licenses(docs):
    got = by_id(licenses.license_scan(docs))
    assert {k: r.n_words for k, r in got.items()} == {1: 200_009, 2: 200_009, 3: 1, 4: 0, 5: 1}


def test_bpe(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for k, r in by_id(bpe.encode_decode(docs, path)).items():
        assert r.ids == own.encode_ordinary(TEXTS[k]) and r.decoded == TEXTS[k]


def test_id_files(spark, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    folder = f"{shared_dir(spark)}/ids"
    files, dictionary = idfiles.write_ids(docs, folder, P.path("byte_bpe_50k.json"))
    for k, r in by_id(idfiles.read_ids(files, folder, dictionary)).items():
        ids = np.array([*library.encode(TEXTS[k], add_special_tokens=False).ids, 0], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_near_duplicates(docs):
    got = by_id(neardup.near_duplicates(docs))
    words = PROSE.split()
    assert got[1].n_shingles == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    assert {k: r.component_id for k, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_benchmark_item_at_the_end(spark, docs):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {(r.doc_id, r.word_start) for r in decontam.contaminated(docs, bench).collect()} == {(1, 200_000), (2, 200_000)}


def test_scores_media_and_shards(docs):
    model = toxicity.Classifier(np.array([8], np.int64), np.array([1.0]), -1.0)
    assert all(0 < r.score < 1 for r in toxicity.toxicity_scores(docs, model).collect())
    scored = by_id(lblm.score(docs))
    assert {k: r.n_tokens for k, r in scored.items()} == {k: len(t.split()) + 1 for k, t in TEXTS.items()}
    assert scored[1].score == scored[2].score
    media = by_id(ogg.media_features(ogg.to_media(docs)))
    assert {k: r.n_bytes for k, r in media.items()} == {k: len(t) for k, t in TEXTS.items()}
    assert {r.doc_id: r.size for r in shards.assign_shards(docs).collect()} == {k: len(t) + 16 for k, t in TEXTS.items()}
