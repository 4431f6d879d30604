import hashlib
import zlib

from driftlens.llm import shards
from driftlens.llm.common import table


def brute(rows, n):
    def key(r):
        own = "" if r.doc_id is None else hashlib.md5(str(r.doc_id).encode()).hexdigest()
        return hashlib.md5((r.text or "").encode()).hexdigest() + own

    rows = sorted(rows, key=key)
    total, at, out, slots = sum(len((r.text or "").encode()) + 16 for r in rows), 0, [], {}
    for r in rows:
        size = len((r.text or "").encode()) + 16
        shard = at * n // total
        out.append((r.doc_id, size, zlib.crc32((r.text or "").encode()), "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        at += size
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_against_brute_force_with_a_hot_text(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    hot = docs.limit(0).union(spark.range(1000, 1100).selectExpr("id", "'same same'", "'en'", "'s'", "9L"))
    docs = docs.union(hot)
    got = shards.assign_shards(docs, 7, sample=60, ranges=8).collect()
    assert in_order(got) == in_order(brute(docs.collect(), 7))


def test_odd_rows(odd, none):
    assert in_order(shards.assign_shards(odd, 3).collect()) == in_order(brute(odd.collect(), 3))
    assert shards.assign_shards(none).count() == 0
