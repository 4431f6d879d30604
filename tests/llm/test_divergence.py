import re
from collections import Counter, defaultdict

from driftlens.llm import divergence as D

DDL = "doc_id long, text string, lang string, source string, n long, p string, base int, terms int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, 1, "x", 2, 3, 4) for k, (lang, s, t) in enumerate(rows)], DDL)


def brute(rows):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        shares = {s: share(c, kept) for (g, s), c in groups.items() if g == lang}
        whole = share(sum((c for (g, _), c in groups.items() if g == lang), Counter()), kept)
        p = shares[source]
        pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), s) for s, q in shares.items() if s != source]
        terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[lang, source][t] and p[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, D.TOP)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def share(counts, kept):
    total = sum(counts[t] for t in kept) + len(kept)
    return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 64)
    monkeypatch.setattr(D, "TOP", 5)
    rows = [("en", f"s{k % 4}", " ".join(f"W{chr(97 + (k * j) % 23)}x" for j in range(k % 17))) for k in range(60)]
    rows += [("de", s, "Über über ÜBER Straße zahl9zahl") for s in ("a", "b", "a", "c")] + [("fr", "only", "un deux trois")] * 3
    rows += [("xx", "a", "rare"), ("xx", "b", "words"), (None, None, None), (None, "z", "z z z"), (None, "z", "z"), (None, None, "z\x00z")]
    assert {tuple(r) for r in D.divergences(frame(spark, rows)).collect()} == brute(rows)


def test_ties_and_empty(spark):
    rows = [("en", s, "b a c é") for s in ("x", "x", "x", "y")] + [("en", "y", "d d d d")] * 3
    got = D.divergences(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert [r["item"] for r in sorted(got, key=lambda r: r["rank"]) if r["source"] == "x" and r["part"] == "term"] == ["a", "b", "c", "é"]
    assert D.divergences(frame(spark, [])).count() == 0


def test_bytes_that_are_no_utf8(spark):
    rows = frame(spark, [("en", "x", "a")] * 3).selectExpr("doc_id", "cast(X'61FF62' as string) as text", "lang", "source")
    assert D.divergences(rows).count() == 0  # one source, whose share is the language's


def test_long_text(spark):
    rows = [("en", "x", "word " * 1_000_000), ("en", "y", "word other"), ("en", "y", "word")]
    assert {tuple(r) for r in D.divergences(frame(spark, rows)).collect()} == brute(rows)


def test_arithmetic_beyond_a_billion_counts(spark):
    count, of = 7_000_000_000_000_000, 9_000_000_000_000_001
    row = spark.range(1).select(D._share(D.F.lit(count), D.F.lit(of)).alias("p"), D._apart(D.F.lit(10**9).cast("long"), D.F.lit(1)).alias("f")).first()
    assert tuple(row) == (1 + 10**9 * (count + 1) // of, (10**9 - 1) ** 2)
