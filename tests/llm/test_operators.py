"""Each operator against a plain version on small fixtures, with nulls, empty and very long texts, ties, repeated rows, an empty table and extra columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from catalith.llm import ann, byte_bpe, exact_dedup, language_id, packing, sharding, simhash, substring_dedup, toxicity, url_filter
from catalith.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id int, fp string, score double, shard string, bucket int"


def words(n, seed, size=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = words(60, 1)
    out = [base, base, base.replace(" ", "\t\n"), words(60, 2) + " " + base, "", None, " ", "a", "one two", words(12, 3), words(13, 3), words(20_000, 4, 3_000), "x" * 100_000, words(60, 5).upper(), words(60, 5), "ünïcödé ß " * 30, "ünïcödé ß " * 30]
    return list(enumerate(out, 1)) + [(1, base), (None, base), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "fp", 0.5, "s", 3) for i, t in texts], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(df, rows):
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(rows)


def test_exact_dedup(docs, texts, none):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[key(t)].append(i)
    want = []
    for i, t in texts:
        keep = min(x for x in groups[key(t)] if x is not None)
        want.append((i, keep, len(groups[key(t)]), i == keep, hashlib.sha256(key(t).encode()).hexdigest()))
    same_rows(exact_dedup.classes(docs), want)
    assert exact_dedup.classes(none).count() == 0


def test_fingerprints_compose_and_collisions_are_found(spark, monkeypatch):
    data = b"some text " * 999
    assert exact_dedup.fingerprint(data, 7) == exact_dedup.fingerprint(data, 4096) == exact_dedup.combine(exact_dedup.fingerprint(data[:50]), exact_dedup.fingerprint(data[50:]))
    d, n = exact_dedup.PRIME - 1, 0
    while d % 2 == 0:
        d, n = d // 2, n + 1
    assert all(pow(a, d, exact_dedup.PRIME) == 1 or any(pow(a, d << i, exact_dedup.PRIME) == exact_dedup.PRIME - 1 for i in range(n)) for a in (2, 3, 5, 7, 11, 13, 17))
    assert exact_dedup.same(data, bytes(data), 100) and not exact_dedup.same(data, data[:-1] + b"!", 100)
    rows = exact_dedup.numbered(spark.createDataFrame([(1, "aaa"), (2, "bbb"), (None, "aaa"), (None, "ccc")], "doc_id long, text string"))
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda text, chunk=0: (7, 3))  # all texts collide, in the driver's process only
    marks = spark.createDataFrame([(r["at"], r["doc_id"], (7).to_bytes(13, "big"), 3, "x") for r in rows.collect()], exact_dedup.MARKS)
    real = spark.createDataFrame([(r["at"], r["doc_id"], exact_dedup.chunk_hash(bytes(r["text"]))[0].to_bytes(13, "big"), 3, "x") for r in rows.collect()], exact_dedup.MARKS)
    assert exact_dedup.collisions(rows, real).count() == 0
    batches = [b for b in rows.selectExpr("at", "cast(null as binary) as fp", "3L as size", "0 as salt", "text").toArrow().to_batches()]
    fixed = [b.set_column(1, "fp", pa.array([(7).to_bytes(13, "big")] * b.num_rows, pa.binary())) for b in batches]
    apart = sum(out.num_rows for out in exact_dedup._differing_rows(iter([pa.concat_batches(fixed)])))
    assert apart == 2 and marks.count() == 4  # the two that differ from the first


def plain_removal(texts):
    rows = [(i if i is not None else float("inf"), (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in rows:
        for p in range(len(w) - 12):
            g = b" ".join(w[p : p + 13])
            first[g] = min(first.get(g, i), i)
    for (i, w), (doc_id, _) in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[b" ".join(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        yield doc_id, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)


@pytest.mark.parametrize(("steps", "fan_in"), [(1, 2), (4, 2)])
def test_substring_dedup(docs, texts, none, steps, fan_in):
    out = substring_dedup.deduplicate(docs, steps, fan_in).withColumn("kept", F.col("kept").cast("string"))
    same_rows(out, [(i, n, r, k.decode()) for i, n, r, k in plain_removal(texts)])
    assert substring_dedup.deduplicate(none).count() == 0


def test_substring_index_takes_batches_in_any_order(spark):
    batches = [[(9, words(30, 7)), (5, words(40, 8))], [(7, words(30, 8) + " " + words(20, 9))], [(1, words(40, 8)), (2, words(25, 7))]]
    index = substring_dedup.SubstringIndex(spark, 3, 2)
    frames = [spark.createDataFrame(b, "doc_id long, text string") for b in batches]
    for f in frames:
        index.add(f)
    everything = frames[0].unionByName(frames[1]).unionByName(frames[2])
    out = substring_dedup.strip(everything, substring_dedup.verify(everything, index.shared(), 3)).withColumn("kept", F.col("kept").cast("string"))
    same_rows(out, [(i, n, r, k.decode()) for i, n, r, k in plain_removal([x for b in batches for x in b])])


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts, none):
    prints = [plain_fingerprint(t) for _, t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    least = {r: min((texts[k][0] for k in range(len(texts)) if root[k] == r and texts[k][0] is not None), default=None) for r in set(root)}
    same_rows(simhash.classes(docs), [(i, f"{prints[k]:016x}", least[root[k]]) for k, (i, _) in enumerate(texts)])
    assert simhash.classes(none).count() == 0


def test_trie_join_finds_all_links():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.choice(48, rng.integers(0, 6), replace=False))) for s in seeds for _ in range(12)]
    values = np.unique(np.array(near, np.uint64))
    root = simhash.trie_links(values)
    want = np.arange(len(values))
    for _ in range(10):
        for a in range(len(values)):
            ok = (np.bitwise_count(values ^ values[a]) <= 3) & (values >> np.uint64(48) == values[a] >> np.uint64(48))
            want[ok] = want[ok].min()
    assert (root == want).all()


def test_byte_bpe(docs, texts, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path(Q.BYTE_BPE)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same_rows(byte_bpe.round_trip(docs, path, P.PATTERN), want)
    assert byte_bpe.round_trip(none, path, P.PATTERN).count() == 0
    both = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    same_rows(both.select("doc_id", F.col("decoded").cast("string")), [(i, t or "") for i, t in texts])
    codec, rng = byte_bpe.codec(path, P.PATTERN), random.Random(3)
    for _ in range(2_000):
        s = "".join(rng.choice("abcdetns AB'.\n\t  \x1céß東京12👍🏽'sé́") for _ in range(rng.randrange(40)))
        assert np.frombuffer(codec.encode(s), "<u4").tolist() == plain.encode_ordinary(s)
    long = "ab" * 3_000 + "東" * 2_000
    assert np.frombuffer(codec.encode(long), "<u4").tolist() == plain.encode_ordinary(long)


def test_utf8_stream_holds_back_unfinished_characters():
    data, stream = "aé東👍z".encode(), byte_bpe.Utf8Stream()
    parts = [stream.feed(data[i : i + 1]) for i in range(len(data))]
    assert b"".join(parts) == data and all(p.decode() is not None for p in parts) and stream.finish() == b""
    assert stream.feed("👍".encode()[:3]) == b"" and stream.finish() == "👍".encode()[:3]


def test_packing(docs, texts, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path(Q.WORD_BPE)
    plain = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).collect()
    got, total, room = collections.Counter(), 0, 0
    want = collections.Counter()
    ids_of = {t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in texts}
    for i, t in texts:
        want[i] += len(ids_of[t])
    sequences = collections.defaultdict(list)
    crcs = {(i, len(ids), s, n): zlib.crc32(ids[s : s + n].tobytes()) for i, t in texts for ids in [ids_of[t]] for p in pieces if p.doc_id == i for s, n in [(p.start, p.length)]}
    for p in pieces:
        got[p.doc_id] += p.length
        sequences[p.sequence_id].append(p)
        assert crcs[p.doc_id, p.doc_tokens, p.start, p.length] == p.ids_crc32
    assert got == want
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
        total, room = total + at, room + (at if at & (at - 1) == 0 else packing.CAPACITY)
    assert 1 - total / room < 0.02
    assert packing.pack(none, path).count() == 0


def test_bins_keep_most_documents_whole():
    rng = random.Random(8)
    lengths = [rng.choice([1, 3, 40, 700, 1_030, 2_048, rng.randrange(1, 2_048), rng.randrange(1, 9_000)]) for _ in range(3_000)]
    for sizes in (lengths, [5_000] * 300, [1_500] * 400, [1] * 5_000, [2_048] * 9, [1], []):
        bins, rows, held = packing.Bins(3), [], 0
        for i, n in enumerate(sizes):
            bins.add(i, b"\1\0\0\0" * n)
            rows += bins.rows
            bins.rows = []
            held = max(held, sum(len(p[2]) for p in bins.spare) // 4)
        bins.finish()
        rows += bins.rows
        assert held <= (packing.WAITING + 5) * packing.CAPACITY
        used, pieces, at = collections.Counter(), collections.Counter(), collections.defaultdict(int)
        for i, start, n, _, tokens, sequence, offset in rows:
            assert tokens == sizes[i] and start == pieces[i] and offset == at[sequence] and n > 0
            pieces[i] += n
            at[sequence] += n
            used[i] += 1
        assert pieces == collections.Counter(dict(enumerate(sizes))) and all(n <= 2_048 for n in at.values())
        assert sum(n != 2_048 for n in at.values()) <= 11 and all(n == 2_048 or n & (n - 1) == 0 for n in at.values())
        if sizes is lengths:
            fit = [i for i, n in enumerate(sizes) if n <= 2_048]
            assert sum(used[i] > 1 for i in fit) < len(fit) / 10


def plain_capacity(sizes, shards):
    def needs(c):
        n, held = 1, 0
        for s in sizes:
            n, held = (n, held + s) if held + s <= c else (n + 1, s)
        return n

    c = max(max(sizes), -(-sum(sizes) // shards))
    while needs(c) > shards:
        c += 1
    return c


def test_sharding(spark, docs, texts, none):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(texts)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    for r in set(r.shard for r in rows):
        assert sorted(x.slot for x in rows if x.shard == r) == list(range(sum(x.shard == r for x in rows)))
    at = collections.defaultdict(set)
    for r in rows:
        at[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in at.values()) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert sharding.shard(none).count() == 0
    rng = random.Random(1)
    sizes = [rng.randrange(1, 50) for _ in range(200)]
    atoms = spark.createDataFrame(list(enumerate(sizes)), "atom long, size long")
    begins = sharding.cuts(atoms, 8)
    sums = [sum(sizes[a:b]) for a, b in zip([0, *begins], [*begins, None], strict=True)]
    assert max(sums) == plain_capacity(sizes, 8) and len(sums) <= 8
    many = spark.createDataFrame([(i, "same") for i in range(500)], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard(many, cell_rows=50).collect()) == list(range(500))


def test_language_id(spark, docs, texts, none):
    rng = random.Random(2)
    kinds = {"en": ["the", "and", "ing", "tion", "her", "ou"], "fr": ["eau", "les", "aux", "ment", "que", "ère"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[lang], k=3)) for _ in range(30)), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(train, F.col("doc_id") < 120, carry=("doc_id", "lang")).filter("doc_id >= 120").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !! ...", "en"), (4, "x" * 500_000, None), (None, "the the", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(train.unionByName(odd), F.col("doc_id") < 200).collect() if r.doc_id is None or r.doc_id < 5}
    assert language_id.identify(none).count() == 0
    alone = {r.doc_id: (r.lang_pred, r.accepted) for r in language_id.identify(odd).collect()}
    assert alone[1] == alone[2] == alone[3] == ("und", False) and got[None].lang_pred in kinds
    assert {r.lang_pred for r in language_id.identify(odd, F.lit(False)).collect()} == {"und"}


def test_toxicity(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1, 1200):
        toxic = i % 10 == 0
        rows.append((i, " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + rng.choices(["vile", "nasty", "foul"], k=3) * toxic)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (None, ""), (5_000, "vile " * 20_000)], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (10, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, F.col("doc_id") % 5 != 1)
    got = collections.defaultdict(list)
    for r in toxicity.score(docs, model).collect():
        got[r.doc_id].append(r.score)
    assert all(0 <= s <= 1 for v in got.values() for s in v) and len(got[None]) == 2
    right = sum((got[i][0] >= 0.5) == (i % 10 == 0) for i, _ in rows)
    assert right / len(rows) > 0.97 and max(got[None]) < 0.5
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, known.filter("false"), F.lit(True))).filter("score > 0.001").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((900, 16))
    data[100:160] = data[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None] + [0.0] * 14, 0), (1004, [1.0], 0), (None, data[0].tolist(), 0), (0, data[0].tolist(), 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, rank int")
    found = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block_rows=256).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    units = data / np.linalg.norm(data, axis=1)[:, None]
    hits = 0
    for q in range(0, 900, 50):
        scores = units @ units[q]
        want = [int(i) for i in np.lexsort((np.arange(900), -np.round(scores, 12))) if i != q][:5]
        hits += len(set(want) & {i for i, _ in found[q]})
        assert len(found[q]) == 5 and all(abs(s - scores[i]) < 1e-12 for i, s in found[q])
    assert hits / 90 >= 0.9 and set(found) == set(range(0, 900, 50))
    assert [i for i, _ in found[100]] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, rank int")
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 2
    assert ann.nearest(df.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize(("url", "want"), [
    ("http://A.Example.ORG/es/1?x#y", ("a.example.org", "/es/1", "example.org/es/", "block")), ("https://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
    ("https://x.org/", ("x.org", "/", "org/", "allow")), ("https://x.org", ("x.org", "", None, None)), ("https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
    ("ftp://b.com/fr/?q", ("b.com", "/fr/", "com/fr/", "allow")), ("http://b.com?x=/de/", ("b.com", "", None, None)), ("no scheme", ("", "", None, None)), (None, ("", "", None, None)),
    ("http://com/de/", ("com", "/de/", "com/de/", "block")),
])
def test_url_rules(spark, url, want):
    r = url_filter.judged(spark.createDataFrame([(1, url)], "page_id long, url string"), Q.URL_RULES).first()
    assert (r.host, r.path, r.rule, r.verdict) == want


def test_url_models(spark):
    rng = random.Random(6)
    rows = [(i, f"http://h{i % 7}.org/good{rng.randrange(99)}" if i % 3 == 0 else f"http://h{i % 5}.com/de/bad{rng.randrange(99)}" if i % 3 == 1 else f"http://h.net/{'good' if i % 2 else 'bad'}{rng.randrange(99)}") for i in range(900)]
    df = spark.createDataFrame([*rows, (None, None), (901, "http://x.net/" + "y" * 5_000), (902, "")], "page_id long, url string")
    out = {r.page_id: r for r in url_filter.classify(df, Q.URL_RULES).collect()}
    open_ = [(i, u) for i, u in rows if i % 3 == 2]
    assert sum((out[i].verdict == "allow") == ("good" in u) for i, u in open_) / len(open_) > 0.95
    assert out[None].score == out[902].score == 0.0 and all(r.verdict in ("allow", "block") for r in out.values())
    assert url_filter.classify(df.filter("false"), Q.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.classify(df.limit(3), []).collect()} == {"allow"}
