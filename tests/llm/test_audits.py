"""The divergence audit, the alignment of tokenizers and the decontamination, each against a plain version."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalith.llm import alignment, decontamination, divergence
from catalith.llm import queries as Q
from tests.compare import difference

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, lang string, source string, term string, row long, words array<string>, count long, mark string, p long, size int, items string, pairs string"


def documents(spark, rows, cut=3):
    """rows: (doc_id, text, lang, source); the table has columns of the names that the operators use inside."""
    full = [(*r, "x", 1, ["x"], 2, "x", 3, 4, "x", "x") for r in rows]
    return spark.createDataFrame(full, CLASHING).repartition(cut)


@pytest.mark.parametrize("name", ["op11_divergence", "op13_decontamination"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    assert difference(Q.queries()[name](spark, SF), Q.ORACLE_SQL[name], SF) == ""


def plain_audit(rows, least=10, shown=10):
    df, n, by_group, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        df[lang].update(set(terms))
        n[lang].update(terms)
        by_group[lang, source].update(terms)
        groups[lang].add(source)
    for lang, sources in groups.items():
        kept = [t for t in df[lang] if df[lang][t] >= least]
        probability = lambda c, v=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in v) + 2 * len(v)) for t in v}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        p, q = {s: probability(by_group[lang, s]) for s in sources}, probability(n[lang])
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if by_group[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:shown])):
                for rank, (value, _, item) in enumerate(found, 1):
                    yield lang, s, part, item, -value, rank


def audited(df, **how):
    return sorted(tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("cells", [64, 1 << 16])
def test_audit_equals_plain_counts(spark, cells):
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(80)] + ["É", "É" * 3, "é", "UND", "und", "ß"]
    rows = []
    for i in range(500):
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        source = rng.choice(["a", "a", "a", "b", "c", "É", None, ""])
        text = rng.choice([" ", "\n", "1", "-"]).join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(40)))
        rows.append((rng.choice([i, 7, None]), rng.choice([text] * 9 + [None]), lang, source))
    rows += [(1, "hot passage here", "en", "a")] * 300 + [(2, None, "xx", "only"), (3, "", "xx", "other"), (4, "few words", "yy", "z")]
    assert audited(documents(spark, rows), cells=cells) == sorted(plain_audit(rows))


def test_audit_of_long_texts_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PART", 50)
    long = " ".join(f"t{'abcdefghij'[i % 10]} {'y' * (i % 70)}" for i in range(400))
    rows = [(i, long, "en", f"s{i % 3}") for i in range(12)] + [(99, "z" * 500, "en", "s0")]
    data = divergence.np.frombuffer(long.encode(), "u1")
    assert b"".join(p.tobytes() for p in divergence._parts(data)) == long.encode() and len(list(divergence._parts(data))) > 50
    assert audited(documents(spark, rows)) == sorted(plain_audit(rows))
    assert audited(documents(spark, rows).limit(0)) == []


def test_sketch_never_underestimates(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"k{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)), "en", "s") for i in range(200)]
    df = documents(spark, rows)
    docs = df.select("lang", "source", F.col("text").cast("binary").alias("text"))
    bits = {r.chunk: bytes(r.bits) for r in divergence.sketch(docs.select("lang", "text"), 256).collect()}
    seen = {r.term: r.documents for r in divergence.counted(docs, bits, 256).groupBy("term").agg(F.sum("documents").alias("documents")).collect()}
    exact = Counter(t for r in rows for t in set(r[1].split()))
    assert {t: n for t, n in exact.items() if n >= 10} == {t: n for t, n in seen.items() if t and n >= 10}
    assert len(seen) < len(exact)  # some are dropped before the shuffle


def test_probabilities_are_exact_for_large_counts(spark):
    row = spark.createDataFrame([(10**15, 7 * 10**15, 10**9)], "c long, total long, kept long").select(divergence.probability("c", "total", "kept").alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 2) // (7 * 10**15 + 2 * 10**9)


# ---- alignment ----


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(Q.tokenizer_path(Q.BYTE_SIDE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path(Q.PIECE_SIDE))
    letters = alignment.byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xs, ys = [a_bytes[i] for i in x], [piece(i) for i in y]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            found.append(([], [], [], []))
            continue
        spans = []
        for tokens in (xs, ys):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        borders = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for begin, end in zip([0, *borders], borders, strict=False):
            groups.append(tuple([i for i, (s, e) in zip(ids, own, strict=True) if begin <= s and e <= end] for ids, own in ((x, spans[0]), (y, spans[1]))))
        links, j = [], 0
        for i, (s, e) in zip(x, spans[0], strict=True):
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(y) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((i, y[j]))
                j += 1
        found.append((x, y, groups, links))
    counts = Counter(link for *_, links in found for link in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for x, y, groups, links in found:
        shown = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if x else ""
        yield len(x), len(y), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), digest


def strange_texts():
    rng = random.Random(3)
    pools = ["abcdef ", "aé ñçÈ\n ", " \t\n\r\x0b\x00 x", "日本語 ひら 한국", "😀👩‍👩‍👧 ä̈ ﬁ", " 　 ​\x85\x1c x y", "'s't 're'll 12,345.67 ", "<|endoftext|> <s></s> <unk> <0x41> "]
    for i in range(1_200):
        pool = pools[i % len(pools)]
        parts = [rng.choice(pool) for _ in range(rng.randrange(60))]
        yield "".join(parts) if rng.random() < 0.7 else " ".join(p for p in "".join(parts).split() if p)
    yield from ["", " ", "  ", "a  b", " a", "a ", "\n", "▁", "a ▁ b", "x" * 9_000, "the " * 4_000, "퟿", "a▁b c", "<|endoftext|>", pools[-1] * 9]


@pytest.mark.parametrize("hot", [1 << 18, 5, 0])
def test_alignment_equals_offsets(spark, monkeypatch, hot):
    texts = list(strange_texts())[:: 1 if hot else 7]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ["the same words again"] * 40
    rows = [(i % 50 or None, t, None, None) for i, t in enumerate(texts)] + [(5, None, None, None)]
    out = alignment.align(documents(spark, rows), Q.tokenizer_path(Q.BYTE_SIDE), Q.tokenizer_path(Q.PIECE_SIDE), hot)
    want = Counter((r[0], *p) for r, p in zip(rows, plain_alignment([r[1] for r in rows]), strict=True))
    have = Counter(tuple(r) for r in out.collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
    assert sum(n for r, n in want.items() if r[1]) > 100


def test_long_texts_are_aligned_part_by_part(monkeypatch):
    own = alignment.aligner(Q.tokenizer_path(Q.BYTE_SIDE), Q.tokenizer_path(Q.PIECE_SIDE))
    text = " ".join(f"wörd{i % 7}\nof a  line{i}" for i in range(3_000))
    whole = own.align([text, ""])
    monkeypatch.setattr(alignment, "STRETCH", 100)
    assert len(list(own.stretches(text))) > 300
    cut = own.align([text, ""])
    assert [tuple(map(str, x)) for x in whole] == [tuple(map(str, x)) for x in cut]


def test_transducer_memoises_and_refuses_other_bytes():
    t = alignment.Transducer([b"ab", b"c", b"abcd", b""], [b"a", b"bc", b"d", b"x"], moves=3)
    assert t.run([0, 1], [0, 1]) == ([([0, 1], [0, 1])], [(0, 0), (0, 1), (1, 1)])
    assert t.run([2], [0, 1, 2]) == ([([2], [0, 1, 2])], [(2, 0), (2, 1), (2, 2)])
    assert t.run([0, 1], [0, 3]) is None and t.run([0], [0]) is None and t.run([0], [0, 1]) is None and t.run([], []) == ([], [])
    assert t.run([0, 1, 0, 1], [0, 1, 0, 1])[0] == [([0, 1], [0, 1])] * 2


def test_alignment_of_an_empty_table(spark):
    out = alignment.align(documents(spark, [(1, "a", None, None)]).limit(0), Q.tokenizer_path(Q.BYTE_SIDE), Q.tokenizer_path(Q.PIECE_SIDE))
    assert out.collect() == []


# ---- decontamination ----


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain_decontamination(rows, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for at in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[at : at + size])].add(item)
    sizes = {len(w) for w in windows}
    for doc_id, text, *_ in rows:
        w, hit, found = item_words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                who = windows.get(tuple(w[at : at + n]))
                if who is not None:
                    hit.update(range(at, at + n))
                    found |= {str(i) for i in who if i is not None}
        yield doc_id, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination_equals_plain_search(spark, block):
    rng = random.Random(4)
    words = ["the", "of", "a1", "É", "é", "x", "TWO", "nine9", "ß", "İ"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, [9, 6, 3, 1, 1, 1, 1, 1, 1, 1], k=n))
    items = [(i, text(rng.choice([12, 14, 25, 10]))) for i in range(12)] + [(100, "x nine9 x"), (101, "ß ß"), (7, "second text of item seven " * 4), (None, "no id here at all " * 4)]
    items += [(200, ""), (201, None), (202, "?!"), (203, "the"), (204, items[0][1]), (205, "ABC-DEF 12")]
    rows = []
    for i in range(150):
        parts = [rng.choice([text(rng.randrange(30)), items[rng.randrange(12)][1] or "", (items[rng.randrange(16)][1] or "")[5:]]) for _ in range(rng.randrange(4))]
        rows.append((rng.choice([i, 3, None]), rng.choice(["\n", " "]).join(parts), None, None))
    rows += [(1, items[0][1].upper(), None, None)] * 3 + [(2, None, None, None), (4, "", None, None), (5, "...", None, None), (6, "A", None, None), (8, "a b", None, None), (9, text(30_000), None, None)]
    bench = spark.createDataFrame([(*x, 1, ["x"]) for x in items], "item_id long, text string, word long, window array<string>")
    out = decontamination.decontaminate(documents(spark, rows), bench, block=block)
    have = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in out.collect())
    want = Counter(plain_decontamination(rows, items))
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])


def test_decontamination_without_items_or_documents(spark):
    bench = spark.createDataFrame([("q1", "some words that an item has and more words still here")], "item_id string, text string")
    docs = documents(spark, [(1, "some words that an item has and more words still here", None, None)])
    assert decontamination.decontaminate(docs.limit(0), bench).collect() == []
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontamination.decontaminate(docs, bench.limit(0)).collect()] == [(1, 11, 0, 0)]
    assert [(r.n_hit, list(r["items"])) for r in decontamination.decontaminate(docs, bench).collect()] == [(11, ["q1"])]


def test_decontamination_runs_no_python(spark):
    out = Q.op13_decontamination(spark, SF)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
