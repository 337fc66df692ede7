"""The operators of the llm subpackage against brute force, and on odd input."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import components, decontaminate, fixity, interpolation, packing, quality, queries, repeats, secrets, simhash, suffix_groups, urlmodel, winnow
from graphloom.llm.common import split_words, xxh64_spans
from tests.llm.test_near import brute_components

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, ties, a long text and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "A b"), (4, "A b"), (5, "a B"), (6, long), (7, long + " x"), (8, "é\u2028ß x\x00y"), (None, "a b"), (9, "password = 'abcdefgh1' AKIAABCDEFGHIJKL " + "0f" * 20), (10, "password = 'abcdefgh1'")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit(1) for c in ("fp", "key", "node", "root", "bucket", "block", "fold", "score", "label", "hash", "count", "length", "piece", "features", "row")}
    return df.withColumns(extra).withColumns({"source": F.lit("s"), "lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "a b"), (2, "a b"), (3, None), (4, "..."), (None, "x y")], "item_id long, text string")


def test_words_and_hashes():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(5000))
    at, size = np.array([r.randrange(4800) for _ in range(3000)]), np.array([r.choice([0, 3, 8, 17, 31, 32, 33, 64, 90]) for _ in range(3000)])
    assert xxh64_spans(data, at, size).tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(at, size)]
    some = [None, "", " a\x0bB \x1c\x85 c\u2003d\n", "x"]
    words, count = split_words(pa.array(some))
    assert words.to_pylist() == [w for s in some for w in re.findall(SPACE, s or "")] and count.tolist() == [len(re.findall(SPACE, s or "")) for s in some]


# 1 ---------------------------------------------------------------------------------
def test_fixity(spark):
    a = spark.createDataFrame([(i, f"p{i}", "x" * (i % 5)) for i in range(300)] + [(None, "q", None), (7, "p7", "xx")], "pos long, name string, body string")
    assert fixity.fixity_audit(a, a, "pos", ["name", "body"]).count() == 0
    b = a.where("coalesce(pos, 0) <> 13").withColumn("body", F.when(F.col("pos") == 200, "y").when(F.col("pos").isNull(), "").otherwise(F.col("body"))).unionByName(spark.createDataFrame([(5000, "n", "b"), (9, "p9", "xxxx")], a.schema))
    got = {r.position: (r.kind, r.primary_records, r.replica_records, r.range_start, r.range_end) for r in fixity.fixity_audit(a, b, "pos", ["name", "body"]).collect()}
    size = lambda i: len(f"p{i}") + i % 5
    upto = lambda i: 1 + sum(size(k) for k in range(i)) + (4 if i > 7 else 0)
    assert got[13] == ("missing", 1, 0, upto(13), upto(14)) and got[200][0] == "changed" and got[200][3:] == (upto(200), upto(201))
    assert got[9] == ("repeated", 1, 2, upto(9), upto(10)) and got[5000][0] == "extra" and got[-1][0] == "changed" and len(got) == 5
    empty = a.limit(0)
    assert fixity.fixity_audit(a, empty, "pos", ["name"]).count() == 301 and fixity.fixity_audit(empty, empty, "pos", ["name"]).count() == 0


def test_fixity_descends_only_where_trees_differ(spark):
    a = spark.range(5000).selectExpr("id as pos", "cast(id as string) as body")
    t = fixity.merkle_tree(a, "pos", ["body"])
    assert [x.count() for x in t] == [5000, 79, 2, 1]
    assert t[-1].first().n_records == 5000


# 2 ---------------------------------------------------------------------------------
def test_interpolation(spark, documents, texts, monkeypatch):
    kept = []
    learn = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda c: kept.append((c, learn(c))) or kept[-1][1])
    got = {r.doc_id: r for r in interpolation.interpolated_scores(documents, interpolation.document_folds(), block_bytes=50_000, bucket_keys=5_000).collect()}
    cells, w = kept[0]
    tok = {i: [*re.findall(SPACE, low(t)), None] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in tok}
    uni, bi, n_docs = collections.Counter(), collections.Counter(), 0
    for i, t in tok.items():
        if fold[i] != 1:
            n_docs += 1
            uni.update(t)
            bi.update(zip(["<s>", *t[:-1]], t))
    n, v = sum(uni.values()), len(uni)
    for i, t in tok.items():
        base = sum(math.log10((uni[a] + 0.5) / (n + 0.5 * (v + 1))) for a in t)
        score = 0.0
        for h, a in zip(["<s>", *t[:-1]], t):
            c = n_docs if h == "<s>" else uni[h]
            b = 1 + int(math.log2(c)) if c else 0
            score += math.log10(w[b][0] * (bi[h, a] / c if c else 0) + w[b][1] * uni[a] / n + w[b][2] / (v + 1))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i] == 1, len(t), sum(uni[a] > 0 for a in t), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)
    # The weights were learnt on every token of the deleted part, and serve held-out texts better than the base does.
    assert sum(c[3] for c in cells) == sum(len(t) for i, t in tok.items() if fold[i] == 4)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_expectation_maximisation_finds_the_mixture():
    # Ratios as of tokens that come from the bigram estimate in three of four cases.
    no = interpolation._NONE
    w = interpolation.learn_weights([(3, 160, 16, 75), (3, no, 16, 15), (3, no, no, 10)])
    assert w[3][0] == pytest.approx(0.75, abs=0.02) and w[3].sum() == pytest.approx(1) and (w[9] == w[3]).all() and w[0][0] == 0


def test_weights_are_those_of_expectation_maximisation_on_single_tokens():
    """Against EM on each token's own ratios, of which many are below 1: words that are rarer than uniform."""
    g = np.random.default_rng(11)
    r2 = np.where(g.random(20_000) < 0.4, 0.0, 2.0 ** g.normal(2, 3, 20_000))
    r1 = 2.0 ** g.normal(-1, 2, 20_000)
    joint = np.stack([r2, r1, np.ones(20_000)], axis=1)
    w = np.full(3, 1 / 3)
    for _ in range(3000):
        w = (joint * w / (joint @ w)[:, None]).mean(axis=0)
    cells = collections.Counter((2, int(round(16 * math.log2(a))) if a else interpolation._NONE, int(round(16 * math.log2(b)))) for a, b in zip(r2, r1))
    got = interpolation.learn_weights([(*k, v) for k, v in cells.items()])[2]
    assert np.abs(got - w).max() < 2e-3
    assert np.log(joint @ got).mean() == pytest.approx(np.log(joint @ w).mean(), abs=1e-3)


def test_keys_packed_as_differences():
    g = np.random.default_rng(3)
    for k in (np.array([7], np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(g.integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64) * np.uint64(2))):
        assert (interpolation._unpacked_keys(interpolation._packed_keys(k)) == k).all()


def test_interpolation_odd(odd):
    got = interpolation.interpolated_scores(odd, interpolation.document_folds())
    assert got.count() == 12 and got.where("score is null or isnan(score) or score > 0").count() == 0
    assert interpolation.interpolated_scores(odd.limit(0), interpolation.document_folds()).count() == 0
    none = interpolation.interpolated_scores(odd, F.lit(interpolation.HELD_OUT)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)


# 3 ---------------------------------------------------------------------------------
def brute_pieces(tokenizer, text, capacity):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity)) for p in [ids[s : s + capacity]]]


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, documents, texts, odd, capacity):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    t = Tokenizer.from_file(path)
    rows = packing.pack(documents, path, capacity).collect()
    want = sorted((i, *p) for i, x in texts.items() for p in brute_pieces(t, x, capacity))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = check_packing(rows, capacity)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // capacity) + 1
    more = packing.pack(odd, path, capacity).collect()
    check_packing(more, capacity)
    assert sum(r.doc_id == 4 for r in more) == 2 and sum(r.doc_id is None for r in more) == 1
    assert packing.pack(odd.limit(0), path, capacity).count() == 0


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    t, w = Tokenizer.from_file(path), packing.WordIds(path)
    some = ["It's a,b. c!?;: 3,14 x|y <|endoftext|>Z <|ENDOFTEXT|> e\u0301 H\u0331 İ\u0130 ﬁ", None, "", "A\u3000B\u00a0C", "don't'S we'LL a'b", "日本語 テスト", "x" * 3000]
    ids, n = w.ids(pa.array(some), 0)
    assert ids.tolist() == [i for s in some for i in [*t.encode(s or "", add_special_tokens=False).ids, 0]] and n.sum() == len(ids)


def test_plan_keeps_every_capacity():
    r = random.Random(2)
    for score in ("norm", "dot"):
        counts = {n: r.randrange(1, 40) for n in range(1, 41)}
        caps = (40, 5, 700)
        plan = packing.plan_best_fit({k: v for k, v in counts.items() if k * k <= caps[2]}, caps, score=score)
        bins = collections.defaultdict(list)
        for n, v in counts.items():
            own = plan[plan[:, 0] == n]
            if n * n > caps[2]:
                continue
            for k in range(v):
                _, first, seq, each, offset = own[np.searchsorted(own[:, 1], k, side="right") - 1]
                bins[seq + (k - first) // each].append((offset + (k - first) % each * n, n))
        for v in bins.values():
            assert sum(n for _, n in v) <= 40 and len(v) <= 5 and sum(n * n for _, n in v) <= 700
            assert sorted(o for o, _ in v) == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))]
    with pytest.raises(ValueError):
        packing.plan_best_fit({50: 1}, (40, 5, 700))


# 4 ---------------------------------------------------------------------------------
RULES = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(RULES) for m in rx.finditer(text or "") if ok(m))


def test_base_spans(texts):
    tricky = ["token=token:abcdefgh12 Token = 'SECRET-12345678'", "AKIAAKIAABCDEFGHIJ AKIA AKIA123", "ſecret=abcdefgh12 toKen=abcdefgh12", "é api_key:\t=x apikey: \"ABCDEFG.H=\"", "f" * 31 + " " + "f" * 32 + "g" + "0" * 40]
    for t in [*texts.values(), *tricky]:
        assert [x[:3] for x in secrets.base_spans(t)] == brute_spans(t)


def test_secrets(spark, documents, texts, odd):
    got = {r.doc_id: r for r in secrets.secret_spans(documents).collect()}
    for i, t in texts.items():
        want = brute_spans(t)
        text = ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert secrets.secret_spans(odd).count() == 12 and secrets.secret_spans(odd.limit(0)).count() == 0


def test_ownership_parts_examples_from_live_ones(spark):
    rows = [(i, f"password = example-{'1' * 10}", f"s{i}", "en") for i in range(4)] + [(10, "token: live9secretvalue77", "s1", "en"), (11, "seen live9secretvalue77 bare", "s1", "en"), (12, "other9secretvalue88 bare", "s1", "en")]
    # Short, dotted and plain values are found bare too, at the end of a sentence as well.
    rows += [(20, "secret=a.b-c.12.", "s5", "en"), (21, "It was a.b-c.12. And hunterhunter", "s5", "fr"), (22, "passwd: hunterhunter", "s6", "en")]
    # Two owners: live in two repositories, an example in four.
    rows += [(30 + i, "token=twoowners1", f"t{i % 2}", "en") for i in range(4)] + [(40 + i, "token=fourrepos2", f"t{i % 2}", "en" if i < 2 else "de") for i in range(4)]
    rows += [(50, None, None, None), (None, "", "s1", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in secrets.secret_spans(d).collect()}
    assert (got[0].n_live, got[0].n_example) == (0, 1) and (got[10].n_live, got[10].n_example) == (1, 0)
    assert got[11].spans == "known:5:23" and got[12].spans == "" and got[21].spans == "known:7:15,known:21:33"
    assert got[30].n_live == 1 and got[40].n_example == 1
    clean = {r.doc_id: r.text for r in secrets.redact_live(d).collect()}
    assert len(clean) == len(rows) and clean[50] is None and clean[None] == ""
    assert clean[10] == "token: [secret]" and clean[11] == "seen [secret] bare" and clean[0] == rows[0][1] and clean[12] == rows[6][1]
    assert clean[20] == "secret=[secret]" and clean[21] == "It was [secret]. And [secret]" and clean[40] == "token=fourrepos2"
    assert secrets.redact_live(d.limit(0)).count() == 0


def test_redaction_odd(odd):
    got = secrets.redact_live(odd)
    assert got.count() == 12 and got.columns == odd.columns
    assert sorted(r.text or "" for r in got.collect() if r.doc_id not in (9, 10)) == sorted(r.text or "" for r in odd.collect() if r.doc_id not in (9, 10))
    assert got.where("doc_id = 10").first().text == "password = '[secret]'"


# 5 ---------------------------------------------------------------------------------
def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = low(m[1]), m[2]
    best = None
    for h, p, v in urlmodel.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def brute_scores(urls, fit):
    """Witten-Bell trigrams over characters, by hand."""
    model = {}
    texts = {u: "\x02\x02" + re.sub(r"[^\x21-\x7e]", "\x7f", u or "") + "\x03" for u in urls}
    for side in ("allow", "block"):
        tri, bi, uni = collections.Counter(), collections.Counter(), collections.Counter()
        for u in urls:
            if fit[u][0] == side and not fit[u][1]:
                t = texts[u]
                for i in range(len(t) - 2):
                    tri[t[i : i + 3]] += 1
                    bi[t[i + 1 : i + 3]] += 1
                    uni[t[i + 2]] += 1
        model[side] = (tri, bi, uni)

    def p(side, g):
        tri, bi, uni = model[side]
        n, k = sum(uni.values()), len(uni)
        p1 = (uni[g[2]] + k / 95) / (n + k) if n else 1 / 95
        own = {x: c for x, c in bi.items() if x[0] == g[1]}
        n, k = sum(own.values()), len(own)
        p2 = (bi[g[1:]] + k * p1) / (n + k) if n else p1
        own = {x: c for x, c in tri.items() if x[:2] == g[:2]}
        n, k = sum(own.values()), len(own)
        return (tri[g] + k * p2) / (n + k) if n else p2

    memo = {}
    out = {}
    for u in urls:
        t = texts[u]
        grams = [t[i : i + 3] for i in range(len(t) - 2)]
        for g in grams:
            if g not in memo:
                memo[g] = math.log10(p("allow", g)) - math.log10(p("block", g))
        out[u] = sum(memo[g] for g in grams) / len(grams)
    return out


def test_url_model(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "no scheme"), (9004, "HTTP://A.Example.NET/en/é?x"), (9005, "x://NET"), (9006, "a://b://c.org/fr/"), (9007, "http://example.com/de/" + "y" * 3000)], pages.schema)
    every = pages.unionByName(odd).unionByName(odd.limit(1)).withColumn("gram", F.lit(1))
    got = urlmodel.url_verdicts(every).collect()
    urls = {r.page_id: r.url for r in every.collect()}
    assert len(got) == every.count()
    fit = {}
    for u in set(urls.values()):
        b = brute_rule(u)[2]
        fit[u] = (b and b[1], zlib.crc32((u or "").encode()) % 5 == 4)
    want = brute_scores(list(urls.values()), {u: fit[u] for u in urls.values()})
    for r in got:
        host, path, rule = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.score == pytest.approx(want[urls[r.page_id]], abs=1e-6)
        assert r.verdict == (rule[1] if rule else "allow" if r.score >= r.threshold else "block")
    assert urlmodel.url_verdicts(pages.limit(0)).count() == 0
    assert {r.verdict for r in urlmodel.url_verdicts(odd.where("page_id = 9002")).collect()} == {"allow"}


@pytest.mark.parametrize("name", ["op5_url_language_model", "op8_winnowing"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 6 ---------------------------------------------------------------------------------
def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def test_repeats_on_documents(documents, texts, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1 << 15)
    ids = sorted(texts)
    want = brute_repeats([texts[i] for i in ids], 200)
    for most in (0, 2, 1024):
        got = {r.doc_id: tuple(r)[1:] for r in repeats.repeated_bytes(documents, block_chars=60_000, bucket_keys=2_000, most_runs=most).collect()}
        assert [got[i] for i in ids] == want


@pytest.mark.parametrize("seed", range(3))
def test_repeats_on_random_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    r = random.Random(seed)
    letters = ["ab", "abcdé", "a"][seed]
    base = ["".join(r.choice(letters) for _ in range(r.choice([0, 5, 30, 60, 200]))) for _ in range(30)]
    base += [r.choice(base) + r.choice(base)[3:] + r.choice(base) for _ in range(20)] + [None, "", "a" * 300, "ab" * 100] * 2
    d = spark.createDataFrame(list(enumerate(base)), "doc_id long, text string")
    want = brute_repeats(base, 20)
    for most in (0, 3, 1024):
        got = sorted(tuple(x) for x in repeats.repeated_bytes(d, 20, 8, 900, 20, most).collect())
        assert [g[1:] for g in got] == want


def test_repeats_odd(odd):
    got = repeats.repeated_bytes(odd)
    assert got.count() == 12 and repeats.repeated_bytes(odd.limit(0)).count() == 0
    assert got.where("doc_id = 6").first().n_removed == got.where("doc_id = 6").first().n_bytes


def test_suffix_groups():
    r = random.Random(3)
    for _ in range(600):
        s = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(40))]
        order = suffix_groups.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = suffix_groups.common_prefixes(s, order)
        for a, b, n in zip(order, order[1:], lcp[1:]):
            assert s[a : a + n] == s[b : b + n] and (s[a + n : a + n + 1] != s[b + n : b + n + 1] or not s[a + n : a + n + 1])
    _, prev = suffix_groups.lyndon_groups(s := [r.randrange(3) for _ in range(200)])
    assert prev == [max((j for j in range(i) if s[j:] < s[i:]), default=-1) for i in range(len(s))]
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(60))) for _ in range(12)]
    want = brute_repeats([t.decode() for t in texts], 8)
    assert [int(c.sum()) for c in suffix_groups.repeated_cover(texts, 8)] == [w[1] for w in want]


# 7 ---------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = re.findall(SPACE, low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_groups(fp, ids):
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fp)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fp))]


def test_simhash(documents, texts, odd):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        fp = [brute_fingerprint(t) for _, t in rows]
        comp = brute_groups(fp, [i for i, _ in rows])
        got = simhash.simhash_groups(df).collect()
        assert sorted(((r.doc_id or -1), r.fingerprint, r.component_id or -1) for r in got) == sorted(((i or -1), f"{f:016x}", c or -1) for (i, _), f, c in zip(rows, fp, comp))
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_links_of_large_buckets(spark):
    """Buckets that are dealt over bands of tiles connect what those in one piece do."""
    g = np.random.default_rng(5)
    centre = g.integers(0, 2**63, 4, dtype=np.int64).view(np.uint64)
    fp = set()
    for c in centre.tolist():
        for _ in range(150):
            x = c
            for b in g.integers(0, 48, g.integers(0, 7)).tolist():
                x ^= 1 << b
            fp.add(x)
    fp = sorted(fp)
    want = brute_groups(fp, list(range(len(fp))))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fp], "fp long")
    for bucket in (40, 8192):
        root = {r.node: r.root for r in components.components(simhash.links(df, bucket=bucket)).collect()}
        label = [root.get(int(np.uint64(x).view(np.int64)), int(np.uint64(x).view(np.int64))) for x in fp]
        pairs = collections.defaultdict(set)
        for a, b in zip(want, label):
            pairs[a].add(b)
        assert all(len(v) == 1 for v in pairs.values()) and len(set(label)) == len(set(want))


def test_linked_matches_brute_force():
    g = np.random.default_rng(1)
    f = np.unique(g.integers(0, 2**63, 1500, dtype=np.int64).view(np.uint64))
    f = np.unique(np.concatenate([f, f[:300] ^ np.uint64(5), f[:200] ^ np.uint64(1 << 40)]))
    want = brute_groups(f[:700].tolist(), list(range(700)))
    got = simhash.linked(f[:700]).tolist()
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_tiles_keep_groups_apart():
    """Many groups share a tile: only pairs within one are compared, and all of those."""
    g = np.random.default_rng(6)
    group = np.sort(g.integers(0, 90, 900))
    f = g.integers(0, 2**63, 900, dtype=np.int64).view(np.uint64) & np.uint64(0xFFF)
    order = np.lexsort((np.bitwise_count(f), group))
    f = f[order]
    got = {(int(a), int(b)) for x, y in simhash.close_pairs(f, group, 2) for a, b in zip(x, y)}
    assert got == {(i, j) for i, j in itertools.combinations(range(900), 2) if group[i] == group[j] and int(f[i] ^ f[j]).bit_count() <= 2}


def test_one_of_each_group_stays(documents, odd):
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(documents).collect()}
    kept = simhash.keep_first(documents)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values())) and kept.columns == documents.columns
    ids = [r.doc_id for r in simhash.keep_first(odd).collect()]
    assert len(ids) == len(set(ids)) and None in ids and 4 in ids and 5 not in ids


def test_rows_are_kept_not_ids(spark):
    """A text that shares its doc_id with a copy of another is not lost for it."""
    from graphloom.llm import near

    rows = [(2, "a b c d e f g"), (4, "a b c d e f g"), (4, "z other text of its own here"), (4, "z other text of its own here"), (None, "a b c d e f g")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in (simhash.keep_first, near.keep_first_of_near):
        assert sorted(map(tuple, keep(d).collect()), key=str) == [rows[0], rows[2], rows[4]]
        assert keep(d.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------
def brute_winnow(text, k=winnow.K, w=winnow.WINDOW):
    """Positions that some window keeps, given any hash of runs of words."""
    words = re.findall(SPACE, text or "")
    grams = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))]
    return words, grams


def test_winnowing(documents, texts, odd):
    for df, block in ((documents, 40_000), (documents, 10**9), (odd, 100_000)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        got = winnow.winnow_documents(df, block_chars=block).collect()
        known = [r for r in rows if r[0] is not None]
        want = []
        for i, (d, t) in enumerate(known):
            n = len(t) // 2
            e = t[: len(t) - n] + known[(i + 1) % len(known)][1][:n]
            want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == sorted(want)
        assert len(got) == len(rows)
        prints = collections.defaultdict(set)
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if r.doc_id is not None:
                prints[r.doc_id].add(r.fingerprint)
        for d, t in known:
            words, grams = brute_winnow(t)
            at = [int(x.split("@")[1]) for x in min(prints[d]).split(",")] if grams else []
            assert at == sorted(set(at)) and (not grams) == (min(prints[d]) == "")
            if len(grams) >= winnow.WINDOW:  # no window without a kept position
                assert at[0] < winnow.WINDOW and at[-1] >= len(grams) - winnow.WINDOW and all(b - a <= winnow.WINDOW for a, b in zip(at, at[1:]))
    assert winnow.winnow_documents(odd.limit(0)).count() == 0


def test_rightmost_of_equal_hashes(spark):
    d = spark.createDataFrame([(1, "a b " * 30), (2, "a b " * 30)], "doc_id long, text string")
    r = winnow.winnow_documents(d).collect()
    at = [int(x.split("@")[1]) for x in r[0].fingerprint.split(",")]
    assert r[0].fingerprint == r[1].fingerprint and r[0].near_next == 1.0
    # Two hashes in turn: each window of eight keeps the last place of the lesser one.
    assert at[0] in (6, 7) and all(b - a == 2 for a, b in zip(at, at[1:]))


def test_prints_are_those_of_a_hash_by_hand(spark):
    """Every gram's hash from its words' hashes, and every window's least, for several sizes."""
    r = random.Random(9)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 6, 7, 8, 9, 13, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    word = {x.w: x.h for x in spark.createDataFrame([(c,) for c in "abc"], "w string").selectExpr("w", f"pmod(xxhash64(w), {winnow.PRIME}) AS h").collect()}
    for k, w in ((5, 8), (1, 1), (3, 5), (6, 3)):
        for row in winnow.with_prints(df, "t", "p", k, w).collect():
            words = row.t.split()
            grams = [words[i : i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
            h = [sum(word[x] * pow(winnow.BASE, len(g) - 1 - j, winnow.PRIME) for j, x in enumerate(g)) % winnow.PRIME for g in grams]
            keep = []
            for i in range(max(len(h) - w + 1, min(len(h), 1))):
                at = max(range(i, min(i + w, len(h))), key=lambda j: (-h[j], j))
                if at not in keep:
                    keep.append(at)
            assert [(x >> 31, winnow._LAST - (x & winnow._LAST)) for x in row.p] == [(h[j], j) for j in keep]


def test_passages_without_spaces_are_found(spark):
    """Twelve Han characters that two texts share, with other characters around them, are in both fingerprints."""
    r = random.Random(8)
    word = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared = word(winnow.K + winnow.WINDOW - 1)
    d = spark.createDataFrame([(i, word(30) + shared + word(r.randrange(25)) + " abc") for i in range(5)], "doc_id long, text string")
    sets = [{x.split("@")[0] for x in p.fingerprint.split(",")} for p in winnow.winnow_documents(d).collect()]
    assert all(a & b for a, b in itertools.combinations(sets, 2))


def test_shared_passages_are_found(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = " ".join(word() for _ in range(winnow.K + winnow.WINDOW - 1))
    d = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randrange(20))) + " " + shared + " " + " ".join(word() for _ in range(9))) for i in range(6)], "doc_id long, text string")
    sets = [{x.split("@")[0] for x in p.fingerprint.split(",")} for p in winnow.winnow_documents(d).collect()]
    assert all(a & b for a, b in itertools.combinations(sets, 2))


# 9 ---------------------------------------------------------------------------------
def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op9_pu_quality(spark, sf).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.93


def test_risk_and_gradient_against_direct_computation():
    """The risk from its definition, one document after another, and its slopes by small steps, on both sides of zero."""
    g = np.random.default_rng(4)
    p, u = g.normal(0.5, 1, (30, 5)), g.normal(0, 1, (50, 5))
    sides = set()
    for prior, move in ((0.3, 0.0), (0.9, 0.0), (0.9, 1.5)):
        m = quality.PositiveUnlabelled(prior, hidden=4, seed=3).fit(p + move, u, epochs=3, batch=16)
        own = lambda x: sum(math.tanh(sum(x[i] * m.w1[i, j] for i in range(5)) + m.b1[j]) * m.w2[j] for j in range(4)) + sum(x[i] * m.w3[i] for i in range(5)) + m.b2
        sig = lambda z: 1 / (1 + math.exp(-z))
        plus = prior * sum(sig(-own(x)) for x in p) / len(p)
        minus = sum(sig(own(x)) for x in u) / len(u) - prior * sum(sig(own(x)) for x in p) / len(p)
        assert m.risk(p, u) == pytest.approx((plus, minus), abs=1e-9)
        sides.add(minus >= 0)
        grad = m.gradient(p, u)
        for name in ("w1", "b1", "w2", "w3"):
            v = getattr(m, name)
            for at in itertools.islice(np.ndindex(v.shape), 6):
                values = []
                for step in (1e-5, -1e-5):
                    v[at] += step
                    a, b = m.risk(p, u)
                    values.append(a + b if minus >= 0 else -b)
                    v[at] -= step
                assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)
    assert sides == {True, False}


def test_threshold_from_the_histogram():
    m = quality.PositiveUnlabelled(0.3)
    m.calibrate({**{k: 70 for k in range(-500, -400)}, **{k: 30 for k in range(400, 500)}, -100: 1})
    assert m.score(np.array([-1.7]))[0] < 0.7 < m.score(np.array([1.5]))[0]
    assert quality.PositiveUnlabelled(0.5).calibrate({}).shift == 0.0


def test_quality_odd(odd, labels):
    got = quality.quality_scores(odd, labels).collect()
    assert len(got) == 12 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in quality.quality_scores(odd, labels.where("quality = 0")).collect()} == {0.5}
    assert quality.quality_scores(odd.limit(0), labels).count() == 0
    assert quality.drop_rejected(odd, labels.limit(0)).count() == 12 and quality.drop_rejected(odd, labels).columns == odd.columns
    assert quality.drop_rejected(odd.limit(0), labels).count() == 0
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(odd, labels).collect()}
    assert sorted(str(r.doc_id) for r in quality.drop_rejected(odd, labels).collect()) == sorted(str(r.doc_id) for r in odd.collect() if scores[r.doc_id])


def test_held_out_labels_are_not_learnt_from(documents, spark):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    turned = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(documents, x).collect()} for x in (lab, turned))
    assert a == b


# 10 --------------------------------------------------------------------------------
CONTENT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, n=10):
    w, hit, found = CONTENT.findall(low(text)), set(), set()
    for i, x in items:
        iw = CONTENT.findall(low(x))
        for win in [iw[k : k + n] for k in range(len(iw) - n + 1)] or ([iw] if iw else []):
            for p in range(len(w) - len(win) + 1):
                if w[p] == win[0] and w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def brute_near(texts, items, n=10, slop=15):
    """For each text, how many items have a window whose rarest word stands somewhere with all others near."""
    words = [CONTENT.findall(low(t)) for t in texts]
    often = collections.Counter(w for x in words for w in x)
    wins = collections.defaultdict(set)
    for i, x in items:
        iw = CONTENT.findall(low(x))
        for win in [tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)] or ([tuple(iw)] if iw else []):
            wins[win].add(str(i))
    out = []
    for x in words:
        at = collections.defaultdict(list)
        for p, w in enumerate(x):
            at[w].append(p)
        found = set()
        for win, ids in wins.items():
            if all(w in at for w in win):
                rare = min(win, key=lambda w: (often[w], w.encode()))
                if any(all(any(abs(q - p) <= slop for q in at[w]) for w in win) for p in at[rare]):
                    found |= ids
        out.append(len(found))
    return out


@pytest.mark.parametrize("block", [10**9, 100])
def test_decontamination(spark, documents, texts, odd, benchmark, block):
    own = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contaminated_words(documents, own, block_words=block).collect()}
    items = [(r.item_id, r.text) for r in own.collect()]
    near = brute_near(texts.values(), items)
    assert all(got[i] == (*brute_hits(t, items), k) for (i, t), k in zip(texts.items(), near))
    assert any(v[4] for v in got.values())
    turned = spark.createDataFrame([(1, "b z a"), (2, "b " + "z " * 15 + "a")], "doc_id long, text string")
    assert sorted(tuple(r)[2:4] + tuple(r)[6:] for r in decontaminate.contaminated_words(turned, benchmark.where("item_id = 2"), block_words=block).collect()) == [(0, 0, 0), (0, 0, 1)]
    few = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = decontaminate.contaminated_words(odd, benchmark, block_words=3).collect()
    every = [r.text for r in odd.collect()]
    assert sorted(tuple(r)[1:] for r in rows) == sorted((*brute_hits(t, few), k) for t, k in zip(every, brute_near(every, few)))
    assert decontaminate.contaminated_words(odd, benchmark.limit(0)).where("n_hit > 0 or n_near_items > 0").count() == 0
    assert decontaminate.contaminated_words(odd.limit(0), benchmark).count() == 0
    clean = decontaminate.drop_contaminated(documents, own)
    assert {r.doc_id for r in clean.collect()} == {i for i, v in got.items() if not v[4]} and clean.columns == documents.columns
    left = decontaminate.drop_contaminated(odd, benchmark)
    assert sorted(r.text or "" for r in left.collect()) == sorted(t or "" for t in every if not brute_hits(t, few)[4]) and left.columns == odd.columns
    assert decontaminate.drop_contaminated(odd, benchmark.limit(0)).count() == 12 and decontaminate.drop_contaminated(odd.limit(0), benchmark).count() == 0


def test_stored_index(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the mat, the cat. Sat"), (3, None), (4, "cat " * 5)]
    ix = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()[0]
    s = decontaminate.Shard.unpacked(pa.array(ix.terms, pa.binary()), ix.sizes, ix.postings, ix["counts"])
    assert ix.ids == [1, 2, 3, 4] and s.counts.tolist() == [6, 5, 0, 5] and ix.terms == sorted(ix.terms)
    assert s.postings[s.first[4] : s.first[4] + s.sizes[4]].tolist() == [0, 4, 6, 8] and ix.terms[4] == b"the"
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    found = lambda *a, **k: sorted({(r.doc_id, r.start) for r in decontaminate.phrase_matches(index, *a, **k).collect()})
    assert found(["the", "cat", "sat"]) == [(1, 0), (2, 2)] and found(["cat", "mat"]) == [] and found(["cat", "cat"]) == [(4, k) for k in range(4)]
    assert {i for i, _ in found(["cat", "mat"], slop=2)} == {2} and found(["dog"]) == []


def brute_masked(rows, mask="[secret]"):
    """Texts with each value masked that few owners hold and that some pattern names, wherever it stands as a word."""
    named, owners, places = set(), collections.defaultdict(set), {}
    for r in rows:
        text = r.text or ""
        own = [(m.start(2 if k == 0 else 0), m[2 if k == 0 else 0].rstrip("." if k == 0 else ""), m.start(), m.end()) for k, (_, rx, ok) in enumerate(RULES) for m in rx.finditer(text) if ok(m)]
        named |= {v for _, v, _, _ in own}
        places[id(r)] = own
    for r in rows:
        taken = [(a, b) for _, _, a, b in places[id(r)]]
        bare = [(m.start(), m[0].rstrip(".")) for m in re.finditer(r"[A-Za-z0-9+/_.=-]{8,}", r.text or "") if m[0].rstrip(".") in named and not any(a < m.end() and b > m.start() for a, b in taken)]
        places[id(r)] = sorted([(a, v) for a, v, _, _ in places[id(r)]] + bare)
        for _, v in places[id(r)]:
            owners[v].add((r.source, r.lang))
    out = {}
    for r in rows:
        text, at = "", 0
        for a, v in places[id(r)]:
            who = len({s for s, _ in owners[v]})
            end = a + len(v) + (len(r.text) > a + len(v) and len(re.match(r"\.*", r.text[a + len(v) :])[0]) if (a, v) and any(x == a for x in assigned(r.text)) else 0)
            if who < 3 and not (who == 2 and len(owners[v]) >= 4) and end > max(at, a):
                text += r.text[at : max(at, a)] + mask
                at = end
        out[r.doc_id] = text + r.text[at:] if r.text is not None else None
    return out


def assigned(text):
    """Where the values of the first pattern begin; the dots after them are masked with them."""
    return {m.start(2) for m in RULES[0][1].finditer(text) if len(m[2]) >= 8}


def test_redaction(spark):
    documents = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = documents.collect()
    want = brute_masked(rows)
    got = secrets.redact_live(documents).collect()
    assert {r.doc_id: r.text for r in got} == want and any("[secret]" in t for t in want.values())
    assert all(r.n_chars == len(r.text) for r in got)


# Pipeline ----------------------------------------------------------------------------
def test_pipeline(spark, documents):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == documents.columns
        kept.append(out.collect())
        docs = out
    good, unique, clean, masked, packed = kept
    scores = {r.doc_id: r.predicted for r in queries.op9_pu_quality(spark, SF).collect()}
    assert {r.doc_id for r in good} == {i for i, p in scores.items() if p}
    assert {r.doc_id for r in unique} == set(brute_components([(r.doc_id, r.text) for r in good]).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {r.doc_id for r in unique if not brute_hits(r.text, items)[4]}
    assert len(masked) == len(clean) and all(r.n_chars == len(r.text) for r in masked)
    assert {r.doc_id: r.text for r in masked} == brute_masked(clean)
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked}
    check_packing(packed, 2048)
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(packed)


def test_stages_on_an_empty_table(spark, documents):
    """No document: each stage gives none, with its columns; the last one's are those of pieces."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, documents.limit(0), SF)
        assert out.count() == 0
        assert "sequence_id" in out.columns if name == corpus_pipeline.STAGES[-1][0] else out.columns == documents.columns


def test_packing_under_every_capacity(spark, documents):
    """Through pack itself: no sequence holds more documents or attention cost than it may."""
    for score in ("norm", "dot"):
        rows = packing.pack(documents, queries.vocabulary_path(), 256, max_documents=3, max_attention=70_000, score=score).collect()
        check_packing(rows, 256)
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append(r.length)
        assert all(len(v) <= 3 and sum(n * n for n in v) <= 70_000 for v in by.values())
        assert any(len(v) == 3 for v in by.values())


def test_stages_keep_other_columns(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
