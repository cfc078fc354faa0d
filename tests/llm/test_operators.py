"""Every operator against a brute-force version, on texts with nulls, empty and long ones, copies, ties and clashing columns."""

import collections
import decimal
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import anchored, common, components, decontamination, langid, licenses, nearduplicates, packing, pii, quality, substrings, suffixes, textvec, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, list string, th string, host string"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    shared, base = prose(70), prose(160)
    texts = [prose(rng.randint(1, 300)) for _ in range(30)]
    texts += [base, base, base.replace(" ", "  "), base.upper()]
    for _ in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [f"{prose(40)} {shared} {prose(40)}" for _ in range(10)]
    texts += ["", " \n\t ", "one", "two words", "a b c d", "A B c d", "of " * 300, "x" * 900, "ab" * 700 + "c" + "ab" * 700, "\x00 \x1c\x85 \xa0 \u2028 𝔘𝔫𝔦 日本語", prose(9000), shared, f"{shared} {shared}"]
    texts += ["mail joe.doe+x@mail.example.com, call +1 (743) 555-3824 or 4111 1111 1111 1111 from 10.2.30.255", "Released under the MIT License.", "line one\nline one\nline one two\n\n\n"]
    return texts


def make_rows():
    texts = make_texts()
    rows = [(3 * i + 1, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t), 1, "l", "h", "x") for i, t in enumerate(texts)]
    rows.append((5000, None, None, None, None, None, None, None, None))
    rows.append((None, texts[30] + " more words here", "en", "s1", 1, None, None, None, None))
    rows.append(rows[33])  # a repeated row
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EMPTY)


def by_id(rows):
    """Distinct documents in the order of their ids, a null one first."""
    out = {}
    for r in rows:
        out.setdefault(r[0], r[1] or "")
    return sorted(out.items(), key=lambda x: (x[0] is not None, x[0]))


def ascii_lower(b):
    return b.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


# --- primitives


def test_words_are_those_of_bytes_split():
    texts = [r[1] for r in ROWS]
    got = []
    for c in textvec.chunks(pa.array(texts), 700):
        w, raw = textvec.words(c), c.data.tobytes()
        for i in range(c.n):
            got.append([raw[s:e] for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])])
    assert got == [(t or "").encode().split() for t in texts]


def test_rolling_hashes_depend_on_content_alone():
    v = textvec.byte_values(np.frombuffer(b"abcabcxabc", np.uint8))
    g = textvec.Rolling(v).grams(3)
    assert g[0] == g[3] == g[7] and len(set(g.tolist())) == 6
    assert textvec.sliding_min(np.array([5, 3, 4, 1, 9], np.uint64), 3).tolist() == [3, 1, 1]


def test_hashes_tell_thue_morse_words_apart():
    """Such words collide under any polynomial modulo a power of two."""
    word = b"a"
    for _ in range(12):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    c = next(textvec.chunks(pa.array([word.decode(), other.decode(), f"{word.decode()}\n{other.decode()}"])))
    assert len(set(textvec.word_hashes(c.data, textvec.words(c))[:2].tolist())) == 2
    v = textvec.byte_values(c.data)
    assert textvec.Rolling(v).of(np.array([0, 4096]), np.array([4096, 8192])).tolist() != [textvec.Rolling(v).of(np.array([0]), np.array([4096]))[0]] * 2
    assert quality.measure(c)["n_dup_lines"].tolist() == [0, 0, 0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    up = list(range(200))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in {x for e in edges for x in e} if root(v) != v}


# --- op1


def brute_base(x):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in patterns.items():
        for m in re.finditer(p, x):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(decimal.Decimal(q) <= 255 for q in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[k]:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base_equals_the_patterns():
    rng = random.Random(2)
    cases = ["".join(rng.choice("0123456789..@@+-- ()ab1%é") for _ in range(rng.randint(0, 70))) for _ in range(20000)]
    for x in cases + [r[1] or "" for r in ROWS] + ["1" * 5000, "9." * 3000, "@" * 500, "+1" * 400, "0" * 5000 + ".1.1.1", "0" * 5000 + "1.1.1.1", "0.0.0.0"]:
        assert [s for s in pii.find(x) if s[0] in pii.KINDS[: pii.BASE]] == brute_base(x)


def test_pii_added_spans_and_redaction():
    text = "see ftp://joe:pw123@host, joe [at] mail [dot] org, IBAN DE89370400440532013000, account no. 12345678, token = \"24be64439e3e49cf46b2d7c9\""
    kinds = {k: text[s:e] for k, s, e in pii.find(text)}
    assert kinds["userinfo"] == "joe:pw123" and kinds["obfuscated"] == "joe [at] mail [dot] org" and kinds["iban"] == "DE89370400440532013000"
    assert kinds["account"] == "12345678" and kinds["secret"] == "24be64439e3e49cf46b2d7c9"
    assert pii.redact("to a@b.cd now") == "to [EMAIL] now" and pii.redact(None) is None and pii.redact("plain") == "plain"
    assert not pii.find("He met token gestures of account and passwords; it is 5 to 10.")


def test_pii_reads_many_cues_in_proportion():
    def took(n):
        at = time.perf_counter()
        for text in ("token=" + "tokentoken=" * n, ("token" + " " * 300) * (n // 20), "token='" + "token=" * n, "://a:b" * n):
            pii.find(text)
        return time.perf_counter() - at

    took(100)
    assert took(20000) < 12 * max(took(5000), 0.01)  # four times as long
    assert [k for k, _, _ in pii.find("token=" + "tokentoken=" * 20)] == ["secret"]


def test_pii_query_rows(docs, empty):
    got = pii.detect(docs).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((r[0], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute_base(r[1] or "")).encode()).hexdigest()) for r in ROWS)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert pii.detect(empty).count() == 0


# --- op2


def test_url_parts_and_rules(spark):
    cases = [
        ("http://A.Example.com/en/75?x=1", "a.example.com", "/en/75", "example.com/en/7", "allow"), ("https://x.com/en/8#f", "x.com", "/en/8", "com/en/", "block"),
        ("https://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("//a.net/de/", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"), ("http://q.net/de/9", "q.net", "/de/9", "net/de/", "allow"),
        ("http://z.org", "z.org", "", None, "allow"), ("a://b.org?/es/", "b.org", "", None, "allow"), ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], None, 7) for i, c in enumerate(cases)], "page_id long, url string, html string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    a = lambda to: f'<p><A class=x HREF="{to}">t</a>'
    rows = [
        (1, "http://seed.net/de/1", a("https://good.example/") + a("/own") + a("//good.example/again")), (2, "http://good.example/x", ""),
        (3, "http://bad.com/en/1", a("http://victim.example/")), (4, "http://victim.example/", ""), (5, "http://fan.example/", a("http://bad.com/en/1")), (6, "http://fan2.example/", a("http://fan.example/")),
        (7, "http://alone.example/", a("#top")),
    ]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow"}


def test_ranks_equal_a_dense_walk(spark):
    rng, n = random.Random(3), 8
    edges = {(rng.randrange(n), rng.randrange(n)): rng.randint(1, 4) for _ in range(20)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    seeds = [("h0", 2.0, 0.0), ("h1", 1.0, 3.0), ("h2", 0.0, 1.0)]
    r = urlfilter.ranks(spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, good double, bad double"))
    got = {x.host: (x.trust, x.distrust) for x in r.collect()}
    for k in (0, 1):
        m = np.zeros((n, n))
        for (a, b), w in edges.items():
            m[(a, b) if k == 0 else (b, a)] = w
        m = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
        s = np.zeros(n)
        for h, *w in seeds:
            s[int(h[1:])] = w[k]
        s /= s.sum()
        x = s.copy()
        for _ in range(urlfilter.ROUNDS):
            moved = x @ m
            x = 0.85 * moved + s * (1 - 0.85 * moved.sum())
        assert all(abs(got.get(f"h{i}", (0, 0))[k] - x[i]) < 1e-9 for i in range(n))


def test_walks_go_on_until_settled(spark):
    chain = [(f"c{i + 1}", f"c{i}", 1) for i in range(11)] + [("c0", "s", 1), ("o", "s", 1499), ("x", "s", 1), ("o", "x", 1499), ("z", "x", 1)]
    edges = spark.createDataFrame(chain, "src string, dst string, n long")
    r = {x.host: x for x in urlfilter.ranks(edges, spark.createDataFrame([("s", 0.0, 1.0), ("t", 0.0, 1e6)], "host string, good double, bad double"), None).collect()}
    assert r["c11"].distrust > 0 and r["c11"].trust == 0  # twelve links from the seed
    assert 0 < r["z"].distrust < 5e-13


# --- op3


def test_quality_equals_brute_force(docs, empty):
    got = {}
    for r in quality.judge(docs, min_docs=3, min_share=0.05).collect():
        got[(r.id, r.th)] = r
    assert len({k[0] for k in got}) == len({r[0] for r in ROWS})
    lines = collections.defaultdict(set)
    texts = collections.defaultdict(set)
    norm = lambda line: b" ".join(ascii_lower(line).split())
    for r in ROWS:
        b = (r[1] or "").encode()
        texts[r[3] or ""].add((r[1] is None, b))
        for line in b.split(b"\n"):
            if line.split():
                lines[(r[3] or "", norm(line))].add((r[1] is None, b))
    common_ = {k for k, v in lines.items() if len(v) >= 3 and len(v) >= 0.05 * len(texts[k[0]])}
    assert common_
    for r in ROWS:
        b = (r[1] or "").encode()
        w = b.split()
        seen, dup = set(), 0
        for line in b.split(b"\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lost = sum(len(line.split()) for line in b.split(b"\n") if (r[3] or "", norm(line)) in common_)
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        x = next(v for k, v in got.items() if k[0] == (common.LEAST_ID if r[0] is None else r[0]))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.n_line_words, x.base_failed) == (len(w), sum(len(q.decode()) for q in w), sum(c in "#*$%&|<>" for c in (r[1] or "")), dup, len(hit), lost, failed), r
        assert x.kept == (not failed and len(w) - lost >= 0.2 * len(w))
    assert quality.judge(empty).count() == 0


def test_keep_drops_boilerplate_lines(spark):
    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{prose(i)}é\n  Share THIS  page \n\n{prose(i + 50)}", "s") for i in range(3)] + [(7, f"{prose(7)}\nshare this page", "s"), (8, f"{prose(8)}\nshare this page", "other"), (9, prose(9), None)]
    d = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars int")
    got = quality.keep(spark, d, "", min_docs=3)
    assert got.dtypes == d.dtypes
    want = {i: f"{prose(i)}é\n\n{prose(i + 50)}" for i in range(3)} | {7: prose(7), 8: rows[4][1], 9: rows[5][1]}
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {k: (v, len(v)) for k, v in want.items()}


# --- op4


@pytest.mark.parametrize("shard,merge", [(1 << 20, 400_000), (1500, 300)])
def test_suffixes_equal_brute_force(docs, empty, shard, merge):
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, shard=shard, merge=merge).withColumn("doc_id", anchored.real_id()).collect()}
    count = collections.Counter()
    for r in ROWS:
        b = (r[1] or "").encode()
        count.update(b[i : i + 400] for i in range(len(b) - 399))
    for r in ROWS:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        x = got[r[0]]
        assert (x.n_bytes, x.n_removed, bytes(x.kept)) == (len(b), sum(gone), bytes(c for c, g in zip(b, gone) if not g)), r
        assert [(s.s, s.e) for s in x.spans] == [m.span() for m in re.finditer(b"\1+", bytes(gone))]
    assert sum(x.n_removed for x in got.values()) > 1000 and suffixes.remove_repeats(empty).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 60))) for _ in range(12)]
    pieces += [pieces[3], pieces[5] + pieces[3], b"a" * 50]
    size = np.array([len(p) for p in pieces])
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = raw.astype(np.uint16) + 1
    symbols[start + size] = 0
    left = np.repeat(start + size, size + 1) - np.arange(len(raw))
    keys = suffixes.first_keys(symbols)
    sa, place = suffixes.suffix_array(keys, left)
    suffix = lambda i: [(int(x), 0) for x in symbols[i : i + left[i]]] + [(0, int(i + left[i]))]
    assert sa.tolist() == sorted(range(len(raw)), key=suffix)
    before = suffixes.common_prefixes(keys, left, sa, place, start, size, 30)
    for i in range(len(raw)):
        if symbols[i] and place[i]:
            a, b = suffix(i), suffix(sa[place[i] - 1])
            n = next(k for k in range(99) if a[k] != b[k])
            assert before[i] == min(n, 30)


# --- op5


ITEMS = [(1, "short item"), (2, None), (3, "..."), (4, " ".join(make_texts()[40].split()[20:50]).upper()), (5, "Straße ÉTÉ of of of of of of of of of of of of"), (6, "two words"), (7, "two words"), (8, "x"), (9, "of")]


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower((t or "").encode()).decode())


def test_decontamination_equals_brute_force(spark, docs, empty):
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    extra = docs.unionByName(spark.createDataFrame([(9001, "a straße ÉTÉ, OF of of of of of of of of of of now", *[None] * 7), (9002, "straße été of of of of of of of of", *[None] * 7)], SCHEMA))
    got = {r.doc_id: r for r in decontamination.find(extra, items).withColumn("doc_id", anchored.real_id()).collect()}
    windows = collections.defaultdict(set)
    for i, t in ITEMS:
        w = brute_words(t)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[k : k + 10])].add(str(i))
    found = 0
    for r in extra.collect():
        w = brute_words(r.text)
        want = sorted((i, n, tuple(sorted(windows[tuple(w[i : i + n])]))) for n in {len(k) for k in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows)
        x = got[r.doc_id]
        assert x.n_words == len(w)
        assert sorted((m.start, m["size"], tuple(m["items"])) for m in x.matches) == want, r
        found += bool(want)
    assert found > 5
    assert decontamination.find(empty, items).count() == 0 and decontamination.find(docs, items.limit(0)).filter(F.size("matches") > 0).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x x x x x x x x beta"), (4, None), (5, "beta x alpha x beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta"), (2, "nowhere alpha")], "item_id long, text string")
    _, near, texts = decontamination.search(d, items)
    ids = {r.row: r.id for r in texts.collect()}
    assert sorted((ids[r.row], r.start, r["last"]) for r in near.collect()) == [(1, 0, 3), (2, 0, 1), (5, 0, 2), (5, 2, 4)]
    assert {r.id: r.near for r in decontamination.find(d, items).collect()} == {1: ["1"], 2: ["1"], 3: [], 4: [], 5: ["1"]}


def test_decontamination_lower_cases_a_to_z_alone(spark):
    text = "ΟΣ'ΑΒ ΛΟΓΟΣ'ΕΝ ΤΟΣ'ΑΡ ΚΑΣ'ΟΝ ΜΕΣ'ΑΛ"
    d = spark.createDataFrame([(1, text), (2, text.replace("'", " ")), (3, text.lower()), (4, "xΣ " + text)], "doc_id long, text string")
    got = {r.id: [(m.start, m["size"]) for m in r.matches] for r in decontamination.find(d, spark.createDataFrame([(1, text)], "item_id long, text string")).collect()}
    assert got == {1: [(0, 10)], 2: [(0, 10)], 3: [], 4: [(1, 10)]}


# --- one doc_id with two texts


def test_rows_with_one_id_and_other_texts_are_apart(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    a, b, c = (" ".join(word() for _ in range(90)) for _ in range(3))
    d = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, c), (4, b + " " + word())], "doc_id long, text string")
    removed = lambda f: sorted((r.id, r.n_removed) for r in f(d).collect())
    assert removed(substrings.remove_repeats) == [(1, 0), (2, 0), (2, 90), (3, 0), (3, 0), (4, 90)]
    n = len(a)
    assert removed(suffixes.remove_repeats) == [(1, n), (2, n), (2, n), (3, n), (3, n), (4, n)]
    near = sorted((r.id, r.component_id, r.first) for r in nearduplicates.near_duplicates(d).collect())
    assert near == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (3, 3, True), (4, 2, False)]
    assert sorted((r.doc_id, r.text) for r in nearduplicates.one_of_each(spark, d, "").collect()) == [(1, a), (2, b), (3, c)]
    found = decontamination.find(d, spark.createDataFrame([(1, b)], "item_id long, text string"))
    assert sorted((r.id, len(r.matches)) for r in found.collect()) == [(1, 0), (2, 0), (2, 81), (3, 0), (3, 0), (4, 81)]


# --- op6


def test_near_duplicates_equal_brute_force(docs, empty, monkeypatch):
    monkeypatch.setattr(nearduplicates, "LIST_BLOCK", 4)
    monkeypatch.setattr(nearduplicates, "SET_BLOCK", 5)
    got = {r.doc_id: r for r in nearduplicates.near_duplicates(docs).withColumn("doc_id", anchored.real_id()).collect()}
    table = by_id(ROWS)
    sets = []
    for _, t in table:
        w = ascii_lower(t.encode()).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and 100 * k >= 85 * (len(a) + len(sets[j]) - k):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    for i, (d, _) in enumerate(table):
        own = table[root(i)][0]
        assert got[d].n_shingles == len(sets[i])
        assert got[d].component_id == own if own is not None else got[d].component_id < 0, d
    assert len({root(i) for i in range(len(sets))}) < len(sets) - 8
    assert nearduplicates.near_duplicates(empty).count() == 0


def test_a_large_cluster_is_compared_in_proportion(spark, monkeypatch):
    """Near copies of one text, each with words of its own: rows dealt to comparisons stay in proportion to the cluster."""
    n, dealt = 6000, []
    base = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit("w"), i))
    changed = F.transform(base, lambda w, i: F.when(i == F.pmod(F.xxhash64("doc_id"), F.lit(300)), F.concat(F.lit("x"), "doc_id")).otherwise(w))
    d = spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", F.array_join(changed, " ").alias("text"))
    plain = nearduplicates._in_blocks

    def counted(rows, *a):
        out = plain(rows, *a)
        dealt.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(nearduplicates, "_in_blocks", counted)
    assert {r[0] for r in nearduplicates.near_duplicates(d).select("component_id").distinct().collect()} == {0}
    assert all(after <= 2 * before for before, after in dealt) and dealt[1][0] < n, dealt


def test_stage_links_from_80_percent_on(spark):
    w = [f"w{i}" for i in range(104)]  # 100 shingles; a word changed in the middle costs 5, one at the end 1
    changed = lambda *at: " ".join("changed" if i in at else x for i, x in enumerate(w))
    d = spark.createDataFrame([(1, " ".join(w)), (2, changed(20, 60)), (3, changed(40, 80, 103, 0))], "doc_id long, text string")  # 90/110 = 0.82; 88/112 = 0.79
    assert {r.doc_id for r in nearduplicates.one_of_each(spark, d, "").collect()} == {1, 3}
    assert {r.component_id for r in nearduplicates.near_duplicates(d).collect()} == {1, 2, 3}


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64)) for _ in range(30)]
    got = nearduplicates.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))


# --- op7


def test_substrings_equal_brute_force(docs, empty):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).withColumn("doc_id", anchored.real_id()).collect()}
    seen, removed = set(), 0
    for d, t in by_id(ROWS):
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        removed += sum(gone)
        x = got[d]
        assert (x.n_words, x.n_removed, bytes(x.text)) == (len(w), sum(gone), b" ".join(q for q, g in zip(w, gone) if not g)), d
        assert sum(s.e - s.s for s in x.spans) == x.n_removed
    assert removed > 500 and substrings.remove_repeats(empty).count() == 0


# --- op8


def test_licenses(spark, docs, empty):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "of", "the"]) for _ in range(n))
    rows, i = [], 0
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            w = t.split()
            rows += [(i, f"{prose(30)}. {t.upper()} {prose(30)}", name), (i + 1, "  ".join(w), name), (i + 2, " ".join(w[: len(w) // 2]) + prose(3), None)]
            if len(w) > 28:
                w[8] = "changed"
                rows.append((i + 3, f"{prose(5)} {' '.join(w)} {prose(5)}", name))
            i += 4
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()}
    for d, _, name in rows:
        if name:
            assert name in got[d].licenses.split(","), rows[d]
        elif got[d].licenses:
            assert got[d].containment >= licenses.CONTAINMENT
    assert {r.licenses for r in licenses.scan(docs).collect()} == {"", "MIT"} and licenses.scan(empty).count() == 0


def test_versions_of_a_notice_and_short_notices(spark):
    gpl2, gpl3, lgpl = licenses.TEMPLATES["GPL-2.0"][0], licenses.TEMPLATES["GPL-3.0"][1], licenses.TEMPLATES["LGPL-2.1"][0]
    rows = [(1, gpl2, "GPL-2.0"), (2, gpl3, "GPL-3.0"), (3, lgpl, "LGPL-2.1"), (4, f"x {gpl2} and then {gpl3}", "GPL-2.0,GPL-3.0"), (5, "Copyright. ALL rights, reserved", "All rights reserved"), (6, "all rights", ""), (7, "reserved. all rights", "")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {d: n for d, _, n in rows}


def test_license_recall_against_exact_containment():
    """Damaged notices within prose: of the templates that brute force finds contained, the bands retrieve nearly all."""
    rng, found, all_ = random.Random(8), 0, 0
    fold = lambda t: [x.strip(".") for x in re.sub(r"[^a-z0-9. ]", " ", t.lower()).split() if x.strip(".")]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, wants = [], []
    templates = [(n, fold(t)) for n, ts in licenses.TEMPLATES.items() for t in ts if len(fold(t)) >= 5]
    long = [w for _, w in templates if len(w) >= 12]
    for _ in range(300):
        w = list(rng.choice(long))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        text = ["lorem"] * 40 + w + ["ipsum"] * 40
        share = {n: max(len(grams(text) & grams(t)) / len(grams(t)) for m, t in templates if m == n) for n, _ in templates}
        texts.append(" ".join(text))
        best = max(share.values())
        wants.append({n for n, x in share.items() if x >= licenses.CONTAINMENT and x == best})
    for c in tv_chunks(texts):
        for hits, want in zip(licenses._scan(c), wants[c.row : c.row + c.n], strict=True):
            names = {licenses._ALL[t].name for t, _ in hits}
            assert names <= want or not want and not names
            found, all_ = found + len(names & want), all_ + len(want)
    assert all_ > 100 and found >= 0.99 * all_


def tv_chunks(texts):
    return textvec.chunks(pa.array(texts))


# --- op9


def test_langid_on_held_out_rows(spark, empty):
    rng, rows = random.Random(7), []
    stems = {"aa": "kalo miru tena posu".split(), "bb": "schtr ungen keit pflo".split(), "cc": "ción mente ado ñasa".split()}
    for i in range(600):
        lang = rng.choice(sorted(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "1234 -- !!", "bb"), (903, "日本", None), (None, "kalomiru", "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d.filter("doc_id % 4 <> 2 or doc_id is null"), per_language=60)
    got = langid.predict(d.select("doc_id", (F.col("doc_id") % 4 == 2).alias("held_out"), "text"), model).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"} and next(r for r in got if r.doc_id == 903).lang_pred in stems
    assert all(0 <= r.score <= 1 for r in got)
    one, many = (next(textvec.chunks(pa.array(t))) for t in (["kalo miru"], ["kalo miru"] * 1200))
    assert sum(c.n for c in langid._pieces(pa.array(["kalo miru"] * 1200))) == 1200 and max(c.n for c in langid._pieces(pa.array(["x"] * 1200))) == langid.ROWS
    assert (langid.counts(many) == langid.counts(one)).all()
    none = langid.fit(empty)
    assert langid.predict(d.select("doc_id", F.lit(False).alias("held_out"), "text"), none).filter("lang_pred <> 'und'").count() == 0


# --- op10


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    extra = docs.sparkSession.createDataFrame([(9100, "J\u030c H\u0331x T\u0308.W\u030a Y\u030aX A<|endoftext|>b <|ENDOFTEXT|> it's 'S fine|X.,'ll ＡＢ ﬁ İstanbul e\u0301=\u0338a 12ab", *[None] * 7)], SCHEMA)
    got = packing.pack(docs.unionByName(extra), length=512, whole=True).collect()
    want = collections.Counter((r[0], tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in [*ROWS, extra.first()])
    found, run = collections.Counter(), []
    stream = sorted(got, key=lambda r: (r.sequence_id, r["offset"]))
    at = 0
    for r in stream:
        assert (r.sequence_id, r["offset"]) == divmod(at, 512) and r.length == len(r.ids) and r["offset"] + r.length <= 512
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == len(run)
        at += r.length
        run += r.ids
        if len(run) == r.doc_tokens:
            found[(r.doc_id, tuple(run))] += 1
            run = []
    assert found == want and not run and packing.pack(empty).count() == 0


def test_pieces_cache_starts_anew(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(packing.VOCABULARY)
    texts = pa.array([r[1] for r in ROWS])
    whole = [packing.Encoder(path).encode(c)[0].tolist() for c in textvec.chunks(texts)]
    monkeypatch.setattr(packing, "CACHE_PIECES", 50)
    e = packing.Encoder(path)
    assert sum(whole, []) == sum((e.encode(c)[0].tolist() for c in textvec.chunks(texts, 2000)), [])
