"""Operators 11 to 13 against brute force, and words that must not be taken for each other."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandtally.llm import audit, divergence, katz, repeats, similar, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rng_texts(n, seed, pool):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(pool, int(rng.integers(0, 160)))) for _ in range(n)]


# filters


def brute_audit(rows, labels):
    """rows (doc_id, text, lang); labels (doc_id, quality, toxic)."""
    docs = [(i, t or "", part or "") for i, t, part in rows]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    fails = []
    for i, t, part in docs:
        w = WORD.findall(t)
        bad = {"A"} if len(w) < 100 else set()
        bad |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        bad |= {"D"} if set(t) & set("#$%&*|") else set()
        bad |= {"E"} if i is not None and least[t] < i else set()
        fails.append((part, bad, i in good, i in toxic))
    out = {}
    for part in {p for _, _, p in docs}:
        own = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(removed)
                every = [x for x in own if f in x[1]]
                out[part, "".join(order), step] = [len(left), len(removed), len(every) - len(removed), sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark):
    pool = [f"w{i}" for i in range(60)] + ["Caps", "SHOUT", "é🙂", "a#b", "x|y", "naïve", "%"]
    texts = [None, "", " \n\t ", "", "A" * 300, "é" * 9 + "A", "word " * 150, "x" * 20_000 + " y", " ".join(f"v{i}" for i in range(120)), *rng_texts(60, 1, pool), *rng_texts(30, 2, [f"u{i}" for i in range(900)])]
    texts += texts[10:25] + texts[3:6] * 4
    langs = [None, "", "en", "de", "x y"]
    rows = [(i, t, langs[i % 5]) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en"), (3, "other", "de"), (None, texts[10], "en"), (None, "", None), (None, "never else", "de"), rows[12], rows[12]]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "n", 2.0) for r in rows], "doc_id long, text string, lang string, mask int, part string, n double").repartition(4)
    told = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, n int")
    found = {tuple(r)[:3]: tuple(r)[3:] for r in audit.audit(df, told).collect()}
    assert found == brute_audit(rows, labels)
    assert audit.audit(df.where("false"), told).count() == 0
    assert audit.audit(df, told.where("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


@pytest.mark.parametrize("keys", ["hash", "few", "one"])
def test_distinct_words_whatever_their_keys(keys):
    from strandtally.llm._shared import word_hashes, words

    texts = ["", "a a b", "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y", " ".join(["ab", "ba", "abc"] * 9), "Straße STRASSE straße", "q" * 70 + " " + "q" * 70 + " " + "q" * 69 + "r", *rng_texts(20, 3, [f"w{i}" for i in range(50)])]
    encoded = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])
    starts, ends, first = words(data, offsets)
    own = word_hashes(data, starts, ends)
    own = {"hash": own, "few": own % np.uint64(3), "one": np.zeros_like(own)}[keys]
    assert audit.distinct_words(data, starts, ends, first, own).tolist() == [len(set(t.split())) for t in texts]


# URLs


def brute_verdict(url, listed):
    def parts(u):
        if u is None or "://" not in u:
            return "", "", ""
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        query = rest[len(host) + len(path) :].split("#")[0].removeprefix("?")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, query

    def canon(u):
        host, path, query = parts(u)
        if not host:
            return None
        asked = sorted((p for p in query.split("&") if p and not p.startswith("utm_")), key=str.encode)
        return re.sub(":(80|443)$", "", host.removeprefix("www.")) + path.rstrip("/") + ("?" + "&".join(asked) if asked else "")

    host, path, _ = parts(url)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict, None
    held = {canon(u) for u in listed} - {None}
    return host, path, None, "block" if canon(url) in held else "allow", canon(url) in held


URLS = [
    None, "", "no scheme", "://", "http://", "https://COM/", "https://com", "http://a.com", "http://a.com/", "http://xcom/", "http://Example.COM/en/1", "http://example.com/en", "https://www.example.com/en/x?y#z",
    "https://m.www.example.com/en/x", "http://notexample.com/en/", "ftp://x.net/es/", "ftp://x.net/fr/9?a", "http://net/fr/", "http://x.net/de/", "http://x.org/a?b=1&a=2&utm_source=q#t", "HTTPS://WWW.X.org:443/a/?a=2&b=1",
    "http://x.org/a?b=1", "http://x.org:8080/a", "http://É.org/Ä", "http://é.org/Ä", "http://u@x.org?q://r/s", "http://x.org#a://b", "http://x.org/é🙂/" + "p" * 100_000, "http://y.org/1", "http://y.org/2\n3", "http://y.org/?&&", "http://[::1]/en/",
]


@pytest.mark.parametrize("blocks", [1 << 20, 1])
def test_url_verdicts_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(urls, "MOST_BLOCKS", blocks)  # a full filter passes everything, and the join decides
    rng = np.random.default_rng(4)
    many = [f"http{'s' * int(rng.integers(2))}://{rng.choice(['', 'www.', 'm.'])}h{int(rng.integers(40))}.org/{int(rng.integers(30))}{rng.choice(['', '/', '?utm_x=1', '#t', '?p=2'])}" for _ in range(1500)]
    listed = [URLS[20], URLS[27], "http://é.org/Ä", None, "nothing", "://", *many[:200], many[0], "http://x.org/a?b=1&utm_=&"]
    own = [*URLS, *many, *[many[0]] * 500]
    ids = [None if i % 7 == 3 else i for i in range(len(own))]
    df = spark.createDataFrame([(i, u, "c", 1) for i, u in zip(ids, own, strict=True)], "page_id long, url string, canon string, block int").repartition(5)
    found = Counter(tuple(r) for r in urls.judge(df, spark.createDataFrame([(u, 1) for u in listed], "url string, w0 int")).collect())
    memo = {u: brute_verdict(u, listed) for u in dict.fromkeys(own)}
    assert found == Counter((i, *memo[u]) for i, u in zip(ids, own, strict=True))
    assert sum(n for r, n in found.items() if r[-1]) > 500
    none = urls.judge(df, df.where("false"))
    assert none.where("listed").count() == 0 and none.count() == len(own)
    assert urls.judge(df.where("false"), df).count() == 0


def test_only_possible_hits_are_shuffled(spark):
    from strandtally.llm._shared import written

    known = written(spark.range(20_000).select(F.concat(F.lit("x.org/"), "id").alias("canon")), "listed")
    blocks = -(-20_000 * urls.BITS_PER_URL // 512)
    rows = spark.range(100_000).select(F.concat(F.lit("x.org/"), F.col("id") + 10_000).alias("canon"))
    passed = urls.passing(rows, urls.bloom(known, blocks), blocks).where("_maybe")
    assert 10_000 <= passed.count() < 10_000 + 0.01 * 90_000  # no false negative, few false positives
    assert passed.join(known, "canon").count() == 10_000
    # a row for each block: what is broadcast is bounded by the number of blocks
    assert urls.bloom(known, blocks).count() <= blocks


# divergence


def brute_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [(lang or "", source or "", term.findall((t or "").translate(lower))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(w for _, _, ws in own for w in set(ws))
        kept = {w for w, n in held.items() if n >= least}
        counts = {s: Counter(w for _, x, ws in own if x == s for w in ws if w in kept) for s in {d[1] for d in own}}
        shares = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in counts if o != s]
            terms = [(q[w] - p[s][w], w.encode()) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    pool = ["The", "the", "tHE", "of", "Straße", "ÉTÉ", "été", "naïve9x", "a-b", "🙂", "x_y", "[q]", "\x7f", *[f"t{c}" for c in "abcdefghij"]]
    texts = [None, "", "123 --", "z" * 30_000, "The " * 4000, *rng_texts(150, 5, pool)]
    rows = [(t, [None, "", "en", "de", "en"][i % 5], [None, "", "s1", "s2", "s3", "S3", "é"][i % 7]) for i, t in enumerate(texts)]
    rows += rows[20:30] + [("unkept words", "fr", "s1"), (None, "fr", "s2"), ("", "fr", None), ("alone", "it", "s1")]
    df = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "text string, lang string, source string, n int, term int, part string").repartition(3)
    found = sorted(tuple(r) for r in divergence.divergence(df, least=6, top=4).collect())
    assert found == brute_divergence(rows, 6, 4)
    assert {r[0] for r in found if r[2] == "pair"} >= {"", "en", "de", "fr"} and any(r[5] == 4 for r in found)
    assert divergence.divergence(df.where("false")).count() == 0


def brute_tally(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    n, held = Counter(), Counter()
    for lang, source, text in rows:
        own = Counter((lang, source, w) for w in term.findall(text.translate(lower)))
        n.update(own)
        held.update(own.keys())
    return {k: (n[k], held[k]) for k in n}


def tally(rows, most):
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])
    return [tuple(r.values()) for b in divergence.tallied(iter([batch.slice(0, 0), batch.slice(0, 7), batch.slice(7)]), most) for r in b.to_pylist()]


@pytest.mark.parametrize("most", [1, 40, 1000, 1 << 20])
def test_terms_are_tallied_by_pieces_and_long_texts_in_parts(most):
    every = "".join(map(chr, [*range(0x250), 0x7FF, 0x800, 0xFFFF, 0x1F642]))
    texts = ["", "123 --", every, every[::-1], "The " * 300, "z" * 2500 + " z", "É" * 700 + "-" + "É" * 9, "a b", "b", "", "b A", *rng_texts(40, 3, ["The", "tHE", "Été", "a-b", "x\x7f", "[q]"]), ""]
    rows = [(["en", "de", ""][i % 3], ["s1", "", "é"][i % 2], t) for i, t in enumerate(texts)]
    out = tally(rows, most)
    n, held = Counter(), Counter()
    for *key, a, b in out:
        n[tuple(key)] += a
        held[tuple(key)] += b
    assert {k: (n[k], held[k]) for k in n} == brute_tally(rows)
    assert not tally([("en", "s", "")] * 9, most) and not tally([("en", "s", " \x00")] * 9, most)


def test_terms_leave_the_kernel_summed(spark):
    """A row for each term of each document was exploded in the JVM before, most of the operator's time."""
    rows = [("en", f"s{i % 2}", "The cat, the CAT and the hat") for i in range(1000)]
    assert len(tally(rows[:7] + rows, 1 << 20)) == 2 * 2 * 4
    df = spark.createDataFrame([(t, lang, source) for lang, source, t in rows], "text string, lang string, source string")
    counts = divergence.kept_counts(df, "text", "lang", "source", 30)[1]
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in counts.collect()} == {("en", s, w, 500 * n) for s in ("s0", "s1") for w, n in [("the", 3), ("cat", 2), ("and", 1), ("hat", 1)]}


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (3, 10, 7), (8_999_999_999, 8_999_999_999, 1), (9_000_000_001, 9_000_000_007, 3), (5 * 10**15, 7 * 10**15 + 1, 10**7), (9 * 10**17, 9 * 10**17, 1)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    rows = df.select("n", "total", "v", divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 5) // (r["total"] + 5 * r["v"]) for r in rows)


# words that polynomial hashes take for each other


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 4096])
def test_thue_morse_words_are_told_apart(spark, size):
    one, two = thue_morse(size)
    tail = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    removed = {r["doc_id"]: r["spans"] for r in repeats.removed_spans(df).collect()}
    assert not removed[1] and not removed[2] and [tuple(s) for s in removed[3]] == [(0, 20)]
    words = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in katz.score_texts(words, F.col("doc_id") == 1).collect()}
    assert (rows[1]["n_known"], rows[2]["n_known"]) == (2, 1)
    texts = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id long, text string")
    assert {r["node"]: r["root"] for r in similar.similar_components(texts).collect()} == {3: 1}


def cell_rows(spark, monkeypatch, texts):
    """Rows that move to cells, and what is found, with blocks of a few texts."""
    moved = []
    checked = similar.checked

    def counted(cells, rows, width, least):
        moved.append(cells.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0])
        return checked(cells, rows, width, least)

    monkeypatch.setattr(similar, "checked", counted)
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 3000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["node"]: r["root"] for r in similar.similar_components(df).collect()}
    return sum(moved), found


def test_rows_moved_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.choice([f"w{i}" for i in range(4000)], 150)
    sizes = (200, 400, 800)
    moved = []
    for n in sizes:
        texts = []
        for i in range(n):
            own = base.copy()
            own[int(rng.integers(0, 150))] = f"new{i}"
            texts.append(" ".join(own))
        with monkeypatch.context() as patch:
            rows, found = cell_rows(spark, patch, texts)
        assert found == dict.fromkeys(range(1, n), 0)
        moved.append(rows)
    assert all(m < 1.5 * n for m, n in zip(moved, sizes, strict=True))
