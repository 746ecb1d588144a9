"""The source audit, the source mix and the vector codes against plain versions, on awkward tables and given ones."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import hot_keys, mixing, queries, radix_trie, source_audit, vector_codes

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, rank string, value string, words string, cell string"
MORE = ("clash", None, "clash", "clash")


def corpus(n=150, seed=2, longest=30_000):
    r = random.Random(seed)
    words = "the of river stone Walks under straße café 漢字 moon and 7seven x".split() + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(n):
        source = r.choice(["a", "a", "a", "a", "b", "c", "é", "", None])
        text = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 9, 40])))
        rows.append((k, text, r.choice(["en", "en", "de", None]), source, *MORE))
    rows += [(900, None, "fr", "lonely", *MORE), (901, "no such tongue", "xx", "p", *MORE), (902, "", "xx", "q", *MORE), (903, "long " * longest, "en", "a", *MORE)]
    return rows + [rows[3], rows[3], (None, "the of", "en", "b", *MORE), (None, "the of", "en", "b", *MORE)]


# --- the audit ---


def plain_audit(rows, least, top):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, usual = {s: share(counts[lang, s]) for s in sources}, share(whole)
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], usual[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > usual[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found if part == "pair" else found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_is_the_plain_one(spark, monkeypatch, small):
    if small:  # several rows a trie, merges in steps, tries given out early, blocks of groups
        for name, value in (("ROW", 5), ("WAITING", 8), ("HELD", 20), ("SPACING", 2), ("GROUPS", 8), ("RANGE", 10)):
            monkeypatch.setattr(source_audit, name, value)
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(tuple(r) for r in source_audit.audit(docs, least_docs=6, top=3).collect())
    assert got == plain_audit(rows, 6, 3)
    assert {r[0] for r in got} == {"en", "de", "", "xx"}  # a language with one source and no kept term has no row
    assert [r[1:] for r in got if r[0] == "xx"] == [("p", "pair", "q", 0, 1), ("q", "pair", "p", 0, 1)]


def test_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], DOCS)).collect() == []
    assert source_audit.audit(spark.createDataFrame([(1, None, None, None, *MORE)], DOCS)).collect() == []


def test_shares_are_exact_beyond_longs():
    assert source_audit.share(np.array([10**12, 0]), 10**13, 7).tolist() == [1 + 10**9 * (10**12 + 2) // (10**13 + 14), 1 + 2 * 10**9 // (10**13 + 14)]


def test_tries_dump_load_cut_and_merge():
    r = random.Random(4)
    plain, tries = Counter(), []
    for _ in range(6):
        own = Counter((bytes(r.choice(b"ab\xc3") for _ in range(r.randint(1, 7))), r.randrange(3)) for _ in range(80))
        terms = sorted({t for t, _ in own}, key=lambda t: r.random())
        pairs = list(own)
        trie = radix_trie.from_counts(
            pa.array(terms, pa.binary()), np.ones(len(terms), np.int64), np.array([terms.index(t) for t, _ in pairs]), np.array([s for _, s in pairs]), np.array([own[p] for p in pairs])
        )
        assert trie.terms.to_pylist() == sorted(terms)
        tries.append(radix_trie.load(radix_trie.dump(trie)))
        plain.update(own)
    found = radix_trie.merge(tries)
    names = found.terms.to_pylist()
    count = lambda t: {(t.terms[int(i)].as_py(), int(s)): int(c) for i, s, c in zip(t.leaf, t.source, t.count, strict=True)}
    assert names == sorted({t for t, _ in plain}) and count(found) == dict(plain)
    places = found.cut([b"a", b"ab", b"\xc3"])
    assert places == [sum(n < at for n in names) for at in (b"a", b"ab", b"\xc3")]
    ranges = [found.range(a, b) for a, b in itertools.pairwise([0, *places, len(names)])]
    assert dict(sum((Counter(count(t)) for t in ranges), Counter())) == dict(plain)
    assert count(found.at_least(4)) == {(t, s): c for (t, s), c in plain.items() if found.docs[names.index(t)] >= 4}


# --- the mix ---


def plain_targets(sizes):
    """Targets by source as fractions; sizes: source or None -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = Fraction(sum(sizes.values())), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return {s: Fraction(3 * sizes[s]) for s in order}
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return share | {s: Fraction(3 * sizes[s]) for s in capped}
        capped |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(spark):
    rows = corpus(1500, longest=400)
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    got = mixing.mixture(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], words(r[1])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    targets = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(float(targets[r.source]), rel=1e-12)
        assert r.size == 0 or math.floor(r.target / r.source_size) <= r.copies <= math.ceil(r.target / r.source_size)
        taken[r.source] += r.copies * r.size
    for s, target in targets.items():
        assert abs(taken[s] - float(target)) <= 0.01 * float(target), s
    again = mixing.mixture(docs.repartition(3).orderBy("text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sorted(map(str, mixing.mixture(docs, seed=1).collect())) != sorted(map(str, got))
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)
    assert mixing.mixed(docs).columns == docs.columns


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", *MORE)], [(1, "a b", "en", None, *MORE)], [(1, "a b c", "en", "s", *MORE), (2, "", "en", "t", *MORE)]])
def test_mix_of_little(spark, rows):
    got = mixing.mixture(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.size for r in got) == sorted(words(r[1]) for r in rows)
    assert sum(r.copies * r.size for r in got) == sum(words(r[1]) for r in rows)  # one source with words takes them all


def test_targets_stop_at_three_times_a_size(spark):
    sizes = {"a": 1000, "b": 3, "c": 5, None: 40, "d": 0, "e": 7}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx({s: float(t) for s, t in plain_targets(sizes).items()})
    assert got["b"] == 9 and got["d"] == 0


def test_settled_pairs_keep_the_words_and_each_expectation():
    sizes, shares, met = [5, 9, 1, 30, 7, 2, 12], [0.3, 0.5, 0.8, 0.2, 0.6, 0.1, 0.9], np.zeros(7)
    for seed in range(4000):
        now = list(shares)
        left = mixing.settle(sizes, now, [mixing.draw(seed, k) for k in range(7)])
        assert len(left) <= 1 and all(p in (0, 1) for k, p in enumerate(now) if k not in left)
        assert math.isclose(math.fsum(s * p for s, p in zip(sizes, now, strict=True)), math.fsum(s * p for s, p in zip(sizes, shares, strict=True)))
        met += now
    assert np.abs(met / 4000 - shares).max() < 0.03


def test_small_documents_make_up_for_large_ones():
    r = random.Random(3)
    for _ in range(50):
        classes = [([2**k + r.randrange(2**k) for _ in range(5)], [r.random() for _ in range(5)], [r.random() for _ in range(5)]) for k in range(12, -1, -1)]
        wanted = math.fsum(s * p for sizes, shares, _ in classes for s, p in zip(sizes, shares, strict=True))
        mixing.land(classes)
        assert all(p in (0, 1) for _, shares, _ in classes for p in shares)
        assert abs(sum(s * p for sizes, shares, _ in classes for s, p in zip(sizes, shares, strict=True)) - wanted) < 8


# --- vector codes ---


def plain_codes(rows, parts, entries, rounds):
    """rows: (id, vector, label), kept ones in order of id."""
    width = -(-max((len(v) for _, v, _ in rows), default=1) // parts) or 1
    cut = [[[math.floor(4096 * Fraction(x)) for x in [*v, *[0.0] * (parts * width - len(v))][p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in rows]
    books = [[cut[k][p] for k in range(min(entries, len(rows)))] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (gap(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[nearest(v[p], books[p])].append(v[p])
            books[p] = [[sum(c) // len(c) for c in zip(*own[e], strict=True)] if own[e] else z for e, z in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(gap(v[p], books[p][e]) for p, e in enumerate(f)) for v, f in zip(cut, found, strict=True)]
    return ["".join(f"{e:02x}" for e in f) for f in found], errors, books


def vectors(kind):
    r = random.Random(5)
    spread = [[r.choice([-0.5, 0.25, 0.125, r.gauss(0, 0.2)]) for _ in range(16)] for _ in range(120)]
    if kind == "copies":
        spread = [spread[0]] * 60 + spread[:20]
    if kind == "large":
        spread[7][3], spread[11] = 3e38, [-2.5e30] * 16
    if kind == "ragged":
        spread[4], spread[9], spread[10] = [], spread[9][:3], [*spread[10], 0.75, -0.75]
    if kind == "few":
        spread = spread[:3]
    return [(k if k != 5 else None, [float(np.float32(x)) for x in v], r.choice([0, 1, None])) for k, v in enumerate(spread)]


@pytest.mark.parametrize("kind", ["plain", "copies", "large", "ragged", "few"])
def test_codes_are_those_of_plain_rounds(spark, kind):
    rows = vectors(kind)
    bad = [(200, None, 1), (-1, [0.1, None], 1), (-2, [float("nan")], 1), (-3, [float("inf")], None)]
    table = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    coded, books = vector_codes.compress(table, parts=4, entries=6, rounds=3)
    assert coded.columns == ["vec_id", "label", "code", "error"]
    ordered = sorted(rows, key=lambda x: (x[0] is None, x[0]))
    codes, errors, want = plain_codes(ordered, 4, 6, 3)
    assert books == want
    got = Counter((r.vec_id, r.label, r.code, r.error) for r in coded.collect())
    assert got == Counter((i, y, c, min(e, vector_codes.LONGEST)) for (i, _, y), c, e in zip(ordered, codes, errors, strict=True))


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(empty)
    assert coded.collect() == [] and books == [[] for _ in range(8)]


def test_whole_nodes_are_assigned_at_once():
    """On points in clusters the tree is asked about a small part of them."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8)).astype(float)
    points = centres[rng.integers(0, 16, 4096)] + rng.integers(-20, 20, (4096, 8))
    looked, plain = [], vector_codes._distances
    vector_codes._distances = lambda x, book: looked.append(len(x)) or plain(x, book)
    try:
        entry, sums, counts = vector_codes.assign(tree := vector_codes.build(points), centres)
    finally:
        vector_codes._distances = plain
    assert sum(looked) < len(points)
    assert (entry == np.argmin(plain(tree.points, centres), axis=1)).all() and counts.sum() == 4096 and sums.sum() == points.sum()


def test_hot_keys_meet_their_totals(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "SHARE", 3)
    rows = spark.createDataFrame([(None,)] * 50 + [(0,)] * 40 + [(k % 9,) for k in range(30)], "k int")
    totals = rows.groupBy("k").count().selectExpr("k", "count as n", "count * 2 as twice")
    got = Counter((r.k, r.twice) for r in hot_keys.with_totals(rows, totals, "k", "n").collect())
    assert got == {(r.k, r.twice): r.n for r in totals.collect()}


@pytest.mark.parametrize("name", ["op11_source_audit", "op13_vector_codes"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    want = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_mix_of_the_given_documents(spark):
    rows = queries.queries()["op12_source_mix"](spark, FOLDER).collect()
    given = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, source, text FROM '{FOLDER}/documents.parquet'").fetchall()}
    taken, targets, sizes = Counter(), {}, Counter()
    for r in rows:
        source, text = given[r.doc_id]
        assert r.size == words(text) and r.taken <= 3 * r.size
        taken[source] += r.taken
        sizes[source] += r.size
        targets[source] = r.target
    assert len(rows) == len(given)
    assert targets == pytest.approx({s: float(t) for s, t in plain_targets(sizes).items()})
    assert sum(abs(taken[s] - t) for s, t in targets.items()) < 0.03 * sum(targets.values())
