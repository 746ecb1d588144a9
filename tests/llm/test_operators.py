"""Each operator on a small table of awkward rows, against a plain version."""

import hashlib
import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.llm import (
    decontamination,
    hmm_lm,
    html_text,
    kernels,
    labelled_pages,
    line_dedup,
    ngram_join,
    pieces,
    pii,
    quality_classifier,
    quality_rules,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_words string"
WORDS = "the of river stone walks under Quiet moon and seven bridges carry old light across town".split()


def texts(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        lines = [" ".join(r.choice(WORDS) + r.choice(["", "", str(r.randint(0, 99))]) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))]
        out.append("\n".join(lines))
    # Copies, near copies, blank and very long texts, and marks of every sort.
    long = " ".join(f"w{k}" for k in range(3000))
    out += [out[0], out[1], out[1] + " extra", None, "", "   \n\t ", long, long + " tail", "é 漢字 ▁ 😀 x\x1cy\xa0z", "a b", "A  B"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with a clashing column, repeated rows and a null id."""
    rows = [(k, t, "en", "s", "clash") for k, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None), (7, "same id as another row", "en", "s", None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def words(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def empty(spark, like):
    return spark.createDataFrame([], like.schema)


# Kernels


def test_windows_and_spans():
    column = pa.array(["a b c", None, "b c d e", "", "x"])
    w = kernels.scan(column, kernels.SPACE)
    h, at = kernels.windows(w, 2)
    assert [w.word(i) for i in range(len(w.starts))] == b"a b c b c d e x".split()
    assert h[1] == h[2] and len(set(h.tolist())) == 4 and at.tolist() == [0, 1, 3, 4, 5]
    big = pa.array(["z" * (kernels.BLOCK + 5) + " a", "a"])
    w = kernels.scan(big, kernels.SPACE)
    assert w.hashes[1] == w.hashes[2] and w.hashes[0] != w.hashes[1]


# 1


def test_hmm_base_and_likelihood(spark, docs, rows):
    got = hmm_lm.hmm_scores(docs, rounds=2).collect()
    counts, n_texts = Counter(), 0
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(words(t))
            n_texts += 1
    counts[None] = n_texts
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        want[i, len(w), sum(counts[x] > 0 for x in w), round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 and np.isfinite(r.score) for r in got)
    assert hmm_lm.hmm_scores(empty(spark, docs)).count() == 0


def test_forward_is_the_sum_over_all_state_paths():
    model = hmm_lm.initial(5, 2)
    codes = [[1, 3, 0], [4, 0], [0]]
    for places, lengths, table in hmm_lm._groups(pa.array([np.array(c, "<u2").tobytes() for c in codes])):
        _, scale, _, _ = hmm_lm.forward(model, lengths, table)
        for k, p in enumerate(places):
            total = 0.0
            for path in np.ndindex(*[2] * len(codes[p])):
                v = model.start[path[0]] * model.emit[codes[p][0], path[0]]
                for t in range(1, len(path)):
                    v *= model.move[path[t - 1], path[t]] * model.emit[codes[p][t], path[t]]
                total += v
            assert np.log(scale[:, k]).sum() == pytest.approx(math.log(total))


def test_expected_counts_are_those_of_a_plain_recursion_without_padding():
    """Scaled at every eighth time only, over packed tokens, the sums are those of unscaled recursions over single texts."""
    r = np.random.default_rng(5)
    model = hmm_lm.initial(30, 3, r.integers(0, 50, 30).astype(float))
    codes = [r.integers(0, 30, n) for n in (1, 2, 8, 9, 17, 33, 40, 40, 25, 24)]
    got = (np.zeros(3), np.zeros((3, 3)), np.zeros((30, 3)))
    total = 0.0
    for _, lengths, table in hmm_lm._groups(pa.array([c.astype("<u2").tobytes() for c in codes])):
        total += hmm_lm.expected(model, lengths, table, got)
        alpha, scale, _, _ = hmm_lm.forward(model, lengths, table)
        assert max(alpha.shape) == lengths.sum() and len(scale) <= 1 + len(table) // 8
    want, likelihood = (np.zeros(3), np.zeros((3, 3)), np.zeros((30, 3))), 0.0
    for c in codes:
        e = model.emit[c]
        a, b = [model.start * e[0]], [np.ones(3)]
        for t in range(1, len(c)):
            a.append((a[-1] @ model.move) * e[t])
            b.insert(0, model.move @ (e[len(c) - t] * b[0]))
        p = a[-1].sum()
        likelihood += np.log(p)
        want[0][:] += a[0] * b[0] / p
        for t in range(len(c)):
            want[2][c[t]] += a[t] * b[t] / p
            if t:
                want[1][:] += np.outer(a[t - 1], e[t] * b[t]) / p
    assert total == pytest.approx(likelihood)
    for x, y in zip(got, want, strict=True):
        assert x == pytest.approx(y)


def test_baum_welch_raises_the_likelihood(spark):
    r = random.Random(2)
    rows = [(k, " ".join(x for _ in range(20) for x in (("a", "b") if r.random() < 0.9 else ("c", "d"))), False) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, held_out boolean")
    totals = []
    for rounds in (0, 1, 4):
        totals.append(sum(x.score for x in hmm_lm.hmm_scores(df, id="id", states=2, rounds=rounds).collect()))
    assert totals[0] < totals[1] < totals[2]


def test_hmm_beats_the_unigram_on_held_out_texts(spark):
    # Texts run through phases with words of their own, which a unigram cannot tell.
    r = random.Random(9)
    rows = []
    for k in range(300):
        phases = [r.randrange(4) for _ in range(4)]
        rows.append((k, " ".join(f"p{p}w{r.randrange(12)}" for p in phases for _ in range(25))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [x for x in hmm_lm.hmm_scores(df).collect() if x.held_out]
    tokens = sum(x.n_tokens for x in got)
    assert len(got) > 20 and sum(x.score - x.base_score for x in got) / tokens > 0.3
    nothing = hmm_lm.hmm_scores(df.where("doc_id < 0").unionByName(df.where(F.col("doc_id").isin([x.doc_id for x in got])))).collect()
    assert nothing and all(x.score < 0 and np.isfinite(x.score) for x in nothing)


# 2


def test_pieces_round_trip(spark, docs):
    out = pieces.decode(pieces.encode(docs)).collect()
    assert Counter(map(str, pieces.encode(docs, decoded="decoded").collect())) == Counter(map(str, out))
    assert all(r.text == r.decoded for r in out) and {"n_words", "lang"} <= set(out[0].asDict())
    assert all((r.piece_ids is None) == (r.text is None) and (r.text != "" or r.piece_ids == []) for r in out)
    assert pieces.encode(empty(spark, docs)).count() == 0


def test_viterbi_is_best():
    v = pieces.load()
    table = {v.raw[i].decode(): s for i, s in zip(v.ids, v.scores, strict=True)}
    score = {int(i): s for i, s in zip(v.ids, v.scores, strict=True)}
    for unit in [" bridge", "walks", "  xx", " an", "é", "qzx", " under"]:
        best = [0.0] + [-math.inf] * len(unit)
        for e in range(1, len(unit) + 1):
            for b in range(e):
                s = table.get(unit[b:e], v.unknown if e - b == 1 else -math.inf)
                best[e] = max(best[e], best[b] + s)
        ids = np.frombuffer(pieces.viterbi([unit], v)[0], "<i4").tolist()
        assert b"".join(v.raw[i] for i in ids).decode() == unit
        if all(c in table for c in unit):
            assert sum(score[i] for i in ids) == pytest.approx(best[-1])


def test_long_texts_are_encoded_in_steps(monkeypatch):
    v = pieces.load()
    texts = [" ".join(f"w{k} \n  x" for k in range(500)), "no-blanks" * 1500, "", None, "   ", "a\n\n b", " " * 300 + "x" * 300]
    whole = pieces.Encoder(v).encode(texts)
    for name, value in (("SPAN", 50), ("UNITS", 7), ("REMEMBERED_BYTES", 1000)):
        monkeypatch.setattr(pieces, name, value)
    assert pieces.Encoder(v).encode(texts) == whole
    assert [t and pieces.decode_ids(np.frombuffer(w, "<i4").tolist(), v) for t, w in zip(texts, whole, strict=True)] == texts


# 3


def test_patience():
    assert line_dedup.matches([1, 2, 3, 4], [0, 2, 3, 9]) == [(1, 1), (2, 2)]
    assert line_dedup.matches([5, 5, 6], [5, 5, 6]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.matches([], [1]) == []
    assert line_dedup.common_blocks([1, 2, 3], [1, 9, 2, 3], [5, 5, 5, 5], 10) == [2, 3]
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randint(0, 6) for _ in range(r.randint(0, 12))], [r.randint(0, 6) for _ in range(r.randint(0, 12))]
        m = line_dedup.matches(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))


def test_line_dedup(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    short = "one common line"
    rows = [
        (1, f"first own\n{passage}\n{short}"), (2, f"second own\n{passage}\n{short}\nlast"), (3, f"first own\n{passage}\n{short}"),
        (4, "unlike any other"), (5, None), (6, ""), (7, f"{short}\nseventh"), (8, "unlike any other"), (8, "unlike any other"),
    ]
    rows += [(100 + k, f"copy {k}\n{passage}") for k in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gone string")
    out = {(r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.deduplicated(df).collect()}
    assert (1, rows[0][1], 0) in out and (3, "", 3) in out and (4, "unlike any other", 0) in out and (5, None, 0) in out
    assert (2, "second own\nlast", 2) in out and (7, f"{short}\nseventh", 0) in out and (8, "", 1) in out
    assert all((100 + k, f"copy {k}", 1) in out for k in range(60))
    kept = sorted(r.doc_id for r in line_dedup.without_repeats(df).collect())
    assert 3 not in kept and 8 not in kept and {1, 2, 4, 5, 6, 7} <= set(kept)
    assert line_dedup.deduplicated(empty(spark, df)).count() == 0


def test_passage_of_short_lines_in_many_documents(spark):
    passage = "\n".join(" ".join(f"s{k}w{j}" for j in range(9)) for k in range(6))
    rows = [(k, f"own start {k}\n{passage}\nown end {k}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()}
    assert out[0] == rows[0][1] and all(out[k] == f"own start {k}\nown end {k}" for k in range(1, 80))


def test_block_whose_lines_come_from_elsewhere(spark):
    # Each line of the later documents' block is first seen in another document.
    block = [" ".join(f"b{k}w{j}" for j in range(10)) for k in range(6)]
    rows = [(k, f"other {k}\n{line}\nend {k}") for k, line in enumerate(block)]
    rows += [(10, "\n".join(["ten", *block])), (11, "\n".join(["eleven", *block, "last"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()}
    assert all(out[i] == t for i, t in rows[:7]) and out[11] == "eleven\nlast"


def all_pairs_dedup(rows, min_words=line_dedup.MIN_WORDS):
    """Lines that any earlier document aligns with, by trying every pair."""
    docs = sorted({(i, t) for i, t in rows if t})
    lines = [[x for x in t.split("\n") if x.encode().split()] for _, t in docs]
    gone = [set() for _ in docs]
    for b in range(len(docs)):
        counts = [len(x.encode().split()) for x in lines[b]]
        for a in range(b):
            if lines[a] == lines[b]:
                gone[b] |= set(range(len(lines[b])))
            else:
                gone[b] |= set(line_dedup.common_blocks(lines[a], lines[b], counts, min_words))
    return {i: [x for k, x in enumerate(own) if k not in lost] for (i, _), own, lost in zip(docs, lines, gone, strict=True)}


def test_line_dedup_is_that_of_all_pairs(spark):
    r = random.Random(12)
    pool = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(r.choice([1, 3, 8, 9, 12, 30]))) for _ in range(60)]
    rows = []
    for k in range(150):
        start = r.randrange(len(pool))
        copied = (pool[start:] + pool[:start])[: r.randint(0, 8)]
        own = [" ".join(r.choice(WORDS) + f"d{k}" for _ in range(r.randint(1, 20))) for _ in range(r.randint(0, 4))]
        cut = r.randint(0, len(own))
        rows.append((k, "\n".join([*own[:cut], *copied, *own[cut:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = all_pairs_dedup(rows)
    got = {x.doc_id: [y for y in x.text.split("\n") if y.split()] for x in line_dedup.deduplicated(df).collect() if x.text}
    for i, own in want.items():
        assert got.get(i, []) == own
    assert sum(len(own) for own in want.values()) < 0.8 * sum(len(t.split("\n")) for _, t in rows)


def held_earlier(rows, min_words=line_dedup.MIN_WORDS):
    """Lines outside of every block of enough words that an earlier document has, read off without any alignment."""
    docs = sorted((i, [x for x in t.split("\n") if x.split()]) for i, t in rows)
    out = {}
    for at, (i, own) in enumerate(docs):
        gone = set(range(len(own))) if any(own == other for _, other in docs[:at]) else set()
        for _, other in docs[:at]:
            for s in range(len(own)):
                for p in range(len(other)):
                    n = 0
                    while s + n < len(own) and p + n < len(other) and own[s + n] == other[p + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[s : s + n]) >= min_words:
                        gone |= set(range(s, s + n))
        out[i] = [x for k, x in enumerate(own) if k not in gone]
    return out


def test_line_dedup_of_blocks_in_any_order(spark):
    x, y = ("\n".join(" ".join(f"{b}{k}w{j}" for j in range(9)) for k in range(4)) for b in "xy")
    rows = [(1, f"{y}\none\n{x}"), (2, f"two\n{x}"), (3, f"three\n{x}\n{y}"), (4, f"{x}\n{y}\n{x}\nfour")]
    r = random.Random(23)
    blocks = [[" ".join(r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(r.choice([2, 5, 9, 14, 30]))) for _ in range(r.randint(1, 4))] for _ in range(14)]
    for k in range(90):
        lines = []
        for block in r.sample(blocks, r.randint(0, 6)):
            cut = r.randint(0, len(block)) if r.random() < 0.3 else 0
            lines += [*block[cut:], *[f"own {k} {r.random()}"] * r.randint(0, 1), *block[: r.randint(0, 2)]]
        rows.append((10 + k, "\n".join([*lines, f"end {k}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {o.doc_id: [z for z in o.text.split("\n") if z] for o in line_dedup.deduplicated(df).collect()}
    assert got[2] == ["two"] and got[3] == ["three"] and got[4] == ["four"]
    assert got == held_earlier(rows)


def test_line_dedup_carries_clashing_names(spark):
    names = ["n_removed_lines", "row", "key", "gone", "a.b"]
    passage = " ".join(f"p{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"a\n{passage}", *"vwxyz"), (2, f"b\n{passage}", *"vwxyz")], ["doc_id", "text", *names])
    kept = line_dedup.without_repeats(df)
    assert kept.columns == df.columns and sorted((r.text, *r[2:]) for r in kept.collect()) == [(f"a\n{passage}", *"vwxyz"), ("b", *"vwxyz")]
    assert sorted(r.n_removed_lines for r in line_dedup.deduplicated(df).collect()) == [0, 1]


# 4


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(sets))


def near_copies(seed, groups):
    r = random.Random(seed)
    out = []
    for size in groups:
        base = [f"{r.choice(WORDS)}{r.randint(0, 999)}" for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"edit{r.randint(0, 10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, rows, n, percent):
    many = rows + [(1000 + k, t) for k, t in enumerate(near_copies(3, [90, 5, 2, 40]))]
    df = spark.createDataFrame([(i, t, 0) for i, t in many], "doc_id long, text string, cls int")
    got = ngram_join.jaccard_components(df, n=n, percent=percent).collect()
    want = plain_components(many, n, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    heads = {c for i, _, c in want if c is not None}
    kept = ngram_join.one_per_group(df.withColumn("_same", F.lit("mine")), n=n, percent=percent).collect()
    assert {r.doc_id for r in kept} - {None} == heads and kept[0].__fields__ == ["doc_id", "text", "cls", "_same"]
    assert {r["_same"] for r in kept} == {"mine"}
    assert ngram_join.jaccard_components(empty(spark, df)).count() == 0


# 5


def test_large_family_with_far_members(spark):
    # Edited and shortened copies of one text: more than a bucket of them, many of which link to each other and not to the leader.
    r = random.Random(5)
    base = [r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(120)]
    family = []
    for k in range(260):
        words = base[: r.choice([120, 120, 100, 84, 70, 60])]
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"w{r.randint(0, 30)}"
        family.append((k, " ".join(words)))
    df = spark.createDataFrame(family, "doc_id long, text string")
    for n, percent in ((5, 80), (3, 90)):
        got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, n=n, percent=percent).collect())
        assert got == plain_components(family, n, percent) and 1 < len({c for _, _, c in got}) < len(family)


@pytest.mark.parametrize("repeated", ["members", "leader"])
def test_repeated_rows_in_a_large_bucket(spark, repeated):
    # Edited copies of a text, and edited copies of its first half, which are too far from it to link.
    base = [f"b{k}" for k in range(200)]
    whole = [(0, " ".join(base))] + [(k, " ".join([*base[: 140 + k], f"x{k}", *base[141 + k :]])) for k in range(1, 46)]
    half = [(100 + k, " ".join([*base[: 40 + k], f"y{k}", *base[41 + k : 98]])) for k in range(1, 46)]
    family = whole + half
    rows = family + (half if repeated == "members" else whole[:1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, n=3, percent=90).collect())
    assert got == plain_components(rows, 3, 90) and 1 < len({c for _, _, c in got}) < len(family)


def test_parity_marks_never_exceed_the_difference():
    r = np.random.default_rng(3)
    for size in (1, 40, 3000):
        a, b = (np.unique(r.integers(0, 4000, size).astype(np.uint64)) for _ in range(2))
        differing = sum(int(x).bit_count() for x in ngram_join.marks(a) ^ ngram_join.marks(b))
        assert differing <= len(np.setxor1d(a, b)) and not (ngram_join.marks(a) ^ ngram_join.marks(a)).any()


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav>"
        "<!-- note --><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p>First  line<br>goes on.<p>Second <b>bold</b>\n text.</p>"
        "<div class='comments'><p>I agree.</p></div></article><footer>&copy; us</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<p"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = html_text.extract(df).collect()
    assert Counter(r.page_id for r in out) == {1: 2, 2: 1, 3: 1, 4: 1}
    for r in out:
        assert r.n_chars == len(r.text) and (r.text == ("A & B\n\nFirst line goes on.\n\nSecond bold text." if r.page_id == 1 else ""))
    assert html_text.extract(empty(spark, df)).count() == 0


def test_html_chain_on_unseen_pages():
    chain = html_text.train(labelled_pages.pages())
    wrong = total = 0
    for p in labelled_pages.pages(100, seed=77):
        found = html_text.blocks(p)
        keep = chain.decode(html_text._features(found))
        wrong += sum(k != b.main for k, b in zip(keep, found, strict=True))
        total += len(found)
    assert wrong < 0.02 * total
    for odd in ("<p>" * 20000, "<!--" * 20000, '<a href="' * 20000, "<div>" * 20000, "&" * 50000, "<svg>" * 20000, "<table><b>" * 9000):
        html_text.main_text(odd, chain)


@pytest.fixture(scope="module")
def chain():
    return html_text.train(labelled_pages.pages())


@pytest.mark.parametrize("unit", ["<div>x", "<p><b>x", "<table><p>x<tr><td>y", "<div class='c{}'>x", "<ul><li>x<a href=/>y", "<svg><svg>x"])
def test_html_takes_time_in_proportion(chain, unit):
    page = lambda n: "".join(unit.replace("{}", f"{k:x}".translate(str.maketrans("0123456789", "ghijklmnop"))) for k in range(n))
    html_text.main_text(page(200), chain)
    assert seconds(html_text.main_text, page(8000), chain) < 3.2 * seconds(html_text.main_text, page(4000), chain) + 0.05


def test_html_keeps_all_of_the_article(chain):
    plain = "<p>The first paragraph tells of the river and the bridge.</p><p>The second one says what happened after that, in some more words.</p>"
    for page in (f"<div>{plain}</div>", f"<html><body><div>{plain}</div></body></html>", f"<html><head><title>t</title></head><body>{plain}</body></html>"):
        assert html_text.main_text(page, chain).count("\n\n") == 1
    maths = "<article><h1>On numbers</h1><p>Let <math><mi>x</mi></math> be <object data=a>large</object>.</p><p>Then <svg/>it is <svg><svg></svg><text>no</text></svg>not small at all.</p></article>"
    assert html_text.main_text(maths, chain) == "On numbers\n\nLet x be large.\n\nThen it is not small at all."


class Article(HTMLParser):
    """A plain reading of the article element: its paragraphs and headings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.parts = False, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.skip += tag in ("script", "style")
        self.parts[-1] += " " if tag == "br" else ""
        if tag not in ("br", "b", "i", "em", "strong", "a", "span"):
            self.parts.append("")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self.parts.append("")
        self.inside &= tag != "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts[-1] += data


def test_html_equals_a_plain_reading_of_the_given_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    wrong = 0
    for r in table.collect():
        reader = Article()
        reader.feed(r.html)
        wrong += got[r.page_id] != "\n\n".join(t for t in (" ".join(p.split()) for p in reader.parts) if t)
    assert len(got) == 250 and wrong == 0


# 6

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and pii.luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_base_is_the_patterns():
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice("ab.@-+1 29(4\n") for _ in range(r.randint(0, 60)))
        base, every = pii.find(t)
        assert base == plain_pii(t) and set(base) <= set(every)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("mail john(at)example(dot)com", "email", "john(at)example(dot)com"),
        ("mail ann at example dot com now", "email", "ann at example dot com"),
        ("j＠example.com", "email", "j＠example.com"),
        ("аlice@exаmple.com", "email", "аlice@exаmple.com"),
        ("at 10.0.０.1!", "ip", "10.0.０.1"),
        ("plus one five five five two three four six seven eight", "phone", "plus one five five five two three four six seven eight"),
        ("+1 (499) 555-6503 4111111111111111", "card", "4111111111111111"),
        ("+1 (499) 555-6503 4111111111111111", "phone", "+1 (499) 555-6503"),
    ],
)
def test_pii_disguises(text, kind, found):
    assert (text.index(found), text.index(found) + len(found), kind) in pii.find(text)[1]


def test_pii_leaves_prose_alone_and_stays_linear():
    for t in ("one two three four", "meet at the mall. Then rest", "it was at noon dot", "nine of ten", "at 12.5 and 3.14"):
        assert pii.find(t)[1] == []
    for t in ("1" * 100000, "a." * 50000, "one " * 20000, "1." * 40000, "+1 " * 20000, "( " * 40000, " " * 100000, "a at " * 20000):
        pii.find(t)


def seconds(f, *arguments):
    best = math.inf
    for _ in range(3):
        began = time.perf_counter()
        f(*arguments)
        best = min(best, time.perf_counter() - began)
    return best


@pytest.mark.parametrize("unit", ["a@b.cd, ", "x (at) y (dot) com ", "+1 (499) 555-6503 4111111111111111 ", "+1 ( ( 2", "j＠x.com 10.0.０.1 ", "ann @ firma.nl "])
def test_pii_takes_time_in_proportion(unit):
    end = " mail ann at example dot com"
    pii.find(unit * 200 + end)
    assert seconds(pii.find, unit * 8000 + end) < 3.2 * seconds(pii.find, unit * 4000 + end) + 0.05


def test_pii_spans_of_texts_with_planted_data():
    r = random.Random(15)
    plants = {
        "email": ["kim.lee@mail.example.org", "kim (at) example (dot) org", "kim at example dot org", "kim @ firma.nl", "kim＠example.com", "kim@exаmple.com"],
        "ip": ["10.20.30.40", "10.20.３0.40", "10.20.30․40"],
        "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "４111111111111111"],
        "phone": ["+14995556503", "+1 (499) 555-6503", "plus one four nine nine five five five six five zero three"],
    }
    for _ in range(300):
        text, want = "", []
        for _ in range(r.randint(1, 6)):
            text += " ".join(r.choice(WORDS) for _ in range(r.randint(1, 12))) + ", "
            kind = r.choice(list(plants))
            plant = r.choice(plants[kind])
            want.append((len(text), len(text) + len(plant), kind))
            text += plant + "; "
        assert [s for s in pii.find(text)[1] if s[2] != "phone" or s in want] == want


def test_pii_table(spark, docs):
    mine = spark.createDataFrame([(1, "to a@b.c or 1.2.3.4", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.private_spans(mine).collect()}
    assert got[1].base == "email:3:8,ip:12:19" and got[1].n_email == got[1].n_ip == 1 and got[2].spans == got[3].base == ""
    assert {r.doc_id: r.text for r in pii.redact(mine).collect()} == {1: "to [email] or [ip]", 2: None, 3: ""}
    assert pii.private_spans(docs).count() == docs.count() and pii.private_spans(empty(spark, docs)).count() == 0


# 7


def test_quality_rules(spark, docs, rows):
    repeated = [(900, "x y z " * 30), (901, "a b c d e f g h\na b c d e f g h\n" + " ".join(f"u{k}" for k in range(40)))]
    df = docs.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(*r, "q") for r in repeated], "doc_id long, text string, n_words string"))
    got = Counter()
    for r in quality_rules.quality_verdicts(df).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.base_failed and r.kept] += 1
    want = Counter()
    for i, t in rows + repeated:
        w = words(t, lower=False)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        marked = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t or "")
        want[i, len(w), sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), len(marked), failed, False] += 1
    assert got == want
    assert quality_rules.quality_verdicts(empty(spark, docs).select("doc_id", "text")).count() == 0


def test_cascade_order_prefers_cheap_rejection(spark):
    df = quality_rules.with_statistics(spark.createDataFrame([(f"w{k} " * 30,) for k in range(50)], "text string"))
    never, always = quality_rules.Rule("never", F.lit(False)), quality_rules.Rule("always", F.col("n_words") > 0)
    assert [r.name for r in quality_rules.cascade_order(df, [never, always])] == ["always", "never"]
    dear = quality_rules.Rule("dear", F.exists(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.transform("words", lambda w: F.xxhash64(w, k)))), lambda h: h > -(1 << 63)))
    assert [r.name for r in quality_rules.cascade_order(df, [dear, never, always])] == ["always", "dear", "never"]
    assert df.where(quality_rules.rejected([never, always])).count() == 50 and quality_rules.cascade_order(df.limit(0), [never]) == [never]


# 8


def test_decontamination(spark):
    long = " ".join(f"b{k}" for k in range(14))
    bench = [(1, long), (2, "Tiny Item"), (3, None), (4, "..."), (2, "Tiny Item"), (None, "no id words")]
    body = long.replace(" ", ", ").upper()
    rows = [(1, f"x {body} y"), (2, "a tiny-item here"), (3, "b0 b1 b2 b3 b4 b5 b6 b7 b8"), (4, None), (5, ""), (6, "clean words only"), (1, f"x {body} y")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, items string")
    table = spark.createDataFrame(bench, "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 10):
        out = decontamination.contamination(docs, table, block_bytes=block).withColumn("n_hit", decontamination.n_hit()).collect()
        got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in out)
        assert got == Counter({(1, 16, 14, "1"): 2, (2, 4, 2, "2"): 1, (3, 9, 0, ""): 1, (4, 0, 0, ""): 1, (5, 0, 0, ""): 1, (6, 3, 0, ""): 1})
    assert sorted(r.doc_id for r in decontamination.without_documents(docs, table).collect()) == [3, 4, 5, 6]
    cut = {r.doc_id: r.text for r in decontamination.without_spans(docs, table).collect()}
    assert cut[1] == "x  y" and cut[2] == "a  here" and cut[4] is None and cut[6] == "clean words only"
    assert sorted(r.doc_id for r in decontamination.without_documents(docs, table, block_bytes=10).collect()) == [3, 4, 5, 6]
    assert decontamination.contamination(docs, empty(spark, table)).where("size(items) > 0").count() == 0
    assert decontamination.contamination(empty(spark, docs), table).count() == 0


def test_long_benchmark_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_WORDS", 7)
    r = random.Random(8)
    item = [f"q{r.randint(0, 400)}" for _ in range(300)]
    docs = [(k, " ".join(["x", *item[k : k + 12], "y"])) for k in range(0, 288, 7)] + [(1000, " ".join(item)), (1001, " ".join(reversed(item)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:9]))], "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 300):
        got = decontamination.contamination(df, bench, block_bytes=block).withColumn("n_hit", decontamination.n_hit()).collect()
        got = {r.doc_id: (r.n_hit, r["items"]) for r in got}
        assert got.pop(1000) == (300, ["1", "2"]) and got.pop(1001) == (0, [])
        assert all(n == 12 and items == (["1", "2"] if k == 0 else ["1"]) for k, (n, items) in got.items())


# 9 and 10


def labelled(spark, bad, seed=6, n=400):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        y = k % 4 == 0
        rows.append((k, bad(r, y), 1.0))
        labels.append((k, int(y)))
    rows += [(9000, None, 0.0), (9001, "", 0.0), (None, "some words", 0.0)]
    labels += [(1, None), (None, 1), (2, labels[2][1])]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, y int")


def accuracy(out, labels):
    truth = {r.doc_id: r.y for r in labels.collect() if r.y is not None and r.doc_id is not None}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity(spark):
    def make(r, y):
        w = [r.choice(WORDS) for _ in range(r.randint(5, 40))] + (["muslim"] if y or r.random() < 0.1 else [])
        return " ".join(w + (["vile"] if y else []))

    docs, labels = labelled(spark, make)
    out = toxicity.toxicity_scores(docs, labels, label="y").collect()
    assert accuracy(out, labels) == 1.0
    assert {r.doc_id: r.held_out for r in out}[5] == (zlib.crc32(b"5") % 4 == 2)
    # A neutral mention of a group that stands beside insults in training stays neutral.
    probe = spark.createDataFrame([(10_000 + k, f"the old {w} river") for k, w in enumerate(("muslim", "christian", "stone"))], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(probe)
    fair = {r.doc_id: r.score for r in toxicity.toxicity_scores(both, labels, label="y", fairness=50.0).collect()}
    plain = {r.doc_id: r.score for r in toxicity.toxicity_scores(both, labels, label="y", fairness=0.0).collect()}
    logit = lambda p: math.log(p / (1 - p))
    gap = lambda s: abs(logit(s[10_000]) - logit(s[10_001]))
    assert gap(fair) < 0.2 * gap(plain) and fair[10_000] < 0.3
    none = toxicity.toxicity_scores(docs, empty(spark, labels), label="y").collect()
    assert {r.score for r in none} == {0.5} and toxicity.toxicity_scores(empty(spark, docs), labels, label="y").count() == 0


def test_quality_classifier(spark):
    def make(r, y):
        w = [r.choice(WORDS) for _ in range(r.randint(30, 80))]
        return " ".join(w) + "." if y else " ".join(x.upper() + "!!" for x in w)

    docs, labels = labelled(spark, make)
    out = quality_classifier.quality_scores(docs, labels, label="y").collect()
    assert accuracy(out, labels) == 1.0 and len(out) == docs.count()
    assert quality_classifier.quality_scores(empty(spark, docs), labels, label="y").count() == 0
    assert {r.score for r in quality_classifier.quality_scores(docs, empty(spark, labels), label="y").collect()} == {0.5}
    kept = {r.doc_id for r in quality_classifier.accepted(docs, labels, label="y").collect()}
    good = {r.doc_id for r in labels.where("y = 1").collect()} - {None}
    assert good <= kept and None in kept


def test_discriminant_is_the_gaussian_formula():
    r = np.random.default_rng(1)
    x = [r.normal(size=(200, 3)), r.normal(size=(300, 3)) * 2 + 1]
    moments = {k: quality_classifier.Moments(len(v), v.mean(0), np.cov(v.T, bias=True)) for k, v in enumerate(x)}
    model = quality_classifier.fit(moments, 0.0, 0.0)
    points = r.normal(size=(5, 3))
    logs = []
    for k in (0, 1):
        m = moments[k]
        d = points - m.mean
        logs.append(np.log(m.n / 500) - 0.5 * np.log(np.linalg.det(m.covariance)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(m.covariance), d))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0]) / quality_classifier.TEMPERATURE))
    assert model.scores(points) == pytest.approx(want)


def plain_statistics(text):
    """The fifteen statistics of a text, one by one."""
    t = text or ""
    raw = t.encode()
    w, lines = words(t, lower=False), [x for x in raw.split(b"\n") if x]
    low = words(t)
    n, more = len(w), quality_classifier.PRIOR_WORDS
    chars = max(len(t), 1)
    blanks = sum(c in " \t\n\x0b\x0c\r" for c in t)
    capitals, small = (sum(c in letters for c in t) for letters in (string.ascii_uppercase, string.ascii_lowercase))
    grams = [tuple(low[k : k + 3]) for k in range(n - 2)]
    n_lines = max(len(lines), 1)

    def share(x, of, usual, per=1):
        return math.sqrt((x + usual * per * more) / (of + per * more))

    return [
        math.log1p(n),
        math.log((chars - blanks + 6 * more) / (n + more)),
        share(capitals, capitals + small, 0.03, 5),
        share(sum(c in string.digits for c in t), chars, 0.002, 6),
        share(min(sum(c in "#*$%&|<>" for c in t), 4 * n), n, 0.01),
        share(min(t.count("!"), 4 * n), n, 0.01),
        share(min(t.count("."), 4 * n), n, 0.15),
        share(min(t.count(","), 4 * n), n, 0.05),
        math.log1p((n + more) / (n_lines + 1)),
        math.log(len(set(low)) + 0.8 * more) - 0.85 * math.log(n + more),
        share(sum(a == b for a, b in zip(low, low[1:], strict=False)), n, 0.01),
        share(len(grams) - len(set(grams)), len(grams), 0.01),
        share(max(n_lines - len(set(lines)), 0) * (n > 0), n_lines, 0.01, 0.1),
        share(max(Counter(low).values(), default=0), n, 0.1),
        share(sum(len(x) > 12 for x in w), n, 0.05),
    ]


def test_statistics_are_the_plain_ones():
    given = [t for t in texts() if t] + ["Ab! Ab! ab, 12.\nAb!\nAb!\n#tag & more", "extraordinarily internationalisation " * 3, "", None]
    got = quality_classifier.statistics(pa.array(given, pa.string()))
    for row, t in zip(got, given, strict=True):
        want = plain_statistics(t)
        assert row == pytest.approx(want), t


def auc(rows):
    """Share of (label 1, label 0) pairs in the right order; ties count half."""
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("scores,label,least", [(toxicity.toxicity_scores, "toxic", 0.95), (quality_classifier.quality_scores, "quality", 0.97)])
def test_held_out_rows_of_the_given_tables(spark, scores, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r[label] for r in labels.collect()}
    rows = [(r.score, truth[r.doc_id]) for r in scores(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(rows) > 50 and auc(rows) > least


def test_hmm_gains_on_the_given_held_out_texts(spark):
    got = [r for r in hmm_lm.hmm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) > 0.05
