"""The pipeline on a small corpus with planted cases, stage by stage, against plain versions."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from pathloom.llm import pieces, queries

WORDS = [a + b + c for a in ("ba", "co", "di", "fu") for b in ("lan", "mor", "net", "pas", "rin") for c in ("", "e", "ing", "s")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    passage, leak = prose(r, 60), prose(r, 30)
    rows = [(k, "\n".join(prose(r, r.randint(15, 60)) for _ in range(3))) for k in range(120)]
    junk = [(200 + k, " ".join(w.upper() + "!!" for w in prose(r, 60).split())) for k in range(40)]
    copies = [(300, rows[5][1]), (301, rows[5][1])]
    near = [(310 + k, rows[6][1].replace("\n", " ").replace(rows[6][1].split()[9 + k], "changed", 1)) for k in range(3)]
    shared = [(320 + k, prose(r, 40) + "\n" + passage + "\n" + prose(r, 40)) for k in range(4)]
    leaked = [(330, prose(r, 20) + " " + leak.lower() + " " + prose(r, 20))]
    every = rows + junk + copies + near + shared + leaked + [(340, None), (341, "")]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in rows[::2]] + [(i, 0, 0) for i, _ in junk[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, prose(r, 25))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(every), {i for i, _ in junk}, passage


def test_stages(spark, folder):
    path, given, junk, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for n, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, path)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{path}/stage{n}")
        docs = spark.read.parquet(f"{path}/stage{n}")
        seen.append({r.doc_id: r for r in docs.collect()})
    quality, lines, groups, clean, coded = seen
    # The classifier rejects the junk and keeps all else that has words.
    assert {i for i, t in given.items() if i not in junk and t} <= set(quality) and not junk & set(quality)
    # Whole copies go; the shared passage stays once.
    assert 5 in lines and not {300, 301} & set(lines)
    assert [i for i, r in lines.items() if r.text and passage in r.text] == [320]
    assert all(lines[i].text == given[i] for i in range(120)) and all(r.n_chars is None or r.n_chars == len(r.text) for r in lines.values())
    # One of the near copies (of five-word shingles) stays.
    assert set(lines) - set(groups) == {310, 311, 312}
    assert set(groups) - set(clean) == {330}
    v = pieces.load()
    assert set(coded) == set(clean)
    for i, r in coded.items():
        assert r.round_trip and (r.piece_ids is None) == (clean[i].text is None)
        assert r.piece_ids is None or pieces.decode_ids(r.piece_ids, v) == clean[i].text


def test_run_is_the_stages(spark, folder):
    path = folder[0]
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == {r.doc_id for r in spark.read.parquet(f"{path}/stage4").collect()}


def test_registered():
    found = __spark_entry__.queries()
    assert set(queries.queries()) | {"pipeline"} <= set(found)
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
