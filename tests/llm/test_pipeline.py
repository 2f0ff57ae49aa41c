"""The pipeline, stage by stage, over small tables with planted cases."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(7)
    v = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    docs = [(i, text(r.randint(80, 160)), "en", f"src{i % 3}") for i in range(90)]
    item = text(30)
    docs += [(100, docs[0][1], "en", "src1"), (101, docs[1][1] + " tail", "en", "src0")]  # copies
    docs += [(110, text(60) + " " + item.upper() + " " + text(60), "en", "src0")]  # leak
    docs += [(120, text(80) + " password=abcdefabcdef1234 " + text(20), "en", "src2")]  # secret
    docs += [(130, "# $ % " * 60, "en", "src0"), (131, None, None, None), (132, "few words", "en", "src1")]  # junk
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, small))
        assert docs.columns == columns, name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(90))
    assert ids[0] == clean | {100, 101, 110, 120}
    assert ids[1] == clean | {110, 120}
    assert ids[2] == ids[3] == clean | {120}
    masked = docs.where("doc_id = 120").first()
    assert "[SECRET]" in masked.text and "password" not in masked.text and masked.n_chars == len(masked.text)
    out = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in out} <= ids[3] and max(r.mix_copy for r in out) <= 2
    again = corpus_pipeline.run(spark, small).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_rows_without_an_id_of_their_own(spark, small):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("klmnop") for _ in range(6)) for _ in range(n))
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    words, a, b, c, d = item.split(), text(60), text(60), text(60), text(60)
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda out: sorted((x.doc_id is None, x.doc_id or 0, x.text or "", x.source) for x in out.collect())
    want = lambda rows: sorted((i is None, i or 0, t or "", s) for i, t, s in rows)

    stays = [(None, a, "s"), (None, a, "s"), (7, b, "s"), (8, " ".join(words[:15]), "s"), (8, " ".join(words[15:]), "s"), (None, None, "s")]
    leaks = [(None, f"{c} {item}", "s"), (7, f"{d} {item}", "s"), (7, f"{d} {item}", "s")]
    assert kept(corpus_pipeline.decontaminated(spark, frame(stays + leaks), small)) == want(stays)

    stays = [(1, a, "s"), (2, b, "r"), (3, c, "s"), (None, d, "s"), (None, None, "s"), (None, None, "s")]
    copies = [(2, a + " end", "s"), (2, b, "s"), (2, b, "s"), (None, c, "s"), (None, d, "s"), (None, d, "s"), (1, a, "s")]
    assert kept(corpus_pipeline.drop_near_duplicates(spark, frame(copies + stays), small)) == want(stays)
    assert corpus_pipeline.drop_near_duplicates(spark, frame([]), small).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
