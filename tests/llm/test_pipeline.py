"""The corpus pipeline against brute force: what each stage lets go, and the packed pieces."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_near_copies import brute_sets, changed
from .test_text_measures import brute_measure, check_pieces

SAY = {"en": "the house by water and of light with ing seven ships went down this long river", "de": "das schöne haus über und nicht straße wasser licht sieben schiffe gehen unter"}


def fixture():
    rng = random.Random(11)
    words = {x: [f"{rng.choice(w.split())}{rng.choice(['', 'en', 'er', 'ing'])}{i}" for i in range(900)] for x, w in SAY.items()}
    rows = []

    def add(text, lang, source="a"):
        rows.append((len(rows), text, lang, source, len(text or "")))

    for i in range(60):
        lang = rng.choice(list(SAY))
        t = [rng.choice(words[lang]) for _ in range(rng.randrange(30, 200))]
        add(" ".join(t), lang, f"s{i % 5}")
        if i % 6 == 0:
            add(" ".join(t), lang, "s1")
            add(changed(rng, t, 1), lang, "s2")
    for t in (None, "", "123 456 $$$", "only six words in this text", "the same eight words come again and again " * 9, "?!"):
        add(t, "en", "s3")
    return rows


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        left[name] = sorted(r.doc_id for r in kept.select("doc_id").collect())
        docs = kept
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert left["language_id"] == [r[0] for r in want]

    def passes(t):
        n, _, _, _, _, repeat = brute_measure(t)
        return n >= 20 and 100 * repeat <= 30 * n

    want = [r for r in want if passes(r[1])]
    assert left["quality_rules"] == [r[0] for r in want]
    sets, gone = brute_sets([(r[0], r[1]) for r in want]), set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                gone.add(want[i][0])  # copies stand behind their originals here
    want = [r for r in want if r[0] not in gone]
    assert gone and left["near_dedup"] == [r[0] for r in want]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_pieces(pieces, [(r[0], r[1]) for r in want], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert {p.doc_id for p in pieces} == {r[0] for r in want}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_awkward_rows(spark, awkward, rows, tmp_path):
    """Null and repeated ids, extra columns with names that the operators use: every stage keeps the columns and loses what
    it says it loses."""
    docs = awkward.withColumn("n_chars", F.length("text").cast("long")).withColumn("label", F.lit("x")).withColumn("row", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns, name
        got = Counter((r.doc_id, r.text, r.lang, r.source) for r in left.collect())
        assert not got - Counter(rows), name
        if name == "language_id":
            assert got == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))
        if name == "quality_rules":
            assert all(brute_measure(t)[0] >= 20 for _, t, _, _ in got)
        if name == "near_dedup":  # the least id of each group; rows without a word are left alone
            assert got[9, rows[8][1], "de", "a"] == 1 and got[1, rows[0][1], "en", "a"] == 1 and (2, rows[1][1], "en", "a") not in got
            assert got[None, rows[11][1], "en", "c"] == 1 and got[None, None, None, None] == 1 and got[3, None, "en", "a"] == 1
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    check_pieces(stage(spark, docs, str(tmp_path)).collect(), [(r[0], r[1]) for r in rows], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
