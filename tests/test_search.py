import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import all_words, digit_runs
from lodestar.operators import index as ix
from lodestar.operators import ranking as rk
from lodestar.operators.coded import blocks_of, read_blocks
from lodestar.operators.corpus import build_corpus, dataset_texts
from lodestar.session import fresh_path
from lodestar.settings import IndexSettings, RankSettings
from lodestar.sources import catalog as ct

STOP = ("the", "of")


def corpus_of(spark, texts, papers=()):
    rows = spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "pos LONG, dataset STRING, text STRING")
    pubs = spark.createDataFrame([(i, t, "u") for i, t in enumerate(papers)], "pos LONG, title STRING, link STRING")
    return build_corpus(rows, pubs)


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id LONG, text STRING")


def collected(hits):
    return sorted((r.query_id, r.entry_type, r["rank"], r.key, round(r.score, 6)) for r in hits.collect())


def test_scores_without_vocabulary(spark):
    """Overlap is shared words over the question's words plus one, times 0.3; a number adds 0.5."""
    index = ix.build_index(corpus_of(spark, ["gene mouse", "the mouse of orbit", "plant 12", "none"]), IndexSettings(STOP, 0))
    got = collected(rk.search(index, asked(spark, "mouse 12", "", "the of")))
    assert got == [
        (0, "dataset", 1, "d2", 0.6), (0, "dataset", 2, "d0", 0.1), (0, "dataset", 3, "d1", 0.1), (2, "dataset", 1, "d1", 0.2),
    ]


@pytest.mark.parametrize("cap", [100, None])
def test_scores_with_vocabulary(spark, cap):
    """Three entries: idf of mouse is ln(4/3) + 1 = 1.287682, of terms in one entry ln(2) + 1 = 1.693147.

    The first entry has mouse, gene and their pair: mouse weighs 1.287682 / 2.718754 = 0.473630 in it, and as much in
    the second one, so these agree by 0.224325.
    """
    index = ix.build_index(corpus_of(spark, ["gene mouse", "mouse of orbit", "plant"]), IndexSettings(STOP, cap))
    got = collected(rk.search(index, asked(spark, "gene mouse")))
    assert got == [(0, "dataset", 1, "d0", 0.9), (0, "dataset", 2, "d1", round(0.7 * 0.224325 + 0.1, 6))]


def test_limits_ties_and_types(spark):
    index = ix.build_index(corpus_of(spark, ["mouse"] * 7, ["mouse"] * 9), IndexSettings(STOP))
    got = collected(rk.search(index, asked(spark, "mouse")))
    assert [(kind, rank, key) for _, kind, rank, key, _ in got] == [
        *(("dataset", i + 1, f"d{i}") for i in range(5)), *(("publication", i + 1, f"pub_{i}") for i in range(8)),
    ]


def many(spark):
    words = "gene mouse flight the of rna cell orbit 12 3.5 x120 plant été".split()
    texts = [" ".join(words[(i * k) % 13] for k in range(1, 2 + i % 9)) for i in range(40)]
    return corpus_of(spark, texts, texts[:15]), asked(spark, *[f"{words[i]} {words[(5 * i + 2) % 13]} 20" for i in range(13)])


def test_shuffled_and_written_give_the_same(spark):
    corpus, questions = many(spark)
    index = ix.build_index(corpus, IndexSettings(STOP, 30))
    want = collected(rk.search(index, questions))
    assert want and collected(rk.search(index, questions, RankSettings(broadcast_rows=0))) == want
    path = fresh_path(spark, "test-index")
    ix.write_index(ix.build_index(corpus.limit(3), IndexSettings()), path)
    ix.write_index(index, path)
    again = ix.read_index(spark, path)
    assert again.settings == IndexSettings(STOP, 30) and collected(rk.search(again, questions)) == want
    by_list = {}
    for query, kind, rank, _, score in want:
        by_list.setdefault((query, kind), []).append((rank, score))
    assert all([r for r, _ in x] == list(range(1, len(x) + 1)) and [s for _, s in x] == sorted((s for _, s in x), reverse=True) for x in by_list.values())


def test_entries_of_several_catalogue_files_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"A": {"description": "mouse"}, "C": {"description": "cell"}}')
    (tmp_path / "b.json").write_text('{"B": {"description": "plant"}, "A": {"description": "orbit"}}')
    catalog = ct.load_catalog(spark, str(tmp_path))
    assert [(r.pos, r.dataset, r.description) for r in catalog.orderBy("pos").collect()] == [(0, "A", "orbit"), (1, "C", "cell"), (2, "B", "plant")]
    index = ix.build_index(corpus_of(spark, [], []).unionByName(build_corpus(dataset_texts(catalog), ct.load_publications(spark, "none"))), IndexSettings(STOP))
    assert [key for _, _, _, key, _ in collected(rk.search(index, asked(spark, "plant")))] == ["B"]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.json").write_text('[{"Title": "one"}]\n[{"Link": "l"}, {"Title": "two"}]\n')
    assert [(r.pos, r.title) for r in ct.load_publications(spark, str(tmp_path / "l"), lines=True).orderBy("pos").collect()] == [(0, "one"), (1, ""), (2, "two")]


def test_weights_have_norm_one(spark):
    index = ix.build_index(many(spark)[0], IndexSettings(STOP))
    norms = index.terms.groupBy("ord").agg(F.sum(F.pow("weight", 2)).alias("n"))
    assert all(abs(r.n - 1) < 1e-9 for r in norms.collect())


def test_scoring_does_not_shuffle_pairs(spark):
    corpus, questions = many(spark)
    pairs = rk.score_pairs(ix.build_index(corpus, IndexSettings(STOP)), questions)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("BroadcastHashJoin")]
    assert "Exchange" not in top and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert "NestedLoop" not in plan


def test_bounded_pairs_give_the_hits_of_all_pairs(spark, monkeypatch):
    """Pruned blocks hold no hit: with every posting rare, or none, and with ties, the hits are those of all pairs."""
    import random

    pick = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "12", "7"]
    texts = [" ".join(pick.choice(vocab) for _ in range(pick.randrange(0, 40))) for _ in range(300)]
    texts += [texts[5]] * 12 + ["w1 w2 w3 12"] * 3
    papers = [" ".join(pick.choice(vocab) for _ in range(pick.randrange(1, 6))) for _ in range(80)]
    index = ix.build_index(corpus_of(spark, texts, papers), IndexSettings(STOP, 40))
    questions = asked(spark, texts[5], "w1 w2 w3 12", "the of", "", "w59 7 7", papers[3])

    def hits(pairs):
        return sorted((r.query_id, r.ord, r["rank"], round(r.score, 9)) for r in rk.top_pairs(pairs).collect())

    want = hits(rk.score_pairs(index, questions))
    for rare in (0, 5, 10_000):
        monkeypatch.setattr(rk, "RARE_POSTINGS", rare)
        assert hits(rk.bounded_pairs(index, questions)) == want
    assert len(want) > 20


def test_words_are_taken_apart_once_and_tasks_grow_with_the_text(spark, monkeypatch):
    """Weights and words read the written tokens, and a task's text is bounded: more text has more tasks."""
    corpus = corpus_of(spark, ["gene mouse"] * 50)
    few = ix.by_entry(corpus).rdd.getNumPartitions()
    monkeypatch.setattr(ix, "TASK_BYTES", 10)
    assert ix.by_entry(corpus).rdd.getNumPartitions() == 50 > few
    index = ix.build_index(corpus, IndexSettings(STOP))
    for table in (index.terms, index.words):
        assert "regexp_extract_all" not in table._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cap", [6, 100])
def test_chunks_do_not_change_terms(spark, monkeypatch, cap):
    """Counts and weights by chunks of a few tokens, also of entries in several rows, are those of plain grouping."""
    corpus, _ = many(spark)
    corpus = corpus.unionByName(corpus.where("ord < 9")).unionByName(corpus.limit(1).withColumn("text", F.lit(None).cast("string")))
    settings = IndexSettings(STOP, cap)
    monkeypatch.setattr(ix, "CHUNK_TOKENS", 3)
    index = ix.build_index(corpus, settings)
    counted = ix.terms(corpus, "ord", settings).groupBy("term", "ord").count().groupBy("term").agg(F.count("*").alias("entries"), F.sum("count").alias("total"))
    listed = corpus.select(F.array_distinct(ix.with_bigrams(ix.kept_tokens(F.col("text"), STOP))).alias("t")).select(F.explode("t").alias("term"))
    df = listed.groupBy("term").agg(F.count("*").alias("df"))
    want = [tuple(r) for r in counted.join(df, "term").orderBy(F.desc("total"), "term").limit(cap).select("term", "df", "total").collect()]
    assert [(r.term, r.df, r.total) for r in index.vocabulary.orderBy(F.desc("total"), "term").collect()] == want
    monkeypatch.setattr(ix, "SENT_TERMS", 0)
    joined = ix.weights(corpus, "ord", index.vocabulary, settings)
    got, plain = (sorted((r.ord, r.term, round(r.weight, 9)) for r in x.collect()) for x in (index.terms, joined))
    assert got == plain and len(got) > 100


@pytest.mark.parametrize("few", [0, 1_000])
def test_few_and_many_questions_have_the_same_hits(spark, monkeypatch, few):
    """All pairs of few questions, scored where they arise, give the hits that the bounded pairs of many give."""
    corpus, questions = many(spark)
    index = ix.build_index(corpus, IndexSettings(STOP, 30))
    want = collected(rk.top_pairs(rk.score_pairs(index, questions)).join(index.entries.select("ord", "key"), "ord"))
    monkeypatch.setattr(rk, "ALL_PAIRS_QUESTIONS", few)
    assert collected(rk.search(index, questions)) == want and want


def test_coded_words_are_those_of_the_expressions(spark):
    """Blocks hold the words and digit runs that Spark's expressions find, with any letters, cases, digits and spaces."""
    texts = [
        "Gene gene_2 ..12.3 4. x\u00b2 \u00c9T\u00c9 \u017dlu\u0165 \u023a\u2013\u201cq\u201d\x00a\u2028b", "\u0130stanbul 5", "\u03a3\u03bf\u03c6\u03bf\u03a3 7.", "\u4e2d\u6587 \u0663\u0664.\u0665",
        "a\U0001f600b 9", "", None, ". . 1..2", "x\nY\r12",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord LONG, text STRING").repartition(2, "ord")
    blocks = blocks_of(rows, "ord", STOP, 40)
    got = {}
    for batch in blocks.toArrow().select(list(ix.BLOCK_WORDS)).to_batches():
        for block in read_blocks([batch]):
            words, runs = block.words.to_pylist(), block.runs.to_pylist()
            for row, key in enumerate(block.keys.to_pylist()):
                of_row = [words[c] for c in block.codes[block.row == row]]
                got[key] = (of_row, sorted(set(r for r, at in zip(runs, block.run_row) if at == row)))
    want = rows.select("ord", all_words(F.col("text")).alias("words"), digit_runs(F.col("text")).alias("runs")).collect()
    assert got == {r.ord: (list(r.words or []), sorted(r.runs or [])) for r in want} and len(got) == 9


def test_few_questions_are_scored_in_the_blocks(spark, monkeypatch):
    """No postings are written for few questions; hits, also of ties, of repeated and null ids, are those of all pairs."""
    corpus, questions = many(spark)
    questions = questions.unionByName(questions.where("query_id < 3").withColumn("text", F.concat("text", F.lit(" the gene 12 x120"))))
    questions = questions.unionByName(questions.limit(1).withColumn("query_id", F.lit(None).cast("long")))
    index = ix.build_index(corpus, IndexSettings(STOP, 30))

    def hits(found):
        return sorted((str(r.query_id), r.ord, r["rank"], round(r.score, 9), round(r.overlap, 9)) for r in found.collect())

    want = hits(rk.top_pairs(rk.score_pairs(index, questions)))
    monkeypatch.setattr(rk, "postings", None)
    assert hits(rk.search(index, questions)) == want and len(want) > 50
