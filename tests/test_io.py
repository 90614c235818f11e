from pyspark.sql import functions as F

from wordweave.functions.lexicon import Lexicon
from wordweave.operators import termstats as ts
from wordweave.sources import corpus, sinks
from wordweave.streaming.lines import filter_lines

LEX = Lexicon.from_rows([("bad", -2, -0.5), ("good", 2, 0.5)])


def texts(frame, column="text"):
    return sorted(r[column] for r in frame.collect())


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\n\n")
    (tmp_path / "b.txt").write_text("four")
    assert texts(corpus.read_lines(spark, str(tmp_path))) == ["", "four", "one", "three", "two"]
    spread = corpus.read_lines(spark, str(tmp_path / "*.txt"), partitions=3)
    assert spread.rdd.getNumPartitions() == 3
    assert corpus.partition_sizes(spread).agg(F.sum("rows")).first()[0] == 5


def test_documents_keep_empty_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.txt").write_text("x y\nx")
    (tmp_path / "sub dir" / "b c.txt").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    docs = corpus.read_documents(spark, str(tmp_path), corpus.empty_files(spark, str(tmp_path)))
    assert texts(docs) == ["", "x", "x y\nx"]
    idf = {r.term: r.idf for r in ts.inverse_document_frequency(docs).collect()}
    assert idf["x"] == 0.0


def test_genres_come_from_the_path(spark, tmp_path):
    for mode, genre in (("written", "blog"), ("spoken", "telephone")):
        (tmp_path / mode / genre).mkdir(parents=True)
        (tmp_path / mode / genre / "f.txt").write_text(genre)
    got = sorted(tuple(r) for r in corpus.read_genres(spark, str(tmp_path)).collect())
    assert got == [("spoken", "telephone", "f.txt", "telephone"), ("written", "blog", "f.txt", "blog")]


def test_headlines(spark, tmp_path):
    (tmp_path / "news.csv").write_text("date,headline\n20200101,man bites dog\n")
    path = str(tmp_path / "news.csv")
    assert texts(corpus.read_headlines(spark, path)) == ["20200101,man bites dog", "date,headline"]
    assert texts(corpus.read_headlines(spark, path, "headline")) == ["man bites dog"]


def test_characters(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes("ab\r\né".encode())
    assert texts(corpus.read_characters(spark, str(tmp_path)), "char") == sorted("ab\né")


def test_vectors_survive_both_forms(spark, tmp_path, docs):
    tf = ts.term_frequency(docs)
    want = sorted((r.term, float(r.tf)) for r in tf.collect())
    for form in ("parquet", "text"):
        path = str(tmp_path / form)
        sinks.write_vector(tf, "tf", path, form)
        assert sorted(tuple(r) for r in corpus.read_vector(spark, path, form).collect()) == want


def test_pair_lines_are_parsed_not_evaluated(spark):
    rows = [
        ("('cat', 3)", "cat", 3.0),
        ("('cat', np.float64(0.25))", "cat", 0.25),
        ('("it\'s", -1.5e-3)', "it's", -0.0015),
        ("('a, b', 2)", "a, b", 2.0),
        ("not a pair", None, None),
        ("('x', __import__('os'))", None, None),
        ("('x', y)", "x", None),
    ]
    frame = spark.createDataFrame([(r[0],) for r in rows], "text string")
    got = [tuple(r) for r in corpus.parse_pairs(frame).collect()]
    assert got == [r[1:] for r in rows]


def test_writers(spark, tmp_path, docs):
    def read(name):
        return [line for f in sorted((tmp_path / name).glob("part*")) for line in f.read_text().splitlines()]

    top = ts.top_terms(ts.term_frequency(docs), "tf", 3)
    sinks.write_top(top, "tf", str(tmp_path / "top"))
    assert read("top") == ["('cat', 3)", "('a', 2)", "('the', 2)"]
    similarity = spark.createDataFrame([(0.5,)], "similarity double")
    sinks.write_similarity(similarity, "a", "b", str(tmp_path / "sim"))
    assert read("sim") == ["a\tb\t0.5"]
    sinks.write_lines(docs.where("doc_id = 2"), str(tmp_path / "lines"))
    assert read("lines") == ["A dog, a cat."]
    paths = spark.createDataFrame([(7, [str(i) for i in range(5)])], "path_id long, words array<string>")
    sinks.write_generated_words(paths, str(tmp_path / "words"), per_line=2)
    assert read("words") == ["0 1", "2 3", "4"]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lex.csv").write_text("term,valence,polarity\nbad,-2,-0.5\ngood,2,0.5\n")
    table = corpus.read_lexicon(spark, str(tmp_path / "lex.csv"))
    assert Lexicon.from_table(table).ratings("valence") == LEX.ratings("valence")


def test_stream_filters_like_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a bad day\na good day\nnothing\n")
    stream = filter_lines(spark, str(tmp_path / "in"), -1.0, -0.1, lexicon=LEX)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    assert texts(spark.read.parquet(str(tmp_path / "out"))) == ["a bad day"]


def test_spread_on_a_local_master(docs):
    assert corpus.spread(docs.coalesce(1)).rdd.getNumPartitions() == 16
