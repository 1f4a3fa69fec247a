"""Worked examples and invariants of operators that SQL can't say."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions.embedding import hash_embedder
from corvane.operators import budget, chunking, graph, normalize, store, triples
from corvane.operators import vector_search as vs
from corvane.plans import ingest
from corvane.plans.registry import Registry, retried, status_of
from corvane.shared import byte_slices, kept, running
from corvane.sources import files
from corvane.streaming import ingest as streaming

TEXTS = st.text(alphabet="ab .!?\n", max_size=400)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(2, 30), st.integers(0, 5))
def test_fixed_chunks_cover_within_limit(text, length, overlap):
    pieces = list(chunking.FixedLength(length, min(overlap, length - 1))(text))
    assert all(text[a:b].strip() == t and chunking.tokens(t) <= length for t, a, b in pieces)
    starts = [a for _, a, _ in pieces]
    assert starts == sorted({*starts})
    covered = {i for _, a, b in pieces for i in range(a, b)}
    assert all(i in covered or c.isspace() for i, c in enumerate(text))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 20), st.integers(0, 30))
def test_other_chunkers_end_and_slice(text, size, overlap):
    for chunker in (chunking.CharWindow(size, overlap), chunking.LongText(4 * size, overlap)):
        pieces = list(chunker(text))
        assert all(text[a:b].strip() == t.strip() for t, a, b in pieces)
        assert not text or not text.strip() or pieces[-1][2] == len(text) or not text[pieces[-1][2] :].strip()


def test_chunker_arguments():
    with pytest.raises(ValueError):
        chunking.FixedLength(10, 10)


def test_sentence_pack_overlaps():
    text = " ".join(f"Sentence number {i} here." for i in range(30))
    pieces = list(chunking.SentencePack(30, 1)(text))
    assert len(pieces) > 3
    assert all(sum(chunking.tokens(x[0]) for x in chunking.sentence_spans(t)) <= 30 for t, _, _ in pieces)
    assert pieces[1][0].split(".")[0] in pieces[0][0]


def test_semantic_splits_by_vectors():
    vectors = {"Aa aa aa.": [1, 0], "Aa bb aa.": [1, 0], "Zz zz zz.": [0, 1]}
    c = chunking.Semantic(lambda s: [vectors[x] for x in s], 0.5, 100, 1)
    assert [t for t, _, _ in c("Aa aa aa. Aa bb aa. Zz zz zz.")] == ["Aa aa aa. Aa bb aa.", "Zz zz zz."]
    assert [t for t, _, _ in chunking.Semantic(lambda s: [[1]] * len(s), 0.5, 100, 50)("Short. Too.")] == []


def test_segments_as_of(spark):
    seg = spark.createDataFrame([(1, 0, "First segment of text."), (1, 1, "Second segment here.")], "id int, turn int, text string")
    s = chunking.segments_of(seg, id_col="id", order="turn", text_col="text")
    assert [r.pos for r in s.orderBy("turn").collect()] == [0, 23]
    c = spark.createDataFrame([(1, 0, 0, 20), (1, 1, 20, 43)], "id int, chunk_no int, start_idx int, end_idx int")
    assert [(r.start_time, r.end_time) for r in chunking.with_times(c, s, id_col="id").orderBy("chunk_no").collect()] == [(0.0, 5.0), (0.0, 10.0)]


def test_upsert_overwrites_given_columns(spark):
    t = spark.createDataFrame([("v1", "c", "old"), ("v2", "d", "x")], "id string, channel string, title string")
    out = store.upsert(t, spark.createDataFrame([("v1", "new", 1), ("v3", "add", 2)], "id string, title string, junk int"), "id")
    assert sorted(map(tuple, out.collect())) == [("v1", "c", "new"), ("v2", "d", "x"), ("v3", None, "add")]
    with pytest.raises(ValueError):
        store.upsert(t, t.drop("id"), "id")


def test_until_known(spark):
    s = spark.createDataFrame([(0, "v1"), (1, "v2")], "pos int, id string")
    assert store.until_known(s, s.filter("id = 'v1'"), "id", "pos").count() == 0
    assert store.until_known(s, s.filter("id = 'v2'"), "id", "pos").count() == 1
    assert store.until_known(s, s.limit(0), "id", "pos").count() == 2


def test_normalize_minimal_record(spark):
    x = spark.createDataFrame([('{"id": "a", "snippet": {"title": "t"}}',), ('{"id": "b", "snippet": {"title": "My #shorts"}, "contentDetails": {"duration": "PT5M30S"}, "statistics": {"viewCount": "1000"}}',)], "j string")
    a, b = normalize.normalized(normalize.parsed(x, "j")).orderBy("video_id").collect()
    assert (a.description, a.duration_seconds, a.view_count, a.tags, a.is_short) == ("", None, 0, [], False)
    assert (b.duration_seconds, b.view_count, b.is_short) == (330, 1000, True)


def test_components_of_a_chain(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002)], "src int, dst int")
    from corvane.shared import kept as keep

    found = {r.node: r.component for r in graph.connected_components(e, keep("t")).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_page_rank_sums_to_one(spark):
    from corvane.shared import kept as keep

    t = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("d", "r", "c")], "subject string, predicate string, object string")
    ranks = {r.node: r["rank"] for r in graph.page_rank(t, keep("t"), rounds=30).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6
    assert max(ranks, key=ranks.get) == "c"
    best = graph.top_subgraph(t, graph.page_rank(t, keep("t"), rounds=3), top=2)
    assert [tuple(r) for r in best.select("subject", "object").collect()] == [("b", "c")]


def test_windows_fit_and_overlap(spark):
    x = spark.createDataFrame([("g", i, 30) for i in range(10)] + [("h", 0, 500)], "by string, ord int, tok int")
    rows = budget.windows(x, by="by", order="ord", tokens="tok", window=100, overlap=30).collect()
    by = {}
    for r in rows:
        by.setdefault((r.by, r.window_no), []).append(r.ord)
    assert by[("g", 0)] == [0, 1, 2] and by[("g", 1)] == [2, 3, 4] and by[("h", 0)] == [0]
    assert {o for (g, _), v in by.items() if g == "g" for o in v} == set(range(10))


def test_vectors_filters_and_ties(spark):
    e = spark.createDataFrame([(f"c{i}", [i + 1.0, 0.0, 0.0], ["sports", "news", None][i]) for i in range(3)], "vec_id string, embedding array<float>, category string")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id int, query_vector array<float>")
    assert [r.vec_id for r in vs.top_k(q, e, k=2).orderBy("rank").collect()] == ["c0", "c1"]
    assert vs.top_k(q, e, filters={"category": "sports"}).count() == 1
    assert vs.top_k(q, e, filters={"category": "none"}).count() == 0
    assert vs.top_k(q, e, filters={"missing": {"$gte": 1}}).count() == 0
    assert vs.top_k(q, e.limit(0)).count() == 0
    assert vs.delete(e, ["c1"], "vec_id").count() == 2


def test_cells_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    c = vs.centroids_of(e, 16)
    exact = {tuple(r) for r in vs.top_k(q, e).select("query_id", "vec_id").collect()}
    near = {tuple(r) for r in vs.top_k_cells(q, vs.cells(e, c), c, probes=12).select("query_id", "vec_id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_ingest_and_retrieve(spark):
    docs = spark.createDataFrame([("doc1", "hello world", "greet"), ("doc2", "foo bar", "other"), ("doc3", "", "none")], "id string, text string, category string")
    embed = hash_embedder(16)
    store_ = ingest.ingest(docs, chunking.FixedLength(16, 2), embed, id_col="id", text_col="text", metadata=["category"])
    assert [tuple(r) for r in ingest.ingest_stats(docs, store_, text_col="text").collect()] == [(2, 2, 2)]
    assert ingest.retrieve(spark, store_, ["hello world"], embed, k=1).first().chunk_id == "doc1_0"


def test_near_duplicate_triples(spark):
    t = spark.createDataFrame([(0, "Ada", "works at", "Lab"), (1, "ada", "works at", "lab"), (2, "Bob", "works at", "Lab")], "pos long, subject string, predicate string, object string")
    v = spark.createDataFrame([("ada", [1.0, 0.0]), ("bob", [0.0, 1.0])], "term string, vector array<double>")
    assert sorted(r.pos for r in triples.near_duplicates_dropped(t, v, kept("t")).collect()) == [0, 2]


def test_extractor_failures_give_nothing(spark):
    def broken(text):
        if text == "bad":
            raise RuntimeError
        return [("a", "b", "c")]

    x = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, text string")
    assert [r.id for r in triples.extract(x, broken).collect()] == ["1"]


def test_files_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", "p", "b"), ("", "p", "c")], "subject string, predicate string, object string")
    (tmp_path / "kg.json").write_text('{"triples": [{"subject": "a", "predicate": "p", "object": "b"}, {"subject": "", "predicate": "p", "object": "c"}]}')
    assert [tuple(r)[1:] for r in files.read_triples(spark, str(tmp_path / "kg.json")).collect()] == [(0, "a", "p", "b")]
    nodes = graph.nodes_of(t)
    files.write_graph_csv(t, nodes, str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g/edges")).columns == ["source", "target", "relation"]
    (tmp_path / "t.txt").write_text("# title: x\nhello\n")
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path)).filter("file = 't.txt'").collect()] == [("t.txt", "hello\n")]
    files.write_triples(t, str(tmp_path / "out"))
    files.save_store(t, str(tmp_path / "store"))
    assert files.load_store(spark, str(tmp_path / "store")).count() == 2
    assert files.read_dataset(spark, str(tmp_path / "kg.json")).first().triple_count == 2
    t.createOrReplaceTempView("some_triples")
    assert ("some_triples", False) in [tuple(r) for r in files.sources(spark).collect()]
    assert files.datasets(spark, str(tmp_path / "kg.json")).first().length > 0
    assert files.node_link(t, nodes).count() == 6
    assert files.graphml_lines(t, nodes).filter("value like '<edge%'").count() == 2


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(20).select(F.col("id"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text")).repartition(3).write.parquet(src)
    stream = streaming.stream_table(spark, src, "id long, text string", files=1)
    q = streaming.ingest_stream(stream, lambda b: b.withColumn("n", F.length("text")), str(tmp_path / "out"), str(tmp_path / "cp"), error_path=str(tmp_path / "err"), valid="text is not null")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 16
    assert spark.read.parquet(str(tmp_path / "err")).count() == 4


def test_streaming_upsert(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string").coalesce(1).write.parquet(src)
    sink = streaming.upsert_sink(spark, str(tmp_path / "t"), "k", "t")
    sink(spark.read.parquet(src), 0)
    more = spark.createDataFrame([(1, 2, "c")], "k int, t int, v string")
    sink(more, 1)
    sink(more, 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t/version=1")).collect()) == [(1, "c"), (2, "b")]


def test_registry_and_retry():
    r = Registry()
    with pytest.raises(ValueError):
        r.register("chunker", "fixed", chunking.FixedLength)
    with pytest.raises(ValueError):
        r.create("chunker", "none")
    assert r.create("chunker", "fixed", length_tokens=8, overlap_tokens=1).length_tokens == 8
    r.clear("chunker")
    assert "chunker" not in r.info()
    r.clear()
    assert "fixed" in r.names("chunker")
    calls = []
    with pytest.raises(OSError):
        retried(lambda: calls.append(1) or (_ for _ in ()).throw(OSError()), retries=2, sleep=lambda _: None)
    assert len(calls) == 3
    assert status_of(KeyError()) == 404 and status_of(RuntimeError()) == 500


def test_config():
    from corvane.plans.config import ExtractionConfig

    assert ExtractionConfig.of({"primary_limit": 5}).describe()["primary_limit"] == 5
    with pytest.raises(ValueError):
        ExtractionConfig.of({"nothing": 1})


def test_running_totals(spark):
    """Totals of groups that span ranges, with a third of all rows in one, nulls as a group of their own."""
    import random
    from collections import defaultdict

    r = random.Random(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"g{r.randrange(20)}", i, r.randrange(50)) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = {x.i: (x.n, x.s) for x in running(running(d, kept("n"), by=["g"], order=["i"], into="n"), kept("s"), by=["g"], order=["i"], value="v", into="s").collect()}
    n, s = defaultdict(int), defaultdict(int)
    for g, i, v in rows:
        n[g] += 1
        s[g] += v
        assert got[i] == (n[g], s[g])


def test_byte_slices_keep_all_rows():
    import pandas as pd

    b = pd.DataFrame({"i": range(50), "t": ["x" * (i * 7 % 90) for i in range(49)] + [None]})
    parts = list(byte_slices(iter([b, b.iloc[:0]]), "t", 100))
    assert pd.concat(parts)["i"].tolist() == list(range(50)) and all(p["t"].str.len().sum() <= 100 or len(p) == 1 for p in parts)


def test_near_duplicate_triples_against_a_fold(spark):
    """The fold by position over all triples, as it is defined."""
    import numpy as np

    r = np.random.default_rng(3)
    terms = [f"t{i}" for i in range(30)] + [f"r{i}" for i in range(4)]
    vec = {t: r.normal(size=3) for t in terms[:-1]}
    rows = [(i // 2, terms[r.integers(30)].upper() if i % 5 == 0 else terms[r.integers(30)], terms[30 + r.integers(4)], terms[r.integers(30)]) for i in range(250)]
    like = lambda a, b, least: a == b or (a in vec and b in vec and vec[a] @ vec[b] > least * np.linalg.norm(vec[a]) * np.linalg.norm(vec[b]))
    kept_rows = []
    for x in sorted(rows, key=lambda x: (x[0], *(c.lower() for c in x[1:]))):
        a = [c.lower() for c in x[1:]]
        if not any(like(a[0], b[0], 0.8) and like(a[1], b[1], 0.7) and like(a[2], b[2], 0.8) for b in kept_rows):
            kept_rows.append(a)
    t = spark.createDataFrame(rows, "pos int, subject string, predicate string, object string")
    v = spark.createDataFrame([(k, x.tolist()) for k, x in vec.items()], "term string, vector array<double>")
    got = triples.near_duplicates_dropped(t, v, kept("near")).collect()
    assert sorted([c.lower() for c in (x.subject, x.predicate, x.object)] for x in got) == sorted(kept_rows)


def test_communities_of_a_two_sided_graph(spark):
    """Labels stay within connected parts, and the labelling chosen is no worse than leaving every node alone."""
    rows = [(f"{g}a{i}", "r", f"{g}b{j}") for g in "xy" for i in range(4) for j in range(4)]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    found = graph.communities(t, kept("c"), rounds=8).cache()
    label = {r.node: r.community for r in found.collect()}
    assert not {label[n] for n in label if n[0] == "x"} & {label[n] for n in label if n[0] == "y"} and len(label) == 16
    alone = found.select("node", F.col("node").alias("community"))
    parts = found.select("node", F.substring("node", 1, 1).alias("community"))
    assert graph.modularity(t, alone).first()[0] < graph.modularity(t, found).first()[0] <= graph.modularity(t, parts).first()[0] == 0.5


def test_page_rank_tolerance(spark):
    t = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("d", "r", "c")], "subject string, predicate string, object string")
    exact = {r.node: r["rank"] for r in graph.page_rank(t, kept("r"), rounds=20, tolerance=0).collect()}
    near = {r.node: r["rank"] for r in graph.page_rank(t, kept("r"), rounds=20, tolerance=1e-5).collect()}
    assert all(abs(exact[n] - near[n]) < 1e-2 for n in exact)


def test_upsert_sink_never_starts_anew(spark, tmp_path):
    sink = streaming.upsert_sink(spark, str(tmp_path / "t"), "k", "t")
    b = lambda k, t: spark.createDataFrame([(k, t, "v")], "k int, t int, v string")
    sink(b(1, 1), 0)
    sink(b(2, 1), 3)  # versions may be missing between
    assert spark.read.parquet(str(tmp_path / "t/version=3")).count() == 2
    with pytest.raises(RuntimeError, match="no version"):
        streaming.upsert_sink(spark, str(tmp_path / "other"), "k", "t")(b(1, 1), 2)


def test_metadata_of_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "aaa bbb", "x"), (1, "ccc", "y"), (None, "ddd", "z")], "id int, text string, m string")
    got = chunking.chunked(d, chunking.Stride(100), id_col="id", text_col="text", metadata=["m"]).collect()
    assert sorted((r.text, r.m) for r in got) == [("aaa bbb", "x"), ("ccc", "y"), ("ddd", "z")]


def test_texts_are_checked():
    for bad in ([], "text", ["a", ""], ["a", None], [" "]):
        with pytest.raises(ValueError):
            chunking.check_texts(bad)
    assert chunking.pieces_of(["abcd", "ef"], chunking.Stride(3)) == ["abc", "d", "ef"]
    assert chunking.ALIASES["semantic_similarity"] is chunking.CharWindow


def test_long_text_is_the_mean_of_its_pieces(spark):
    import numpy as np

    text, embed = " ".join(f"word{i}" for i in range(300)), hash_embedder(8)
    d = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "id int, text string")
    got = {r.id: r for r in ingest.long_text_vectors(d, embed, id_col="id", text_col="text", most_tokens=50).collect()}
    pieces = [t for t, _, _ in chunking.LongText(200)(text)]
    assert got.keys() == {1, 2} and got[1].pieces == len(pieces) > 5 and got[2].pieces == 1
    assert np.allclose(got[1].embedding, np.mean(embed(pieces), axis=0), atol=1e-6)


def test_extractor_waits_longer_each_time(spark):
    waits, calls = [], []

    def broken(text):
        calls.append(text)
        raise OSError

    run = triples.extract(spark.createDataFrame([("1", "x")], "id string, text string"), broken, retries=3, first_wait=0.01)
    assert run.count() == 0
    assert triples.extract_batched(spark.createDataFrame([(str(i), "a b") for i in range(12)], "id string, text string"), lambda ts: [[("s", "p", "o")] for _ in ts], size=5).count() == 12
    assert not waits and not calls  # tasks run elsewhere


def test_parsed_relations(spark):
    d = spark.createDataFrame([("1", "Ada knows Bob in London. New York is a city. I has I")], "id string, text string")
    got = {(r.subject, r.predicate, r.object) for r in triples.parsed_relations(d, triples.simple_patterns(), id_col="id", text_col="text").collect()}
    assert got == {("Ada", "knows", "Bob"), ("York", "is", "city"), ("Bob", "in", "London"), ("New", "part_of", "York")}


def test_routes_and_unknown_channels(spark):
    from corvane.operators import retrieval

    q = spark.createDataFrame([("How are A and B related?",), ("When was the latest?",), ("What is it",)], "q string")
    assert [r[0] for r in q.select(retrieval.route(F.col("q"))).collect()] == ["graph", "temporal", "text"]
    c = normalize.parsed(spark.createDataFrame([('{"id": "UC1", "contentDetails": {"relatedPlaylists": {"uploads": "UU1"}}}',)], "j string"), "j")
    with pytest.raises(LookupError):
        normalize.channel_videos(c, c, c, "@none")


def test_settings_from_yaml(tmp_path):
    from corvane.plans.config import ExtractionConfig, describe

    (tmp_path / "s.yaml").write_text("extraction:\n  retries: 7\n  dropped: [says]\n")
    assert ExtractionConfig.from_yaml(str(tmp_path / "s.yaml")).retries == 7
    assert describe(chunking.FixedLength(10, 2))["length_tokens"] == 10 and describe(hash_embedder(5))["dimension"] == 5


def test_rounds_over_edges_carry_numbers(spark):
    """Nodes are numbered from 1 in the order of their names, and joins on a bucketed column do not shuffle its table again."""
    from corvane.shared import bucketed

    t = spark.createDataFrame([("b", "r", "a"), ("b", "s", "a"), ("é", "r", "b"), ("c", "r", "c")], "subject string, predicate string, object string")
    ids, edges = graph.numbered(t, kept("n"))
    assert sorted(map(tuple, ids.collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "é")]
    assert sorted(map(tuple, edges.collect())) == [(2, 1), (3, 3), (4, 2)]
    dealt = bucketed(edges, "e", "src", 3, each=1)
    joined = dealt.join(ids.hint("merge"), dealt.src == ids.id)
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert joined.count() == 3 and bucketed(edges.limit(0), "none", "src", 0).count() == 0


def test_communities_and_ranks_of_no_or_loose_edges(spark):
    none = spark.createDataFrame([], "subject string, predicate string, object string")
    assert graph.communities(none, kept("c")).count() == graph.page_rank(none, kept("r"), rounds=2).count() == 0
    loop = spark.createDataFrame([("a", "r", "a")], none.schema)
    assert [tuple(r) for r in graph.communities(loop, kept("c")).collect()] == [("a", "a")]
    assert [tuple(r) for r in graph.page_rank(loop, kept("r"), rounds=2).collect()] == [("a", 1.0)]


def test_one_call_ingest_in_bounded_batches(spark, tmp_path):
    """30 MB of texts of one task come to Python a few MB at a time; the store is whole and the setting is put back."""

    def small(batches):
        for b in batches:
            if b.nbytes > 6 << 20:
                raise ValueError(f"a batch of {b.nbytes} bytes")
            yield b

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(3000).coalesce(1).select("id", F.expr("repeat('word ', 2000)").alias("text")).mapInArrow(small, "id long, text string")
    found = ingest.ingest_documents(docs, chunker="window", chunker_options={"max_tokens": 256, "overlap": 16}, embedder_options={"dim": 4}, path=str(tmp_path / "store"))
    pieces = len(list(chunking.CharWindow(256, 16)("word " * 2000)))
    assert found.count() == 3000 * pieces and spark.conf.get(name) == before


def test_ranks_read_each_table_once_for_each_use(spark, tmp_path):
    """Ends come from one scan of the triples; a round scans the edges once and the ranks twice; ranks equal those by hand."""
    rows = [("a", "r", "b"), ("a", "s", "b"), ("b", "r", "c"), ("c", "r", "c"), ("d", "r", "c"), ("d", "r", None), (None, "r", "e"), (None, "r", None)]
    spark.createDataFrame(rows * 2, "subject string, predicate string, object string").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans(graph.nodes_of(t)) == 1
    assert sorted(map(tuple, graph.nodes_of(t).collect()), key=str) == sorted([(x, "INFERRED") for x in (None, *"abcde")], key=str)
    read = []

    def keep(df):
        if "rank" in df.columns:
            read.append(scans(df))
        return kept("r")(df)

    names, edges = [None, *"abcde"], {(s, o) for s, _, o in rows if s and o}
    rank = {x: 1 / len(names) for x in names}
    for _ in range(3):
        loose = sum(v for x, v in rank.items() if not any(s == x for s, _ in edges))
        rank = {x: 0.15 / len(names) + 0.85 * (sum(rank[s] / sum(a == s for a, _ in edges) for s, o in edges if o == x) + loose / len(names)) for x in names}
    got = {r.node: r["rank"] for r in graph.page_rank(t, keep, rounds=3, tolerance=0).collect()}
    assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) < 1e-8 for x in names)
    assert read == [3, 3, 3]
    read.clear()
    graph.page_rank(t, keep, rounds=40, every=2, tolerance=1e-3)
    assert len(read) % 2 == 0 and len(read) < 40
    none = t.limit(0)
    assert graph.page_rank(none, kept("r"), rounds=5).count() == 0


def test_many_small_files_are_listed_and_read_in_few_tasks(spark, tmp_path):
    """100 files of texts: no stage has a task for each folder or for a few files, and the settings are as before."""
    from corvane.queries import QUERIES

    rows = [(i, None if i == 7 else f"http://x/{'y' * i}", "") for i in range(100)] + [(8, "http://x/again", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("texts", "texts")
    try:
        found = QUERIES["text_files_and_totals"](spark, str(tmp_path))
        got = {r.page_id: r.tokens for r in found.collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    text = {i: "" if u is None else f"word {i}\n{u}" for i, u, _ in rows[:100]}
    want = {str(i): len(x) // 4 for i, x in text.items()} | {"8": (len(text[8]) + 1 + len("word 8\nhttp://x/again")) // 4}
    assert got == want | {None: sum(want.values())}
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(k) for job in tracker.getJobIdsForGroup("texts") for k in tracker.getJobInfo(job).stageIds]
    assert len(stages) > 2 and max(x.numTasks for x in stages if x) <= 4
    assert "Coalesce 4" in found._jdf.queryExecution().executedPlan().toString() and spark.conf.get(name) == before
