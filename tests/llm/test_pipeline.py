"""The pipeline's stages on a small corpus with planted cases, against the brute-force versions of its stages."""

import pytest
from pyspark.sql import functions as F
from test_llm_operators import leaks_by_brute_force, lines_by_brute_force, linked, prose, slow_fingerprint

import corpus_pipeline
from seqlake.llm import catalog, common, components, golay_dedup, noisy_toxicity, piece_codec


def corpus(spark, where):
    texts = {i: "\n".join(prose(20, 100 * i + k) for k in range(4)) for i in range(120)}
    for i in range(0, 120, 4):
        texts[i] += f"\n{prose(6, i)} idiot {prose(6, i + 1)}"
    texts[201] = texts[1]  # an exact copy
    texts[202] = texts[2] + "\nshort end"
    item = prose(30, 9999)
    texts[203] = f"{prose(40, 77)}\n{item}\n{prose(40, 78)}"
    for i in (204, 205):
        texts[i] = f"{prose(40, i)}\n{prose(60, 555)}"  # a passage that two documents share
    texts[206] = None
    texts[207] = ""
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return docs, texts, item


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs, texts, item = corpus(spark, tmp_path)
    columns = docs.columns
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        if name != "tokens":
            assert now.columns == columns
        if name == "toxicity":
            clean = {i for i in texts if i >= 200 or i % 4}
            assert set(after) <= clean and len(clean - set(after)) <= 5  # a small sample to learn from
        if name == "line_dedup":
            assert after == lines_by_brute_force(list(before.items()))
            assert after[201] == "" and after[202] == "short end" and prose(60, 555) not in after[205]
        if name == "near_duplicates":
            ids = sorted(before)
            roots = linked([slow_fingerprint(before[i] or "") for i in ids])
            assert set(after) == {min(i for i, r in zip(ids, roots, strict=True) if r == k) for k in set(roots)}
        if name == "decontamination":
            assert set(before) - set(after) == {i for i, _ in leaks_by_brute_force(list(before.items()), [(0, item)])} == {203}
        if name == "tokens":
            assert set(after) == set(before) and all(r["round_trip"] and len(r["ids"]) == 4 * r["n_tokens"] for r in now.collect())
    whole = catalog.queries()["pipeline"](spark, str(tmp_path))
    assert sorted(whole.columns) == sorted(now.columns) and whole.count() == now.count()


def test_little_goes_to_the_driver(spark, tmp_path, monkeypatch):
    """The pipeline's first stages collect neither texts nor a row for each bucket of words."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs, texts, _ = corpus(spark, tmp_path)
    whole = {t for t in texts.values() if t}
    collect, most, seen = DataFrame.collect, [], []

    def counted(df):
        rows = collect(df)
        most.append(len(rows))
        seen.extend(x for r in rows for x in r if isinstance(x, str) and x in whole)
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert most and not seen
    most.clear()
    corpus_pipeline.lines(spark, docs, str(tmp_path))
    assert most and max(most) <= 512


def test_one_worker_a_task(spark, tmp_path, monkeypatch):
    """No task of these stages runs Python twice: each such step would take a worker of its own, and keep it with its models."""
    pytest.importorskip("public_tokenizers")
    docs, _, _ = corpus(spark, tmp_path)
    plans = [corpus_pipeline.tokens(spark, docs, str(tmp_path))]
    really = components.written

    def seen(df):
        plans.append(df)
        return really(df)

    monkeypatch.setattr(components, "written", seen)
    monkeypatch.setattr(golay_dedup, "written", seen)
    corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    tasks = [t for p in plans for t in p._jdf.queryExecution().executedPlan().toString().split("Exchange")]
    assert max(t.count("MapInArrow") for t in tasks) == 1


def test_round_trip_as_encoded_and_decoded(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    model = catalog.tokenizer()
    df = spark.createDataFrame([(1, "plain words here"), (2, None), (3, ""), (4, "  two  blanks \n"), (5, "\u2581mark \U0001f600 \t")], "doc_id long, text string")
    two = {r["doc_id"]: r for r in piece_codec.decode_documents(piece_codec.encode_documents(df, model), model).collect()}
    for r in piece_codec.round_trip(df, model).collect():
        other = two[r["doc_id"]]
        assert (r["text"], r["n_tokens"], r["ids"]) == (other["text"], other["n_tokens"], other["ids"])
        assert r["round_trip"] == (other["decoded"] == (r["text"] or ""))


def test_workers_keep_one_operators_models(spark, tmp_path):
    """A worker that a stage has left gives up its models once another operator works there, and its caches at once."""
    pytest.importorskip("public_tokenizers")
    codecs, made = dict(piece_codec._codecs), dict(noisy_toxicity._made)
    try:
        piece_codec.codec_of(catalog.tokenizer())
        assert piece_codec._codecs

        class Parts:
            value = ({"^^a": 1}, {}, [0.0, 1.0, 1.0, 1.0])

        own = noisy_toxicity._model_of("t", Parts)
        assert not piece_codec._codecs and list(noisy_toxicity._made) == ["t"]
        own.score("some w0rds")
        noisy_toxicity._forget("t")
        assert not own.kept and not own.model.kept and not own.model.ways
        golay_dedup.golay()
        assert not noisy_toxicity._made
    finally:
        for held, before in ((piece_codec._codecs, codecs), (noisy_toxicity._made, made)):
            held.clear()
            held.update(before)
        common._last.clear()


def test_caches_are_emptied_at_the_end_of_every_task(spark, tmp_path, monkeypatch):
    """Measuring and scoring forget in the worker's own models, not in a copy of them that came with the function."""
    docs, _, _ = corpus(spark, tmp_path)
    labelled = noisy_toxicity._labelled(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), F.col("doc_id") >= 0).coalesce(1)
    model = noisy_toxicity.CharModel(noisy_toxicity.Counter(["some", "words"]))
    noisy_toxicity._measured(labelled, model, [{"=idiot": 3.0}, {"=idiot": 3.0}])

    def look(batches):
        import pyarrow as pa

        from seqlake.llm import noisy_toxicity as own

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(m.kept) for m in own._made.values())])], names=["n"])

    assert {r["n"] for r in spark.range(200).repartition(40).mapInArrow(look, "n long").collect()} == {0}


def test_lines_stage_counts_all_lines():
    """The pipeline's line dedup takes its counts of tokens from every line, as the operator does."""
    from seqlake.llm import line_dedup

    assert line_dedup.COUNTED is None
